import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import types as T
from tokenizers import Tokenizer

from chronoframe.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("row", T.StringType()), T.StructField("length", T.StringType())])


def test_knapsack_against_all_choices():
    rng = np.random.default_rng(0)
    for _ in range(30):
        size, value = rng.integers(1, 12, 4), rng.random(4)
        slow = max(sum(n * v for n, v in zip(c, value, strict=True)) for c in np.ndindex(21, 21, 21, 21) if sum(n * s for n, s in zip(c, size, strict=True)) <= 20) if _ < 3 else None
        got, taken = packing.knapsack(value, size, 20)
        assert taken @ size <= 20 and np.isclose(taken @ value, got) and (slow is None or np.isclose(got, slow))


def test_patterns_meet_demand_and_beat_first_fit_bound():
    rng = np.random.default_rng(1)
    for top, many in ((4096, 40_000), (300, 7), (5000, 300)):
        counts = np.bincount(np.clip(rng.lognormal(6.4, 0.9, many).astype(int), 1, 4095), minlength=4096)
        made = packing.plan(counts, 4096)
        assert made.sequences >= counts @ np.arange(4096) / 4096
        if many > 10_000:
            assert made.sequences <= 1.01 * counts @ np.arange(4096) / 4096
        assert top


def test_pieces_cover_documents_and_fill_sequences(spark):
    rng = np.random.default_rng(2)
    words = ["the", "packing", "of", "sequences", "1234", "naïve", "日本"]
    rows = [(i, " ".join(rng.choice(words, int(rng.integers(0, 60)))), "a", "b") for i in range(150)]
    rows += [(500, "word " * 700, "", ""), (501, None, "", ""), (502, "", "", ""), (None, "same", "", ""), (3, "again", "", ""), (3, "again", "", "")]
    got = packing.pack(spark.createDataFrame(rows, DOCS), PATH, 2, capacity=64).collect()
    library = Tokenizer.from_file(PATH)
    slow = {}
    for doc_id, text, *_ in rows:
        slow.setdefault(doc_id, []).append([*library.encode(text or "", add_special_tokens=False).ids, 2])
    docs = {}
    for r in got:
        docs.setdefault((r["doc_id"], r["row"]), []).append(r)
    assert len(docs) == len(rows)
    for (doc_id, _), pieces in docs.items():
        pieces.sort(key=lambda r: r["start"])
        assert [r["start"] for r in pieces] == np.cumsum([0, *(r["length"] for r in pieces)]).tolist()[:-1]
        ids = next(x for x in slow[doc_id] if len(x) == pieces[0]["doc_tokens"])
        assert sum(r["length"] for r in pieces) == len(ids)
        for r in pieces:
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], dtype="<u4").tobytes())
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in sequences.values():
        own.sort()
        assert [o for o, _ in own] == np.cumsum([0, *(n for _, n in own)]).tolist()[:-1] and sum(n for _, n in own) <= 64
    assert len(sequences) <= 1.1 * sum(r["length"] for r in got) / 64 + 1


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], DOCS), PATH, 2).collect() == []
