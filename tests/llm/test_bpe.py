import hashlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import types as T
from tokenizers import Tokenizer

from chronoframe.llm import bpe
from chronoframe.llm.chunking import Chunker

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("ids", T.StringType()), T.StructField("own", T.StringType())])
NAMES = ["word_bpe_49k.json", "byte_bpe_50k.json"]


def corpus():
    rng = np.random.default_rng(4)
    words = ["the", "Naïve", "it's", "é́x", "日本語", "123", "<|endoftext|>", "**##", "straße", "\n", "don't  ", "\t", "\U0001f600"] + [f"w{i}or" for i in range(60)]
    passage = " ".join(rng.choice(words, 400))
    rows = [(i, " ".join(rng.choice(words, int(rng.integers(0, 300)))), "", "") for i in range(30)]
    rows += [(50 + i, f"x{i}" * i + passage + f"y{i} z" * i, "", "") for i in range(12)]
    rows += [(80 + i, passage, "", "") for i in range(3)] + [(90, "", "", ""), (91, None, "", ""), (92, "nospace" * 400, "", ""), (93, "日本" * 900, "", ""), (None, "null id", "", ""), (5, passage, "k", "l")]
    return rows


@pytest.mark.parametrize("name", NAMES)
def test_parts_join_to_the_librarys_ids(name):
    path = public_tokenizers.path(name)
    library = Tokenizer.from_file(path)
    chunker = Chunker(4, 32, 64, text=True)
    split = [[c.decode() for c in chunks] for chunks in chunker.split([(t or "").encode() for _, t, *_ in corpus()])]
    got = bpe.join_parts(path, [bpe.encode_parts(path, chunks) for chunks in split])
    for raw, (_, text, *_) in zip(got, corpus(), strict=True):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert bpe.coder(path).ids(raw).tolist() == ids
        assert bpe.decode(path, raw) == library.decode(ids, skip_special_tokens=False)


def test_documents_against_the_library(spark):
    path = public_tokenizers.path(NAMES[0])
    library = Tokenizer.from_file(path)
    docs = spark.createDataFrame(corpus(), DOCS).repartition(3)
    slow = []
    for doc_id, text, *_ in corpus():
        ids = library.encode(text or "", add_special_tokens=False).ids
        slow.append((doc_id or -1, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    got = [(r[0] or -1, *r[1:]) for r in bpe.token_digests(docs, path, average_bits=5, least=64, most=512).collect()]
    assert sorted(got) == sorted((a if a else -1, *b) for a, *b in slow)
    ids = {r["doc_id"]: r["ids"] for r in bpe.token_ids(docs, path, average_bits=5, least=64, most=512).collect()}
    assert ids[50] == library.encode(corpus()[30][1], add_special_tokens=False).ids


def test_empty_table(spark):
    assert bpe.token_digests(spark.createDataFrame([], DOCS), public_tokenizers.path(NAMES[0])).collect() == []
