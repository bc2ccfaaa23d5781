import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T
from tokenizers import Tokenizer

from chronoframe.llm import simple8b, tokenfiles, tokens

ODD = ["", "it's they'll WE'RE x'y 's ''s !'s", "a  b\n\n c \t", "<|endoftext|> hi <|startoftext|>", "naïve ÀÉ ß µ ª º ²³ ¼", "Σας ΟΔΟΣ", "é x y\u0085z", "日本語 テキスト", "a\x1cb\x00c",
       "İstanbul ſecret K", "12 345 6a7b", "   ", "don't\nstop", "a" * 3000, "\U0001f600 emoji", "soft\xadhyphen", "x <| y |> <|", "   lead\ttrail   \n", "é café ́x", "a\xa0b"]
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("file", T.StringType()), T.StructField("place", T.StringType())])


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_as_the_library(name):
    own = tokens.Coder(public_tokenizers.path(name))
    library = Tokenizer.from_file(public_tokenizers.path(name))
    mixed = [" ".join(ODD[i:]) for i in range(0, len(ODD), 3)]
    for _ in range(2):  # new words, then remembered ones
        for text, raw in zip(ODD + mixed, own.encode(ODD + mixed), strict=True):
            assert own.ids(raw).tolist() == library.encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60000), st.integers(0, 2**64 - 1)), max_size=300))
def test_simple8b_round_trip(ids):
    ids = np.array(ids, dtype=np.uint64)
    words, offsets = simple8b.encode(ids)
    assert simple8b.decode(words).tolist() == ids.tolist() and len(offsets) == (len(ids) > 0)


def test_simple8b_blocks_and_escapes_that_look_like_escapes():
    rng = np.random.default_rng(3)
    ids = rng.integers(0, 50000, 5000).astype(np.uint64)
    ids[[7, 8, 2000]] = [0xE000000000000001, 0xEFFFFFFFFFFFFFFF, 1 << 60]
    words, offsets = simple8b.encode(ids)
    blocks = [simple8b.decode_block(words, offsets, i) for i in range(len(offsets))]
    assert [len(b) for b in blocks] == [1024] * 4 + [904] and np.concatenate(blocks).tolist() == ids.tolist()
    assert len(simple8b.encode(np.zeros(120, dtype=np.uint64))[0]) == 2


def test_files_against_plain_encoding(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(i * 7 % 50, t, "", "") for i, t in enumerate([*ODD, *(f"text {i} " * i for i in range(30))])]
    rows += [(3, "again", None, None), (3, "again", None, None), (51, None, "", "")]
    got = [tuple(r) for r in tokenfiles.round_trip(spark.createDataFrame(rows, DOCS), path, 2).orderBy("start").collect()]
    library, start, slow = Tokenizer.from_file(path), 0, []
    for doc_id, text in sorted((r[0], (r[1] or "").encode()) for r in rows):
        ids = [*library.encode(text.decode(), add_special_tokens=False).ids, 2]
        slow.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    assert got == slow


def test_empty_table_and_null_id(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert tokenfiles.round_trip(spark.createDataFrame([], DOCS), path, 2).collect() == []
    assert tokenfiles.round_trip(spark.createDataFrame([(5, "b", "", ""), (None, None, "", "")], DOCS), path, 2).orderBy("start").collect()[0][:3] == (None, 0, 1)
