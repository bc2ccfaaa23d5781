import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from chronoframe.llm import chunking, media
from chronoframe.llm.common import Workspace

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("row", T.StringType()), T.StructField("key", T.StringType())])


def slow_marks(data, bits):
    out, h = [], 0
    for i, b in enumerate(data):
        h = ((h << 1) + int(chunking.GEAR[b])) & 0xFFFFFFFF
        if h >> (32 - bits) == 0:
            out.append(i + 1)
    return out


def test_marks_as_rolled_byte_by_byte():
    data = np.random.default_rng(0).integers(0, 256, 20000, dtype=np.uint8)
    found = chunking.cut_marks(data, 6)
    assert [m for m in found.tolist() if m >= 32] == [m for m in slow_marks(data, 6) if m >= 32]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=900), max_size=6), st.booleans())
def test_chunks_are_the_payload(parts, text):
    chunker = chunking.Chunker(5, 32, 100, text)
    payloads = [p.encode() * (i + 1) for i, p in enumerate(parts)]
    for p, chunks in zip(payloads, chunker.split(payloads), strict=True):
        assert b"".join(chunks) == p and all(len(c) <= 103 for c in chunks)
        if text:
            assert all(c.decode().encode() == c for c in chunks)


def test_equal_passages_are_cut_alike():
    rng = np.random.default_rng(1)
    passage = rng.bytes(20000)
    a, b = chunking.Chunker(8, 64, 4096).split([rng.bytes(777) + passage, rng.bytes(5000) + passage])
    assert len(set(a) & set(b)) > 0.8 * len(a)


def rows_of(rng):
    words = [f"word{i}" for i in range(500)]
    passage = " ".join(rng.choice(words, 900))
    rows = [(i, " ".join(rng.choice(words, int(rng.integers(1, 700)))), "", "") for i in range(40)]
    rows += [(100 + i, f"lead {i} " * int(i + 1) + passage + f" tail {i}", "x", "y") for i in range(20)]
    return [*rows, (200, passage, "", ""), (201, passage, "", ""), (202, passage, "", ""), (203, "", "", ""), (204, None, "", ""), (None, "null id", "", ""), (7, "again é𝄞", "", ""), (7, "again é𝄞", "", ""), (300, "a" * 50000, "", "")]


def test_round_trip_against_plain(spark):
    rows = rows_of(np.random.default_rng(2))
    got = media.round_trip(spark.createDataFrame(rows, DOCS).repartition(3)).collect()
    slow = []
    for doc_id, text, *_ in rows:
        raw = (text or "").encode()
        padded = raw + b"\xff" * (576 * max(1, -(-len(raw) // 576)) - len(raw))
        slow.append((doc_id, len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:]), media.feature(np.frombuffer(padded, dtype=np.uint8))))
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted(((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"], r["feature"]) for r in got), key=key) == sorted(slow, key=key)
    assert len({(r["payload_sha256"], r["media_sha256"], r["media_bytes"], r["feature"]) for r in got}) == len({r["payload_sha256"] for r in got})


def test_each_repeated_chunk_is_stored_once_and_damage_is_seen(spark):
    rows = rows_of(np.random.default_rng(3))
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    space = Workspace(spark, "media-test")
    lists, chunks = media.store(docs, space, chunking.Chunker(8, 64, 4096))
    assert chunks.count() == chunks.select("digest").distinct().count() > 0
    bodies = chunks.selectExpr("sum(length(body)) n").first()["n"] + lists.selectExpr("sum(length(own)) n").first()["n"]
    assert bodies < 0.75 * sum(len(media.payload(t or "")) for _, t, *_ in rows)
    broken = chunks.selectExpr("digest", "concat(body, X'00') as body")
    with pytest.raises(Exception, match="not what its list says"):
        media.load(lists, broken, Workspace(spark, "media-test"))


def test_empty_table(spark):
    assert media.round_trip(spark.createDataFrame([], DOCS)).collect() == []
