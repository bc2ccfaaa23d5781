import numpy as np
import pytest
from pyspark.sql import types as T

from chronoframe.llm import hamming

CODES = "id long, code long"


def slow(rows, queries, k):
    out = []
    for qid, q in set(queries):
        near = sorted((((q ^ c) & (2**64 - 1)).bit_count(), i) for i, c in set(rows) if i != qid)
        out += [(qid, i, d, n + 1) for n, (d, i) in enumerate(near[:k])]
    return sorted(out)


def run(spark, rows, queries, k):
    return sorted(tuple(r) for r in hamming.top_k(spark.createDataFrame(rows, CODES), spark.createDataFrame(queries, CODES), k).collect())


@pytest.mark.parametrize("m", [2, 5])
def test_against_all_pairs(spark, monkeypatch, m):
    monkeypatch.setattr(hamming, "segment_count", lambda n: m)
    rng = np.random.default_rng(m)
    base = rng.integers(-(2**63), 2**63, 30)
    codes = [int(b) ^ (1 << int(rng.integers(0, 63))) for b in base for _ in range(6)] + [int(base[0])] * 40
    rows = list(enumerate(codes))
    if m == 2:  # wide segments: keep the balls small
        rows = [(i, c % 2**20 * 2**22) for i, c in rows]
    queries = [r for r in rows if r[0] % 20 == 0]
    assert run(spark, rows, queries, 5) == slow(rows, queries, 5)


def test_ties_repeats_few_rows(spark):
    rows = [(i, 7) for i in range(30)] + [(3, 7), (50, 6), (51, 5)]
    assert run(spark, rows, [(2, 7), (2, 7), (99, 0)], 4) == slow(rows, [(2, 7), (99, 0)], 4)
    assert run(spark, rows[:3], [(0, 7)], 10) == slow(rows[:3], [(0, 7)], 10)
    assert run(spark, [], [(0, 7)], 10) == [] == run(spark, rows, [], 10)


def test_sign_codes(spark):
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("code", T.StringType())])
    numbers = np.random.default_rng(0).normal(size=64).astype(float).tolist()
    rows = [(1, numbers, ""), (2, None, ""), (3, [1.0, None, 2.0], ""), (None, numbers, ""), (4, [-1.0] * 63 + [1.0], "")]
    got = {r["id"]: r["code"] & (2**64 - 1) for r in hamming.sign_codes(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: sum(1 << i for i, x in enumerate(numbers) if x > 0), 2: 0, 3: 5, 4: 1 << 63}


def test_outlying_queries_are_held_against_all_codes(spark, monkeypatch):
    monkeypatch.setattr(hamming, "segment_count", lambda n: 2)
    monkeypatch.setattr(hamming, "SHELL", 40)  # radius 2 of 32 bits has 496 values
    monkeypatch.setattr(hamming, "SCANNED", 16)
    rng = np.random.default_rng(7)
    rows = [(i, int(c)) for i, c in enumerate(rng.integers(-(2**63), 2**63, 120))] + [(200 + i, 5) for i in range(20)] + [(300 + i, 5 ^ (1 << i)) for i in range(6)]
    queries = [r for r in rows if r[0] % 10 == 0] + [(999, -1)]
    assert run(spark, rows, queries, 6) == slow(rows, queries, 6)


def test_long_vectors_and_odd_numbers(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=n).tolist()) for i, n in enumerate((64, 65, 128, 200, 1))] + [(9, [float("nan"), 1.0] + [0.0] * 70), (10, [])]
    got = {r["id"]: r["code"] & (2**64 - 1) for r in hamming.sign_codes(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    for i, numbers in rows:
        numbers = [0.0 if x != x else x for x in numbers]
        assert got[i] == sum(1 << b for b in range(64) if sum(numbers[b::64]) > 0)
    same = spark.createDataFrame([(i, [1.0] * (i % 3)) for i in range(300)] + [(100, [-1.0, 1.0]), (None, [1.0])], "vec_id long, embedding array<double>")
    found = hamming.search_every(same, k=2).collect()
    assert {r["query_id"] for r in found} == {0, 100, 200} and all(r["rank"] <= 2 for r in found)
    assert hamming.search_every(same.where("false")).collect() == []
