import random

from chronoframe.operators import folds
from chronoframe.operators import intervals as iv


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_concatenated_intervals_are_split_at_sources(spark):
    sources = spark.createDataFrame([(1, s, 10.0) for s in range(3)], "k int, source int, duration double")
    asked = spark.createDataFrame([(1, 20.0, 25.0, "a"), (1, 8.0, 13.0, "b")], "k int, a0 double, a1 double, name string")
    got = iv.migrate_intervals(asked, sources, ["k"], "source", 4.0)
    assert rows(got, "name", "source", "start", "duration") == [("a", 2, 0.0, 5.0), ("b", 0, 8.0, 2.0), ("b", 1, 0.0, 3.0)]


def test_overlap_and_union(spark):
    pieces = spark.createDataFrame([(1, 7, 3.0, 7.0)], "k int, p int, a0 double, a1 double")
    used = spark.createDataFrame([(1, 1.0, 5.0)], "k int, b0 double, b1 double")
    assert rows(iv.overlap(pieces, used, ["k"], ["p"], 2.0), "taken") == [(2.0,)]
    both = spark.createDataFrame([(1, 3.0, 7.0), (1, 1.0, 5.0), (1, 9.0, 9.5), (2, 0.0, 1.0), (2, 1.0, 2.0)], "k int, s double, e double")
    assert rows(iv.coverage_union(both, ["k"], "s", "e"), "k", "s", "e", "merged") == [(1, 1.0, 7.0, 2), (1, 9.0, 9.5, 1), (2, 0.0, 2.0, 2)]


def test_boundaries_become_ranges(spark):
    points = spark.createDataFrame([(1, float(t), 60.0) for t in (0, 10, 20, 30, 40, 60)] + [(2, 5.0, 8.0)], "k int, t double, d double")
    got = rows(iv.scene_ranges(points, ["k"], "t", "d"), "k", "start", "end")
    assert got == [(1, 0.0, 10.0), (1, 10.0, 20.0), (1, 20.0, 30.0), (1, 30.0, 40.0), (1, 40.0, 60.0), (2, 0.0, 8.0)]


def test_pairs_and_odd_counts(spark):
    flat = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate([0, 2, 5, 4, 7])], "k int, i int, v double")
    assert rows(iv.pair_intervals(flat, ["k"], ["i"], "v"), "pair", "valid") == [(0, True), (1, False), (2, False)]


def test_first_gap(spark):
    fragments = spark.createDataFrame([(1, 0, 0.0, 2.0), (1, 1, 5.0, 9.0), (2, 0, 0.0, 1.0), (3, 0, 0.0, 1.0)], "k int, i int, a0 double, a1 double")
    used = spark.createDataFrame([(1, 0.0, 2.0), (1, 5.03, 6.0), (1, 7.0, 8.0), (2, 0.0, 0.97)], "k int, b0 double, b1 double")
    assert rows(iv.first_unused(fragments, used, ["k"], "i"), "k", "offset") == [(1, 3.0), (3, 0.0)]


def test_as_of_joins(spark):
    points = spark.createDataFrame([(1, 1.0), (1, 2.0), (1, 3.5), (2, 1.0)], "k int, t double")
    marks = spark.createDataFrame([(1, 2.0, 20), (1, 3.0, 30)], "k int, t double, v int")
    assert [(r["k"], r["t"], r["v"]) for r in iv.backward(points, marks, ["k"], "t", ["v"]).orderBy("k", "t").collect()] == [(1, 1.0, None), (1, 2.0, 20), (1, 3.5, 30), (2, 1.0, None)]
    assert [r["v"] for r in iv.backward(points, marks, ["k"], "t", ["v"], strict=True).orderBy("k", "t").collect()] == [None, None, 30, None]
    assert [r["v"] for r in iv.forward(points, marks, ["k"], "t", ["v"]).orderBy("k", "t").collect()] == [20, 20, None, None]


def test_gaps_count_from_the_last_row_kept(spark):
    times = spark.createDataFrame([(k, float(t)) for k in (1, 2) for t in (0, 4, 9, 10, 14, 20, 29, 30)], "k int, t double").repartition(3)
    assert rows(folds.min_gap(times, ["k"], "t", 10.0), "k", "t") == [(k, t) for k in (1, 2) for t in (0.0, 10.0, 20.0, 30.0)]
    assert rows(folds.min_gap(times, ["k"], "t", 10.0, start=0.0), "t")[0] == (10.0,)


def test_joins_of_intervals_have_no_nested_loop(spark):
    a = spark.createDataFrame([(1, 0.0, 5.0)], "k int, a0 double, a1 double")
    b = spark.createDataFrame([(1, 4.0, 6.0)], "k int, b0 double, b1 double")
    plan = iv.join_overlapping(a, b, ["k"], 2.0)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_empty_tables(spark):
    a = spark.createDataFrame([], "k int, a0 double, a1 double")
    b = spark.createDataFrame([], "k int, b0 double, b1 double")
    assert iv.clip(a, b, ["k"], 1.0).collect() == [] and iv.coverage_union(a, ["k"], "a0", "a1").collect() == []


def test_shares_of_shots_used_before(spark):
    rng = random.Random(5)
    shots = [(k, i, a := rng.randrange(40), a + rng.randrange(1, 9)) for k in (1, 2) for i in range(60)]
    df = spark.createDataFrame([(k, i, a / 4, b / 4) for k, i, a, b in shots], "k int, i int, a0 double, a1 double").repartition(5)
    got = {(r["k"], r["i"]): r["reused"] for r in folds.reused(df, ["k"], ["i"]).collect()}
    for k, i, a, b in shots:
        before = {x for q, j, c, d in shots if q == k and j < i for x in range(c, d)}
        assert got[k, i] == len(before & set(range(a, b))) / (b - a)


def test_shots_without_a_range_use_nothing(spark):
    odd = [(1, 0, None, 5.0), (1, 1, 2.0, 2.0), (1, 2, 0.0, float("nan")), (1, 3, float("-inf"), 9.0), (1, 4, 1.0, 3.0), (1, 5, 1.0, 3.0), (None, 0, 1.0, 3.0)]
    df = spark.createDataFrame(odd, "k int, i int, a0 double, a1 double")
    got = {(r["k"], r["i"]): r["reused"] for r in folds.reused(df, ["k"], ["i"]).collect()}
    assert got == {(1, 0): None, (1, 1): None, (1, 2): None, (1, 3): None, (1, 4): 0.0, (1, 5): 1.0, (None, 0): 0.0}
    assert folds.reused(df.limit(0), ["k"], ["i"]).count() == 0
