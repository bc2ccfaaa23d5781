"""Interval algebra on DataFrames: all windows, aggregations and equi-joins.

Intervals are half open. A join of intervals is turned into an equi-join on buckets of a stated width, after which the
exact condition is checked, so no plan has a nested loop over both sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ADJACENT = 1e-7
SMALLEST_GAP = 0.04


def scene_ranges(points: DataFrame, keys: list[str], t: str, duration: str) -> DataFrame:
    """Neighbouring points as ranges [start, end), clamped to duration, empty ones dropped; a key without a range gets the whole.

    points: a row per boundary with its key's duration. Boundaries below zero count as zero.
    """
    w = Window.partitionBy(*keys).orderBy(t)
    clamped = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.col(duration))
    made = points.select(*keys, duration, clamped(F.col(t)).alias("start"), clamped(F.lead(t).over(w)).alias("end"))
    ranges = made.where("end > start")
    every = made.groupBy(*keys).agg(F.max(duration).alias(duration), F.count(F.when(F.col("end") > F.col("start"), 1)).alias("n"))
    whole = every.where("n = 0").select(*keys, F.lit(0.0).alias("start"), F.col(duration).alias("end"))
    return ranges.select(*keys, "start", "end").unionByName(whole)


def pair_intervals(flat: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Numbers two by two as (start, end). A key with an odd count, or a pair that does not go forward, is an error row: valid is false."""
    w = Window.partitionBy(*keys).orderBy(*order)
    placed = flat.select(*keys, F.col(value).alias("v"), (F.row_number().over(w) - 1).alias("place"))
    pairs = placed.groupBy(*keys, F.floor(F.col("place") / 2).alias("pair")).agg(
        F.max(F.when(F.col("place") % 2 == 0, F.col("v"))).alias("start"), F.max(F.when(F.col("place") % 2 == 1, F.col("v"))).alias("end")
    )
    return pairs.withColumn("valid", F.col("end").isNotNull() & (F.col("start") >= 0) & (F.col("end") > F.col("start")))


def offsets(rows: DataFrame, keys: list[str], order: list[str], duration: str, name: str = "before") -> DataFrame:
    """Adds the sum of durations of the rows before."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(name, F.coalesce(F.sum(duration).over(w), F.lit(0.0)))


def buckets(start: Column, end: Column, width: float) -> Column:
    """Numbers of the buckets that [start, end) touches."""
    return F.sequence(F.floor(start / width), F.greatest(F.floor(start / width), F.ceil(end / width) - 1))


def join_overlapping(left: DataFrame, right: DataFrame, keys: list[str], width: float) -> DataFrame:
    """Pairs whose intervals meet. left: keys, a0, a1, right: keys, b0, b1, and other columns of different names.

    Each side is dealt into buckets of `width`; a pair is kept in the first bucket that both touch, so it comes once.
    """
    lb = left.select("*", F.explode(buckets(F.col("a0"), F.col("a1"), width)).alias("_bucket"))
    rb = right.select("*", F.explode(buckets(F.col("b0"), F.col("b1"), width)).alias("_bucket"))
    # Sizes after an explode are not known when the plan is made, so neither side may be broadcast on an estimate.
    met = lb.hint("merge").join(rb, [*keys, "_bucket"]).where((F.col("a0") < F.col("b1")) & (F.col("b0") < F.col("a1")))
    return met.where(F.col("_bucket") == F.floor(F.greatest("a0", "b0") / width)).drop("_bucket")


def clip(fragments: DataFrame, requests: DataFrame, keys: list[str], width: float) -> DataFrame:
    """fragments (a0, a1) cut to requests (b0, b1): start and end of what is longer than 1e-7."""
    met = join_overlapping(fragments, requests, keys, width)
    cut = met.withColumn("start", F.greatest("a0", "b0")).withColumn("end", F.least("a1", "b1"))
    return cut.where(F.col("end") > F.col("start") + 1e-7)


def migrate_intervals(intervals: DataFrame, sources: DataFrame, keys: list[str], source: str, width: float) -> DataFrame:
    """Intervals (a0, a1) of a concatenated timeline as intervals of its sources: source, start and duration of each part.

    sources: keys, source (its place in the order) and duration.
    """
    placed = offsets(sources, keys, [source], "duration").select(*keys, source, F.col("before").alias("b0"), (F.col("before") + F.col("duration")).alias("b1"))
    met = join_overlapping(intervals, placed, keys, width)
    low, high = F.greatest("a0", "b0") - F.col("b0"), F.least("a1", "b1") - F.col("b0")
    return met.withColumn("start", low).withColumn("duration", high - low).where("duration > 0")


def overlap(pieces: DataFrame, covered: DataFrame, keys: list[str], piece: list[str], width: float) -> DataFrame:
    """For each piece (its columns `piece`, a0, a1) the seconds that covered ranges (b0, b1) take of it, its own length at most."""
    met = join_overlapping(pieces, covered, keys, width)
    taken = met.groupBy(*keys, *piece).agg(F.sum(F.least("a1", "b1") - F.greatest("a0", "b0")).alias("taken"))
    joined = pieces.join(taken, [*keys, *piece], "left")
    return joined.withColumn("taken", F.least(F.coalesce("taken", F.lit(0.0)), F.col("a1") - F.col("a0")))


def coverage_union(ranges: DataFrame, keys: list[str], start: str, end: str, eps: float = ADJACENT) -> DataFrame:
    """Overlapping and adjacent ranges merged."""
    before = Window.partitionBy(*keys).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    so_far = Window.partitionBy(*keys).orderBy(start, end).rowsBetween(Window.unboundedPreceding, 0)
    fresh = F.coalesce(F.col(start) > F.max(end).over(before) + eps, F.lit(True))
    marked = ranges.withColumn("_fresh", fresh.cast("int"))
    islands = marked.withColumn("_island", F.sum("_fresh").over(so_far))
    return islands.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("merged")).drop("_island")


def first_unused(fragments: DataFrame, covered: DataFrame, keys: list[str], order: str, width: float = 60.0) -> DataFrame:
    """Per key the local offset of the first gap of at least SMALLEST_GAP in its fragments (order, a0, a1) that covered (b0, b1, merged and sorted) leaves.

    A key that is covered wholly has no row. The gap before a covered range counts if it is longer than SMALLEST_GAP; the
    last gap if it ends more than that after the cursor.
    """
    placed = offsets(fragments.withColumn("_len", F.col("a1") - F.col("a0")), keys, [order], "_len")
    # The end of a fragment closes the last gap, as a covered range of no length would.
    closing = placed.select(*keys, order, "before", "a0", "a1", F.col("a1").alias("b0"), F.col("a1").alias("b1"), F.lit(True).alias("_close"))
    inside = join_overlapping(placed, covered, keys, width)
    rows = closing.unionByName(inside.select(*keys, order, "before", "a0", "a1", "b0", "b1", F.lit(False).alias("_close")))
    earlier = Window.partitionBy(*keys, order).orderBy("b0", "_close", "b1").rowsBetween(Window.unboundedPreceding, -1)
    cursor = F.greatest("a0", F.coalesce(F.max("b1").over(earlier), F.col("a0")))
    gaps = rows.withColumn("_cursor", cursor)
    found = F.when(F.col("_close"), F.col("_cursor") < F.col("a1") - SMALLEST_GAP).otherwise(F.col("b0") > F.col("_cursor") + SMALLEST_GAP)
    # An earlier gap within a fragment that is too small to count still ends before the fragment's end.
    open_ = gaps.where(found & (F.col("_cursor") < F.col("a1") - SMALLEST_GAP))
    return open_.groupBy(*keys).agg(F.min(F.col("before") + F.col("_cursor") - F.col("a0")).alias("offset"))


def backward(points: DataFrame, marks: DataFrame, keys: list[str], at: str, values: list[str], strict: bool = False) -> DataFrame:
    """As-of join: to each point the values of the last mark of its key at or before it (strict: before it); null where there is none.

    A union under one window: each side is read once and dealt once, and no pair of rows is formed. Of marks at the same
    time the last in order of `values` counts.
    """
    held = F.struct(*values)
    rank = F.lit(0 if strict else 1)
    here = points.select(F.struct(*points.columns).alias("_row"), *keys, F.col(at).alias("_at"), rank.alias("_side"), F.lit(None).cast(marks.select(held.alias("h")).schema["h"].dataType).alias("_held"))
    there = marks.select(F.lit(None).cast(here.schema["_row"].dataType).alias("_row"), *keys, F.col(at).alias("_at"), F.lit(1 if strict else 0).alias("_side"), held.alias("_held"))
    w = Window.partitionBy(*keys).orderBy("_at", "_side", "_held").rowsBetween(Window.unboundedPreceding, 0)
    met = here.unionByName(there).withColumn("_last", F.last("_held", ignorenulls=True).over(w)).where("_row is not null")
    return met.select("_row.*", *(F.col(f"_last.{v}").alias(v) for v in values))


def forward(points: DataFrame, marks: DataFrame, keys: list[str], at: str, values: list[str]) -> DataFrame:
    """To each point the values of the first mark of its key at or after it."""
    mirror = lambda df: df.withColumn(at, -F.col(at))
    return mirror(backward(mirror(points), mirror(marks), keys, at, values))


def nearest(points: DataFrame, marks: DataFrame, keys: list[str], at: str, value: str, cap: Column) -> DataFrame:
    """Adds the nearest mark's `value` (its time), the earlier one of equals, at most cap; the point's own time where there is no mark."""
    low = backward(points, marks, keys, at, [value], strict=True).withColumnRenamed(value, "_low")
    both = forward(low, marks, keys, at, [value]).withColumnRenamed(value, "_high")
    t = F.col(at)
    pick = F.when(F.col("_high").isNull(), F.col("_low")).when(F.col("_low").isNull(), F.col("_high")).when(t - F.col("_low") <= F.col("_high") - t, F.col("_low")).otherwise(F.col("_high"))
    return both.withColumn("nearest", F.least(F.coalesce(pick, t), cap)).drop("_low", "_high")
