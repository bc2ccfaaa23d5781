"""Exact top-k search of binary codes by incremental multi-index hashing.

A code is cut into segments and each segment value is an index key. For a growing radius s, all segment values at exactly
s bits from a query's are probed. After radius s every code that has not turned up differs by more than s in each of the m
segments, so its distance is at least m * (s + 1): once a query's kth verified distance is below that, its answer is
proved and it leaves. Distances of codes that turn up are computed in full. Shells grow fast on wide segments: queries that
are still open when a shell has more than SHELL values are held against all codes, block by block.

Equal codes are one index entry with their k least ids, which is all that a top-k list with ties by id can need.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoframe.llm.common import Workspace

BITS = 64
#: Parts that a hot code is cut into while its least ids are found.
SALTS = 64
#: Codes of one page of an index key.
PAGE = 64
#: Segment values at one radius from a query's, above which queries still open are held against all codes instead.
SHELL = 4096
#: Queries of one such pass, and codes that they meet at once.
QUERIES, SCANNED = 4096, 1024
#: Verified pairs that a task holds before it sends on the nearest.
HELD = 1 << 20


def sign_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id and code (long): bit i is set where the sum of the numbers i, i + 64, i + 128, ... of the vector is above zero.

    So each number counts, whatever the length; up to 64 numbers have a bit of their own. Null vectors, and null, NaN or missing
    numbers, count as zero. Rows without id are left out: they can't be told.
    """
    vector = F.col(f"`{vector_col}`")
    number = lambda i: F.coalesce(F.nanvl(F.get(vector, i).cast("double"), F.lit(0.0)), F.lit(0.0))
    size = F.coalesce(F.size(vector), F.lit(0))
    one = lambda i: number(F.lit(i)) > 0
    places = lambda i: F.sequence(F.lit(i), F.greatest(size - 1, F.lit(i)), F.lit(BITS))
    long = lambda i: F.aggregate(places(i), F.lit(0.0), lambda so_far, at: so_far + number(at)) > 0

    def packed(test) -> Column:
        bits = [F.when(test(i), F.lit(1 << i if i < 63 else -(1 << 63))).otherwise(F.lit(0)) for i in range(BITS)]
        return reduce(Column.bitwiseOR, bits)

    code = F.when(size > BITS, packed(long)).otherwise(packed(one))
    rows = vectors.where(F.col(f"`{id_col}`").isNotNull())
    return rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), code.cast("long").alias("code"))


def segment_count(codes: int) -> int:
    """As many segments as leave about eight codes a key: 64 / (log2(codes) - 3), between 2 and 8."""
    return min(8, max(2, round(BITS / max(8.0, math.log2(max(codes, 2)) - 3))))


def _bounds(m: int) -> list[tuple[int, int]]:
    cuts = [round(i * BITS / m) for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _segment(code: Column, first: int, width: int) -> Column:
    return F.shiftrightunsigned(code, first).bitwiseAND(F.lit((1 << width) - 1))


def _least_ids(rows: DataFrame, k: int) -> DataFrame:
    """code, ids: the k least ids of each code. A hot code is thinned salt by salt before its rows meet."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    few = salted.withColumn("n", F.row_number().over(Window.partitionBy("code", "salt").orderBy("id"))).where(F.col("n") <= k)
    return few.groupBy("code").agg(F.slice(F.array_sort(F.collect_list("id")), 1, k).alias("ids"))  # SALTS * k ids at most


def _nearest(held: list[np.ndarray], wanted: int) -> list[np.ndarray]:
    """Of each query the codes that can be among its `wanted` nearest: each stands for a row at least, so as many codes are enough; ties stay."""
    q, code, n, distance = held
    order = np.lexsort((distance, q))
    q, code, n, distance = q[order], code[order], n[order], distance[order]
    start, end = np.searchsorted(q, q), np.searchsorted(q, q, side="right")
    near = distance <= distance[np.minimum(start + wanted, end) - 1]
    return [x[near] for x in (q, code, n, distance)]


def _verified(batches: Iterator[pa.RecordBatch], bounds: list[tuple[int, int]], radius: int, wanted: int) -> Iterator[pa.RecordBatch]:
    """Full distances of the codes that probes hit; a task sends on what can be among the `wanted` nearest, at most HELD rows at a time.

    A pair turns up in every segment at the least distance of all; it is taken in the first of them, so it comes once.
    """
    held: list[list[np.ndarray]] = []
    rows = 0

    def merged() -> list[np.ndarray]:
        return _nearest([np.concatenate(x) for x in zip(*held, strict=True)], wanted)

    def out(columns: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["q", "code", "n", "distance"])

    for batch in batches:
        lists = batch.column(2)
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
        inner = lists.flatten()
        code, n = (inner.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        q, j = (np.repeat(batch.column(i).to_numpy(zero_copy_only=False), sizes) for i in (0, 1))
        differ = (q ^ code).view(np.uint64)
        gaps = np.stack([np.bitwise_count((differ >> np.uint64(a)) & np.uint64((1 << w) - 1)) for a, w in bounds])
        first = (gaps.min(axis=0) == radius) & (gaps.argmin(axis=0) == j)
        held.append([q[first], code[first], n[first].astype(np.int32), np.bitwise_count(differ[first]).astype(np.int32)])
        rows += int(first.sum())
        if rows > HELD:
            held = [merged()]
            rows = len(held[0][0])
            if rows > HELD // 2:
                yield out(held[0])
                held, rows = [], 0
    if held:
        yield out(merged())


def _scanned(batches: Iterator[pa.RecordBatch], queries: np.ndarray, wanted: int) -> Iterator[pa.RecordBatch]:
    """Distances of all codes of a task to a block of queries, in parts; sends on what can be among the `wanted` nearest."""
    held = [np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int32)]
    last = np.full(len(queries), BITS, dtype=np.int64)  # beyond this distance a query has enough codes
    for batch in batches:
        code, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        for at in range(0, len(code), SCANNED):
            part, count = code[at : at + SCANNED], n[at : at + SCANNED].astype(np.int32)
            gap = np.bitwise_count((queries[:, None] ^ part[None, :]).view(np.uint64)).astype(np.int32)
            i, j = np.nonzero(gap <= last[:, None])
            new = [queries[i], part[j], count[j], gap[i, j]]
            held = _nearest([np.concatenate(x) for x in zip(held, new, strict=True)], wanted)
            order = np.searchsorted(queries, held[0])
            full = np.bincount(order, minlength=len(queries)) >= wanted
            top = np.zeros(len(queries), dtype=np.int64)
            np.maximum.at(top, order, held[3])
            last = np.where(full, top, BITS)
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], names=["q", "code", "n", "distance"])


def _by_scan(index: DataFrame, open_codes: DataFrame, space: Workspace, wanted: int) -> DataFrame:
    """The nearest codes of the queries left, in blocks of QUERIES against all codes: exact, in bounded memory, a pass for each block."""
    spark, found = index.sparkSession, None
    codes = index.select("code", F.size("ids").alias("n"))
    numbered = open_codes.withColumn("block", F.floor((F.row_number().over(Window.partitionBy(F.pmod(F.xxhash64("q"), F.lit(SALTS))).orderBy("q")) - 1) / (QUERIES // SALTS)))
    numbered = space.save(numbered, "blocks")
    for block in range((numbered.agg(F.max("block")).first()[0] or 0) + 1):
        own = np.sort(np.array([r["q"] for r in numbered.where(F.col("block") == block).select("q").collect()], dtype=np.int64))  # QUERIES at most
        shared = spark.sparkContext.broadcast(own)
        met = codes.mapInArrow(lambda batches, x=shared: _scanned(batches, x.value, wanted), "q long, code long, n int, distance int")
        met = space.save(met, f"scanned-{block}")
        found = met if found is None else found.union(met)
    return found


def _masks(width: int, radius: int) -> list[int]:
    return [sum(1 << i for i in chosen) for chosen in combinations(range(width), radius)]


def _needed(found: DataFrame, wanted: int) -> DataFrame:
    """Codes at a distance count by the rows they stand for; a code is needed while fewer than `wanted` rows are nearer."""
    nearer = Window.partitionBy("q").orderBy("distance").rangeBetween(Window.unboundedPreceding, -1)
    return found.withColumn("before", F.coalesce(F.sum("n").over(nearer), F.lit(0))).where(F.col("before") < wanted)


def top_k(rows: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, id, distance, rank: for each query row the k rows nearest by Hamming distance, ties by id; itself excluded.

    rows and queries: id and code (long). Fewer rows than k: all of them. Rows that repeat both id and code count once;
    an id with two codes is two entries. Equal query codes are searched once. No rows or no queries: an empty result.
    """
    space = Workspace(rows.sparkSession, "hamming")
    wanted = k + 1  # a query can be one of the rows
    index = space.save(_least_ids(rows.distinct(), wanted), "index")
    count = index.count()
    asked = space.save(queries.select(F.col("id").alias("query_id"), "code").distinct(), "asked")
    open_codes = space.save(asked.select(F.col("code").alias("q")).distinct(), "open-0")
    m = segment_count(count)
    bounds = _bounds(m)
    widest = max(w for _, w in bounds)
    parts = F.array(*(F.struct(F.lit(j).alias("j"), _segment(F.col("code"), a, w).alias("key")) for j, (a, w) in enumerate(bounds)))
    # A key's codes are pages of about PAGE codes, so a probe that hits is a row for each page and not for each code.
    keyed = index.select("code", F.size("ids").alias("n"), F.explode(parts).alias("s")).select("code", "n", "s.j", "s.key")
    sized = keyed.groupBy("j", "key").agg(F.ceil(F.count("*") / PAGE).alias("pages"))
    paged = keyed.join(sized, ["j", "key"]).withColumn("page", F.pmod(F.xxhash64("code"), F.col("pages")))
    pages = space.save(paged.groupBy("j", "key", "page").agg(F.collect_list(F.struct("code", "n")).alias("codes")).drop("page"), "pages")
    best = None
    for radius in range(widest + 1):
        if open_codes.isEmpty():
            break
        if math.comb(widest, radius) > SHELL:
            met = _by_scan(index, open_codes, space, wanted)
            settled = met if best is None else best.join(open_codes, "q", "left_anti").select("q", "code", "n", "distance").union(met)
            best = space.save(_needed(settled, wanted), "best-scanned")
            break
        probes = None
        for j, (a, w) in enumerate(bounds):
            shell = open_codes.select("q", F.lit(j).alias("j"), F.explode(F.lit(_masks(w, radius))).alias("mask"))  # C(w, radius) values
            shell = shell.select("q", "j", _segment(F.col("q"), a, w).bitwiseXOR(F.col("mask")).alias("key"))
            probes = shell if probes is None else probes.union(shell)
        # The planner takes an exploded table for as small as what it came from: without a hint it would send all probes everywhere.
        # A query's pages meet in one task, so no other task sends on codes that are near only among those it has seen.
        met = probes.hint("merge").join(pages, ["j", "key"]).select("q", "j", "codes").repartition("q").mapInArrow(lambda batches, r=radius: _verified(batches, bounds, r, wanted), "q long, code long, n int, distance int")
        found = met if best is None else best.select("q", "code", "n", "distance").union(met)
        best = space.save(_needed(found, wanted), f"best-{radius}")
        reached = best.groupBy("q").agg(F.sum("n").alias("rows"), F.max("distance").alias("last"))
        proved = reached.where((F.col("rows") >= wanted) & (F.col("last") < m * (radius + 1))).select("q")
        open_codes = space.save(open_codes.join(proved, "q", "left_anti"), f"open-{radius + 1}")
    if best is None:
        return asked.select("query_id", F.col("code").alias("id"), F.lit(0).alias("distance"), F.lit(0).alias("rank")).where("false")
    listed = best.join(index, "code").select("q", "distance", F.explode("ids").alias("id"))
    pairs = asked.join(listed, asked["code"] == listed["q"]).where("id <> query_id").select("query_id", "id", "distance")
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))).where(F.col("rank") <= k)


def search_every(vectors: DataFrame, step: int = 100, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The stated query set: rows whose id is divisible by step, against all rows.

    Vectors are turned into codes as sign_codes says (null, NaN and missing numbers count as zero); ties go by id; rows
    without id are left out; rows that repeat an id with another vector are entries of their own, and a repeated id that is
    a query is asked once for each different code. Empty table: empty result. Other columns are not read.
    """
    codes = sign_codes(vectors, id_col, vector_col)
    return top_k(codes, codes.where(F.col("id") % step == 0), k)
