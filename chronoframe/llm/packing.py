"""Packing of documents into sequences as a cutting-stock problem, solved by column generation.

A document is cut at multiples of the capacity; full pieces are sequences of their own and what remains is packed. The
histogram of remainders has at most `capacity` lengths whatever the corpus, so the linear program over packing patterns
runs on the driver: rows are length classes, columns are patterns, and a knapsack program over the capacity prices new
columns by the dual values until none pays. Patterns rounded down cover almost all documents; the rest, a few per
class, is packed by first fit. Each pattern takes a range of ranks of each class, so documents find their sequence by
their rank without any of them meeting.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoframe.llm.common import Workspace, column, picked, sliced, texts
from chronoframe.llm.tokens import coder, encoded

#: Length classes: as many as the program has rows.
CLASSES = 320
#: Column generation ends when all patterns together can't save more than this share of the sequences, or this part of one:
#: by linear duality the best use of all patterns is at least the present one divided by the best pattern's worth.
GAIN, PART = 2e-3, 0.1
#: It also ends when so many columns in a row have saved less than that, and after MOST_COLUMNS.
STALLED, MOST_COLUMNS = 120, 3000
#: Patterns that one solution of the knapsack gives.
AT_ONCE = 16
_LENGTHS = "row long, doc_id long, doc_tokens long, crcs array<long>"


def token_lengths(docs: DataFrame, vocabulary: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row of docs its number of ids with end_id, and the CRC-32 of each piece of `capacity` ids (32 bits wide, little-endian)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(vocabulary)
        end = np.array([end_id], dtype=own.dtype).tobytes()
        for batch in sliced(batches):
            counts, sums = [], []
            for raw in encoded(vocabulary, texts(batch)):
                ids = own.ids(raw + end).astype("<u4").tobytes()
                counts.append(len(ids) // 4)
                sums.append([zlib.crc32(ids[a : a + 4 * capacity]) for a in range(0, len(ids), 4 * capacity)])
            yield pa.RecordBatch.from_arrays([column(batch, "row"), column(batch, "_id"), pa.array(counts, pa.int64()), pa.array(sums, pa.list_(pa.int64()))], names=["row", "doc_id", "doc_tokens", "crcs"])

    return picked(docs, id_col, text_col).select(F.monotonically_increasing_id().alias("row"), "_id", "_text").mapInArrow(run, _LENGTHS)


def length_classes(counts: np.ndarray, most: int) -> np.ndarray:
    """For each length its class, -1 where no piece has that length. Classes are runs of lengths with about equal tokens; a class stands for its longest length."""
    lengths = np.flatnonzero(counts)
    kind = np.full(len(counts), -1)
    if len(lengths) <= most:
        kind[lengths] = np.arange(len(lengths))
        return kind
    # Rounding up wastes most where many pieces are long apart, so runs are cut by pieces and by span alike.
    weight = counts[lengths] / counts[lengths].sum() + np.diff(lengths, prepend=lengths[0] - 1) / lengths[-1]
    cut = np.minimum((np.cumsum(weight) / weight.sum() * most).astype(int), most - 1)
    kind[lengths] = np.unique(cut, return_inverse=True)[1]
    return kind


def _table(value: np.ndarray, size: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For each capacity the best total value of sizes within it, each as often as wished, and the size taken last (-1: none)."""
    best = np.zeros(capacity + 1)
    last = np.full(capacity + 1, -1)
    order = np.argsort(-value / size, kind="stable")
    for i in order[value[order] > 1e-12].tolist():
        s, v = int(size[i]), value[i]
        while True:  # once for each further copy that pays somewhere
            better = best[:-s] + v > best[s:] + 1e-12
            if not better.any():
                break
            old = best[s:].copy()
            best[s:] = np.where(better, best[:-s] + v, old)
            last[s:][better] = i
    return best, last


def _taken(last: np.ndarray, size: np.ndarray, at: int) -> np.ndarray:
    taken = np.zeros(len(size), dtype=np.int64)
    while at > 0 and last[at] >= 0:
        taken[last[at]] += 1
        at -= int(size[last[at]])
    return taken


def knapsack(value: np.ndarray, size: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Best total value of sizes within capacity, each as often as wished, and how often each is taken."""
    best, last = _table(value, size, capacity)
    taken = _taken(last, size, int(np.argmax(best)))
    return float(taken @ value), taken


def priced(value: np.ndarray, size: np.ndarray, capacity: int, least: float) -> np.ndarray:
    """Patterns worth more than `least`, a row each: the best of all, and for the sizes that can be in such a one the best with that size."""
    best, last = _table(value, size, capacity)
    with_it = value + best[capacity - size]
    rows = [_taken(last, size, int(np.argmax(best)))]
    for i in np.argsort(-with_it, kind="stable")[:AT_ONCE].tolist():
        row = _taken(last, size, capacity - int(size[i]))
        row[i] += 1
        rows.append(row)
    made = np.unique(np.array(rows), axis=0)
    return made[made @ value > least]


def first_basis(demand: np.ndarray, size: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """A pattern for each class (a row) and how often it is used: longest first as far as they fit, until one class is used up.

    Each pattern has nothing of the classes used up before it, so the rows are a basis.
    """
    n = len(demand)
    rows, use = np.zeros((n, n), dtype=np.int64), np.zeros(n)
    left, longest = demand.astype(float), np.argsort(-size, kind="stable")
    while True:
        alive = longest[left[longest] > 1e-9]
        if not len(alive):
            break
        row, room = np.zeros(n, dtype=np.int64), capacity
        for i, s, have in zip(alive.tolist(), size[alive].tolist(), np.ceil(left[alive]).astype(np.int64).tolist(), strict=True):
            if s <= room:
                row[i] = min(room // s, have)
                room -= row[i] * s
        held = np.flatnonzero(row)
        ratio = left[held] / row[held]
        gone = held[int(np.argmin(ratio))]
        rows[gone], use[gone] = row, ratio.min()
        left -= use[gone] * row
        left[gone] = 0
    idle = np.flatnonzero(rows[np.arange(n), np.arange(n)] == 0)  # used up together with another
    rows[idle, idle] = 1
    return rows, use


def patterns(demand: np.ndarray, size: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """(how many of each class in a sequence, how many such sequences); together exactly the demand, no sequence over capacity.

    Priced patterns are kept: as long as one of them pays at the present dual values it enters, and only then is the
    knapsack solved again.
    """
    n = len(demand)
    out: list[tuple[np.ndarray, int]] = []
    rest = demand.astype(np.int64).copy()
    if n:
        basis, use = first_basis(demand, size, capacity)
        inverse, columns = np.linalg.inv(basis.T), list(basis)
        known, pool = np.zeros((0, n), dtype=np.int64), np.zeros((0, n))
        marked = np.inf
        for turn in range(MOST_COLUMNS):
            if turn % STALLED == 0:
                if use.sum() > marked - max(GAIN * use.sum(), PART):
                    break
                marked = use.sum()
            dual = inverse.sum(axis=0)
            least = 1 + max(GAIN, PART / use.sum())
            gains = pool @ dual
            if not len(gains) or gains.max() <= least:
                known = priced(dual, size, capacity, least)
                if not len(known):
                    break
                pool = known.astype(float)
                gains = pool @ dual
            new = known[int(np.argmax(gains))]
            step = inverse @ new
            able = np.flatnonzero(step > 1e-9)
            ratio = use[able] / step[able]
            out_row = able[int(np.argmin(ratio))]
            pivot = inverse[out_row] / step[out_row]
            amount = use[out_row] / step[out_row]
            inverse -= np.outer(step, pivot)
            inverse[out_row] = pivot
            use -= step * amount
            use[out_row] = amount
            use[np.abs(use) < 1e-9] = 0
            columns[out_row] = new
        for c, x in zip(columns, use, strict=True):
            times = int(np.floor(x + 1e-7))
            if times > 0:
                times = min(times, int(min(rest[c > 0] // c[c > 0])))
            if times > 0:
                out.append((c, times))
                rest -= times * c
        for at in np.argsort(np.floor(use + 1e-7) - use, kind="stable").tolist():  # rounded up where demand is left, largest fractions first
            c = columns[at]
            if use[at] % 1 > 1e-7 and c @ size > (1 - GAIN) * capacity and (rest >= c).all():
                out.append((c, 1))
                rest -= c
    bins: list[tuple[int, np.ndarray]] = []  # what rounding left: first fit, longest first
    for i in np.argsort(-size, kind="stable").tolist():
        for _ in range(int(rest[i])):
            at = next((k for k, (room, _) in enumerate(bins) if room >= size[i]), None)
            if at is None:
                bins.append((capacity, np.zeros(n, dtype=np.int64)))
                at = len(bins) - 1
            room, held = bins[at]
            held[i] += 1
            bins[at] = (room - int(size[i]), held)
    return out + [(held, 1) for _, held in bins]


@dataclass
class Plan:
    """Where each rank of each class goes: ranges of (class, rank), sorted, with what they need to name a sequence."""

    kind: np.ndarray  # of each length
    low: np.ndarray  # class * 2^48 + first rank
    first: np.ndarray
    each: np.ndarray
    base: np.ndarray
    sequences: int

    def of(self, kind: np.ndarray, rank: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.low, (kind.astype(np.int64) << 48) + rank, side="right") - 1
        return self.base[at] + (rank - self.first[at]) // self.each[at]


def plan(counts: np.ndarray, capacity: int) -> Plan:
    """counts[n]: pieces of n ids, n < capacity."""
    kind = length_classes(counts, CLASSES)
    n = int(kind.max()) + 1 if len(kind) else 0
    demand = np.bincount(kind[kind >= 0], weights=counts[kind >= 0], minlength=n).astype(np.int64)
    size = np.zeros(n, dtype=np.int64)
    np.maximum.at(size, kind[kind >= 0], np.flatnonzero(kind >= 0))
    taken, base, rows = np.zeros(n, dtype=np.int64), 0, []
    for pattern, times in patterns(demand, size, capacity):
        for i in np.flatnonzero(pattern).tolist():
            rows.append(((i << 48) + int(taken[i]), int(taken[i]), int(pattern[i]), base))
            taken[i] += int(pattern[i]) * times
        base += times
    assert (taken == demand).all()
    low, first, each, bases = (np.array(x, dtype=np.int64) for x in zip(*sorted(rows), strict=True)) if rows else [np.zeros(0, dtype=np.int64)] * 4
    return Plan(kind, low, first, each, bases, base)


def _ranked(rows: DataFrame, by: str, salts: int, amount: str) -> DataFrame:
    """Adds `before`: the sum of amount over all earlier rows of the same `by`. Salts split a hot `by`; their sums come first."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)))
    own = F.sum(amount).over(Window.partitionBy(by, "salt").orderBy("row")) - F.col(amount)
    sums = salted.groupBy(by, "salt").agg(F.sum(amount).alias("_sum"))
    sums = sums.select(by, "salt", (F.sum("_sum").over(Window.partitionBy(by).orderBy("salt")) - F.col("_sum")).alias("earlier"))
    return salted.withColumn("own", own).join(sums, [by, "salt"]).withColumn("before", F.col("own") + F.col("earlier")).drop("own", "earlier", "salt")


def pack(docs: DataFrame, vocabulary: str, end_id: int, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and row (the document's number in this run), one row per piece.

    Each id of each document lies in one piece, and a sequence's pieces fill it without gaps from 0. A null text is
    empty (end_id alone); a null id stays null; rows that repeat an id are documents of their own, told apart by row.
    Empty table: empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    space = Workspace(spark, "packing")
    lengths = space.save(token_lengths(docs, vocabulary, end_id, capacity, id_col, text_col), "lengths")
    rest = F.col("doc_tokens") % capacity
    counts = np.zeros(capacity, dtype=np.int64)  # at most `capacity` rows come to the driver
    for r in lengths.select(rest.alias("n")).where("n > 0").groupBy("n").count().collect():
        counts[r["n"]] = r["count"]
    total = int(counts.sum())
    made = plan(counts, capacity)
    salts = max(64, total // 500_000)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = made.of(column(batch, "kind").to_numpy(zero_copy_only=False), column(batch, "before").to_numpy(zero_copy_only=False))
            names = ["row", "doc_id", "doc_tokens", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(column(batch, n) for n in names), pa.array(found)], names=[*names, "sequence_id"])

    piece = ["row", "doc_id", "doc_tokens"]
    left = lengths.where(rest > 0).select(*piece, (F.col("doc_tokens") - rest).alias("start"), rest.alias("length"), F.element_at("crcs", -1).alias("ids_crc32"), F.lit(1).cast("long").alias("one"))
    table = spark.createDataFrame([(int(n), int(k)) for n, k in enumerate(made.kind) if k >= 0], "length long, kind int")
    left = left.join(F.broadcast(table), "length")  # fewer than `capacity` rows
    left = _ranked(left, "kind", salts, "one").select(*piece, "start", "length", "ids_crc32", "kind", "before")
    packed = left.mapInArrow(assign, "row long, doc_id long, doc_tokens long, start long, length long, ids_crc32 long, sequence_id long")
    packed = space.save(packed, "packed")
    inside = F.sum("length").over(Window.partitionBy("sequence_id").orderBy(F.desc("length"), "row")) - F.col("length")  # a sequence has at most `capacity` pieces
    packed = packed.withColumn("offset", inside)
    full = lengths.where(F.col("doc_tokens") >= capacity).withColumn("n", F.floor(F.col("doc_tokens") / capacity)).withColumn("kind", F.lit(0))
    full = _ranked(full, "kind", salts, "n").select(*piece, "before", "n", F.posexplode(F.slice("crcs", 1, F.col("n").cast("int"))).alias("number", "ids_crc32"))
    full = full.select(*piece, (F.col("number") * F.lit(capacity)).cast("long").alias("start"), F.lit(capacity).cast("long").alias("length"), "ids_crc32", (F.lit(made.sequences) + F.col("before") + F.col("number")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(full).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "row")
