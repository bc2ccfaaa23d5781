"""Rules that depend on the last row kept, run as a stream over sorted partitions.

Rows are dealt by key and sorted once; a key's state is a few numbers and its rows pass in Arrow batches, so a long timeline
needs no memory of its own. No window function can say "at least this far from the last row that was kept".
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

Keep = Callable[[np.ndarray, dict], np.ndarray]


def _by_key(batches: Iterator[pa.RecordBatch], keys: list[str], values: list[str], rule: Callable[..., np.ndarray], kind: type) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Each batch with what rule says of its rows; a key's state goes on from batch to batch."""
    last, state = None, {}
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.schema.get_field_index
        columns = [batch.column(at(k)).to_pylist() for k in keys]
        key = list(zip(*columns, strict=True)) if keys else [()] * batch.num_rows
        cuts = [0, *(i for i in range(1, len(key)) if key[i] != key[i - 1]), len(key)]
        numbers = [batch.column(at(v)).to_numpy(zero_copy_only=False) for v in values]
        said = np.zeros(batch.num_rows, dtype=kind)
        for a, b in zip(cuts, cuts[1:], strict=False):
            if key[a] != last:
                last, state = key[a], {}
            said[a:b] = rule(*(n[a:b] for n in numbers), state)
        yield batch, said


def keep_where(df: DataFrame, keys: list[str], order: list[str], values: list[str], rule: Callable[..., np.ndarray]) -> DataFrame:
    """Rows of df that rule keeps. rule(values of a run of one key's rows..., state) -> booleans; state is a dict that lives as long as the key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, kept in _by_key(batches, keys, values, rule, bool):
            yield batch.filter(pa.array(kept))

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, df.schema)


def numbered(df: DataFrame, keys: list[str], order: list[str], values: list[str], name: str, rule: Callable[..., np.ndarray]) -> DataFrame:
    """df with a double that rule, as in keep_where, says of each row; null where it is not a number."""
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, said in _by_key(batches, keys, values, rule, float):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(said, from_pandas=True)], names=[*batch.schema.names, name])

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def gap_rule(gap: float, start: float | None = None) -> Keep:
    """Keep a time at least gap after the last kept one, jumping by binary search; start: what counts as kept before the first."""

    def rule(t: np.ndarray, state: dict) -> np.ndarray:
        kept = np.zeros(len(t), dtype=bool)
        last = state.get("last", start)
        at = 0 if last is None else int(np.searchsorted(t, last + gap - 1e-12 * max(1.0, abs(last)), side="left"))
        while at < len(t):
            if last is not None and t[at] - last < gap:
                at += 1
                continue
            kept[at], last = True, t[at]
            at = max(at + 1, int(np.searchsorted(t, last + gap - 1e-12 * max(1.0, abs(last)), side="left")))
        state["last"] = last
        return kept

    return rule


def min_gap(df: DataFrame, keys: list[str], time: str, gap: float, order: list[str] = (), start: float | None = None) -> DataFrame:
    """Rows at least gap apart, by the last kept row."""
    return keep_where(df, keys, [time, *order], [time], gap_rule(gap, start))


def sampled(df: DataFrame, keys: list[str], time: str, score: str, gap: float, always: float, order: list[str] = ()) -> DataFrame:
    """The first row, rows at least gap after the last kept one, and rows whose score is above `always`."""

    def rule(t: np.ndarray, s: np.ndarray, state: dict) -> np.ndarray:
        kept = np.zeros(len(t), dtype=bool)
        last = state.get("last")
        for i, (x, y) in enumerate(zip(t.tolist(), s.tolist(), strict=True)):
            if last is None or x - last >= gap or y > always:
                kept[i], last = True, x
        state["last"] = last
        return kept

    return keep_where(df, keys, [time, *order], [time, score], rule)


def reused(shots: DataFrame, keys: list[str], order: list[str], start: str = "a0", end: str = "a1") -> DataFrame:
    """Adds reused: the share of a shot's range that shots before it (by order, within keys) have used.

    The state of a key is its used ranges, merged, so it grows with the gaps between them and not with the shots. A range that
    is null, not finite or of no length uses nothing, and its share is null.
    """

    def rule(a0: np.ndarray, a1: np.ndarray, state: dict) -> np.ndarray:
        begins, ends = state.setdefault("begins", []), state.setdefault("ends", [])
        shares = np.full(len(a0), np.nan)
        for n, (a, b) in enumerate(zip(a0.tolist(), a1.tolist(), strict=True)):
            if a is None or b is None or not (-np.inf < a < b < np.inf):
                continue
            i, j = bisect_left(ends, a), bisect_right(begins, b)
            taken = sum(min(e, b) - max(s, a) for s, e in zip(begins[i:j], ends[i:j], strict=True))
            shares[n] = min(max(taken / (b - a), 0.0), 1.0)
            low, high = (min(a, begins[i]), max(b, ends[j - 1])) if i < j else (a, b)
            begins[i:j], ends[i:j] = [low], [high]
        return shares

    return numbered(shots, keys, order, [start, end], "reused", rule)
