"""Connected components by alternating stars, as DataFrame joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoframe.llm.common import Workspace, column

#: So many edges or fewer are joined up in one task, some 5 MB; more take rounds of joins. Both give the same.
FEW = 100_000

#: A node with more than one in so many of all pairs is hot, so there are fewer hot nodes than this.
MOST_HOT = 5_000
#: A node with fewer edges than this is never hot.
LEAST_HOT = 1_000


def unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the components of a[i] and b[i]; label[x] is the least index of x's component, before and after."""
    while True:
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            return
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while (label[label] != label).any():
            label[:] = label[label]


def _at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All edges (u, v) of one task -> u and the smallest node m reachable, where that is another."""
    held = [[column(batch, c).to_numpy() for c in ("u", "v")] for batch in batches]
    ends = np.concatenate([np.zeros((2, 0), dtype=np.int64), *(np.stack(x) for x in held)], axis=1)
    nodes, at = np.unique(ends, return_inverse=True)
    label = np.arange(len(nodes))
    unite(label, *at.reshape(2, -1))
    moved = label != np.arange(len(nodes))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[label[moved]])], names=["u", "m"])


def _with_minima(pairs: DataFrame, edges: int, space: Workspace, name: str) -> DataFrame:
    """pairs with m, for each u the smallest of its neighbours and itself.

    Partial aggregation keeps a hot u cheap. The join back would bring all its pairs to one task, so the few minima of hot
    nodes are broadcast and their pairs stay where they are. edges: no fewer than there are pairs.
    """
    most = max(LEAST_HOT, edges // MOST_HOT)
    minima = space.save(pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")), name)
    named = minima.select("u", "m")
    if edges <= most or minima.where(F.col("n") > most).isEmpty():
        return pairs.join(named, "u")
    hot = F.broadcast(minima.where(F.col("n") > most).select("u", "m"))  # fewer than MOST_HOT rows
    return pairs.join(hot, "u").union(pairs.join(hot.select("u"), "u", "left_anti").join(named, "u"))


def components(edges: DataFrame, space: Workspace, most_rounds: int = 60) -> DataFrame:
    """Nodes u (long) with the smallest node m reachable, for every node that has an edge to a smaller one.

    edges: columns u, v (long); loops, repeats and either direction are allowed; rows with a null are no edges.
    Each round is a large star and a small star: edges shrink towards one star per component, in about log² of the
    largest component's size rounds. Each round is written to the shared folder, so lineage stays short.
    No edges: an empty result.
    """
    now = space.save(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges-0")
    count, state = now.count(), None
    if count <= FEW:
        return now.coalesce(1).mapInArrow(_at_once, "u long, m long")
    for i in range(1, most_rounds):
        both = now.union(now.select("v", "u"))
        large = _with_minima(both, 2 * count, space, f"minima-{i}").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = space.save(large.where("u <> v").distinct(), f"large-{i}")
        small = _with_minima(large, 2 * count, space, f"minima-{i}-small")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        after = space.save(small.where("u <> v").distinct(), f"edges-{i}")
        seen = after.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        for done in (f"edges-{i - 1}", f"minima-{i}", f"large-{i}", f"minima-{i}-small"):
            space.drop(done)
        if seen == state or not seen["n"]:
            break
        count, state, now = seen["n"], seen, after
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return after.groupBy("u").agg(F.min("v").alias("m"))
