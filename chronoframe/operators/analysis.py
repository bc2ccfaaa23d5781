"""Analysis of sources: one ordered pass over frames, then runs, cuts, smoothed motion and sessions as DataFrames."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoframe.operators import intervals as iv
from chronoframe.operators import kernels, signal
from chronoframe.sources.frames import Layout

_PASS = "source int, t double, blank boolean, cut boolean, sampled boolean, activity double, confidence double, duration double"


@dataclass
class Analysis:
    """fragments (source, start, end), motion (source, t, activity, confidence), cuts (source, t), counts (source, decoded, removed, duration)."""

    fragments: DataFrame
    motion: DataFrame
    cuts: DataFrame
    counts: DataFrame


def scan(frames: DataFrame, layout: Layout, height: int, width: int, remove_blank: bool = True) -> DataFrame:
    """frames: source, frame, t, score, duration, pixels. A row per frame: blank, cut, and motion where it was sampled.

    Frames of a source pass in order; the state is the last sampled picture. Times that do not rise, or lie outside the
    source, are an error. A blank frame and a cut forget the picture before them.
    """
    rows, columns = kernels.sample_places(height, width)
    step = 1 / signal.SAMPLE_RATE - 1e-6

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seen, picture, sampled_at = None, None, None, -1.0
        for batch in batches:
            out = []
            for source, t, score, duration, raw in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if source != now:
                    now, seen, picture, sampled_at = source, None, None, -1.0
                if t < -0.001 or t > duration + 0.1 or (seen is not None and t <= seen):
                    raise ValueError(f"times of source {source} do not rise or lie outside it")
                t = seen = max(t, 0.0)
                planes = layout.planes(raw, height, width)
                blank, cut = remove_blank and layout.blank(planes), score > signal.CUT_SCORE
                if blank or cut:
                    picture = None
                sampled = not blank and (t - sampled_at >= step or cut)
                moved = (None, None)
                if sampled:
                    luma = layout.luma(planes, rows, columns)
                    moved = kernels.motion_score(picture, luma) if picture is not None else (0.0, 0.0)
                    picture, sampled_at = luma, t
                out.append((source, t, blank, cut, sampled, *moved, duration))
            kinds = [pa.int32(), pa.float64(), pa.bool_(), pa.bool_(), pa.bool_(), pa.float64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], names=[x.split()[0] for x in _PASS.split(", ")])

    dealt = frames.select("source", "t", "score", "duration", "pixels").repartition("source").sortWithinPartitions("source", "t")
    return dealt.mapInArrow(run, _PASS)


def analyse(scanned: DataFrame, remove_blank: bool = True) -> Analysis:
    """What a scan says of each source. With blank frames kept, a source is one fragment and cuts may be closer."""
    w = Window.partitionBy("source").orderBy("t")
    if remove_blank:
        fragments = signal.valid_runs(scanned, ["source"], "t", "blank", "duration").select("source", "start", "end")
    else:
        fragments = scanned.groupBy("source").agg(F.max("duration").alias("end")).select("source", F.lit(0.0).alias("start"), "end")
    scored = scanned.where("cut").select("source", "t", F.lit(1.0).alias("score"), "duration")
    cuts = signal.cuts(scored, ["source"], "t", "score", "duration", least=1.0 if remove_blank else 0.15).select("source", "t")
    ends = scanned.groupBy("source").agg(F.max("duration").alias("duration"))
    cuts = cuts.union(ends.select("source", F.lit(0.0))).union(ends.select("source", "duration"))
    before = F.lag("blank").over(w)
    turns = scanned.withColumn("_turn", F.coalesce(F.col("blank") != before, F.col("blank")) | F.col("cut")).where("_turn").select("source", "t")
    samples = scanned.where("sampled").select("source", "t", "activity", "confidence")
    motion = signal.smooth_motion(samples, turns.union(ends.select("source", F.lit(0.0))).distinct(), ["source"])
    counts = scanned.groupBy("source").agg(F.count("*").alias("decoded"), F.count(F.when(F.col("blank"), 1)).alias("removed"), F.max("duration").alias("duration"))
    return Analysis(fragments, motion, cuts, counts)


def by_cuts(selections: DataFrame, cuts: DataFrame) -> DataFrame:
    """Selections (source, b0, b1) cut at every cut of their source; scenes are numbered by the cut before them."""
    w = Window.partitionBy("source").orderBy("t")
    between = cuts.select("source", F.col("t").alias("a0"), F.lead("t").over(w).alias("a1"), (F.row_number().over(w) - 1).alias("scene_id")).where("a1 > a0")
    met = iv.join_overlapping(between, selections.select("source", "b0", "b1"), ["source"], 60.0)
    return met.select("source", "scene_id", F.greatest("a0", "b0").alias("b0"), F.least("a1", "b1").alias("b1"))


def prepare(analysis: Analysis, selections: DataFrame) -> DataFrame:
    """Prepared scenes: selections (source, scene_id, b0, b1) with the fragments, motion and actions that lie in them.

    A selection without usable fragments has no row. Order is that of the selection's place, kept in `position` where the
    selections have it.
    """
    keys = ["source", "scene_id"]
    place = ["position"] if "position" in selections.columns else []
    asked = selections.select(*keys, "b0", "b1", *place)
    clipped = iv.clip(analysis.fragments.select("source", F.col("start").alias("a0"), F.col("end").alias("a1")), asked, ["source"], 60.0)
    pieces = clipped.select(*keys, "b0", "b1", *place, F.col("start").alias("a0"), F.col("end").alias("a1"))
    numbered = pieces.withColumn("fragment", F.row_number().over(Window.partitionBy(*keys).orderBy("a0")))
    # Pieces and samples meet in buckets of a minute, so a long source is many keys and not one.
    dealt = numbered.withColumn("_bucket", F.explode(iv.buckets(F.col("a0"), F.col("a1"), 60.0)))
    samples = analysis.motion.withColumn("_bucket", F.floor(F.col("t") / 60.0))
    met = dealt.hint("merge").join(samples, ["source", "_bucket"]).where((F.col("t") >= F.col("a0")) & (F.col("t") < F.col("a1")))
    inside = met.select(*keys, "fragment", "t", "activity", "confidence")
    actions = signal.action_windows(inside.select(*keys, "fragment", "t", (F.col("activity") * F.col("confidence")).alias("activity")), numbered.select(*keys, "fragment", "a0", "a1"), keys, "fragment")
    listed = lambda df, name, *fields: df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
    parts = numbered.groupBy(*keys).agg(*(F.min(c).alias(c) for c in place), F.min("b0").alias("source_start"), F.max("b1").alias("source_end"), F.array_sort(F.collect_list(F.struct(F.col("a0").alias("start"), (F.col("a1") - F.col("a0")).alias("duration")))).alias("fragments"))
    motion = listed(inside, "motion", F.col("t").alias("time"), "activity", "confidence")
    acts = listed(actions, "actions", "start", "end", "peak", "activity")
    scenes = parts.join(motion, keys, "left").join(acts, keys, "left")
    usable = F.aggregate("fragments", F.lit(0.0), lambda a, f: a + f["duration"])
    return scenes.select(*place, F.col("scene_id"), F.col("source").alias("source_id"), "source_start", "source_end", "fragments", F.coalesce("motion", F.array().cast(scenes.schema["motion"].dataType)).alias("motion"), F.coalesce("actions", F.array().cast(scenes.schema["actions"].dataType)).alias("actions"), usable.alias("usable"))


def fresh_sources(sources: DataFrame, cache: DataFrame, version: int, remove_blank: bool) -> DataFrame:
    """Sources (source, fingerprint) that no cached analysis of this version and kind covers."""
    known = cache.where((F.col("version") == version) & (F.col("remove_blank") == remove_blank)).select("fingerprint").distinct()
    return sources.join(known, "fingerprint", "left_anti")


def by_selection(prepared: DataFrame, selections: DataFrame, plan: list[str]) -> DataFrame:
    """Adds place, by which scenes are ordered: the least position of a selection (plan, source_id, scene_id, position) of the scene.

    A scene that was not selected takes its own number. Scenes of one place keep the order they came in.
    """
    keys = [*plan, "source_id", "scene_id"]
    first = selections.groupBy(*keys).agg(F.min("position").alias("_first"))
    return prepared.join(first, keys, "left").withColumn("place", F.coalesce("_first", F.col("scene_id"))).drop("_first")
