"""Facts of sources and plans as tables: what probers found, galleries, thumbnails, shots, names and picked clips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoframe.functions.numbers import half_up, to_places
from chronoframe.operators import folds
from chronoframe.operators import intervals as iv

#: A rate this close to a whole number is that number.
WHOLE = 0.05
#: Score of a cut, least seconds between cuts, and how near to either end none counts.
SCENE_SCORE, SCENE_GAP, SCENE_EDGE, SCENE_TAIL = 0.30, 1.0, 0.5, 0.1


def probed(rows: DataFrame, probers: list[str], fps: str) -> DataFrame:
    """Adds duration, that of the first prober (columns in order) that has one, its name as prober, and the rate made whole."""
    whole = half_up(F.col(fps))
    named = F.coalesce(*(F.when(F.col(p).isNotNull(), F.lit(p)) for p in probers))
    rate = F.when(F.abs(F.col(fps) - whole) < WHOLE, whole).otherwise(F.col(fps))
    return rows.withColumn("duration", F.coalesce(*probers)).withColumn("prober", named).withColumn(fps, rate)


def track_durations(packets: DataFrame, keys: list[str], track: str, ticks: str, rate: str) -> DataFrame:
    """keys and packets: the longest track of a file, each the sum of its packets' ticks over its ticks a second."""
    own = packets.groupBy(*keys, track).agg((F.sum(ticks) / F.max(rate)).alias("_own"))
    return own.groupBy(*keys).agg(F.max("_own").alias("packets"))


def gallery(scenes: DataFrame, keys: list[str], order: list[str], a0: str, a1: str) -> DataFrame:
    """A row per scene: its number, its place on the timeline of all, and the time of its picture (35 % into it)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    own = scenes.withColumn("_len", F.col(a1) - F.col(a0))
    placed = iv.offsets(own, keys, order, "_len", "clip_start").withColumn("clip", (F.row_number().over(w) - 1).cast("long"))
    placed = placed.withColumn("clip_end", F.col("clip_start") + F.col("_len"))
    return placed.withColumn("thumb_t", to_places(F.col(a0) + F.col("_len") * 0.35, 3)).drop("_len")


def strongest(motion: DataFrame, keys: list[str], t: str, value: str) -> DataFrame:
    """keys, thumb_t and activity: the time of the greatest value, the earliest of equals; 0 and 0 where all are null."""
    key = F.when(F.col(value).isNotNull(), F.struct(-F.col(value), F.col(t)))
    best = motion.groupBy(*keys).agg(F.min_by(t, key).alias("_t"), F.max(value).alias("_v"))
    return best.select(*keys, F.when(F.col("_v").isNotNull(), F.col("_t")).otherwise(0.0).alias("thumb_t"), F.coalesce("_v", F.lit(0.0)).alias("activity"))


def sessions(rows: DataFrame, keys: list[str], t: str, gap: float) -> DataFrame:
    """start, end and events of runs of rows with gaps of at most `gap`."""
    w = Window.partitionBy(*keys).orderBy(t)
    marked = rows.withColumn("_fresh", F.coalesce((F.col(t) > F.lag(t).over(w) + gap).cast("int"), F.lit(1)))
    numbered = marked.withColumn("_s", F.sum("_fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "_s").agg(F.min(t).alias("start"), F.max(t).alias("end"), F.count("*").alias("events")).drop("_s")


def held(rows: DataFrame, keys: list[str], order: list[str], kind: str, value: str) -> DataFrame:
    """Adds held: how much of the same kind has come in a row, up to each row."""
    run = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - F.row_number().over(Window.partitionBy(*keys, kind).orderBy(*order))
    w = Window.partitionBy(*keys, kind, "_run").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_run", run).withColumn("held", F.sum(value).over(w)).drop("_run")


def shots_of(segments: DataFrame, keys: list[str], order: str, scene: str, gap: float = 0.003) -> DataFrame:
    """shot, t0, t1 and segments: segments of one scene that follow each other without a gap are one shot."""
    w = Window.partitionBy(*keys).orderBy(order)
    fresh = F.coalesce(((F.col(scene) != F.lag(scene).over(w)) | (F.abs(F.col("t0") - F.lag("t1").over(w)) >= gap)).cast("int"), F.lit(1))
    marked = segments.withColumn("_fresh", fresh).withColumn("shot", F.sum("_fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))
    return marked.groupBy(*keys, "shot").agg(F.min("t0").alias("t0"), F.max("t1").alias("t1"), F.count("*").alias("segments"))


def by_turns(segments: DataFrame, index: str, low: float, high: float) -> DataFrame:
    """Adds scale_start, scale_end and curve: even segments go in and snap, odd ones go out and ease."""
    even = F.col(index) % 2 == 0
    scaled = segments.withColumn("scale_start", F.when(even, low).otherwise(high)).withColumn("scale_end", F.when(even, high).otherwise(low))
    return scaled.withColumn("curve", F.when(even, "snap").otherwise("saddle"))


def unused_names(requests: DataFrame, taken: DataFrame, base: str = "base", ending: str = "ending") -> DataFrame:
    """Adds name: base.ending, or base-N.ending with the least N from 1 on that no row of taken (name) has. One request per base and ending.

    The names of a base are numbered 0 (none), 1, ... in order; the first whose number is not its place leaves a gap.
    """
    keys = [base, ending]
    whole = F.concat_ws(".", base, ending)
    asked = requests.select(*keys).distinct()
    parts = taken.select("name", F.regexp_extract("name", r"^(.*?)(?:-([1-9][0-9]{0,8}))?\.([^.]*)$", 2).alias("_n"))
    stem = F.when(F.col("_n") != "", F.regexp_replace("name", r"-[1-9][0-9]{0,8}\.([^.]*)$", ".$1")).otherwise(F.col("name"))
    # A name can be a base of its own ("a-1") or the numbered one of another ("a"): it counts as both.
    numbered = parts.select(stem.alias("_whole"), F.when(F.col("_n") != "", F.col("_n")).otherwise("0").cast("long").alias("_k"))
    both = numbered.union(parts.where("_n <> ''").select(F.col("name").alias("_whole"), F.lit(0).cast("long").alias("_k"))).distinct()
    met = asked.withColumn("_whole", whole).join(both, "_whole")
    w = Window.partitionBy(*keys).orderBy("_k")
    placed = met.withColumn("_place", F.row_number().over(w) - 1)
    run = placed.where("_k = _place").groupBy(*keys).agg(F.count("*").alias("_free"))
    free = F.coalesce("_free", F.lit(0))
    named = F.when(free == 0, whole).otherwise(F.concat(F.col(base), F.lit("-"), free.cast("string"), F.lit("."), F.col(ending)))
    return requests.join(run, keys, "left").withColumn("name", named).drop("_free")


def cut_positions(segments: DataFrame, cuts: DataFrame, keys: list[str], index: str, near: float = 1e-6) -> DataFrame:
    """Cuts (keys, t) with position, the first segment that begins within `near` of it; other cuts have no row.

    A cut meets segments by the number of its millisecond and the two beside it, so it is an equi-join.
    """
    grain = lambda x: F.floor(x * 1000.0)
    starts = segments.select(*keys, F.col(index).alias("_i"), F.col("t0").alias("_t0"), grain(F.col("t0")).alias("_g"))
    asked = cuts.select(*keys, "t", F.explode(F.array(*(grain(F.col("t")) + k for k in (-1, 0, 1)))).alias("_g"))
    met = asked.hint("merge").join(starts, [*keys, "_g"]).where(F.abs(F.col("_t0") - F.col("t")) < near)
    return met.groupBy(*keys, "t").agg(F.min("_i").alias("position"))


def detected_scenes(scored: DataFrame, keys: list[str], t: str, score: str, duration: str) -> DataFrame:
    """keys and t: 0, the cuts, and the duration, in hundredths of a second.

    A cut scores above SCENE_SCORE, is more than SCENE_EDGE from both ends and SCENE_GAP or more after the last one as it was
    rounded. The duration is left out where the last cut is within SCENE_TAIL of it.
    """
    places = lambda x: half_up(x * 100.0) / 100.0

    def rule(times, state):
        import numpy as np

        kept = np.zeros(len(times), dtype=bool)
        last, at = state.get("last", 0.0), 0
        while True:
            at += int(np.searchsorted(times[at:], last + SCENE_GAP - 1e-9, side="left"))
            while at < len(times) and times[at] - last < SCENE_GAP:
                at += 1
            if at >= len(times):
                state["last"] = last
                return kept
            kept[at], last = True, np.floor(times[at] * 100.0 + 0.5) / 100.0
            at += 1

    able = scored.where((F.col(score) > SCENE_SCORE) & (F.col(t) > SCENE_EDGE) & (F.col(t) < F.col(duration) - SCENE_EDGE))
    cuts = folds.keep_where(able.select(*keys, F.col(t).alias("t")), keys, ["t"], ["t"], rule).select(*keys, places(F.col("t")).alias("t"))
    every = scored.groupBy(*keys).agg(F.max(duration).alias("_d"))
    last = every.join(cuts.groupBy(*keys).agg(F.max("t").alias("_last")), keys, "left")
    ends = last.where(F.coalesce("_last", F.lit(0.0)) < F.col("_d") - SCENE_TAIL).select(*keys, places(F.col("_d")).alias("t"))
    return cuts.unionByName(ends).unionByName(every.select(*keys, F.lit(0.0).alias("t")))


def picked_clips(clips: DataFrame, many: Column) -> DataFrame:
    """scene_id, source_id, start and end of picked clips (index, source, start, end, source_duration): whole sources where a plan has many."""
    start, end = F.when(many, 0.0).otherwise(F.col("start")), F.when(many, F.col("source_duration")).otherwise(F.col("end"))
    rest = [c for c in clips.columns if c not in ("index", "source", "start", "end", "source_duration")]
    return clips.select(*rest, F.col("index").alias("scene_id"), F.col("source").alias("source_id"), start.alias("start"), end.alias("end"))


BEATS = "beats array<double>, downbeats array<double>, bpm double"


def beat_times(text: Column) -> Column:
    """beats, downbeats (in order, finite ones from 0 on) and bpm of a beat detector's JSON; empty lists and 120 for what it lacks."""
    found = F.from_json(text, BEATS)
    times = lambda name: F.array_sort(F.filter(F.coalesce(found[name], F.array().cast("array<double>")), lambda x: x.isNotNull() & ~F.isnan(x) & (x >= 0.0)))
    bpm = F.when((found["bpm"] > 0.0) & (found["bpm"] < float("inf")), found["bpm"]).otherwise(120.0)
    return F.struct(times("beats").alias("beats"), times("downbeats").alias("downbeats"), bpm.alias("bpm"))


def long_clip_parts(video: Column, audio: Column) -> Column:
    """(start, length) of the parts of a long source that a plan may use: two to eight of four seconds each, evenly spread."""
    count = F.least(F.greatest(F.floor(audio / 3.25 + 0.5), F.lit(2)), F.lit(8)).cast("int")
    step = F.greatest(video - 3.5, F.lit(0.0)) / F.greatest(count - 1, F.lit(1))
    part = lambda i: F.struct((i * step).alias("start"), F.least(F.lit(4.0), video - i * step).alias("length"))
    whole = F.array(F.struct(F.lit(0.0).alias("start"), F.least(video, audio + 2.0).alias("length")))
    return F.when(video > audio, F.transform(F.sequence(F.lit(0), count - 1), part)).otherwise(whole)
