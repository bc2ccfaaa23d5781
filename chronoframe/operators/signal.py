"""Runs, cuts, motion and sessions over sampled sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoframe.operators import folds

SAMPLE_RATE = 12.0
CUT_SCORE = 0.30
MOST_ACTIONS = 64


def valid_runs(frames: DataFrame, keys: list[str], t: str, blank: str, duration: str, order: list[str] = (), source: str = "us") -> DataFrame:
    """Runs of frames that are not blank, as [start, end): from the first frame to the next blank one, the last to the source's duration.

    One sort by key and time serves both windows. A last run that starts at or after the duration is dropped.
    """
    w = Window.partitionBy(*keys).orderBy(t, *order)
    run = F.sum(F.col(blank).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    closes = F.min(F.when(F.col(blank), F.col(t))).over(w.rowsBetween(0, Window.unboundedFollowing))
    marked = frames.select(*keys, F.col(t).alias("_t"), F.col(blank).alias("_blank"), F.col(duration).alias("_all"), run.alias("_run"), closes.alias("_next"))
    runs = marked.where("not _blank").groupBy(*keys, "_run").agg(F.min("_t").alias("start"), F.coalesce(F.min("_next"), F.max("_all")).alias("end"), F.count("*").alias("frames"))
    return runs.where("end > start").drop("_run")


def cuts(scored: DataFrame, keys: list[str], t: str, score: str, duration: str, least: float = 1.0, tail: float = 0.1) -> DataFrame:
    """Scores above CUT_SCORE at least `least` after the last kept cut (zero before the first), none in the last `tail` seconds."""
    strong = scored.where((F.col(score) > CUT_SCORE) & (F.col(t) < F.col(duration) - tail))
    return folds.min_gap(strong, keys, t, least, start=0.0)


def downsampled(frames: DataFrame, keys: list[str], t: str, score: str, order: list[str] = ()) -> DataFrame:
    """Frames to look at: the first, one each twelfth of a second, and every scene change."""
    return folds.sampled(frames, keys, t, score, 1 / SAMPLE_RATE, CUT_SCORE, order)


def smooth_motion(samples: DataFrame, resets: DataFrame, keys: list[str], reach: float = 0.2) -> DataFrame:
    """samples (t, activity, confidence) with each value the mean of itself and its neighbours within reach and with no reset (t) between.

    A reset belongs to the rows from its time on, so rows on different sides are in different epochs.
    """
    mark = resets.select(*keys, "t", F.lit(1).alias("_reset"), F.lit(None).cast("double").alias("activity"), F.lit(None).cast("double").alias("confidence"))
    both = samples.select(*keys, "t", F.lit(0).alias("_reset"), "activity", "confidence").unionByName(mark)
    up_to = Window.partitionBy(*keys).orderBy("t", F.desc("_reset")).rowsBetween(Window.unboundedPreceding, 0)
    rows = both.withColumn("_epoch", F.sum("_reset").over(up_to)).where("_reset = 0")
    w = Window.partitionBy(*keys, "_epoch").orderBy("t")
    near = lambda f: F.abs(f("t", 1).over(w) - F.col("t")) <= reach
    prev, after = F.coalesce(near(F.lag), F.lit(False)), F.coalesce(near(F.lead), F.lit(False))
    count = 1 + prev.cast("int") + after.cast("int")
    mean = lambda c: (F.when(prev, F.lag(c).over(w)).otherwise(0.0) + F.col(c) + F.when(after, F.lead(c).over(w)).otherwise(0.0)) / count
    return rows.select(*keys, "t", mean("activity").alias("activity"), mean("confidence").alias("confidence"))


def action_windows(samples: DataFrame, fragments: DataFrame, keys: list[str], fragment: str, most: int = MOST_ACTIONS) -> DataFrame:
    """Sessions of active samples inside a fragment, the `most` strongest per key: start, end, peak and activity.

    samples: keys, fragment, t, activity (already times confidence); fragments: keys, fragment, a0, a1. Active is 0.35 of the
    key's peak and 0.015 at least. A session goes on while a sample comes at most 0.2 after its end, which is 0.4 after the
    last sample or the fragment's end.
    """
    peak = Window.partitionBy(*keys)
    active = samples.withColumn("_peak", F.max("activity").over(peak)).where(F.col("activity") >= F.greatest(F.col("_peak") * 0.35, F.lit(0.015)))
    rows = active.join(fragments, [*keys, fragment])
    w = Window.partitionBy(*keys, fragment).orderBy("t")
    end_before = F.least(F.lag("t").over(w) + 0.4, F.col("a1"))
    fresh = F.coalesce((F.col("t") > end_before + 0.2).cast("int"), F.lit(1))
    sessions = rows.withColumn("_fresh", fresh).withColumn("_session", F.sum("_fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    first_best = F.min_by(F.col("t"), F.struct(-F.col("activity"), F.col("t")))
    made = sessions.groupBy(*keys, fragment, "_session").agg(
        F.greatest(F.min("t") - 0.35, F.min("a0")).alias("start"), F.least(F.max("t") + 0.4, F.min("a1")).alias("end"), first_best.alias("peak"), F.max("activity").alias("activity")
    )
    rank = Window.partitionBy(*keys).orderBy(F.desc("activity"), "start")
    return made.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= most).drop("_session")


def activity_profile(samples: DataFrame, pieces: DataFrame, keys: list[str], piece: list[str], width: float) -> DataFrame:
    """Per piece (piece columns, a0, a1, both ends included) the mean of capped activity and the share of active samples; zeros without samples.

    samples: keys, t, value (activity times confidence).
    """
    dealt = pieces.select("*", F.explode(F.sequence(F.floor(F.col("a0") / width), F.floor(F.col("a1") / width))).alias("_bucket"))
    met = dealt.join(samples.select(*keys, F.col("t").alias("_t"), "value", F.floor(F.col("t") / width).alias("_bucket")), [*keys, "_bucket"])
    met = met.where((F.col("_t") >= F.col("a0")) & (F.col("_t") <= F.col("a1")))
    sums = met.groupBy(*keys, *piece).agg(
        F.avg(F.least(F.col("value") / 0.18, F.lit(1.0))).alias("activity"), F.avg((F.col("value") > 0.015).cast("double")).alias("active"), F.count("*").alias("samples")
    )
    zero = {"activity": 0.0, "active": 0.0, "samples": 0}
    return pieces.join(sums, [*keys, *piece], "left").fillna(zero, list(zero))


def bin_peaks(samples: DataFrame, keys: list[str], start: str, duration: str, bins: int, lead: float = 0.35) -> DataFrame:
    """Per key and equal bin the last of its strongest samples, and where a shot of it should start: lead earlier, in the bin.

    samples: keys, t, value, and the key's start and duration.
    """
    number = F.least(F.floor((F.col("t") - F.col(start)) / F.col(duration) * bins), F.lit(bins - 1))
    low = F.col(start) + F.col("bin") * F.col(duration) / bins
    best = samples.withColumn("bin", number).groupBy(*keys, "bin", start, duration).agg(F.max(F.struct("value", "t")).alias("best"))
    return best.select(*keys, "bin", F.col("best.t").alias("peak"), F.col("best.value").alias("value"), F.greatest(F.col("best.t") - lead, low).alias("shot_start"))


def around(samples: DataFrame, keys: list[str], each_side: int = 2) -> DataFrame:
    """Adds `nearby`: the strongest value among the samples before each one and from it on, each_side of both."""
    w = Window.partitionBy(*keys).orderBy("t").rowsBetween(-each_side, each_side - 1)
    return samples.withColumn("nearby", F.greatest(F.max("value").over(w), F.lit(0.0)))
