"""Rules of plans as rows: every broken rule is a row (key, rule), and a plan is valid if it has none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoframe.functions import text
from chronoframe.plans import presets

CONTIGUOUS, OVERRUN = 0.002, 0.051
#: Scenes of a plan, overlap of fragments, and how far actions may pass their bounds.
MOST_SCENES, OVERLAP, LOOSE = 100_000, 1e-7, 1e-4
CURVES = ("snap", "saddle", "linear")


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def within(x: Column, low, high) -> Column:
    return finite(x) & (x >= low) & (x <= high)


def parameter_errors(params: DataFrame, key: str) -> DataFrame:
    """params: key, name, value. Rows whose value is not finite or out of its parameter's range; unknown names go by 0 to 1."""
    table = presets.parameter_table(params.sparkSession).where("style = 'HARD'").select("name", "low", "high")
    met = params.join(F.broadcast(table), "name", "left")
    bad = ~within(F.col("value"), F.coalesce("low", F.lit(0.0)), F.coalesce("high", F.lit(1.0)))
    return met.where(bad).select(key, F.col("name").alias("rule"))


def segment_errors(segments: DataFrame, keys: list[str], order: str, target: str, video: str) -> DataFrame:
    """segments: keys, order, t0, t1, s0, s1, curve, target, video: each row's broken rules, and a plan whose end isn't the target."""
    w = Window.partitionBy(*keys).orderBy(order)
    before = F.coalesce(F.lag("t1").over(w), F.lit(0.0))
    last = F.lead("t1").over(w).isNull()
    rules = {
        "finite": ~(finite(F.col("t0")) & finite(F.col("t1")) & finite(F.col("s0")) & finite(F.col("s1"))),
        "contiguous": F.abs(F.col("t0") - before) > CONTIGUOUS,
        "forward": F.col("t1") <= F.col("t0"),
        "source": (F.least("s0", "s1") < 0.0) | (F.greatest("s0", "s1") > F.col(video) + OVERRUN),
        "curve": ~F.col("curve").isin(*CURVES),
        "coverage": last & (F.abs(F.col("t1") - F.col(target)) > CONTIGUOUS),
    }
    found = F.filter(F.array(*(F.when(test, F.lit(name)) for name, test in rules.items())), lambda x: x.isNotNull())
    return segments.select(*keys, order, found.alias("found")).select(*keys, order, F.explode("found").alias("rule"))


def plan_errors(plans: DataFrame, key: str) -> DataFrame:
    """plans: key, schema_version, style, w, h, fps, target, video, codec, format, bitrate."""
    c = F.col
    rules = {
        "version": ~c("schema_version").between(1, 4),
        "style": ~F.upper("style").isin(*presets.STYLES),
        "size": (c("w") <= 0) | (c("h") <= 0) | (c("w") % 2 != 0) | (c("h") % 2 != 0),
        "rate": ~c("fps").between(1, 120),
        "target": ~(finite(c("target")) & (c("target") > 0) & (c("target") <= 86400) & (c("target") * c("fps") >= 0.5)),
        "video": ~(finite(c("video")) & (c("video") > 0)),
        "export": ~text.valid_export(c("codec"), c("format"), c("bitrate")),
    }
    found = F.filter(F.array(*(F.when(F.coalesce(test, F.lit(True)), F.lit(name)) for name, test in rules.items())), lambda x: x.isNotNull())
    return plans.select(key, F.explode(found).alias("rule"))


def range_errors(ranges: DataFrame, keys: list[str], start: str, duration: str, source_duration: str) -> DataFrame:
    """Ranges that are not finite, empty, before zero or past their source's end."""
    s, d = F.col(start), F.col(duration)
    bad = ~finite(s) | ~finite(d) | (s < 0) | (d <= 0) | (s + d > F.col(source_duration) + OVERRUN) | F.col(source_duration).isNull()
    return ranges.where(F.coalesce(bad, F.lit(True))).select(*keys, F.lit("range").alias("rule"))


def event_errors(events: DataFrame, keys: list[str], target: str) -> DataFrame:
    """Creative events of the same kind that overlap, or lie outside the plan."""
    w = Window.partitionBy(*keys, "kind").orderBy("t0")
    bad = (F.col("t0") < F.lag("t1").over(w)) | (F.col("t0") < 0) | (F.col("t1") > F.col(target) + 1e-9) | (F.col("t1") <= F.col("t0"))
    return events.withColumn("_bad", F.coalesce(bad, F.lit(False))).where("_bad").select(*keys, "kind", "t0")


def prepared_errors(prepared: DataFrame, plan: list[str], scene: str) -> DataFrame:
    """plan, scene and rule for each rule that a prepared scene (of analysis.prepare) breaks: scene, fragment, motion or action.

    A plan of more than MOST_SCENES scenes has a row without a scene: count. A null or infinite number breaks its rule, a null
    list is an empty one, and a scene needs a fragment. The rate counts where there is a column fps. No scenes, no errors.
    """
    low, high = F.col("source_start"), F.col("source_end")

    def broken(items: str, test) -> Column:
        tests = F.transform(items, lambda x, i: F.coalesce(test(x, i), F.lit(True)))
        return F.coalesce(F.exists(tests, lambda t: t), F.lit(False))

    def fragment(x, i):
        last = F.get(F.col("fragments"), i - 1)
        begin = F.when(i == 0, low).otherwise(last["start"] + last["duration"])
        right = finite(x["start"]) & finite(x["duration"]) & (x["duration"] > 0)
        return ~right | (x["start"] < begin - OVERLAP) | (x["start"] + x["duration"] > high + OVERRUN)

    def sample(x, i):
        last = F.when(i == 0, -1.0).otherwise(F.get(F.col("motion"), i - 1)["time"])
        return ~(within(x["time"], low, high) & (x["time"] >= last) & within(x["activity"], 0.0, 1.0) & within(x["confidence"], 0.0, 1.0))

    def action(x, i):
        inside = within(x["start"], low - LOOSE, high) & within(x["end"], low, high + LOOSE) & (x["end"] > x["start"])
        return ~(inside & within(x["peak"], x["start"] - LOOSE, x["end"] + LOOSE) & within(x["activity"], -LOOSE, 1.0 + LOOSE))

    usable = finite(low) & finite(high) & (low >= 0) & (high > low) & (F.size(F.coalesce("fragments", F.array())) > 0)
    if "fps" in prepared.columns:
        usable = usable & finite(F.col("fps")) & (F.col("fps") > 0)
    rules = {"scene": ~F.coalesce(usable, F.lit(False)), "fragment": broken("fragments", fragment), "motion": broken("motion", sample), "action": broken("actions", action)}
    found = F.filter(F.array(*(F.when(test, F.lit(name)) for name, test in rules.items())), lambda x: x.isNotNull())
    errors = prepared.select(*plan, scene, F.explode(found).alias("rule"))
    many = prepared.groupBy(*plan).agg(F.count("*").alias("_n")).where(F.col("_n") > MOST_SCENES)
    return errors.unionByName(many.select(*plan, F.lit(None).cast(prepared.schema[scene].dataType).alias(scene), F.lit("count").alias("rule")))


def gate(df: DataFrame, errors: DataFrame, key: str, message: str) -> DataFrame:
    """df, or an error where a key of it has any: for sinks that must not see an invalid plan."""
    bad = errors.select(F.col(key).alias("_bad")).distinct()
    return df.join(bad, df[key] == bad["_bad"], "left").withColumn("_bad", F.when(F.col("_bad").isNotNull(), F.raise_error(F.lit(message)).cast("string"))).where("_bad is null").drop("_bad")
