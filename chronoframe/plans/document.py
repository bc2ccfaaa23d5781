"""Plan documents: one JSON text per plan, read with defaults for what older versions lack."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S = T.StructField
REMAP = T.StructType([_S("strength", T.DoubleType()), _S("phase_start", T.DoubleType()), _S("phase_end", T.DoubleType())])
SEGMENT = T.StructType([_S("t0", T.DoubleType()), _S("t1", T.DoubleType()), _S("s0", T.DoubleType()), _S("s1", T.DoubleType()), _S("curve", T.StringType()), _S("reverse", T.BooleanType()), _S("remap", REMAP)])
PLAN = T.StructType([_S("schema_version", T.IntegerType()), _S("plan_id", T.LongType()), _S("style", T.StringType()), _S("fps", T.IntegerType()), _S("target_duration", T.DoubleType()), _S("video_duration", T.DoubleType()), _S("loops", T.LongType()), _S("segments", T.ArrayType(SEGMENT))])


#: Lists of events that a document may hold, with their fields; each is sorted by the first.
LISTS = {"one_framers": ["t", "type"], "transitions": ["t", "type", "duration_frames", "is_wrap"], "creative_events": ["t0", "t1", "kind", "seed", "strength"], "source_ranges": ["source_id", "start", "duration"]}


def with_events(docs: DataFrame, **events: DataFrame) -> DataFrame:
    """docs (plan_id, doc) with lists of events added by name; a plan without any has an empty list. Each list's rows: plan_id and its fields."""
    for name, rows in events.items():
        own = rows.groupBy("plan_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct(*LISTS[name])))).alias("_list"))
        body = F.expr("substring(doc, 1, length(doc) - 1)")
        docs = docs.join(own, "plan_id", "left").select("plan_id", F.concat(body, F.lit(f',"{name}":'), F.coalesce("_list", F.lit("[]")), F.lit("}")).alias("doc"))
    return docs


def assemble(plans: DataFrame, segments: DataFrame) -> DataFrame:
    """plan_id and doc, the JSON of each plan with its segments in order. plans: plan_id, style, fps, target, video."""
    fields = F.struct("idx", F.struct("t0", "t1", "s0", "s1", "curve", "reverse").alias("s"))
    own = segments.groupBy("plan_id").agg(F.transform(F.array_sort(F.collect_list(fields)), lambda x: x["s"]).alias("segments"), F.sum("loops").alias("loops"))
    met = plans.join(own, "plan_id")
    doc = F.struct(F.lit(2).alias("schema_version"), "plan_id", "style", "fps", F.col("target").alias("target_duration"), F.col("video").alias("video_duration"), "loops", "segments")
    return met.select("plan_id", F.to_json(doc).alias("doc"))


def parse(docs: DataFrame, column: str = "doc") -> DataFrame:
    """The plan as columns; what a text lacks has its default, and a text that is no plan has a null version."""
    p = F.from_json(F.col(column), PLAN)
    rows = docs.select("*", p.alias("_p"))
    return rows.select(
        *docs.columns, F.col("_p.schema_version").alias("schema_version"), F.coalesce("_p.style", F.lit("HARD")).alias("style"), F.coalesce("_p.fps", F.lit(30)).alias("fps"),
        F.col("_p.target_duration").alias("target_duration"), F.col("_p.video_duration").alias("video_duration"), F.coalesce("_p.loops", F.lit(0)).alias("loops"), F.coalesce("_p.segments", F.array().cast(T.ArrayType(SEGMENT))).alias("segments"),
    )


def save(docs: DataFrame, path: str) -> None:
    """One JSON text per line; an existing path is an error, and a failed job leaves nothing."""
    docs.select("doc").write.mode("errorifexists").text(path)
