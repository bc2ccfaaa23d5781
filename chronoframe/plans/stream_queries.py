"""Queries over streams of the events table, run to the end of what is there."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoframe.plans.registry import query
from chronoframe.sources.tables import FRAMES_SQL
from chronoframe.streaming import runs


def _stream(spark, sf_dir, table):
    """A table's file or folder as a stream of files."""
    path = f"{sf_dir}/{table}.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/{table}*.parquet")


@query("""WITH f AS (SELECT user_id AS tid, event_id AS eid, CAST(epoch_us(ts) AS DOUBLE) / 1e6 AS t, event_type = 'error' AS blank FROM events),
r AS (SELECT *, coalesce(sum(CAST(blank AS INT)) OVER (PARTITION BY tid ORDER BY t, eid ROWS UNBOUNDED PRECEDING), 0) AS run, min(CASE WHEN blank THEN t END) OVER (PARTITION BY tid ORDER BY t, eid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nxt, max(t) OVER (PARTITION BY tid) + 1 AS duration FROM f)
SELECT tid, min(t) AS "start", coalesce(min(nxt), max(duration)) AS "end", count(*) AS frames FROM r WHERE NOT blank GROUP BY tid, run HAVING coalesce(min(nxt), max(duration)) > min(t)""")
def stream_valid_runs(spark, sf_dir):
    """Runs of frames that are not blank, the last one closed by the marker that its source ends with."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    t = F.unix_micros(F.col("ts").cast("timestamp")).cast("double") / 1e6
    frames = e.select(F.col("user_id").alias("tid"), F.col("event_id").alias("eid"), t.alias("t"), (F.col("event_type") == "error").alias("blank"))
    marked = runs.with_ends(frames, frames.groupBy("tid").agg((F.max("t") + 1).alias("t")))
    place = f"{runs.folder(spark)}/frames"
    marked.write.parquet(place)
    return runs.drain(runs.valid_runs(spark.readStream.schema(marked.schema).parquet(place)), runs.RUNS).where("error is null").drop("error")


@query("""WITH x AS (SELECT user_id, epoch_us(ts) AS u, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w > 1800000000 OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
y AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY u ROWS UNBOUNDED PRECEDING) AS s FROM x) SELECT user_id, count(*) AS events, min(u) AS first_us, max(u) AS last_us FROM y GROUP BY user_id, s""")
def stream_sessions(spark, sf_dir):
    e = _stream(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    made = runs.drain(runs.sessions(e, "user_id", "ts"), mode="complete")
    return made.select("user_id", "events", F.unix_micros("first").alias("first_us"), F.unix_micros("last").alias("last_us"))


@query(f"""WITH {FRAMES_SQL}, e AS (SELECT source, frame, px, lag(px, 1) OVER w AS p1, lag(px, 2) OVER w AS p2, lag(px, 3) OVER w AS p3 FROM frames WINDOW w AS (PARTITION BY source ORDER BY frame))
SELECT source, frame, array_to_string(list_transform(range(1, 65), lambda i: CAST(((256 - 76) * px[i] + 76 * ((coalesce(p1[i], 128) + coalesce(p2[i], 128) + coalesce(p3[i], 128)) // 3)) >> 8 AS INTEGER)), ',') AS px FROM e""")
def stream_echo_trail(spark, sf_dir):
    px = F.transform("embedding", lambda x: F.least(F.greatest(F.floor((x.cast("double") + 1.0) * 127.5), F.lit(0)), F.lit(255)).cast("int"))
    frames = _stream(spark, sf_dir, "embeddings").select(F.col("label").alias("source"), F.col("vec_id").alias("frame"), px.alias("px"))
    return runs.drain(runs.echo_trail(frames))
