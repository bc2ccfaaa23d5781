"""The driver's tables as timelines. They hold no media, so each logical input is a stated stand-in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The same as DuckDB text, to be put in front of an oracle's query.
TIMELINE_SQL = """tl AS (SELECT user_id AS tid, event_id AS eid, event_type AS type, value,
  CAST(epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id) AS DOUBLE) / 1e6 AS t FROM events)"""
SCENES_SQL = """scenes AS (SELECT o_custkey AS cid, o_orderkey AS oid, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS a0,
  CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) + 1 + o_orderkey % 7 AS DOUBLE) AS a1, o_totalprice AS price FROM orders)"""
MOTION_SQL = """motion AS (SELECT tid, eid, t / 3600.0::DOUBLE AS t, least(value / 100.0::DOUBLE, 1.0::DOUBLE) AS activity, CAST(eid % 10 AS DOUBLE) / 10.0::DOUBLE AS confidence, type FROM tl)"""


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events: one timeline per user (tid), t in seconds from its first event."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = read(spark, sf_dir, "events").select(F.col("user_id").alias("tid"), F.col("event_id").alias("eid"), F.col("event_type").alias("type"), "value", us.alias("us"))
    t = (F.col("us") - F.min("us").over(Window.partitionBy("tid"))).cast("double") / 1e6
    return rows.select("tid", "eid", "type", "value", t.alias("t"))


def motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """timeline as motion samples, an hour as a second."""
    tl = timeline(spark, sf_dir)
    return tl.select("tid", "eid", (F.col("t") / 3600.0).alias("t"), F.least(F.col("value") / 100.0, F.lit(1.0)).alias("activity"), ((F.col("eid") % 10).cast("double") / 10.0).alias("confidence"), "type")


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders: a scene per order, on its customer's timeline (cid), in days."""
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date"))
    o = read(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").alias("cid"), F.col("o_orderkey").alias("oid"), day.cast("double").alias("a0"), (day + 1 + F.col("o_orderkey") % 7).cast("double").alias("a1"), F.col("o_totalprice").alias("price"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem: segments of an order (oid) one after the other, t0 and t1 by quantity; idx from 0."""
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]
    w = Window.partitionBy("l_orderkey").orderBy(*order)
    t1 = F.sum("l_quantity").over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = read(spark, sf_dir, "lineitem")
    return rows.select(
        F.col("l_orderkey").alias("oid"), (F.row_number().over(w) - 1).cast("long").alias("idx"), (t1 - F.col("l_quantity")).alias("t0"), t1.alias("t1"),
        F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"),
    )


LINES_SQL = """lines AS (SELECT l_orderkey AS oid, row_number() OVER w - 1 AS idx, sum(l_quantity) OVER (w ROWS UNBOUNDED PRECEDING) - l_quantity AS t0, sum(l_quantity) OVER (w ROWS UNBOUNDED PRECEDING) AS t1,
  l_extendedprice AS price, l_discount AS discount, l_tax AS tax, l_partkey AS part, l_suppkey AS supp, l_returnflag AS flag, l_linestatus AS status FROM lineitem
  WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate))"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as 8 x 8 luma frames of bytes: source is the label, frame the vec_id, px an array of 64 numbers 0 to 255."""
    px = F.transform("embedding", lambda x: F.least(F.greatest(F.floor((x.cast("double") + 1.0) * 127.5), F.lit(0)), F.lit(255)).cast("int"))
    return read(spark, sf_dir, "embeddings").select(F.col("label").alias("source"), F.col("vec_id").alias("frame"), px.alias("px"))


FRAMES_SQL = """frames AS (SELECT label AS source, vec_id AS frame, list_transform(embedding, lambda x: CAST(least(greatest(floor((CAST(x AS DOUBLE) + 1.0::DOUBLE) * 127.5::DOUBLE), 0), 255) AS INTEGER)) AS px FROM embeddings)"""
