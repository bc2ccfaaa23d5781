"""Runs, sessions and echo trails over streams of frames.

Order is part of the input: a frame that comes before one already seen is an error row and changes nothing. State per key is
a few numbers (or the last few frames), so a stream can go on for ever.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

RUNS = "tid long, start double, end double, frames long, error string"


def folder(spark: SparkSession) -> str:
    """A folder of its own in the shared one that the cluster names, or in a temporary one where none is named."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        base = "file://" + tempfile.mkdtemp(prefix="chronoframe-stream-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex[:12]}"


def _runs(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    start, count, seen = state.get if state.exists else (None, 0, None)
    out = []
    rows = pd.concat(list(batches)).sort_values(["t", "eid"], kind="stable")
    for t, blank in zip(rows["t"].tolist(), rows["blank"].tolist(), strict=True):
        if seen is not None and t < seen:
            out.append((key[0], t, None, 0, "frames out of order"))
            continue
        seen = t
        if blank:
            if start is not None and t > start:
                out.append((key[0], start, t, count, None))
            start, count = None, 0
        else:
            start, count = (t if start is None else start), count + 1
    state.update((start, count, seen))
    yield pd.DataFrame(out, columns=["tid", "start", "end", "frames", "error"]).astype({"tid": "int64", "start": "float64", "end": "float64", "frames": "int64"})


def with_ends(frames: DataFrame, ends: DataFrame) -> DataFrame:
    """frames with the marker that a source ends with: a blank frame at its duration (tid, t), which closes its last run."""
    last = F.lit((1 << 63) - 1).cast("long")
    return frames.unionByName(ends.select("tid", last.alias("eid"), "t", F.lit(True).alias("blank")))


def valid_runs(frames: DataFrame) -> DataFrame:
    """frames (a stream): tid, eid, t, blank. Each run of frames that are not blank, once the blank frame that ends it has come. A source's last run needs the marker of with_ends."""
    return frames.groupBy("tid").applyInPandasWithState(_runs, RUNS, "start double, count long, seen double", "append", GroupStateTimeout.NoTimeout)


def sessions(events: DataFrame, key: str, ts: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of a key's events; events later than `late` behind the newest are dropped once their session is out."""
    w = F.session_window(ts, gap)
    return events.withWatermark(ts, late).groupBy(key, w.alias("w")).agg(F.count("*").alias("events"), F.min(ts).alias("first"), F.max(ts).alias("last")).drop("w")


def joined_frames(pixels: DataFrame, marks: DataFrame, late: str = "10 seconds") -> DataFrame:
    """Two streams of the same decoder, frames and their metadata, brought together by source and number within a watermark."""
    a = pixels.withWatermark("ts", late).alias("a")
    b = marks.withWatermark("ts", late).withColumnRenamed("ts", "mark_ts").alias("b")
    span = F.expr(f"mark_ts BETWEEN ts - INTERVAL {late} AND ts + INTERVAL {late}")
    return a.join(b, (F.col("a.source") == F.col("b.source")) & (F.col("a.frame") == F.col("b.frame")) & span).select("a.source", "a.frame", "a.ts", "score")


def _echo(depth: int, alpha: int) -> Callable:
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("frame", kind="stable")
        own = np.stack([np.asarray(x, dtype=np.int64) for x in rows["px"]])
        past = np.array([list(x) for x in state.get[0]], dtype=np.int64) if state.exists else np.full((depth, own.shape[1]), 128)
        line = np.concatenate([past[::-1], own])  # the latest frame of the state stands just before the first of these
        before = sum(line[depth - k : depth - k + len(own)] for k in range(1, depth + 1)) // depth
        mixed = ((256 - alpha) * own + alpha * before) >> 8
        state.update((line[-depth:][::-1].tolist(),))
        yield pd.DataFrame({"source": key[0], "frame": rows["frame"].to_numpy(), "px": [",".join(map(str, x)) for x in mixed.tolist()]})

    return step


def echo_trail(frames: DataFrame, depth: int = 3, alpha: int = 76) -> DataFrame:
    """frames (a stream): source, frame, px. Each with a share of the mean of the `depth` before it; the ring of them is the state."""
    return frames.groupBy("source").applyInPandasWithState(_echo(depth, alpha), "source int, frame long, px string", "ring array<array<int>>", "append", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, schema: str | None = None, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now into files of the shared folder, and return them. mode complete keeps the last result."""
    spark = stream.sparkSession
    place = folder(spark)
    if mode == "append":
        writer = stream.writeStream.format("parquet").option("path", f"{place}/out")
    else:
        writer = stream.writeStream.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{place}/out"))
    running = writer.outputMode(mode).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.schema(schema or stream.schema).parquet(f"{place}/out")
