"""Raw frames as rows: pixel layouts, splitting of raw files, and a store of frames in blocks that readers can prune."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Planar formats by prefix, with how many pixels share a chroma sample across and down; the first match counts.
PLANAR = [("yuv420p", 2, 2), ("yuv422p", 2, 1), ("yuv444p", 1, 1), ("yuv440p", 1, 2), ("yuv411p", 4, 1), ("yuv410p", 4, 4), ("yuvj420p", 2, 2), ("yuvj422p", 2, 1), ("yuvj444p", 1, 1)]
PACKED = ("rgba", "bgra", "argb", "abgr", "0rgb", "0bgr")
#: Weights of the green, blue and red plane in luma.
LUMA = np.array([0.7152, 0.0722, 0.2126], dtype=np.float32)
BLOCK_SECONDS = 2.0


@dataclass(frozen=True)
class Layout:
    """How a frame's bytes are to be read: planes of samples, of which the first is luma or all three are green, blue, red."""

    depth: int
    rgb: bool
    black: int
    white: int
    mid: int | None
    size: int
    classify: bool = True

    @property
    def sample_bytes(self) -> int:
        return 2 if self.depth > 8 else 1

    def planes(self, raw: bytes, height: int, width: int) -> list[np.ndarray]:
        if len(raw) != self.size:
            raise ValueError("incomplete frame")
        samples = np.frombuffer(raw, dtype="<u2" if self.depth > 8 else np.uint8)
        n = height * width
        return [samples[i * n : (i + 1) * n].reshape(height, width) for i in range(3)] if self.rgb else [samples[:n].reshape(height, width), samples[n:]]

    def blank(self, planes: list[np.ndarray]) -> bool:
        """All samples black, or all white, with chroma in the middle; never for a layout that isn't known."""
        if not self.classify:
            return False
        first, rest = (planes, []) if self.rgb else (planes[:1], planes[1:])
        flat = any(all((p == v).all() for p in first) for v in (self.black, self.white))
        return flat and (self.mid is None or all((p == self.mid).all() for p in rest))

    def luma(self, planes: list[np.ndarray], rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
        """Luma of 0 to 255 at some rows and columns."""
        at = [p[rows[:, None], columns].astype(np.float32) * np.float32(255.0 / ((1 << self.depth) - 1)) for p in (planes if self.rgb else planes[:1])]
        return sum(a * w for a, w in zip(at, LUMA, strict=False)) if self.rgb else at[0]


def _depth(name: str, prefix: str) -> int:
    digits = ""
    for c in name[len(prefix) :]:
        if not c.isdigit():
            break
        digits += c
    return int(digits) if digits and 8 <= int(digits) <= 16 else 8


def _rgb(depth: int, n: int, classify: bool = True) -> Layout:
    return Layout(depth, True, 0, (1 << depth) - 1, None, 3 * n * (2 if depth > 8 else 1), classify)


def layout(name: str, full_range: str, width: int, height: int) -> Layout:
    """By a pixel format's name and colour range; a name that isn't known is 16-bit planes that are never blank."""
    n = width * height
    for prefix, across, down in PLANAR:
        if name.startswith(prefix):
            depth = _depth(name, prefix)
            full = full_range == "pc" or name.startswith("yuvj")
            size = (n + 2 * -(-width // across) * -(-height // down)) * (2 if depth > 8 else 1)
            return Layout(depth, False, 0 if full else 16 << (depth - 8), (1 << depth) - 1 if full else 235 << (depth - 8), 128 << (depth - 8), size)
    for prefix in ("gbrp", "gbrap"):
        if name.startswith(prefix) and not name.startswith(prefix + "f"):
            return _rgb(_depth(name, prefix), n)
    if name.startswith(("rgb", "bgr")) or name in PACKED:
        return _rgb(16 if "48" in name or "64" in name else 8, n)
    if name.startswith("gray") and not name.startswith("grayf"):
        depth = _depth(name, "gray")
        tv = full_range == "tv"
        return Layout(depth, False, 16 << (depth - 8) if tv else 0, 235 << (depth - 8) if tv else (1 << depth) - 1, None, n * (2 if depth > 8 else 1))
    return _rgb(16, n, classify=False)


def layout_names(formats: DataFrame, name: str) -> DataFrame:
    """Adds prefix, across and down of planar formats, by a join with the few prefixes; the first of the table counts."""
    rows = [(i, *p) for i, p in enumerate(PLANAR)]
    table = formats.sparkSession.createDataFrame(rows, "_order int, prefix string, across int, down int")
    # The prefixes are all letters, digits and one p: equality on what stands up to it, and no comparison of all with all.
    head = F.regexp_extract(F.col(name), r"^(yuvj?4\d\dp)", 1)
    return formats.withColumn("_head", head).join(F.broadcast(table.withColumnRenamed("prefix", "_head")), "_head", "left").withColumnRenamed("_head", "prefix").drop("_order")


def listed(spark: SparkSession, path: str) -> DataFrame:
    """Files under path with their fingerprints: path, length, modified, fingerprint. Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", F.unix_micros("modificationTime").alias("modified"))
    return files.withColumn("fingerprint", F.concat_ws(":", "path", F.col("length").cast("string"), F.col("modified").cast("string")))


def raw_frames(files: DataFrame, pixels: Layout, fps: float) -> DataFrame:
    """files (source, content): a row per frame of raw bytes. A file that ends within a frame is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if len(content) % pixels.size:
                    raise ValueError(f"source {source} ends within a frame")
                n = len(content) // pixels.size
                for at in range(0, n, 64):
                    own = range(at, min(at + 64, n))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([source] * len(own), pa.int32()), pa.array(list(own), pa.int64()), pa.array([i / fps for i in own]), pa.array([content[i * pixels.size : (i + 1) * pixels.size] for i in own], pa.binary())],
                        names=["source", "frame", "t", "pixels"],
                    )

    return files.select("source", "content").mapInArrow(run, "source int, frame long, t double, pixels binary")


def block_of(frame: Column, fps: float) -> Column:
    return F.floor(frame / (fps * BLOCK_SECONDS)).cast("int")


def store(frames: DataFrame, path: str, fps: float) -> None:
    """Frames in folders by source and block of two seconds, so that random access reads one block's folder."""
    frames.withColumn("block", block_of(F.col("frame"), fps)).repartition("source", "block").sortWithinPartitions("frame").write.partitionBy("source", "block").mode("errorifexists").parquet(path)


def fetch(spark: SparkSession, path: str, source: int, first: int, last: int, fps: float) -> DataFrame:
    """Frames first to last of a source; the filter on block prunes folders before any is read."""
    low, high = int(first // (fps * BLOCK_SECONDS)), int(last // (fps * BLOCK_SECONDS))
    return spark.read.parquet(path).where((F.col("source") == source) & F.col("block").between(low, high) & F.col("frame").between(first, last))
