"""What is to be drawn: one row per output frame with its source frame, its speed and the parameters of its effects."""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoframe.functions import curves as cv
from chronoframe.functions.numbers import clamp, half_up


def frame_table(segments: DataFrame, keys: list[str], fps: int, blur: bool = True) -> DataFrame:
    """segments (keys, idx, t0, t1, s0, s1, curve, strength, phase_start, phase_end; the last three may be null) as output frames.

    Segments expand into their own frames, so no frame looks for its segment. Each row has t, x (place in the segment), u
    and slope of the curve, source_t, speed and how many source frames are blended. Reversed segments read just before
    their boundary. Frames at the very end belong to the last segment.
    """
    last = F.max("idx").over(Window.partitionBy(*keys)) == F.col("idx")
    first = F.ceil(F.col("t0") * fps - 1e-9)
    after = F.when(last, F.ceil(F.col("t1") * fps - 0.5) - 1).otherwise(F.ceil(F.col("t1") * fps - 1e-9) - 1)
    rows = segments.withColumn("_a", first).withColumn("_b", after).where("_b >= _a")
    rows = rows.select(*[c for c in segments.columns], F.explode(F.sequence("_a", "_b")).alias("frame")).withColumn("t", F.col("frame") / float(fps))
    length = F.greatest(F.col("t1") - F.col("t0"), F.lit(1e-6))
    rows = rows.withColumn("t_rel", F.greatest(F.col("t") - F.col("t0"), F.lit(0.0))).withColumn("length", length).withColumn("x", clamp(F.col("t_rel") / F.col("length"), 0.0, 1.0))
    value, slope = cv.remapped(F.col("curve"), F.col("x"), F.col("strength"), F.col("phase_start"), F.col("phase_end"))
    rows = rows.withColumn("u", value).withColumn("slope", slope)
    source = F.col("s0") + (F.col("s1") - F.col("s0")) * F.col("u")
    rows = rows.withColumn("source_t", F.when(F.col("s1") < F.col("s0"), F.greatest(source - 1e-7, F.lit(0.0))).otherwise(source))
    rows = rows.withColumn("speed", F.abs(F.col("s1") - F.col("s0")) / F.col("length") * F.col("slope"))
    return rows.withColumn("blend", cv.blur_frames(F.col("speed"), F.lit(blur)))


def source_frame(t: Column, before: Column, first: Column, frames: Column, fps: Column) -> Column:
    """The number of the frame shown at a time of a range that begins `before` seconds into the source and holds `frames` from `first`."""
    return F.least(F.greatest(first + half_up((t - before) * fps).cast("long"), first), first + frames - 1)


def alternate_frame(base: Column, seed: Column, fps: Column, reverse: Column, low: Column, high: Column) -> Column:
    """The delayed frame that panels show: a few hundredths of a second back (ahead in reverse), inside its shot; the frame itself where the shot has none."""
    delay = F.greatest(half_up(fps * (0.08 + (seed % 5).cast("double") * 0.015)), F.lit(1.0)).cast("long")
    moved = base + F.when(reverse, delay).otherwise(-delay)
    return F.when(low <= high, F.least(F.greatest(moved, low), high)).otherwise(base)


def bmp(rgb: np.ndarray) -> bytes:
    """A frame as an uncompressed bitmap: rows from the top, blue first, padded to four bytes."""
    h, w, _ = rgb.shape
    rows = np.zeros((h, -(-w * 3 // 4) * 4), dtype=np.uint8)
    rows[:, : w * 3] = rgb[..., ::-1].reshape(h, -1)
    head = struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 54 + rows.size, 0, 0, 54, 40, w, -h, 1, 24, 0, rows.size, 2835, 2835, 0, 0)
    return head + rows.tobytes()


def data_url(content: Column, kind: str = "image/bmp") -> Column:
    return F.concat(F.lit(f"data:{kind};base64,"), F.regexp_replace(F.base64(content), r"\s", ""))
