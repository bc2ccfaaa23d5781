"""Queries over frames of pixels."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from chronoframe.functions import curves as cv
from chronoframe.functions.numbers import to_places
from chronoframe.operators import analysis, kernels, previews, render
from chronoframe.plans.event_queries import D, r6
from chronoframe.plans.registry import query
from chronoframe.sources.frames import layout
from chronoframe.sources.tables import FRAMES_SQL, frames, read


@query(f"""WITH {FRAMES_SQL} SELECT source, frame, (list_min(px) = list_max(px)) AS flat, (list_max(px) < 140) AS dark, (list_min(px) > 110) AS light, CAST(len(list_filter(px, lambda x: x > 140)) AS INTEGER) AS bright, {r6("list_sum(px)::DOUBLE / 64.0::DOUBLE")} AS mean,
{r6(f"list_sum(px)::DOUBLE / 64.0{D} - lag(list_sum(px)::DOUBLE / 64.0{D}, 1, 128.0{D}) OVER (PARTITION BY source ORDER BY frame)")} AS exposure FROM frames""")
def frame_blank(spark, sf_dir):
    """Tests that hold for all samples of a frame stop at the first that fails."""
    mean = F.aggregate("px", F.lit(0), lambda a, x: a + x).cast("double") / 64.0
    rows = frames(spark, sf_dir).withColumn("mean", mean)
    w = Window.partitionBy("source").orderBy("frame")
    return rows.select(
        "source", "frame", F.forall("px", lambda x: x == F.col("px")[0]).alias("flat"), F.forall("px", lambda x: x < 140).alias("dark"), F.forall("px", lambda x: x > 110).alias("light"),
        F.size(F.filter("px", lambda x: x > 140)).alias("bright"), to_places(F.col("mean"), 6).alias("mean"), to_places(F.col("mean") - F.lag("mean", 1, 128.0).over(w), 6).alias("exposure"),
    )


_RGB = "list_transform(range(0, 16), lambda i: {body})"


def _pixel(body: str) -> str:
    for k, c in enumerate("RGB", 1):
        body = body.replace(f"@{c}", f"px[3 * i + {k}]")
    return _RGB.replace("{body}", body)


def joined(px):
    """Numbers as text, which every engine compares alike."""
    return F.array_join(F.transform(px, lambda x: x.cast("string")), ",")


@query(f"""WITH {FRAMES_SQL} SELECT frame, array_to_string({_pixel("255 - ((@R * 77 + @G * 150 + @B * 29) >> 8)")}, ',') AS inverted, array_to_string(list_transform(px[1:48], lambda x: least((x * 2 + 2040) // 10, 255)), ',') AS white, array_to_string(list_transform(px[1:48], lambda x: x * 2 // 10), ',') AS black,
array_to_string(list_transform(range(0, 48), lambda i: least((px[i + 1] * [135, 120, 105][i % 3 + 1] + [4000, 2000, 500][i % 3 + 1]) // 100, 255)), ',') AS tinted FROM frames""")
def pixel_flash_invert(spark, sf_dir):
    """The first 48 numbers as 16 pixels; every effect is an expression over the array."""
    px = F.slice("px", 1, 48)
    at = lambda i, k: F.get(F.col("px"), i * 3 + k)
    grey = lambda i: F.shiftright(at(i, 0) * 77 + at(i, 1) * 150 + at(i, 2) * 29, 8)
    pick = lambda i, v: F.element_at(F.array(*map(F.lit, v)), (i % 3 + 1).cast("int"))
    div = lambda a, b: F.floor(a / b).cast("int")
    return frames(spark, sf_dir).select(
        "frame", joined(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: (F.lit(255) - grey(i)).cast("int"))).alias("inverted"), joined(F.transform(px, lambda x: F.least(div(x * 2 + 2040, 10), F.lit(255)))).alias("white"), joined(F.transform(px, lambda x: div(x * 2, 10))).alias("black"),
        joined(F.transform(px, lambda x, i: F.least(div(x * pick(i, [135, 120, 105]) + pick(i, [4000, 2000, 500]), 100), F.lit(255)))).alias("tinted"),
    )


@query(f"""WITH {FRAMES_SQL}, x AS (SELECT frame, unnest(range(0, 64)) AS i, unnest(px) AS v FROM frames), y AS (SELECT frame, i // 8 AS r, i % 8 AS c, v FROM x), h AS (SELECT frame, r, c, sum(v) OVER w // count(*) OVER w AS v FROM y WINDOW w AS (PARTITION BY frame, r ORDER BY c ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
z AS (SELECT frame, r, c, sum(v) OVER w // count(*) OVER w AS v FROM h WINDOW w AS (PARTITION BY frame, c ORDER BY r ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) SELECT frame, CAST(r AS BIGINT) AS r, CAST(c AS BIGINT) AS c, CAST(v AS BIGINT) AS v FROM z""")
def pixel_blur_prefix(spark, sf_dir):
    """A box blur by prefix sums, rows then columns, in Arrow batches; the oracle slides windows."""
    schema = "frame long, r long, c long, v long"

    def run(batches):
        for batch in batches:
            px = np.array(batch.column(1).to_pylist(), dtype=np.int64).reshape(-1, 8, 8)
            out = kernels.box_blur(kernels.box_blur(px, 2, 2), 2, 1)
            n = len(px)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.asarray(batch.column(0)), 64)), pa.array(np.tile(np.repeat(np.arange(8), 8), n)), pa.array(np.tile(np.arange(8), 8 * n)), pa.array(out.reshape(-1))], names=["frame", "r", "c", "v"])

    return frames(spark, sf_dir).select("frame", "px").mapInArrow(run, schema)


@query(f"""WITH {FRAMES_SQL}, e AS (SELECT source, frame, px, lag(px, 1) OVER w AS p1, lag(px, 2) OVER w AS p2, lag(px, 3) OVER w AS p3 FROM frames WINDOW w AS (PARTITION BY source ORDER BY frame))
SELECT source, frame, array_to_string(list_transform(range(1, 65), lambda i: CAST(((256 - 76) * px[i] + 76 * ((coalesce(p1[i], 128) + coalesce(p2[i], 128) + coalesce(p3[i], 128)) // 3)) >> 8 AS INTEGER)), ',') AS px FROM e""")
def echo_trail(spark, sf_dir):
    """Each frame with a share of the mean of the three before it, grey where there is none yet."""
    w = Window.partitionBy("source").orderBy("frame")
    grey = F.array_repeat(F.lit(128), 64)
    rows = frames(spark, sf_dir).select("source", "frame", "px", *(F.lag("px", k).over(w).alias(f"p{k}") for k in (1, 2, 3)))
    rows = rows.select("source", "frame", "px", *(F.coalesce(f"p{k}", grey).alias(f"p{k}") for k in (1, 2, 3)))
    mean = lambda i: F.floor((F.get("p1", i) + F.get("p2", i) + F.get("p3", i)) / 3).cast("int")
    return rows.select("source", "frame", joined(F.transform("px", lambda x, i: F.shiftright(180 * x + 76 * mean(i), 8).cast("int"))).alias("px"))


@query(f"""WITH {FRAMES_SQL}, g AS (SELECT source, frame, px, lead(px, 2) OVER (PARTITION BY source ORDER BY frame) AS ghost, last_value(px) OVER (PARTITION BY source ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS lst FROM frames)
SELECT source, frame, array_to_string(list_transform(range(1, 65), lambda i: CAST((px[i] * 180 + coalesce(ghost, lst)[i] * 76) >> 8 AS INTEGER)), ',') AS px FROM g""")
def dissolve_ghost(spark, sf_dir):
    """Each frame under a share of the one two later, the last one at the end."""
    w = Window.partitionBy("source").orderBy("frame")
    last = F.last("px").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = frames(spark, sf_dir).select("source", "frame", "px", F.coalesce(F.lead("px", 2).over(w), last).alias("ghost"))
    return rows.select("source", "frame", joined(F.zip_with("px", "ghost", lambda a, b: F.shiftright(a * 180 + b * 76, 8).cast("int"))).alias("px"))


@query(f"""SELECT p_partkey, CAST(floor(least(greatest(1.0{D} - 0.3{D} * (((x - w / 2.0{D}) * (x - w / 2.0{D}) + (y - h / 2.0{D}) * (y - h / 2.0{D})) / (w / 2.0{D} * (w / 2.0{D}) + h / 2.0{D} * (h / 2.0{D}))), 0.0{D}), 1.0{D}) * 255.0{D}) AS INTEGER) AS shade FROM (SELECT p_partkey, CAST(p_partkey % 64 AS DOUBLE) AS x, CAST(p_partkey // 64 % 36 AS DOUBLE) AS y, 64.0{D} AS w, 36.0{D} AS h FROM part)""")
def vignette_lut(spark, sf_dir):
    p = read(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 64).cast("double").alias("x"), (F.floor(F.col("p_partkey") / 64) % 36).cast("double").alias("y"))
    return p.select("p_partkey", cv.vignette(F.col("x"), F.col("y"), F.lit(64.0), F.lit(36.0), F.lit(0.3)).alias("shade"))


def _pictures(spark, sf_dir):
    """Frames tiled to 64 x 48 RGB pictures, as bytes."""

    def run(batches):
        for batch in batches:
            px = np.array(batch.column(2).to_pylist(), dtype=np.uint8).reshape(-1, 8, 8)
            big = np.repeat(np.repeat(px, 6, axis=1), 8, axis=2)
            rgb = np.stack([big, big[:, ::-1], big[:, :, ::-1]], axis=3)
            n = len(px)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([48] * n, pa.int32()), pa.array([64] * n, pa.int32()), pa.array([p.tobytes() for p in rgb], pa.binary())], names=["source", "frame", "height", "width", "pixels"])

    return frames(spark, sf_dir).select("source", "frame", "px").mapInArrow(run, "source int, frame long, height int, width int, pixels binary")


_KINDS = [*kernels.ONE_FRAME, "WARP_BUBBLE", "WAVE_WARP", "SLIDE_SHAKE", "TRANSFORM", "AMBIANCE", "DEEP_DARK", "ink_pulse", "prism_drift", "focus_pull", "relief_light", "paper_gate", "time_slice"]


def _apply(f: np.ndarray, row: dict) -> np.ndarray:
    name, seed = row["effect"], row["frame"]
    special = {
        "WARP_BUBBLE": lambda: kernels.warp_bubble(f, 0.4, 1.2), "WAVE_WARP": lambda: kernels.wave_warp(f, 12.0, 0.2, 20.0, 2.0), "SLIDE_SHAKE": lambda: kernels.slide_shake(f, 9.0),
        "TRANSFORM": lambda: kernels.transform(f, dx=2.0, dy=-1.5, scale=1.1, tilt=0.05, skew=0.02, scale_x=1.05, barrel=0.05), "AMBIANCE": lambda: kernels.ambiance(f, 0.1, (4, -3, 2), False, 0.3, 0.15),
        "DEEP_DARK": lambda: kernels.deep_dark(f, seed),
    }
    if name in special:
        return special[name]()
    return kernels.one_framer(f, name) if name in kernels.ONE_FRAME else kernels.creative(f, name, 0.4, seed, 0.9, np.ascontiguousarray(f[::-1]))


@query()
def pixel_kernels(spark, sf_dir):
    """Every kernel in turn over the frames of a source: the picture's digest after it."""
    effect = F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("frame") % len(_KINDS) + 1).cast("int"))
    rows = _pictures(spark, sf_dir).withColumn("effect", effect)
    made = kernels.over_frames(rows, _apply, ["effect", "frame"])
    return made.select("source", "frame", "effect", F.sha2("pixels", 256).alias("digest"), F.length("pixels").alias("bytes"))


@query()
def motion_blocks(spark, sf_dir):
    """Motion between a picture and itself moved by the frame's number: activity grows with the move."""

    def run(batches):
        for batch in batches:
            out = []
            for frame, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                f = np.frombuffer(raw, dtype=np.uint8).reshape(48, 64, 3)
                luma = f[..., 1] * 0.7152 + f[..., 2] * 0.0722 + f[..., 0] * 0.2126 + (np.arange(64) * 7 % 50)
                out.append(kernels.motion_score(luma, np.roll(luma, frame % 4, axis=1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([a for a, _ in out]), pa.array([c for _, c in out])], names=["frame", "activity", "confidence"])

    return _pictures(spark, sf_dir).select("frame", "pixels").mapInArrow(run, "frame long, activity double, confidence double")


@query()
def source_analysis(spark, sf_dir):
    """Fragments, cuts and motion of each source's tiled pictures at 12 a second; a picture whose number divides by 17 is black."""
    shot = F.when(F.col("frame") % 40 == 39, 0.9).otherwise(0.0)
    w = Window.partitionBy("source").orderBy("frame")
    black = F.when(F.col("frame") % 17 == 0, F.lit(bytes(3 * 48 * 64))).otherwise(F.col("pixels"))
    rows = _pictures(spark, sf_dir).select("source", "frame", ((F.row_number().over(w) - 1) / 12.0).alias("t"), shot.alias("score"), black.alias("pixels"))
    rows = rows.withColumn("duration", F.max("t").over(Window.partitionBy("source")) + 1 / 12)
    a = analysis.analyse(analysis.scan(rows, layout("rgb24", "", 64, 48), 48, 64))
    parts = [a.fragments.select("source", F.lit("fragment").alias("kind"), F.col("start").alias("a"), F.col("end").alias("b")), a.cuts.select("source", F.lit("cut"), "t", F.lit(0.0)), a.motion.select("source", F.lit("motion"), "t", "activity")]
    made = parts[0].union(parts[1]).union(parts[2])
    return made.select("source", "kind", to_places(F.col("a"), 6).alias("a"), to_places(F.col("b"), 6).alias("b"))


@query()
def effect_previews(spark, sf_dir):
    """The catalogue of effects, with the digest of each one's picture."""
    made = previews.catalogue(spark, 96, 96)
    return made.select("effect", "category", F.length("bitmap").alias("bytes"), F.sha2("bitmap", 256).alias("digest"), F.substring(render.data_url(F.col("bitmap")), 1, 40).alias("url_head"))
