"""Sparse events placed by hashing: no random numbers, so the same plan always has the same events."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoframe.functions import curves
from chronoframe.functions.numbers import half_up, lcg, let, position_hash, unsigned_mod
from chronoframe.operators import intervals

#: The one-frame effects in the order that hashes choose by; the last three flash.
ONE_FRAMERS = ["OFFSET_BLUR", "RADIAL_BLUR", "DIRECTIONAL_MINIMAX", "WARP_FISHEYE", "BOKEH_OCTAGON", "TINT_SCENE", "SOFT_TINT_FLASH", "FLASH_WHITE", "FLASH_BLACK", "INVERT"]
CALM_FRAMERS = ONE_FRAMERS[:7]
#: Transitions by style as (upper bound of hash % 100, type).
TRANSITIONS = {"HARD": [(30, "WARP_BUBBLE"), (50, "WAVE_WARP"), (90, "SLIDE_SHAKE")], "SMOOTH": [(10, "SLIDE_SHAKE")], "HYBRID": [(15, "WARP_BUBBLE"), (25, "WAVE_WARP"), (50, "SLIDE_SHAKE")]}
TRANSITION_FRAMES = {"WARP_BUBBLE": 4, "WAVE_WARP": 6, "SLIDE_SHAKE": 6}
#: Parameters of transitions, each with its name in the plan's parameters and what it is without one.
TRANSITION_PARAMETERS = {
    "WARP_BUBBLE": {"amplitude": ("warp_amplitude", 0.5), "frequency": ("warp_frequency", 1.2)},
    "WAVE_WARP": {"height": ("wave_height", 280.0), "speed": ("wave_speed", 20.0)},
    "SLIDE_SHAKE": {"amplitude": ("slide_pixels", 100.0)},
}
#: The seed's mask, and effects in the order of their draws with the share of segments (percent) by style.
SEED_MASK = 0x5BF03635
LOTTERY = {
    "HARD": {"bouncy": 30, "dissolve": 25, "skew": 20, "squish": 40, "optics": 25, "chain": 30, "stretch": 20},
    "SMOOTH": {"bouncy": 30, "dissolve": 25, "skew": 20, "squish": 40, "optics": 25, "chain": 30, "stretch": 20},
    "HYBRID": {"bouncy": 15, "dissolve": 10, "skew": 10, "squish": 20, "optics": 10, "chain": 15, "stretch": 10},
}
#: Creative kinds in order, with salt, length and clean gap in periods, and the offset of a lone anchor.
CREATIVE = [
    ("time_slice", 0x19AB, 0.75, 2.0, 0.0), ("ink_pulse", 0x72D1, 1.1, 2.0, 0.4), ("prism_drift", 0xC3E7, 0.9, 1.5, 0.0),
    ("focus_pull", 0x3F4A, 1.0, 3.0, 0.0), ("relief_light", 0x59C2, 1.2, 3.0, 0.35), ("paper_gate", 0xE13B, 0.9, 3.0, 0.7),
]


def _pick(pool: list[str], h: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, pool)), (unsigned_mod(h, len(pool)) + 1).cast("int"))


def one_framers(segments: DataFrame, downbeats: DataFrame, keys: list[str], style: str, fps: int, target: str, calm: bool = False) -> DataFrame:
    """t and type of one-frame effects around cuts and on downbeats, one per frame, the first in time and order of origin.

    segments: keys, idx, t0, target; downbeats: keys, idx, t, target. A cut has frames -2, -1, 0 and +1.
    """
    pool = CALM_FRAMERS if calm else ONE_FRAMERS
    even = lambda df, t, salt: df.where(position_hash(F.col(t), salt).bitwiseAND(F.lit(1)) == 0)
    snap = lambda t: half_up(t * float(fps)) / float(fps)
    cuts = even(segments, "t0", 100) if style == "SMOOTH" else segments
    offsets = F.posexplode(F.array(*(F.lit(k / fps) for k in (-2, -1, 0, 1)))).alias("k", "off")
    cuts = cuts.select(*keys, target, "idx", "t0", offsets)
    cuts = cuts.select(*keys, target, snap(F.col("t0") + F.col("off")).alias("t"), (F.col("idx") * 10 + F.col("k") + 1).alias("salt"), F.lit(0).alias("origin"), (F.col("idx") * 4 + F.col("k")).alias("seq"))
    beats = even(downbeats, "t", 200) if style == "HYBRID" else downbeats
    beats = beats.select(*keys, target, snap(F.col("t")).alias("t"), (F.col("idx") * 100 + 777).alias("salt"), F.lit(1).alias("origin"), F.col("idx").alias("seq"))
    both = cuts.unionByName(beats).where((F.col("t") >= -1e-6) & (F.col("t") <= F.col(target) + 1e-6))
    named = both.withColumn("type", let(position_hash(F.col("t"), F.col("salt")), lambda h: _pick(pool, h))).withColumn("frame", half_up(F.col("t") * float(fps)).cast("long"))
    first = Window.partitionBy(*keys, "frame").orderBy("t", "origin", "seq")
    return named.withColumn("_n", F.row_number().over(first)).where("_n = 1").select(*keys, "t", "frame", "type")


def transitions(segments: DataFrame, keys: list[str], style: str, wrap: str) -> DataFrame:
    """t, type, frames and is_wrap of transitions at cuts: always a bubble where the source wraps, else by hash; none at the first segment."""

    def by_hash(h: Column) -> Column:
        kind = F.lit(None).cast("string")
        for bound, name in reversed(TRANSITIONS.get(style, [])):
            kind = F.when(unsigned_mod(h, 100) < bound, name).otherwise(kind)
        return kind

    chosen = F.when(F.col(wrap), "WARP_BUBBLE").when(F.col("idx") > 0, let(position_hash(F.col("t0"), 999), by_hash))
    made = segments.select(*keys, "idx", F.col("t0").alias("t"), chosen.alias("type"), F.col(wrap).alias("is_wrap")).where("type is not null")
    frames = F.when(F.col("type") == "WARP_BUBBLE", 4).otherwise(6)
    return made.withColumn("duration_frames", frames)


def transition_params(made: DataFrame, given: dict[str, Column] | None = None) -> DataFrame:
    """Adds params, a map of each transition's own parameters: those given for the plan, or their defaults where null or not there."""
    value = lambda name, default: F.coalesce((given or {}).get(name, F.lit(None)).cast("double"), F.lit(default))
    chosen = F.lit(None).cast("map<string,double>")
    for kind, own in TRANSITION_PARAMETERS.items():
        pairs = [x for name, source in own.items() for x in (F.lit(name), value(*source))]
        chosen = F.when(F.col("type") == kind, F.create_map(*pairs)).otherwise(chosen)
    return made.withColumn("params", chosen)


def seeds(index: Column) -> list[Column]:
    """The segment's seed and the eight draws that follow from it."""
    out = [lcg(index.cast("long")).bitwiseXOR(F.lit(SEED_MASK))]
    for _ in range(8):
        out.append(lcg(out[-1]))
    return out


def lottery(segments: DataFrame, style: Column, index: str = "idx", toggles: dict[str, Column] | None = None) -> DataFrame:
    """Adds seed, a boolean per effect, the axes and the zoom offset. Draws are chained columns, so each is computed once.

    toggles: a boolean per effect that decides whether it can be drawn at all, whatever the style; an effect without one is on,
    but for smooth plans, where only the chain is.
    """
    smooth = style == "SMOOTH"
    allowed = {name: F.lit(True) if name == "chain" else ~smooth for name in LOTTERY["HARD"]} | (toggles or {})
    df = segments.withColumn("seed", lcg(F.col(index).cast("long")).bitwiseXOR(F.lit(SEED_MASK)))
    for i in range(1, 9):
        df = df.withColumn(f"_s{i}", lcg(F.col(f"_s{i - 1}" if i > 1 else "seed")))
    for i, name in enumerate(LOTTERY["HARD"], 1):
        share = F.when(style == "HYBRID", LOTTERY["HYBRID"][name]).otherwise(LOTTERY["HARD"][name])
        df = df.withColumn(name, (F.col(f"_s{i}") % 100 < share) & allowed[name])
    df = df.withColumn("bouncy_axis", (F.col("_s1") % 2).cast("int")).withColumn("stretch_axis", (F.col("_s7") % 2).cast("int")).withColumn("zoom_offset", (F.col("_s8") % 3).cast("int"))
    return df.drop(*(f"_s{i}" for i in range(1, 9)))


def chained(segments: DataFrame, keys: list[str], order: str, flag: str) -> DataFrame:
    """Adds from_prev: whether the segment before asks to be continued."""
    before = F.lag(flag).over(Window.partitionBy(*keys).orderBy(order))
    return segments.withColumn("from_prev", F.coalesce(before, F.lit(False)))


def creative_times(anchors: DataFrame, keys: list[str], kind: str, period: Column, fps: int, target: str) -> DataFrame:
    """Candidate events of one kind: every nth anchor, snapped to frames, before any is dropped for its gap.

    anchors: keys, t and target, already thinned. Their seeds come from seeded().
    """
    _, salt, length, _, lone = next(c for c in CREATIVE if c[0] == kind)
    w = Window.partitionBy(*keys)
    rows = anchors.withColumn("idx", F.row_number().over(w.orderBy("t")) - 1).withColumn("n", F.count("*").over(w))
    i, n = F.col("idx"), F.col("n")
    chosen = {"time_slice": i % 2 == 0, "ink_pulse": (i % 2 == 1) | (n == 1), "prism_drift": (i % 3 == 1) | (n == 1), "focus_pull": i % 3 == 0, "relief_light": (i % 3 == 1) | (n == 1), "paper_gate": (i % 3 == 2) | ((n < 3) & (i == n - 1))}[kind]
    frame = 1.0 / fps
    latest = F.greatest(F.floor(F.col(target) / frame) - 2.0, F.lit(0.0)) * frame
    start = F.least(half_up((F.col("t") + F.when(n == 1, period * lone).otherwise(0.0)) / frame) * frame, latest)
    end = F.least(start + F.least(F.greatest(period * length, F.lit(frame * 2)), F.lit(1.2)), F.col(target))
    made = rows.where(chosen).select(*keys, F.lit(kind).alias("kind"), F.col("t").alias("anchor"), start.alias("t0"), end.alias("t1"), target, period.alias("period"))
    return made.where(F.col("t1") - F.col("t0") > frame).withColumn("salt", F.lit(salt))


def seeded(events: DataFrame, segments: DataFrame, keys: list[str], video: float, style: str) -> DataFrame:
    """Accepted events (keys, anchor, t0, salt, ...) with seed and strength.

    The seed hashes the anchor, the source's time at the event's start and a share of the video's duration. The segment (keys,
    idx, t0, t1, s0, s1, curve) is the one that the event begins in, else the plan's first; events of plans without segments
    have no row. Segments follow each other, so it is found by an as-of join.
    """
    picture = F.struct("idx", F.col("t0").alias("g0"), F.col("t1").alias("g1"), "s0", "s1", "curve")
    marks = segments.select(*keys, F.col("t0").alias("_at"), picture.alias("_here"))
    first = segments.groupBy(*keys).agg(F.min(picture).alias("_first"))
    met = intervals.backward(events.withColumn("_at", F.col("t0")), marks, keys, "_at", ["_here"]).join(first, keys)
    met = met.withColumn("_g", F.when(F.col("t0") < F.col("_here.g1"), F.col("_here")).otherwise(F.col("_first")))
    g = lambda name: F.col(f"_g.{name}")
    x = (F.col("t0") - g("g0")) / (g("g1") - g("g0"))
    source = g("s0") + (g("s1") - g("s0")) * curves.curve(g("curve"), x)
    seed = position_hash(F.col("anchor") + source + video * 0.17, F.col("salt")).bitwiseAND(F.lit((1 << 32) - 1))
    base = 0.72 if style == "SMOOTH" else 0.9
    made = met.withColumn("seed", seed).withColumn("strength", base * (0.9 + (F.col("seed") % 11).cast("double") * 0.01))
    return made.drop("_at", "_here", "_first", "_g")


def with_clean_gaps(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates that begin a clean gap after the end of the last accepted one of their kind; a stream over sorted rows."""
    gap = F.lit(None).cast("double")
    for kind, _, _, periods, _ in CREATIVE:
        gap = F.when(F.col("kind") == kind, F.col("period") * periods).otherwise(gap)
    rows = candidates.withColumn("_gap", gap)
    by = [*keys, "kind"]
    schema = rows.schema
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, end = None, -1.0
        for batch in batches:
            columns = [batch.column(names.index(c)).to_pylist() for c in [*by, "t0", "t1", "_gap"]]
            kept = np.zeros(batch.num_rows, dtype=bool)
            for i, (*key, t0, t1, clean) in enumerate(zip(*columns, strict=True)):
                if key != now:
                    now, end = key, -1.0
                if end < 0.0 or t0 >= end + clean:
                    kept[i], end = True, t1
            yield batch.filter(pa.array(kept))

    return rows.repartition(*by).sortWithinPartitions(*by, "t0").mapInArrow(run, schema).drop("_gap")


def active_nearest(frames: DataFrame, events: DataFrame, keys: list[str], fps: float, seq: str) -> DataFrame:
    """To each frame (keys, frame, t) the first event (keys, t, seq, ...) within half a frame of it; frames without one are left out.

    Events are joined by the number of the nearest frame and its neighbours, so the tolerance costs three rows and no range join.
    """
    near = events.select("*", F.explode(F.array(*((half_up(F.col("t") * fps) + k).cast("long") for k in (-1, 0, 1)))).alias("frame")).withColumnRenamed("t", "event_t")
    met = frames.join(near, [*keys, "frame"]).where(F.abs(F.col("t") - F.col("event_t")) < 0.5 / fps + 1e-6)
    first = Window.partitionBy(*keys, "frame").orderBy("event_t", seq)
    return met.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def active_transition(frames: DataFrame, events: DataFrame, keys: list[str], fps: float, seq: str) -> DataFrame:
    """To each frame the first transition whose window of frames covers it."""
    reach = 7
    near = events.select("*", F.explode(F.sequence(F.floor(F.col("t") * fps) - 4, F.floor(F.col("t") * fps) + reach)).alias("frame")).withColumnRenamed("t", "event_t")
    met = frames.join(near, [*keys, "frame"]).withColumn("t_frames", (F.col("t") - F.col("event_t")) * fps)
    x, kind = F.col("t_frames"), F.col("type")
    covers = F.when(kind == "WARP_BUBBLE", F.abs(x) <= 2.0 + 1e-4).when(kind == "WAVE_WARP", (x >= -1e-4) & (x <= 6.0 + 1e-4)).when(kind == "SLIDE_SHAKE", F.abs(x) <= 3.0 + 1e-4).otherwise(F.lit(False))
    first = Window.partitionBy(*keys, "frame").orderBy("event_t", seq)
    return met.where(covers).withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def active_creative(frames: DataFrame, events: DataFrame, keys: list[str], fps: float) -> DataFrame:
    """Per frame the last event of each kind that is under way, as one map, and the gain that shares the picture among them."""
    dealt = events.select("*", F.explode(F.sequence(F.floor(F.col("t0") * fps), F.ceil(F.col("t1") * fps))).alias("frame"))
    met = frames.join(dealt, [*keys, "frame"]).where((F.col("t") > F.col("t0")) & (F.col("t") < F.col("t1")) & (F.col("strength") > 0))
    last = met.groupBy(*keys, "frame", "t", "kind").agg(F.max(F.struct("t0", "seed")).alias("e"))
    return last.groupBy(*keys, "frame", "t").agg(F.array_join(F.array_sort(F.collect_list("kind")), ",").alias("kinds"), F.count("*").alias("active"), (1.0 / (1.0 + 0.25 * (F.count("*") - 1))).alias("gain"))
