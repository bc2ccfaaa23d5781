"""Curves, envelopes and per-frame parameters as Spark columns: all stay in generated code, none needs Python."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from chronoframe.functions.numbers import clamp, half_up, num, wrapping32


def curve(name: Column, x: Column) -> Column:
    """Eased position for x in [0, 1] (clamped): snap, saddle, or x itself for any other name."""
    x, kind = clamp(x, 0.0, 1.0), F.lower(name)
    left = 1.0 - x
    return F.when(kind == "snap", 1.0 - left * left * left).when(kind == "saddle", x * x * (3.0 - 2.0 * x)).otherwise(x)


def curve_slope(name: Column, x: Column) -> Column:
    x, kind = clamp(x, 0.0, 1.0), F.lower(name)
    return F.when(kind == "snap", 3.0 * (1.0 - x) * (1.0 - x)).when(kind == "saddle", 6.0 * x * (1.0 - x)).otherwise(F.lit(1.0))


def remapped(name: Column, x: Column, strength: Column, phase_start: Column, phase_end: Column) -> tuple[Column, Column]:
    """Value and slope of a curve blended with the identity by strength, over a window of phases, renormalised; a null strength is the plain curve."""
    x = clamp(x, 0.0, 1.0)
    blend = lambda p: p * (1.0 - strength) + strength * curve(name, p)
    window = phase_end - phase_start
    phase = phase_start + window * x
    first = blend(phase_start)
    span = F.greatest(blend(phase_end) - first, F.lit(1e-12))
    value = clamp((blend(phase) - first) / span, 0.0, 1.0)
    slope = (1.0 - strength + strength * curve_slope(name, phase)) * window / span
    plain = strength.isNull()
    return F.when(plain, curve(name, x)).otherwise(value), F.when(plain, curve_slope(name, x)).otherwise(slope)


def inverse_curve(name: Column, value: Column, strength: Column, steps: int = 40) -> Column:
    """The phase at which the blended curve has this value, by bisection."""

    def step(acc: Column, _: Column) -> Column:
        middle = (acc["low"] + acc["high"]) / 2.0
        under = middle * (1.0 - strength) + strength * curve(name, middle) < value
        return F.struct(F.when(under, middle).otherwise(acc["low"]).alias("low"), F.when(under, acc["high"]).otherwise(middle).alias("high"))

    start = F.struct(F.lit(0.0).alias("low"), F.lit(1.0).alias("high"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda acc: (acc["low"] + acc["high"]) / 2.0)


def shake_envelope(t: Column, duration: Column, fps: Column) -> Column:
    """Up over the first two frames and down over the last two."""
    ramp = 2.0 / fps
    rise = F.when(t <= ramp, clamp(t / ramp, 0.0, 1.0)).otherwise(1.0)
    fall = F.when(t >= duration - ramp, clamp((duration - t) / ramp, 0.0, 1.0)).otherwise(1.0)
    return F.when((duration <= 1e-6) | (fps <= 0.0), 0.0).when(ramp <= 1e-6, 1.0).otherwise(clamp(rise * fall, 0.0, 1.0))


def _through(x: Column, points: list[tuple[float, Column | float]]) -> Column:
    """Linear between points; the caller bounds x."""
    out = None
    for (x0, y0), (x1, y1) in zip(points, points[1:], strict=False):
        y0, y1 = num(y0), num(y1)
        value = y0 + (x - x0) / (x1 - x0) * (y1 - y0)
        out = F.when(x <= x1, value) if out is None else out.when(x <= x1, value)
    return out


#: Frames and heights of the bounce.
BOUNCE = [(0.0, -1.0), (1.0, 0.14), (3.0, 0.05), (6.0, 0.022), (8.0, -0.006), (10.0, 0.0)]


def bounce(frame: Column) -> Column:
    return F.when((frame >= 0.0) & (frame <= 10.0), _through(frame, BOUNCE)).otherwise(0.0)


def skew(t: Column, duration: Column, degrees: Column) -> Column:
    u = t / duration
    angle = degrees * math.pi / 180.0 * F.exp(-3.0 * u) * F.cos(2.0 * math.pi * 4.0 * u)
    return F.when(duration <= 1e-9, 0.0).otherwise(F.tan(angle))


def squish(frame: Column, y_min: Column, x_max: Column) -> tuple[Column, Column]:
    """Scales in x and y: pressed at frame 1, overshooting at 3, at rest from 5 on."""
    inside = (frame > 0.0) & (frame < 5.0)
    y = _through(frame, [(0.0, 1.0), (1.0, y_min), (3.0, 1.0 + (1.0 - y_min) / 2.0), (5.0, 1.0)])
    x = _through(frame, [(0.0, 1.0), (1.0, x_max), (3.0, 1.0 - (x_max - 1.0) * 0.4), (5.0, 1.0)])
    return F.when(inside, x).otherwise(1.0), F.when(inside, y).otherwise(1.0)


def optics(t: Column, duration: Column, k0: Column) -> Column:
    u = clamp(1.0 - t / duration, 0.0, 1.0)
    return F.when(duration <= 1e-9, 0.0).otherwise(k0 * u * u)


def stretch(t: Column, duration: Column, start: Column) -> Column:
    return F.when(duration <= 1e-9, 1.0).otherwise(start + (1.0 - start) * curve(F.lit("saddle"), t / duration))


def chain(t: Column, duration: Column, fps: Column, from_prev: Column, to_next: Column) -> Column:
    """From 0.6 up at a chained start and down to 0.6 at a chained end, over two frames each."""
    ramp = 2.0 * F.when(fps > 0.0, 1.0 / fps).otherwise(1.0 / 30.0)
    head = F.when(from_prev & (t < ramp), 0.6 + 0.4 * clamp(t / ramp, 0.0, 1.0)).otherwise(1.0)
    tail = F.when(to_next & (t > duration - ramp), 0.6 + 0.4 * clamp((duration - t) / ramp, 0.0, 1.0)).otherwise(1.0)
    return head * tail


def blur_frames(speed: Column, enabled: Column) -> Column:
    """Frames blended into one: more the faster the source runs, four at most."""
    return F.when(~enabled | (speed <= 1.0), 1).otherwise(F.least(1 + F.floor(speed), F.lit(4))).cast("int")


def transform_params(e: dict[str, Column], t: Column, duration: Column, fps: Column) -> Column:
    """One struct of dx, dy, scale, tilt, skew, scale_x, scale_y and barrel from the effects of a segment.

    e: shake_a0, shake_omega, shake_k, shake_seed, zoom_start, zoom_end, zoom_offset (frames); bouncy_amp, bouncy_axis,
    stretch_start, stretch_axis, squish_y, squish_x, skew_deg, optics_k0 with null for an absent effect; chained, chain_prev, chain_next.
    """
    frame = F.when(fps > 0.0, 1.0 / fps).otherwise(1.0 / 30.0)
    envelope = shake_envelope(t, duration, fps) * F.when(e["chained"], chain(t, duration, fps, e["chain_prev"], e["chain_next"])).otherwise(1.0)
    angle = lambda factor: (wrapping32(e["shake_seed"], factor) % 360).cast("double") * math.pi / 180.0
    swing = e["shake_a0"] * F.exp(-e["shake_k"] * t)
    wave = lambda factor: F.sin(e["shake_omega"] * t + angle(factor)) * envelope
    bounced = bounce(t / frame) * e["bouncy_amp"]
    dx = F.when(e["bouncy_amp"].isNotNull() & (e["bouncy_axis"] == 0), bounced).otherwise(swing * wave(1))
    dy = F.when(e["bouncy_amp"].isNotNull() & (e["bouncy_axis"] != 0), bounced).otherwise(swing * wave(17))
    late = F.when(e["zoom_offset"] > 0, F.greatest(t - e["zoom_offset"] * frame, F.lit(0.0))).otherwise(t)
    zoomed = e["zoom_start"] + (e["zoom_end"] - e["zoom_start"]) * clamp(late / F.greatest(duration, F.lit(1e-6)), 0.0, 1.0)
    scale = F.greatest(zoomed * (1.0 + swing / 100.0 * wave(31)), F.lit(0.1))
    pulled = stretch(t, duration, e["stretch_start"])
    squish_x, squish_y = squish(t / frame, e["squish_y"], e["squish_x"])
    along = lambda axis, s: F.when(e["stretch_start"].isNotNull() & (F.when(e["stretch_axis"] == 0, 0).otherwise(1) == axis), pulled).otherwise(1.0) * F.when(e["squish_y"].isNotNull(), s).otherwise(1.0)
    return F.struct(
        dx.alias("dx"), dy.alias("dy"), scale.alias("scale"), (swing / 5.0 * wave(47) * math.pi / 180.0).alias("tilt"),
        F.when(e["skew_deg"].isNotNull(), skew(t, duration, e["skew_deg"]) * envelope).otherwise(0.0).alias("skew"),
        along(0, squish_x).alias("scale_x"), along(1, squish_y).alias("scale_y"),
        F.when(e["optics_k0"].isNotNull(), optics(t, duration, e["optics_k0"])).otherwise(0.0).alias("barrel"),
    )


def warp_bubble(frames: Column) -> Column:
    return F.when(F.abs(frames) <= 2.0 + 1e-4, 0.5 * F.greatest(1.0 - F.abs(frames) / 2.0, F.lit(0.0))).otherwise(0.0)


def wave_height(frames: Column, height: float = 280.0) -> Column:
    return F.when((frames >= -1e-4) & (frames <= 6.0 + 1e-4), height * clamp(1.0 - frames / 6.0, 0.0, 1.0)).otherwise(0.0)


def slide_shift(frames: Column, pixels: float = 100.0) -> Column:
    left = pixels * clamp(1.0 + frames / 3.0, 0.0, 1.0)
    right = -pixels * clamp(1.0 - frames / 3.0, 0.0, 1.0)
    return F.when((frames >= -3.0 - 1e-4) & (frames < 0.0), left).when((frames >= 0.0) & (frames <= 3.0 + 1e-4), right).otherwise(0.0)


def flicker(t: Column, amplitude: Column, hertz: Column, seed: Column) -> Column:
    return amplitude * F.sin(2.0 * math.pi * hertz * t + seed * 0.0012345)


def flash(t: Column, times: Column, peak: Column, fps: Column) -> Column:
    """The strongest flash at t among all times (an array), each two frames to either side."""
    one = lambda x: F.when(F.abs((t - x) * fps) <= 2.0 + 1e-4, peak * F.greatest(1.0 - F.abs((t - x) * fps) / 2.0, F.lit(0.0))).otherwise(0.0)
    return F.greatest(F.coalesce(F.array_max(F.transform(times, one)), F.lit(0.0)), F.lit(0.0))


def exposure(flicker_part: Column, flash_part: Column) -> Column:
    return clamp(flicker_part + flash_part, -0.999, 0.999)


def phase(t: Column, t0: Column, t1: Column) -> Column:
    return clamp((t - t0) / (t1 - t0), 0.0, 1.0)


def accent(p: Column, strength: Column) -> Column:
    """Weight out of 256 of a creative event at a phase: nothing at both ends."""
    s = F.sin(math.pi * p)
    return half_up(s * s * strength * 256.0).cast("int")


def vignette(x: Column, y: Column, width: Column, height: Column, strength: Column) -> Column:
    rx, ry = width / 2.0, height / 2.0
    far = ((x - rx) * (x - rx) + (y - ry) * (y - ry)) / (rx * rx + ry * ry)
    return F.floor(clamp(1.0 - strength * far, 0.0, 1.0) * 255.0).cast("int")


def output_size(w: Column, h: Column) -> Column:
    """out_w and out_h, even: given sizes of 100 and more are taken as they are, smaller ones are an aspect ratio at 1080."""
    w, h = F.when(w == 0, 1080).otherwise(w), F.when(h == 0, 1080).otherwise(h)
    even = lambda x: (F.floor(x / 2) * 2).cast("int")
    wide, tall = even(half_up(1080.0 * (w / h))), even(half_up(1080.0 * (h / w)))
    exact = (w >= 100) & (h >= 100)
    out_w = F.when(exact, even(w)).when(w >= h, F.greatest(wide, F.lit(2))).otherwise(F.lit(1080))
    out_h = F.when(exact, even(h)).when(w >= h, F.lit(1080)).otherwise(F.greatest(tall, F.lit(2)))
    return F.struct(out_w.cast("int").alias("out_w"), out_h.cast("int").alias("out_h"))


def edge_mirror(c: Column, size: Column) -> Column:
    """Reflected once at each edge, the edge repeated, then clamped."""
    a = F.abs(c)
    b = F.when(a >= size, 2 * size - 1 - a).otherwise(a)
    return F.when(size <= 1, 0).otherwise(F.least(F.greatest(b, F.lit(0)), size - 1))


def periodic_mirror(c: Column, size: Column) -> Column:
    """Reflected again and again, the edge not repeated."""
    last = size - 1
    p = F.pmod(c, F.greatest(last * 2, F.lit(1)))
    return F.when(size <= 1, 0).when(p > last, last * 2 - p).otherwise(p)


def normalised(c: Column, size: Column) -> Column:
    """A coordinate as a share of 65536."""
    return F.when(size <= 1, 32768).otherwise(F.floor(c * 65536 / F.greatest(size - 1, F.lit(1)))).cast("int")


def preferred_cadence(beat: Column, rhythm: Column, scenes: Column, target: Column, style: Column, smart: Column) -> Column:
    """Seconds that a shot should take: beats by rhythm, longer where scenes are few, six at most; smart: halfway to musical phrases."""
    cadence = F.when(rhythm == "fast", beat).when(rhythm == "slow", F.greatest(beat * 8.0, F.lit(3.0))).otherwise(beat * 4.0)
    covering = F.least(F.greatest(cadence, F.least(8.0 / scenes, F.lit(5.5))), F.lit(6.0))
    phrases = F.when(style == "SMOOTH", cadence * 2.0).otherwise(cadence)
    return F.least(F.when(smart, F.greatest(F.sqrt(phrases * covering), F.lit(0.35))).otherwise(covering), target)
