"""Style presets: toggles, parameters and their limits, as one small table each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STYLES = ["HARD", "SMOOTH", "HYBRID"]
#: Parameter, default for HARD, SMOOTH and HYBRID, least and greatest.
PARAMETERS = [
    ("shake_a0", 8.0, 3.0, 5.0, 0.0, 30.0), ("shake_omega", 15.0, 8.0, 12.0, 0.0, 30.0), ("shake_k", 3.0, 2.0, 2.5, 0.0, 10.0),
    ("bouncy_amplitude", 40.0, 25.0, 25.0, 0.0, 60.0), ("dissolve_pct", 30.0, 15.0, 15.0, 0.0, 100.0), ("skew_s0", 10.0, 0.0, 7.0, 0.0, 30.0),
    ("squish_y_min", 0.85, 0.92, 0.88, 0.5, 1.0), ("squish_x_max", 1.18, 1.08, 1.14, 1.0, 1.5), ("optics_k0", 0.08, 0.04, 0.06, 0.0, 0.3), ("stretch_scale", 1.40, 1.20, 1.30, 1.0, 2.0),
    ("zoom_start", 1.0, 1.0, 1.0, 0.8, 1.5), ("zoom_end", 1.15, 1.05, 1.10, 0.8, 1.5), ("zoom_offset_frames", 1.0, 0.0, 1.0, 0.0, 8.0),
    ("flicker_amplitude", 0.15, 0.08, 0.12, 0.0, 1.0), ("flicker_hz", 12.0, 8.0, 10.0, 0.0, 30.0), ("flash_peak", 0.5, 0.3, 0.4, 0.0, 1.0),
    ("echo_alpha", 0.3, 0.2, 0.25, 0.0, 1.0), ("echo_depth", 3.0, 2.0, 3.0, 1.0, 4.0), ("tint_r", 0.0, 0.0, 0.0, -255.0, 255.0), ("tint_g", 0.0, 0.0, 0.0, -255.0, 255.0), ("tint_b", 0.0, 0.0, 0.0, -255.0, 255.0),
    ("vignette", 0.3, 0.2, 0.25, 0.0, 1.0), ("scanlines", 0.15, 0.10, 0.12, 0.0, 1.0),
    ("warp_amplitude", 0.5, 0.3, 0.4, 0.0, 1.0), ("warp_frequency", 1.2, 1.0, 1.1, 0.0, 5.0), ("wave_height", 280.0, 180.0, 230.0, 0.0, 600.0), ("wave_speed", 20.0, 15.0, 18.0, 0.0, 40.0), ("slide_pixels", 100.0, 60.0, 80.0, 0.0, 200.0),
]
#: Toggles that are on with full effects, off for smooth plans, always on, always off.
WITH_FULL = ["one_framers", "tint", "vignette"]
NOT_SMOOTH = ["bouncy_shake", "dissolve_shake", "skew_shake", "squish_pop", "optics_bounce", "warp_stretch"]
ALWAYS = ["shakes", "zoom", "flicker", "buildup_chain", "zoom_beat_offset"]
NEVER = ["transitions", "scanlines", "echo_trail", "cc_deep_dark", "anti_flash"]


def toggles(style: str, full: bool) -> dict[str, bool]:
    """What a plan of this style switches on; an unknown style is a hard one."""
    smooth = style.upper() == "SMOOTH"
    return {k: full for k in WITH_FULL} | {"exposure_flash": full and not smooth} | {k: not smooth for k in NOT_SMOOTH} | {k: True for k in ALWAYS} | {k: False for k in NEVER}


def parameters(style: str) -> dict[str, float]:
    at = {"SMOOTH": 2, "HYBRID": 3}.get(style.upper(), 1)
    return {p[0]: p[at] for p in PARAMETERS}


def parameter_table(spark: SparkSession) -> DataFrame:
    """style, name, value, low, high: as many rows as styles and parameters."""
    rows = [(s, p[0], p[1 + i], p[4], p[5]) for i, s in enumerate(STYLES) for p in PARAMETERS]
    return spark.createDataFrame(rows, "style string, name string, value double, low double, high double")


def toggle_table(spark: SparkSession) -> DataFrame:
    rows = [(s, f, k, v) for s in STYLES for f in (False, True) for k, v in toggles(s, f).items()]
    return spark.createDataFrame(rows, "style string, full_fx boolean, name string, enabled boolean")


#: What lies over a whole plan; one of these toggles is enough for a plan to have an ambiance.
OVER_ALL = ["flicker", "exposure_flash", "echo_trail", "tint", "vignette", "scanlines", "cc_deep_dark"]
#: Fixed values that do not go by style.
ECHO_ALPHA, ECHO_DEPTH, VIGNETTE, SCANLINES = 0.3, 3.0, 0.3, 0.0


def ambiance(style: Column, on: dict[str, Column], downbeats: Column, given: dict[str, Column] | None = None) -> Column:
    """A plan's ambiance as a struct, or null where no toggle of OVER_ALL is on. A toggle that is null or not there is off.

    given: parameters by the names in PARAMETERS; one that is null or not there takes its default, and trails need their own
    alpha. anti_flash takes out flicker, flashes and the inversions of the tint. An unknown style is a hard one.
    """
    given = given or {}
    switch = lambda name: F.coalesce(on[name], F.lit(False)) if name in on else F.lit(False)
    calm = switch("anti_flash")
    flashing = switch("exposure_flash") & ~calm
    flicker, inverting = switch("flicker") & ~calm, switch("tint") & ~calm

    def by_style(name: str) -> Column:
        return F.when(F.upper(style) == "SMOOTH", parameters("SMOOTH")[name]).when(F.upper(style) == "HYBRID", parameters("HYBRID")[name]).otherwise(parameters("HARD")[name])

    def own(name: str, default: Column | float) -> Column:
        default = default if isinstance(default, Column) else F.lit(default)
        return F.coalesce(given[name].cast("double"), default) if name in given else default

    def where(test: Column, value: Column, otherwise: Column | float) -> Column:
        return F.when(test, value).otherwise(otherwise)

    none = F.array().cast("array<double>")
    trails = switch("echo_trail") & (given["echo_alpha"].isNotNull() if "echo_alpha" in given else F.lit(False))
    hz, peak = by_style("flicker_hz"), by_style("flash_peak")
    shift = [where(switch("tint"), own(name, 0.0), 0.0).cast("int").alias(name[-1]) for name in ("tint_r", "tint_g", "tint_b")]
    made = F.struct(
        F.struct(where(flicker, own("flicker_amplitude", by_style("flicker_amplitude")), 0.0).alias("amplitude"), where(flicker, own("flicker_hz", hz), hz).alias("hz"), F.lit(0.0).alias("phase")).alias("flicker"),
        F.struct(where(flashing, own("flash_peak", peak), 0.0).alias("peak"), where(flashing, downbeats, none).alias("times")).alias("flash"),
        F.struct(trails.alias("enabled"), where(trails, own("echo_alpha", ECHO_ALPHA), ECHO_ALPHA).alias("alpha"), where(trails, own("echo_depth", ECHO_DEPTH), ECHO_DEPTH).cast("int").alias("depth")).alias("echo"),
        F.struct(*shift, inverting.alias("invert"), where(inverting, downbeats, none).alias("times")).alias("tint"),
        where(switch("vignette"), own("vignette", VIGNETTE), 0.0).alias("vignette"),
        where(switch("scanlines"), own("scanlines", SCANLINES), 0.0).alias("scanlines"),
        switch("cc_deep_dark").alias("deep_dark"),
    )
    return F.when(F.exists(F.array(*map(switch, OVER_ALL)), lambda t: t), made)


def active(over: Column) -> Column:
    """How many effects an ambiance counts for: flicker, flashes, trails, shifted colours, vignette and scanlines; 0 for none."""
    shifted = (over["tint"]["r"] != 0) | (over["tint"]["g"] != 0) | (over["tint"]["b"] != 0)
    tests = [over["flicker"]["amplitude"] > 0, F.size(over["flash"]["times"]) > 0, over["echo"]["enabled"], shifted, over["vignette"] > 0, over["scanlines"] > 0]
    return sum((F.when(t, 1).otherwise(0) for t in tests), F.lit(0))
