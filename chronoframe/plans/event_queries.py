"""Queries of placed events, curves, envelopes and presets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronoframe.functions import curves as cv
from chronoframe.functions.numbers import HASH_FIRST, HASH_SECOND, HASH_START, let, position_hash, to_places, unsigned_mod
from chronoframe.operators import events as ev
from chronoframe.operators import facts, folds
from chronoframe.plans import presets
from chronoframe.plans.registry import query
from chronoframe.plans.signal_queries import greedy
from chronoframe.sources.tables import LINES_SQL, TIMELINE_SQL, lines, read, timeline

D = "::DOUBLE"
PI = "pi()"


def half_up_sql(x: str) -> str:
    return f"(sign({x}) * floor(abs({x}) + 0.5{D}))"


def r6(x: str) -> str:
    """Six places, halves away from zero, no negative zero."""
    return f"(CASE WHEN abs({x}) * 1e6 < 0.5 THEN 0.0::DOUBLE ELSE {half_up_sql(f'({x}) * 1e6')} / 1e6 END)"


def out6(x):
    return to_places(x, 6)


def hash_sql(source: str, into: str, t: str, salt: str) -> str:
    """CTEs that add h, the position hash, in 128-bit arithmetic."""
    m = "18446744073709551616::UHUGEINT"
    bits = f"CAST((CAST({half_up_sql(f'({t}) * 10000.0{D}')} AS HUGEINT) + 18446744073709551616::HUGEINT) % 18446744073709551616::HUGEINT AS UBIGINT)"
    return f"""{into}_1 AS (SELECT *, CAST(((xor(xor({bits}, {HASH_START}::UBIGINT), CAST({salt} AS UBIGINT)))::UHUGEINT * {HASH_FIRST}::UHUGEINT + 1::UHUGEINT) % {m} AS UBIGINT) AS h1 FROM {source}),
{into}_2 AS (SELECT * EXCLUDE (h1), CAST((xor(h1, h1 // 8589934592::UBIGINT))::UHUGEINT * {HASH_SECOND}::UHUGEINT % {m} AS UBIGINT) AS h2 FROM {into}_1),
{into} AS (SELECT * EXCLUDE (h2), xor(h2, h2 // 268435456::UBIGINT) AS h FROM {into}_2)"""


@query(f"WITH {TIMELINE_SQL}, " + hash_sql("tl", "hashed", "t", "eid") + " SELECT eid, CAST(h % 1000003 AS BIGINT) AS h_mod, CAST(h // 18014398509481984 AS BIGINT) AS h_top FROM hashed")
def position_hashes(spark, sf_dir):
    h = position_hash(F.col("t"), F.col("eid"))
    return timeline(spark, sf_dir).select("eid", let(h, lambda v: unsigned_mod(v, 1000003)).alias("h_mod"), F.shiftrightunsigned(h, 54).alias("h_top"))


FPS = 16
_SEG = f"""{TIMELINE_SQL}, q AS (SELECT tid, eid, t / 3600.0{D} AS t, type, max(t / 3600.0{D}) OVER (PARTITION BY tid) + 1 AS target FROM tl),
seg AS (SELECT tid, target, t AS t0, row_number() OVER (PARTITION BY tid ORDER BY t, eid) - 1 AS idx FROM q WHERE type IN ('click', 'signup')), db AS (SELECT tid, target, t, row_number() OVER (PARTITION BY tid ORDER BY t, eid) - 1 AS idx FROM q WHERE type = 'purchase')"""


def _segments(spark, sf_dir):
    w = Window.partitionBy("tid").orderBy("t", "eid")
    rows = timeline(spark, sf_dir).withColumn("t", F.col("t") / 3600.0).withColumn("target", F.max("t").over(Window.partitionBy("tid")) + 1)
    seg = rows.where(F.col("type").isin("click", "signup")).select("tid", "target", F.col("t").alias("t0"), (F.row_number().over(w) - 1).cast("long").alias("idx"))
    return seg, rows.where("type = 'purchase'").select("tid", "target", "t", (F.row_number().over(w) - 1).cast("long").alias("idx"))


_POOL = "[" + ", ".join(f"'{x}'" for x in ev.ONE_FRAMERS) + "]"


@query(f"""WITH {_SEG}, c0 AS (SELECT s.tid, target, {half_up_sql(f"(t0 + o / 16.0{D}) * 16")} / 16.0{D} AS t, idx * 10 + o + 3 AS salt, 0 AS origin, idx * 4 + o + 2 AS seq FROM seg s, (SELECT unnest([-2, -1, 0, 1]) AS o)),
d0 AS (SELECT tid, target, t, idx FROM db), {hash_sql("d0", "d1", "t", "200")}, b0 AS (SELECT tid, target, {half_up_sql("t * 16")} / 16.0{D} AS t, idx * 100 + 777 AS salt, 1 AS origin, idx AS seq FROM d1 WHERE h % 2 = 0),
u AS (SELECT * FROM c0 UNION ALL SELECT * FROM b0), v AS (SELECT * FROM u WHERE t >= -1e-6 AND t <= target + 1e-6), {hash_sql("v", "w", "t", "salt")},
x AS (SELECT *, CAST({half_up_sql("t * 16")} AS BIGINT) AS frame FROM w), y AS (SELECT *, row_number() OVER (PARTITION BY tid, frame ORDER BY t, origin, seq) AS n FROM x)
SELECT tid, t, frame, {_POOL}[CAST(h % 10 AS INT) + 1] AS type FROM y WHERE n = 1""")
def one_framers(spark, sf_dir):
    seg, beats = _segments(spark, sf_dir)
    return ev.one_framers(seg, beats, ["tid"], "HYBRID", FPS, "target")


@query(f"""WITH {_SEG}, {hash_sql("seg", "sh", "t0", "999")}, x AS (SELECT tid, idx, t0 AS t, idx % 11 = 5 AS is_wrap, CASE WHEN idx % 11 = 5 THEN 'WARP_BUBBLE' WHEN idx = 0 THEN NULL WHEN h % 100 < 30 THEN 'WARP_BUBBLE' WHEN h % 100 < 50 THEN 'WAVE_WARP' WHEN h % 100 < 90 THEN 'SLIDE_SHAKE' END AS type FROM sh)
SELECT tid, idx, t, type, is_wrap, CASE WHEN type = 'WARP_BUBBLE' THEN 4 ELSE 6 END AS duration_frames FROM x WHERE type IS NOT NULL""")
def transitions(spark, sf_dir):
    seg, _ = _segments(spark, sf_dir)
    return ev.transitions(seg.withColumn("wrap", F.col("idx") % 11 == 5), ["tid"], "HARD", "wrap")


_LCG = "(({x} * 1664525 + 1013904223) % 4294967296)"
_DRAWS = "l0 AS (SELECT *, xor((idx * 1664525 + 1013904223) % 4294967296, 1542469173) AS seed FROM lines), l1 AS (SELECT *, (seed * 1664525 + 1013904223) % 4294967296 AS s1 FROM l0)" + "".join(f", l{i} AS (SELECT *, (s{i - 1} * 1664525 + 1013904223) % 4294967296 AS s{i} FROM l{i - 1})" for i in range(2, 9))
_STYLE = "CASE part % 3 WHEN 0 THEN 'HARD' WHEN 1 THEN 'SMOOTH' ELSE 'HYBRID' END"


@query(f"""WITH {LINES_SQL}, {_DRAWS}, z AS (SELECT *, {_STYLE} AS style FROM l8)
SELECT oid, idx, style, CAST(seed AS BIGINT) AS seed, """ + ", ".join(f"(s{i} % 100 < CASE WHEN style = 'HYBRID' THEN {ev.LOTTERY['HYBRID'][n]} ELSE {ev.LOTTERY['HARD'][n]} END{'' if n == 'chain' else ' AND style <> $$SMOOTH$$'}) AS {n}" for i, n in enumerate(ev.LOTTERY["HARD"], 1)) + """,
CAST(s1 % 2 AS INT) AS bouncy_axis, CAST(s7 % 2 AS INT) AS stretch_axis, CAST(s8 % 3 AS INT) AS zoom_offset FROM z""")
def effect_lottery(spark, sf_dir):
    style = F.when(F.col("part") % 3 == 0, "HARD").when(F.col("part") % 3 == 1, "SMOOTH").otherwise("HYBRID")
    rows = lines(spark, sf_dir).select("oid", "idx", style.alias("style"))
    return ev.lottery(rows, F.col("style"))


@query(f"""WITH {LINES_SQL}, {_DRAWS} SELECT oid, idx, s6 % 100 < 30 AS chain_next, coalesce(lag(s6 % 100 < 30) OVER (PARTITION BY oid ORDER BY idx), false) AS from_prev, CASE WHEN idx % 2 = 0 THEN 1.0{D} ELSE 1.15{D} END AS scale_start, CASE WHEN idx % 2 = 0 THEN 1.15{D} ELSE 1.0{D} END AS scale_end,
CASE WHEN idx % 2 = 0 THEN 'snap' ELSE 'saddle' END AS curve FROM l8""")
def zoom_chain_flags(spark, sf_dir):
    rows = ev.lottery(lines(spark, sf_dir).select("oid", "idx"), F.lit("HARD"))
    flagged = ev.chained(rows.withColumnRenamed("chain", "chain_next"), ["oid"], "idx", "chain_next")
    return facts.by_turns(flagged, "idx", 1.0, 1.15).select("oid", "idx", "chain_next", "from_prev", "scale_start", "scale_end", "curve")


def curve_sql(name: str, x: str) -> str:
    c = f"least(greatest({x}, 0.0{D}), 1.0{D})"
    return f"(CASE {name} WHEN 'snap' THEN 1.0{D} - (1.0{D} - {c}) * (1.0{D} - {c}) * (1.0{D} - {c}) WHEN 'saddle' THEN {c} * {c} * (3.0{D} - 2.0{D} * {c}) ELSE {c} END)"


def slope_sql(name: str, x: str) -> str:
    c = f"least(greatest({x}, 0.0{D}), 1.0{D})"
    return f"(CASE {name} WHEN 'snap' THEN 3.0{D} * (1.0{D} - {c}) * (1.0{D} - {c}) WHEN 'saddle' THEN 6.0{D} * {c} * (1.0{D} - {c}) ELSE 1.0{D} END)"


_GRID = f"""grid AS (SELECT part, supp, idx, CASE idx % 3 WHEN 0 THEN 'snap' WHEN 1 THEN 'saddle' ELSE 'linear' END AS curve, CAST(part % 101 AS DOUBLE) / 100.0{D} AS x, CASE WHEN supp % 4 = 0 THEN NULL ELSE discount * 8.0{D} END AS strength, CAST(supp % 10 AS DOUBLE) / 40.0{D} AS p0, 1.0{D} - CAST(part % 10 AS DOUBLE) / 40.0{D} AS p1, oid FROM lines)"""


def _grid(spark, sf_dir):
    kind = F.when(F.col("idx") % 3 == 0, "snap").when(F.col("idx") % 3 == 1, "saddle").otherwise("linear")
    return lines(spark, sf_dir).select(
        "oid", "idx", kind.alias("curve"), ((F.col("part") % 101).cast("double") / 100.0).alias("x"), F.when(F.col("supp") % 4 != 0, F.col("discount") * 8.0).alias("strength"),
        ((F.col("supp") % 10).cast("double") / 40.0).alias("p0"), (1.0 - (F.col("part") % 10).cast("double") / 40.0).alias("p1"), "part", "supp", "price", "discount", "tax", "t0", "t1",
    )


def _blend(p: str) -> str:
    return f"(({p}) * (1.0{D} - strength) + strength * {curve_sql('curve', p)})"


@query(f"""WITH {LINES_SQL}, {_GRID}, a AS (SELECT *, p0 + (p1 - p0) * x AS phase FROM grid), b AS (SELECT *, {_blend("p0")} AS b0, greatest({_blend("p1")} - {_blend("p0")}, 1e-12) AS span, {_blend("phase")} AS bp FROM a)
SELECT oid, idx, {r6(f"CASE WHEN strength IS NULL THEN {curve_sql('curve', 'x')} ELSE least(greatest((bp - b0) / span, 0.0{D}), 1.0{D}) END")} AS value,
{r6(f"CASE WHEN strength IS NULL THEN {slope_sql('curve', 'x')} ELSE (1.0{D} - strength + strength * {slope_sql('curve', 'phase')}) * (p1 - p0) / span END")} AS slope,
CASE WHEN part % 2 = 0 OR {slope_sql("curve", "x")} <= 1 THEN 1 ELSE CAST(least(1 + floor({slope_sql("curve", "x")}), 4) AS INT) END AS blur FROM b""")
def remap_curves(spark, sf_dir):
    g = _grid(spark, sf_dir)
    value, slope = cv.remapped(F.col("curve"), F.col("x"), F.col("strength"), F.col("p0"), F.col("p1"))
    blur = cv.blur_frames(cv.curve_slope(F.col("curve"), F.col("x")), F.col("part") % 2 != 0)
    return g.select("oid", "idx", out6(value).alias("value"), out6(slope).alias("slope"), blur.alias("blur"))


@query(f"""WITH RECURSIVE {LINES_SQL}, {_GRID}, g AS (SELECT oid, idx, curve, x, coalesce(strength, 0.0{D}) AS strength FROM grid),
s AS (SELECT *, 0 AS n, 0.0{D} AS lo, 1.0{D} AS hi FROM g UNION ALL SELECT oid, idx, curve, x, strength, n + 1, CASE WHEN {_blend("(lo + hi) / 2")} < x THEN (lo + hi) / 2 ELSE lo END, CASE WHEN {_blend("(lo + hi) / 2")} < x THEN hi ELSE (lo + hi) / 2 END FROM s WHERE n < 40)
SELECT oid, idx, {r6("(lo + hi) / 2")} AS phase FROM s WHERE n = 40""")
def inverse_curve(spark, sf_dir):
    g = _grid(spark, sf_dir)
    return g.select("oid", "idx", out6(cv.inverse_curve(F.col("curve"), F.col("x"), F.coalesce("strength", F.lit(0.0)))).alias("phase"))


def _through_sql(x: str, points: list[tuple[str, str]]) -> str:
    cases = " ".join(f"WHEN {x} <= {x1} THEN {y0} + ({x} - {x0}) / ({x1} - {x0}) * ({y1} - {y0})" for (x0, y0), (x1, y1) in zip(points, points[1:], strict=False))
    return f"(CASE {cases} END)"


_BOUNCE = [(f"{x}{D}", f"({y}{D})") for x, y in cv.BOUNCE]
_RAMP = f"(2.0{D} / 16.0{D})"


@query(f"""WITH {LINES_SQL}, e AS (SELECT oid, idx, t1 - t0 AS d, (t1 - t0) * CAST(part % 21 AS DOUBLE) / 20.0{D} AS t, price / 10000.0{D} AS a0, 5.0{D} + tax * 100.0{D} AS om, 2.0{D} + discount AS k, CAST(supp AS BIGINT) AS seed, part, supp FROM lines),
f AS (SELECT *, least(greatest((CASE WHEN t <= {_RAMP} THEN least(greatest(t / {_RAMP}, 0), 1) ELSE 1 END) * (CASE WHEN t >= d - {_RAMP} THEN least(greatest((d - t) / {_RAMP}, 0), 1) ELSE 1 END), 0), 1) AS env, t * 16.0{D} AS fr, a0 * exp(-k * t) AS sw FROM e),
g AS (SELECT *, (sin(om * t + CAST(seed % 360 AS DOUBLE) * {PI} / 180.0{D}) * env) AS w1, (sin(om * t + CAST((seed * 17) % 4294967296 % 360 AS DOUBLE) * {PI} / 180.0{D}) * env) AS w17, (sin(om * t + CAST((seed * 31) % 4294967296 % 360 AS DOUBLE) * {PI} / 180.0{D}) * env) AS w31, (sin(om * t + CAST((seed * 47) % 4294967296 % 360 AS DOUBLE) * {PI} / 180.0{D}) * env) AS w47,
  CASE WHEN fr >= 0 AND fr <= 10 THEN {_through_sql("fr", _BOUNCE)} ELSE 0 END * 40.0{D} AS bn, least(greatest((greatest(t - CAST(part % 3 AS DOUBLE) / 16.0{D}, 0)) / greatest(d, 1e-6), 0), 1) AS zx, least(greatest(t / d, 0), 1) AS u FROM f)
SELECT oid, idx, {r6("CASE WHEN part % 4 = 0 THEN bn ELSE sw * w1 END")} AS dx, {r6("CASE WHEN part % 4 = 1 THEN bn ELSE sw * w17 END")} AS dy, {r6(f"greatest((1.0{D} + (1.15{D} - 1.0{D}) * zx) * (1.0{D} + sw / 100.0{D} * w31), 0.1{D})")} AS scale, {r6(f"sw / 5.0{D} * w47 * {PI} / 180.0{D}")} AS tilt,
{r6(f"CASE WHEN supp % 3 = 0 THEN tan(10.0{D} * {PI} / 180.0{D} * exp(-3.0{D} * t / d) * cos(2.0{D} * {PI} * 4.0{D} * t / d)) * env ELSE 0 END")} AS skew,
{r6(f"CASE WHEN supp % 5 = 0 THEN 1.4{D} + (1.0{D} - 1.4{D}) * (u * u * (3.0{D} - 2.0{D} * u)) ELSE 1 END * CASE WHEN part % 2 = 0 AND fr > 0 AND fr < 5 THEN {_through_sql('fr', [(f'0.0{D}', f'1.0{D}'), (f'1.0{D}', f'1.1{D}'), (f'3.0{D}', f'(1.0{D} - (1.1{D} - 1.0{D}) * 0.4{D})'), (f'5.0{D}', f'1.0{D}')])} ELSE 1 END")} AS scale_x,
{r6(f"CASE WHEN part % 2 = 0 AND fr > 0 AND fr < 5 THEN {_through_sql('fr', [(f'0.0{D}', f'1.0{D}'), (f'1.0{D}', f'0.88{D}'), (f'3.0{D}', f'(1.0{D} + (1.0{D} - 0.88{D}) / 2.0{D})'), (f'5.0{D}', f'1.0{D}')])} ELSE 1 END")} AS scale_y,
{r6(f"CASE WHEN supp % 2 = 0 THEN 0.08{D} * (1.0{D} - u) * (1.0{D} - u) ELSE 0 END")} AS barrel FROM g""")
def shake_params(spark, sf_dir):
    g = _grid(spark, sf_dir)
    part, supp, none = F.col("part"), F.col("supp"), F.lit(None).cast("double")
    e = {
        "shake_a0": F.col("price") / 10000.0, "shake_omega": 5.0 + F.col("tax") * 100.0, "shake_k": 2.0 + F.col("discount"), "shake_seed": supp, "zoom_start": F.lit(1.0), "zoom_end": F.lit(1.15), "zoom_offset": part % 3,
        "bouncy_amp": F.when(part % 4 < 2, 40.0), "bouncy_axis": part % 4, "stretch_start": F.when(supp % 5 == 0, 1.4).otherwise(none), "stretch_axis": F.lit(0),
        "squish_y": F.when(part % 2 == 0, 0.88), "squish_x": F.lit(1.10), "skew_deg": F.when(supp % 3 == 0, 10.0), "optics_k0": F.when(supp % 2 == 0, 0.08), "chained": F.lit(False), "chain_prev": F.lit(False), "chain_next": F.lit(False),
    }
    d = F.col("t1") - F.col("t0")
    made = g.select("oid", "idx", cv.transform_params(e, d * (part % 21).cast("double") / 20.0, d, F.lit(16.0)).alias("p"))
    return made.select("oid", "idx", *(out6(F.col(f"p.{c}")).alias(c) for c in ("dx", "dy", "scale", "tilt", "skew", "scale_x", "scale_y", "barrel")))


@query(f"""WITH {TIMELINE_SQL}, q AS (SELECT tid, eid, t / 3600.0{D} AS t, type FROM tl), b AS (SELECT tid, list(t) AS times FROM q WHERE type = 'purchase' GROUP BY tid),
x AS (SELECT q.tid, eid, q.t, 0.15{D} * sin(2.0{D} * {PI} * 12.0{D} * q.t + CAST(eid AS DOUBLE) * 0.0012345{D}) AS fl, greatest(coalesce(list_max(list_transform(times, lambda z: CASE WHEN abs((q.t - z) * 2.0{D}) <= 2.0{D} + 1e-4 THEN 0.5{D} * greatest(1.0{D} - abs((q.t - z) * 2.0{D}) / 2.0{D}, 0) ELSE 0.0{D} END)), 0), 0) AS fs FROM q LEFT JOIN b ON q.tid = b.tid)
SELECT tid, eid, {r6("fl")} AS flicker, {r6("fs")} AS flash, {r6(f"least(greatest(fl + fs, -0.999{D}), 0.999{D})")} AS exposure FROM x""")
def flicker_exposure(spark, sf_dir):
    rows = timeline(spark, sf_dir).withColumn("t", F.col("t") / 3600.0)
    beats = rows.where("type = 'purchase'").groupBy("tid").agg(F.collect_list("t").alias("times"))
    x = rows.join(beats, "tid", "left").select("tid", "eid", cv.flicker(F.col("t"), F.lit(0.15), F.lit(12.0), F.col("eid").cast("double")).alias("fl"), cv.flash(F.col("t"), F.col("times"), F.lit(0.5), F.lit(2.0)).alias("fs"))
    return x.select("tid", "eid", out6(F.col("fl")).alias("flicker"), out6(F.col("fs")).alias("flash"), out6(cv.exposure(F.col("fl"), F.col("fs"))).alias("exposure"))


@query(f"""WITH p AS (SELECT p_partkey, p_size * (CASE WHEN p_partkey % 3 = 0 THEN 40 ELSE 1 END) AS w, CAST(p_partkey % 50 AS INT) * (CASE WHEN p_partkey % 3 = 0 THEN 40 ELSE 1 END) AS h0 FROM part), q AS (SELECT p_partkey, CASE WHEN w = 0 THEN 1080 ELSE w END AS w, CASE WHEN h0 = 0 THEN 1080 ELSE h0 END AS h FROM p)
SELECT p_partkey, CAST(CASE WHEN w >= 100 AND h >= 100 THEN w // 2 * 2 WHEN w >= h THEN greatest(CAST({half_up_sql(f"1080.0{D} * (CAST(w AS DOUBLE) / h)")} AS BIGINT) // 2 * 2, 2) ELSE 1080 END AS INT) AS out_w,
CAST(CASE WHEN w >= 100 AND h >= 100 THEN h // 2 * 2 WHEN w >= h THEN 1080 ELSE greatest(CAST({half_up_sql(f"1080.0{D} * (CAST(h AS DOUBLE) / w)")} AS BIGINT) // 2 * 2, 2) END AS INT) AS out_h, {r6(f"1080.0{D} / w")} AS scale_x FROM q""")
def crop_dims(spark, sf_dir):
    big = F.when(F.col("p_partkey") % 3 == 0, 40).otherwise(1)
    p = read(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * big).alias("w"), ((F.col("p_partkey") % 50).cast("int") * big).alias("h"))
    sized = p.select("p_partkey", cv.output_size(F.col("w"), F.col("h")).alias("s"), out6(1080.0 / F.when(F.col("w") == 0, 1080).otherwise(F.col("w"))).alias("scale_x"))
    return sized.select("p_partkey", "s.out_w", "s.out_h", "scale_x")


@query("""WITH p AS (SELECT p_partkey, CAST(p_partkey % 200 AS BIGINT) - 100 AS c, CAST(p_size AS BIGINT) AS n FROM part), q AS (SELECT *, CASE WHEN abs(c) >= n THEN 2 * n - 1 - abs(c) ELSE abs(c) END AS b, ((c % greatest(2 * (n - 1), 1)) + greatest(2 * (n - 1), 1)) % greatest(2 * (n - 1), 1) AS m FROM p)
SELECT p_partkey, CASE WHEN n <= 1 THEN 0 ELSE least(greatest(b, 0), n - 1) END AS edge, CASE WHEN n <= 1 THEN 0 WHEN m > n - 1 THEN 2 * (n - 1) - m ELSE m END AS periodic, CASE WHEN n <= 1 THEN 32768 ELSE CAST(floor(CAST(m * 65536 AS DOUBLE) / greatest(n - 1, 1)) AS INT) END AS share FROM q""")
def mirror_coords(spark, sf_dir):
    p = read(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 200 - 100).alias("c"), F.col("p_size").cast("long").alias("n"))
    m = F.pmod("c", F.greatest(2 * (F.col("n") - 1), F.lit(1)))
    return p.select("p_partkey", cv.edge_mirror(F.col("c"), F.col("n")).cast("long").alias("edge"), cv.periodic_mirror(F.col("c"), F.col("n")).cast("long").alias("periodic"), cv.normalised(m, F.col("n")).alias("share"))


_VALUES = ", ".join(f"('{s}', '{p[0]}', {p[1 + i]}{D}, {p[4]}{D}, {p[5]}{D})" for i, s in enumerate(presets.STYLES) for p in presets.PARAMETERS)
_SEGMENT_STYLE = "CASE c_mktsegment WHEN 'BUILDING' THEN 'SMOOTH' WHEN 'MACHINERY' THEN 'HYBRID' ELSE 'HARD' END"


def _styles(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    return c.select("c_custkey", "c_acctbal", F.when(F.col("c_mktsegment") == "BUILDING", "SMOOTH").when(F.col("c_mktsegment") == "MACHINERY", "HYBRID").otherwise("HARD").alias("style"))


@query(f"""WITH p(style, name, value, low, high) AS (VALUES {_VALUES}), c AS (SELECT c_custkey, {_SEGMENT_STYLE} AS style FROM customer)
SELECT c.c_custkey, c.style, p.name, p.value FROM c JOIN p ON c.style = p.style WHERE p.value <> 0""")
def style_presets(spark, sf_dir):
    table = presets.parameter_table(spark)  # a fixed number of rows
    return _styles(spark, sf_dir).join(F.broadcast(table), "style").where("value <> 0").select("c_custkey", "style", "name", "value")


_ON = ", ".join(f"('{s}', {f}, '{k}', {str(v).lower()})" for s in presets.STYLES for f in ("false", "true") for k, v in presets.toggles(s, f == "true").items())


@query(f"""WITH p(style, full_fx, name, enabled) AS (VALUES {_ON}), c AS (SELECT {_SEGMENT_STYLE} AS style, c_acctbal > 5000 AS full_fx FROM customer)
SELECT c.style, p.name, count(*) AS plans, count(CASE WHEN enabled THEN 1 END) AS enabled FROM c JOIN p ON c.style = p.style AND c.full_fx = p.full_fx GROUP BY c.style, p.name""")
def style_toggles(spark, sf_dir):
    c = _styles(spark, sf_dir).withColumn("full_fx", F.col("c_acctbal") > 5000)
    met = c.join(F.broadcast(presets.toggle_table(spark)), ["style", "full_fx"])
    return met.groupBy("style", "name").agg(F.count("*").alias("plans"), F.count(F.when(F.col("enabled"), 1)).alias("enabled"))


_FRAMES = f"""frames AS (SELECT tid, f AS frame, f / 2.0{D} AS t FROM (SELECT tid, CAST(floor(max(t0) * 2) AS BIGINT) AS n FROM seg GROUP BY tid) q, range(0, 3000) r(f) WHERE f <= n)"""


def _frames(seg, fps):
    ends = seg.groupBy("tid").agg(F.floor(F.max("t0") * fps).alias("n"))
    return ends.select("tid", F.explode(F.sequence(F.lit(0).cast("long"), "n")).alias("frame")).select("tid", "frame", (F.col("frame") / fps).alias("t"))


@query(f"""WITH {_SEG}, {_FRAMES}, m AS (SELECT f.tid, f.frame, f.t, s.idx, row_number() OVER (PARTITION BY f.tid, f.frame ORDER BY s.t0, s.idx) AS n FROM frames f JOIN seg s ON f.tid = s.tid AND abs(f.t - s.t0) < 0.5{D} / 2.0{D} + 1e-6)
SELECT tid, frame, idx FROM m WHERE n = 1""")
def active_event_nearest(spark, sf_dir):
    seg, _ = _segments(spark, sf_dir)
    return ev.active_nearest(_frames(seg, 2.0), seg.select("tid", F.col("t0").alias("t"), "idx"), ["tid"], 2.0, "idx").select("tid", "frame", "idx")


_KIND = "CASE idx % 3 WHEN 0 THEN 'WARP_BUBBLE' WHEN 1 THEN 'WAVE_WARP' ELSE 'SLIDE_SHAKE' END"


@query(f"""WITH {_SEG}, {_FRAMES}, e AS (SELECT tid, t0, idx, {_KIND} AS type FROM seg), m AS (SELECT f.tid, f.frame, e.idx, e.type, e.t0, (f.t - e.t0) * 2.0{D} AS x FROM frames f JOIN e ON f.tid = e.tid AND abs(f.t - e.t0) < 8),
c AS (SELECT *, row_number() OVER (PARTITION BY tid, frame ORDER BY t0, idx) AS n FROM m WHERE CASE type WHEN 'WARP_BUBBLE' THEN abs(x) <= 2.0{D} + 1e-4 WHEN 'WAVE_WARP' THEN x >= -1e-4 AND x <= 6.0{D} + 1e-4 ELSE abs(x) <= 3.0{D} + 1e-4 END)
SELECT tid, frame, idx, type, {r6(f"CASE type WHEN 'WARP_BUBBLE' THEN 0.5{D} * greatest(1.0{D} - abs(x) / 2.0{D}, 0) WHEN 'WAVE_WARP' THEN 280.0{D} * least(greatest(1.0{D} - x / 6.0{D}, 0), 1) WHEN 'SLIDE_SHAKE' THEN CASE WHEN x < 0 THEN 100.0{D} * least(greatest(1.0{D} + x / 3.0{D}, 0), 1) ELSE -100.0{D} * least(greatest(1.0{D} - x / 3.0{D}, 0), 1) END END")} AS amount FROM c WHERE n = 1""")
def active_transition_first(spark, sf_dir):
    seg, _ = _segments(spark, sf_dir)
    kind = F.when(F.col("idx") % 3 == 0, "WARP_BUBBLE").when(F.col("idx") % 3 == 1, "WAVE_WARP").otherwise("SLIDE_SHAKE")
    met = ev.active_transition(_frames(seg, 2.0), seg.select("tid", F.col("t0").alias("t"), "idx", kind.alias("type")), ["tid"], 2.0, "idx")
    x = F.col("t_frames")
    amount = F.when(F.col("type") == "WARP_BUBBLE", cv.warp_bubble(x)).when(F.col("type") == "WAVE_WARP", cv.wave_height(x)).otherwise(cv.slide_shift(x))
    return met.select("tid", "frame", "idx", "type", out6(amount).alias("amount"))


@query(f"""WITH {_SEG}, {_FRAMES}, e AS (SELECT tid, t0, t0 + 1.2{D} AS t1, {_KIND} AS kind, idx AS seed FROM seg), m AS (SELECT DISTINCT f.tid, f.frame, e.kind FROM frames f JOIN e ON f.tid = e.tid AND f.t > e.t0 AND f.t < e.t1),
c AS (SELECT tid, frame, string_agg(kind, ',' ORDER BY kind) AS kinds, count(*) AS active FROM m GROUP BY tid, frame) SELECT tid, frame, kinds, active, {r6(f"1.0{D} / (1.0{D} + 0.25{D} * (active - 1))")} AS gain FROM c""")
def creative_active(spark, sf_dir):
    seg, _ = _segments(spark, sf_dir)
    kind = F.when(F.col("idx") % 3 == 0, "WARP_BUBBLE").when(F.col("idx") % 3 == 1, "WAVE_WARP").otherwise("SLIDE_SHAKE")
    e = seg.select("tid", "t0", (F.col("t0") + 1.2).alias("t1"), kind.alias("kind"), F.col("idx").alias("seed"), F.lit(0.9).alias("strength"))
    return ev.active_creative(_frames(seg, 2.0), e, ["tid"], 2.0).select("tid", "frame", "kinds", "active", out6(F.col("gain")).alias("gain"))


_CREATIVE_ONE = """{kind} AS (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY tid) AS n FROM anchors)"""


_PICTURES = f"""pic0 AS (SELECT tid, idx, t0, lead(t0, 1, target) OVER (PARTITION BY tid ORDER BY idx) AS t1 FROM seg), pic AS (SELECT *, CAST(idx % 7 AS DOUBLE) * 10 AS s0, CAST(idx % 7 AS DOUBLE) * 10 + (t1 - t0) * 0.75{D} AS s1, CASE idx % 3 WHEN 0 THEN 'snap' WHEN 1 THEN 'saddle' ELSE 'linear' END AS curve FROM pic0 WHERE t1 > t0)"""


def _pictures(seg):
    """The cuts of a timeline as segments that follow each other, each from a place of its own in a source of 720 s."""
    w = Window.partitionBy("tid").orderBy("idx")
    i = F.col("idx")
    curve = F.when(i % 3 == 0, "snap").when(i % 3 == 1, "saddle").otherwise("linear")
    rows = seg.select("tid", "idx", "t0", F.coalesce(F.lead("t0").over(w), F.col("target")).alias("t1")).where("t1 > t0")
    s0 = (i % 7).cast("double") * 10
    return rows.select("tid", "idx", "t0", "t1", s0.alias("s0"), (s0 + (F.col("t1") - F.col("t0")) * 0.75).alias("s1"), curve.alias("curve"))


def _creative_sql() -> str:
    test = {"time_slice": "i % 2 = 0", "ink_pulse": "i % 2 = 1 OR n = 1", "prism_drift": "i % 3 = 1 OR n = 1", "focus_pull": "i % 3 = 0", "relief_light": "i % 3 = 1 OR n = 1", "paper_gate": "i % 3 = 2 OR (n < 3 AND i = n - 1)"}
    f = f"(1.0{D} / 16)"
    parts = []
    for kind, salt, length, gap, lone in ev.CREATIVE:
        start = f"least({half_up_sql(f'(t + CASE WHEN n = 1 THEN 0.75{D} * {lone}{D} ELSE 0 END) / {f}')} * {f}, greatest(floor(target / {f}) - 2, 0) * {f})"
        parts.append(f"SELECT tid, '{kind}' AS kind, t AS anchor, {salt} AS salt, {start} AS t0, least({start} + least(greatest(0.75{D} * {length}{D}, {f} * 2), 1.2{D}), target) AS t1, 0.75{D} * {gap}{D} AS gap FROM numbered WHERE {test[kind]}")
    union = " UNION ALL ".join(parts)
    return f"""WITH RECURSIVE {_SEG}, v AS (SELECT tid, 0 AS eid, t FROM db), {greedy("v", f"0.02{D}", None)}, anchors AS (SELECT k.tid, k.t, target FROM k JOIN (SELECT DISTINCT tid, target FROM db) g ON k.tid = g.tid WHERE kept),
numbered AS (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY tid) AS n FROM anchors), cand AS ({union}), ok AS (SELECT *, row_number() OVER (PARTITION BY tid, kind ORDER BY t0, anchor) AS r FROM cand WHERE t1 - t0 > {f}),
acc AS (SELECT tid, kind, anchor, salt, t0, t1, gap, r, true AS kept2, t1 AS last_end FROM ok WHERE r = 1 UNION ALL SELECT o.tid, o.kind, o.anchor, o.salt, o.t0, o.t1, o.gap, o.r, o.t0 >= a.last_end + o.gap, CASE WHEN o.t0 >= a.last_end + o.gap THEN o.t1 ELSE a.last_end END FROM acc a JOIN ok o ON o.tid = a.tid AND o.kind = a.kind AND o.r = a.r + 1),
fin AS (SELECT * FROM acc WHERE kept2), {_PICTURES}, pr AS (SELECT tid, arg_min(idx, idx) AS idx0 FROM pic GROUP BY tid),
src AS (SELECT f.*, coalesce(p.t0, z.t0) AS g0, coalesce(p.t1, z.t1) AS g1, coalesce(p.s0, z.s0) AS s0, coalesce(p.s1, z.s1) AS s1, coalesce(p.curve, z.curve) AS curve FROM fin f JOIN pr ON pr.tid = f.tid JOIN pic z ON z.tid = f.tid AND z.idx = pr.idx0 LEFT JOIN pic p ON p.tid = f.tid AND f.t0 >= p.t0 AND f.t0 < p.t1),
pl AS (SELECT *, anchor + (s0 + (s1 - s0) * {curve_sql("curve", "(t0 - g0) / (g1 - g0)")}) + 720.0{D} * 0.17{D} AS place FROM src), {hash_sql("pl", "fh", "place", "salt")}
SELECT tid, kind, t0, t1, CAST(h % 4294967296 AS BIGINT) AS seed, {r6(f"0.9{D} * (0.9{D} + CAST(h % 4294967296 % 11 AS DOUBLE) * 0.01{D})")} AS strength FROM fh"""


@query(_creative_sql())
def creative_schedule(spark, sf_dir):
    """All six kinds over the downbeats of each timeline, each with its own clean gaps."""
    seg, beats = _segments(spark, sf_dir)
    anchors = folds.min_gap(beats.select("tid", "t", "target"), ["tid"], "t", 0.02)
    parts = [ev.creative_times(anchors, ["tid"], kind, F.lit(0.75), FPS, "target") for kind, *_ in ev.CREATIVE]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    kept = ev.seeded(ev.with_clean_gaps(rows, ["tid"]), _pictures(seg), ["tid"], 720.0, "HARD")
    return kept.select("tid", "kind", "t0", "t1", "seed", out6(F.col("strength")).alias("strength"))
