"""Queries of the rules of plans, sources and effects that the other modules do not reach."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronoframe.functions import curves as cv
from chronoframe.functions import text as tx
from chronoframe.functions.numbers import mix32
from chronoframe.operators import analysis, facts, folds, planning, words
from chronoframe.operators import events as ev
from chronoframe.plans import presets, validation
from chronoframe.plans.event_queries import _SEG, D, FPS, _segments, half_up_sql, hash_sql, out6, r6
from chronoframe.plans.plan_queries import _plans
from chronoframe.plans.registry import query
from chronoframe.sources.tables import LINES_SQL, SCENES_SQL, TIMELINE_SQL, lines, read, scenes, timeline


@query(f"""WITH {LINES_SQL}, x AS (SELECT oid, idx, (t1 - t0) * CAST(part % 21 AS DOUBLE) / 20.0{D} AS t, t1 - t0 AS d, supp % 2 = 0 AS p, supp % 3 = 0 AS n, 2.0{D} / 16 AS ramp FROM lines)
SELECT oid, idx, {r6(f"(CASE WHEN p AND t < ramp THEN 0.6{D} + 0.4{D} * least(greatest(t / ramp, 0), 1) ELSE 1 END) * (CASE WHEN n AND t > d - ramp THEN 0.6{D} + 0.4{D} * least(greatest((d - t) / ramp, 0), 1) ELSE 1 END)")} AS gain FROM x""")
def chain_envelope(spark, sf_dir):
    rows = lines(spark, sf_dir)
    d = F.col("t1") - F.col("t0")
    gain = cv.chain(d * (F.col("part") % 21).cast("double") / 20.0, d, F.lit(16.0), F.col("supp") % 2 == 0, F.col("supp") % 3 == 0)
    return rows.select("oid", "idx", out6(gain).alias("gain"))


@query(f"""WITH {LINES_SQL}, x AS (SELECT oid, idx, least(greatest((CAST(part % 60 AS DOUBLE) - t0) / (t1 - t0), 0), 1) AS p, discount * 10 AS s FROM lines)
SELECT oid, idx, {r6("p")} AS phase, CAST({half_up_sql(f"sin(pi() * p) * sin(pi() * p) * s * 256.0{D}")} AS INT) AS weight FROM x""")
def creative_phase(spark, sf_dir):
    p = cv.phase((F.col("part") % 60).cast("double"), F.col("t0"), F.col("t1"))
    return lines(spark, sf_dir).select("oid", "idx", out6(p).alias("phase"), cv.accent(p, F.col("discount") * 10).alias("weight"))


_MIX = f"""a AS (SELECT event_id, CAST(event_id * 2654435761 % 4294967296 AS UBIGINT) AS x FROM events), b AS (SELECT event_id, xor(x, x >> 16) * {0x7FEB352D}::UBIGINT % 4294967296::UBIGINT AS x FROM a),
c AS (SELECT event_id, xor(x, x >> 15) * {0x846CA68B}::UBIGINT % 4294967296::UBIGINT AS x FROM b)"""


@query(f"WITH {_MIX} SELECT event_id, CAST(xor(x, x >> 16) AS BIGINT) AS mixed FROM c")
def noise_mix(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", mix32(F.col("event_id") * 2654435761 % 4294967296).alias("mixed"))


_PLAN_RULES = f"""p AS (SELECT o_orderkey AS oid, CAST(o_orderkey % 6 AS INT) AS v, ['HARD', 'smooth', 'HYBRID', 'ODD'][CAST(o_orderkey % 4 AS INT) + 1] AS style, CAST(o_orderkey % 40 AS INT) - 2 AS w, CAST(o_orderkey % 30 AS INT) * 2 AS h, CAST(o_orderkey % 130 AS INT) AS fps,
o_totalprice / 2.0{D} - 1000 AS target, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_totalprice - 5000 END AS video, ['h.264', 'H265', 'vp9', 'mpeg'][CAST(o_custkey % 4 AS INT) + 1] AS codec, ['mp4', 'webm', 'gif'][CAST(o_custkey % 3 AS INT) + 1] AS format, CAST(o_custkey % 110 AS INT) AS bitrate FROM orders),
q AS (SELECT *, replace(upper(codec), '.', '') AS c, upper(format) AS f FROM p)"""


@query(f"""WITH {_PLAN_RULES}, r AS (SELECT oid, unnest([CASE WHEN NOT v BETWEEN 1 AND 4 THEN 'version' END, CASE WHEN upper(style) NOT IN ('HARD', 'SMOOTH', 'HYBRID') THEN 'style' END, CASE WHEN w <= 0 OR h <= 0 OR w % 2 <> 0 OR h % 2 <> 0 THEN 'size' END,
CASE WHEN NOT fps BETWEEN 1 AND 120 THEN 'rate' END, CASE WHEN NOT (target > 0 AND target <= 86400 AND target * fps >= 0.5) THEN 'target' END, CASE WHEN video IS NULL OR video <= 0 THEN 'video' END,
CASE WHEN NOT (c IN ('H264', 'H265', 'HEVC', 'VP9') AND f IN ('MP4', 'MKV', 'WEBM') AND (f <> 'WEBM' OR c = 'VP9') AND bitrate BETWEEN 1 AND 100) THEN 'export' END]) AS rule FROM q) SELECT oid, rule FROM r WHERE rule IS NOT NULL""")
def plan_rules(spark, sf_dir):
    pick = lambda names, key: F.element_at(F.array(*map(F.lit, names)), (F.col(key) % len(names) + 1).cast("int"))
    k, price = F.col("o_orderkey"), F.col("o_totalprice")
    plans = read(spark, sf_dir, "orders").select(
        k.alias("oid"), (k % 6).cast("int").alias("schema_version"), pick(["HARD", "smooth", "HYBRID", "ODD"], "o_orderkey").alias("style"), ((k % 40).cast("int") - 2).alias("w"), ((k % 30).cast("int") * 2).alias("h"),
        (k % 130).cast("int").alias("fps"), (price / 2.0 - 1000).alias("target"), F.when(k % 9 != 0, price - 5000).alias("video"),
        pick(["h.264", "H265", "vp9", "mpeg"], "o_custkey").alias("codec"), pick(["mp4", "webm", "gif"], "o_custkey").alias("format"), (F.col("o_custkey") % 110).cast("int").alias("bitrate"),
    )
    return validation.plan_errors(plans, "oid")


@query(f"""WITH {SCENES_SQL}, s AS (SELECT cid, oid, a0 - 8100 AS st, a1 - a0 - 1 AS d, CASE WHEN oid % 7 = 3 THEN NULL ELSE 2000.0{D} END AS src FROM scenes) SELECT cid, oid, 'range' AS rule FROM s WHERE st < 0 OR d <= 0 OR src IS NULL OR st + d > src + 0.051{D}""")
def range_rules(spark, sf_dir):
    s = scenes(spark, sf_dir)
    ranges = s.select("cid", "oid", (F.col("a0") - 8100).alias("start"), (F.col("a1") - F.col("a0") - 1).alias("duration"), F.when(F.col("oid") % 7 != 3, 2000.0).alias("source_duration"))
    return validation.range_errors(ranges, ["cid", "oid"], "start", "duration", "source_duration")


@query(f"""WITH {LINES_SQL}, e AS (SELECT oid, CASE idx % 2 WHEN 0 THEN 'ink_pulse' ELSE 'focus_pull' END AS kind, t0 - 3 AS t0, t0 + discount * 400 AS t1, max(t1) OVER (PARTITION BY oid) AS target FROM lines), f AS (SELECT *, lag(t1) OVER (PARTITION BY oid, kind ORDER BY t0) AS p FROM e)
SELECT oid, kind, t0 FROM f WHERE coalesce(t0 < p, false) OR t0 < 0 OR t1 > target + 1e-9 OR t1 <= t0""")
def event_rules(spark, sf_dir):
    rows = lines(spark, sf_dir).withColumn("target", F.max("t1").over(Window.partitionBy("oid")))
    kind = F.when(F.col("idx") % 2 == 0, "ink_pulse").otherwise("focus_pull")
    events = rows.select("oid", kind.alias("kind"), (F.col("t0") - 3).alias("t0"), (F.col("t0") + F.col("discount") * 400).alias("t1"), "target")
    return validation.event_errors(events, ["oid"], "target")


_CALM = "[" + ", ".join(f"'{x}'" for x in ev.CALM_FRAMERS) + "]"


@query(f"""WITH {_SEG}, {hash_sql("seg", "s1", "t0", "100")}, c0 AS (SELECT tid, target, {half_up_sql(f"(t0 + o / 16.0{D}) * 16")} / 16.0{D} AS t, idx * 10 + o + 3 AS salt, 0 AS origin, idx * 4 + o + 2 AS seq FROM (SELECT * FROM s1 WHERE h % 2 = 0) s, (SELECT unnest([-2, -1, 0, 1]) AS o)),
b0 AS (SELECT tid, target, {half_up_sql("t * 16")} / 16.0{D} AS t, idx * 100 + 777 AS salt, 1 AS origin, idx AS seq FROM db), u AS (SELECT * FROM c0 UNION ALL SELECT * FROM b0), v AS (SELECT * FROM u WHERE t >= -1e-6 AND t <= target + 1e-6), {hash_sql("v", "w", "t", "salt")},
x AS (SELECT *, CAST({half_up_sql("t * 16")} AS BIGINT) AS frame FROM w), y AS (SELECT *, row_number() OVER (PARTITION BY tid, frame ORDER BY t, origin, seq) AS n FROM x)
SELECT tid, t, frame, {_CALM}[CAST(h % 7 AS INT) + 1] AS type FROM y WHERE n = 1""")
def one_framers_calm(spark, sf_dir):
    """A smooth plan with the flashing effects taken out of the pool."""
    seg, beats = _segments(spark, sf_dir)
    return ev.one_framers(seg, beats, ["tid"], "SMOOTH", FPS, "target", calm=True)


def _transition_sql(style: str) -> str:
    kinds = " ".join(f"WHEN h % 100 < {bound} THEN '{name}'" for bound, name in ev.TRANSITIONS[style])
    return f"""WITH {_SEG}, {hash_sql("seg", "sh", "t0", "999")}, x AS (SELECT tid, idx, t0 AS t, idx % 13 = 4 AS is_wrap, CASE WHEN idx % 13 = 4 THEN 'WARP_BUBBLE' WHEN idx = 0 THEN NULL {kinds} END AS type FROM sh)
SELECT tid, idx, t, type, is_wrap, CASE WHEN type = 'WARP_BUBBLE' THEN 4 ELSE 6 END AS duration_frames FROM x WHERE type IS NOT NULL"""


@query(_transition_sql("SMOOTH"))
def transitions_smooth(spark, sf_dir):
    seg, _ = _segments(spark, sf_dir)
    return ev.transitions(seg.withColumn("wrap", F.col("idx") % 13 == 4), ["tid"], "SMOOTH", "wrap")


@query(_transition_sql("HYBRID"))
def transitions_hybrid(spark, sf_dir):
    seg, _ = _segments(spark, sf_dir)
    return ev.transitions(seg.withColumn("wrap", F.col("idx") % 13 == 4), ["tid"], "HYBRID", "wrap")


_DRAWN = f"""l0 AS (SELECT *, xor((idx * 1664525 + 1013904223) % 4294967296, {ev.SEED_MASK}) AS s0 FROM lines)""" + "".join(f", l{i} AS (SELECT *, (s{i - 1} * 1664525 + 1013904223) % 4294967296 AS s{i} FROM l{i - 1})" for i in range(1, 9))


@query(f"""WITH {LINES_SQL}, {_DRAWN}, z AS (SELECT *, CASE part % 3 WHEN 0 THEN 'HARD' WHEN 1 THEN 'SMOOTH' ELSE 'HYBRID' END AS style FROM l8) SELECT oid, idx, style, """ + ", ".join(f"(s{i} % 100 < CASE WHEN style = 'HYBRID' THEN {ev.LOTTERY['HYBRID'][n]} ELSE {ev.LOTTERY['HARD'][n]} END AND (supp + {i}) % 4 <> 0) AS {n}" for i, n in enumerate(ev.LOTTERY["HARD"], 1)) + " FROM z")
def effect_toggles(spark, sf_dir):
    """The lottery with every effect switched on or off by hand, in all three styles."""
    style = F.when(F.col("part") % 3 == 0, "HARD").when(F.col("part") % 3 == 1, "SMOOTH").otherwise("HYBRID")
    toggles = {n: (F.col("supp") + i) % 4 != 0 for i, n in enumerate(ev.LOTTERY["HARD"], 1)}
    made = ev.lottery(lines(spark, sf_dir).select("oid", "idx", "supp", style.alias("style")), F.col("style"), toggles=toggles)
    return made.select("oid", "idx", "style", *ev.LOTTERY["HARD"])


@query(f"""WITH {TIMELINE_SQL}, g AS (SELECT tid, max(t / 3600.0{D}) + 1 AS target FROM tl GROUP BY tid) SELECT tid AS plan_id, CAST(floor((target + 1e-9) / 50.0{D}) AS BIGINT) AS loops FROM g""")
def plan_loops(spark, sf_dir):
    """How often a plan without scenes uses its source up: once for each whole length in the target."""
    made = planning.plan(_plans(spark, sf_dir, "no_change", "HARD", 50.0, False))
    return made.groupBy("plan_id").agg(F.sum("loops").alias("loops"))


@query(f"""WITH p AS (SELECT p_partkey, p_retailprice / 20.0{D} AS video, CAST(p_size AS DOUBLE) AS audio FROM part), n AS (SELECT *, least(greatest(CAST(floor(audio / 3.25{D} + 0.5{D}) AS INT), 2), 8) AS c FROM p), s AS (SELECT *, greatest(video - 3.5{D}, 0) / greatest(c - 1, 1) AS step FROM n),
r AS (SELECT p_partkey, video, audio, step, unnest(range(0, CASE WHEN video > audio THEN c ELSE 1 END)) AS i FROM s)
SELECT p_partkey, CAST(i AS INT) AS part, {r6("i * step")} AS "start", {r6(f"CASE WHEN video > audio THEN least(4.0{D}, video - i * step) ELSE least(video, audio + 2.0{D}) END")} AS length FROM r""")
def long_clip_parts(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    parts = facts.long_clip_parts(F.col("p_retailprice") / 20.0, F.col("p_size").cast("double"))
    rows = p.select("p_partkey", F.posexplode(parts).alias("part", "x"))
    return rows.select("p_partkey", "part", out6(F.col("x.start")).alias("start"), out6(F.col("x.length")).alias("length"))


@query(f"""SELECT event_id, CASE event_id % 6 WHEN 0 THEN 1.0{D} WHEN 1 THEN 8.0{D} WHEN 2 THEN 1.0{D} WHEN 3 THEN 6.0{D} ELSE 1.0{D} END AS sx, CASE event_id % 6 WHEN 0 THEN 8.0{D} WHEN 1 THEN 1.0{D} WHEN 2 THEN 6.0{D} ELSE 1.0{D} END AS sy FROM events""")
def rapid_scale(spark, sf_dir):
    """The first four frames of a rapid word are stretched one way and the other."""
    return read(spark, sf_dir, "events").select("event_id", tx.rapid_scale(F.col("event_id") % 6).alias("s")).select("event_id", "s.sx", "s.sy")


@query("""WITH r AS (SELECT DISTINCT 'name' || CAST(c_nationkey AS VARCHAR) AS base, 'mp4' AS ending FROM customer),
t AS (SELECT DISTINCT 'name' || CAST(c_nationkey AS VARCHAR) || CASE WHEN c_custkey % 5 = 0 THEN '' ELSE '-' || CAST(c_custkey % 5 AS VARCHAR) END || '.mp4' AS name FROM customer WHERE c_nationkey % 4 <> 0 AND (c_custkey + c_nationkey) % 3 <> 0),
c AS (SELECT base, ending, n, CASE WHEN n = 0 THEN base || '.mp4' ELSE base || '-' || CAST(n AS VARCHAR) || '.mp4' END AS name FROM r, range(0, 12) k(n))
SELECT base, ending, arg_min(name, n) AS name FROM c WHERE name NOT IN (SELECT name FROM t) GROUP BY base, ending""")
def unused_names(spark, sf_dir):
    """Output names that no file has yet."""
    c = read(spark, sf_dir, "customer")
    base = F.concat(F.lit("name"), F.col("c_nationkey").cast("string"))
    number = F.when(F.col("c_custkey") % 5 == 0, "").otherwise(F.concat(F.lit("-"), (F.col("c_custkey") % 5).cast("string")))
    taken = c.where("c_nationkey % 4 <> 0 and (c_custkey + c_nationkey) % 3 <> 0").select(F.concat(base, number, F.lit(".mp4")).alias("name")).distinct()
    return facts.unused_names(c.select(base.alias("base"), F.lit("mp4").alias("ending")).distinct(), taken)


@query(f"""WITH {LINES_SQL}, c AS (SELECT oid, t0 + CASE part % 3 WHEN 0 THEN 0.0{D} WHEN 1 THEN 0.0000005{D} ELSE 0.01{D} END AS t FROM lines WHERE supp % 2 = 0) SELECT c.oid, c.t, min(l.idx) AS position FROM c JOIN lines l ON l.oid = c.oid AND abs(l.t0 - c.t) < 1e-6 GROUP BY c.oid, c.t""")
def cut_positions(spark, sf_dir):
    """The segments that begin at a cut."""
    rows = lines(spark, sf_dir)
    off = F.when(F.col("part") % 3 == 0, 0.0).when(F.col("part") % 3 == 1, 0.0000005).otherwise(0.01)
    return facts.cut_positions(rows.select("oid", "idx", "t0"), rows.where("supp % 2 = 0").select("oid", (F.col("t0") + off).alias("t")), ["oid"], "idx")


@query(f"""WITH RECURSIVE {TIMELINE_SQL}, m AS (SELECT tid, eid, t / 7200.0{D} AS t, type IN ('click', 'error') AS cut, max(t / 7200.0{D}) OVER (PARTITION BY tid) + 0.3{D} AS d FROM tl), x AS (SELECT tid, t, row_number() OVER (PARTITION BY tid ORDER BY t, eid) AS i FROM m WHERE cut AND t > 0.5{D} AND t < d - 0.5{D}),
k AS (SELECT tid, t, i, t - 0.0{D} >= 1.0{D} AS kept, CASE WHEN t >= 1.0{D} THEN floor(t * 100.0{D} + 0.5{D}) / 100.0{D} ELSE 0.0{D} END AS last FROM x WHERE i = 1 UNION ALL SELECT x.tid, x.t, x.i, x.t - k.last >= 1.0{D}, CASE WHEN x.t - k.last >= 1.0{D} THEN floor(x.t * 100.0{D} + 0.5{D}) / 100.0{D} ELSE k.last END FROM k JOIN x ON x.tid = k.tid AND x.i = k.i + 1),
c AS (SELECT tid, last AS t FROM k WHERE kept), g AS (SELECT tid, max(d) AS d FROM m GROUP BY tid), e AS (SELECT g.tid, d, coalesce(max(c.t), 0.0{D}) AS last FROM g LEFT JOIN c ON c.tid = g.tid GROUP BY g.tid, d)
SELECT tid, t FROM c UNION ALL SELECT tid, 0.0{D} FROM g UNION ALL SELECT tid, floor(d * 100.0{D} + 0.5{D}) / 100.0{D} FROM e WHERE last < d - 0.1{D}""")
def detected_scenes(spark, sf_dir):
    """Scene boundaries by score, each at least a second after the last as it was rounded."""
    rows = timeline(spark, sf_dir).withColumn("t", F.col("t") / 7200.0)
    scored = rows.withColumn("score", F.when(F.col("type").isin("click", "error"), 0.9).otherwise(0.1)).withColumn("d", F.max("t").over(Window.partitionBy("tid")) + 0.3)
    return facts.detected_scenes(scored, ["tid"], "t", "score", "d")


@query(f"""WITH {SCENES_SQL}, s AS (SELECT cid, oid, a0, a1, price, count(*) OVER (PARTITION BY cid) > 12 AS many FROM scenes) SELECT cid, oid AS scene_id, CAST(oid % 5 AS BIGINT) AS source_id, CASE WHEN many THEN 0.0{D} ELSE a0 END AS "start", CASE WHEN many THEN a1 + 10 ELSE a1 END AS "end" FROM s WHERE price > 50000""")
def picked_clips(spark, sf_dir):
    s = scenes(spark, sf_dir).withColumn("many", F.count("*").over(Window.partitionBy("cid")) > 12)
    clips = s.where("price > 50000").select("cid", "many", F.col("oid").alias("index"), (F.col("oid") % 5).alias("source"), F.col("a0").alias("start"), F.col("a1").alias("end"), (F.col("a1") + 10).alias("source_duration"))
    return facts.picked_clips(clips, F.col("many")).drop("many")


_BEATS = """'{"beats":[' || CAST(event_id % 50 AS VARCHAR) || '.5,' || CAST(event_id % 7 AS VARCHAR) || ',-1' || '],' || CASE WHEN event_id % 3 = 0 THEN '"bpm":' || CAST(event_id % 200 AS VARCHAR) || '.0,' ELSE '' END || '"downbeats":' || CASE WHEN event_id % 4 = 0 THEN 'null' ELSE '[2.25]' END || '}'"""


@query(f"""SELECT event_id, array_to_string([CAST(x AS VARCHAR) FOR x IN list_sort([CAST(event_id % 50 AS DOUBLE) + 0.5{D}, CAST(event_id % 7 AS DOUBLE)])], ' ') AS beats, CASE WHEN event_id % 4 = 0 THEN 0 ELSE 1 END AS downbeats, CASE WHEN event_id % 3 = 0 AND event_id % 200 > 0 THEN CAST(event_id % 200 AS DOUBLE) ELSE 120.0{D} END AS bpm FROM events""")
def beat_json(spark, sf_dir):
    """What a beat detector's JSON says, with defaults for what it lacks."""
    found = read(spark, sf_dir, "events").select("event_id", facts.beat_times(F.expr(_BEATS.replace("VARCHAR", "STRING"))).alias("b"))
    shown = F.array_join(F.transform("b.beats", lambda x: x.cast("string")), " ")
    return found.select("event_id", shown.alias("beats"), F.size("b.downbeats").alias("downbeats"), "b.bpm")


@query(f"""WITH p AS (SELECT l_orderkey AS oid, l_suppkey % 3 AS track, sum(l_quantity) / max(1.0{D} + l_suppkey % 3) AS own FROM lineitem GROUP BY l_orderkey, l_suppkey % 3) SELECT oid, {r6("max(own)")} AS packets FROM p GROUP BY oid""")
def track_durations(spark, sf_dir):
    """A file is as long as its longest track, by its packets."""
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("oid"), (F.col("l_suppkey") % 3).alias("track"), F.col("l_quantity").alias("ticks"), (1.0 + F.col("l_suppkey") % 3).alias("rate"))
    made = facts.track_durations(rows, ["oid"], "track", "ticks", "rate")
    return made.select("oid", out6(F.col("packets")).alias("packets"))


@query("""WITH s AS (SELECT c_custkey AS source, 'f' || CAST(c_custkey % 400 AS VARCHAR) AS fingerprint FROM customer), k AS (SELECT 'f' || CAST(o_custkey % 400 AS VARCHAR) AS fingerprint FROM orders WHERE o_orderkey % 3 = 1 AND o_orderkey % 16 = 5)
SELECT source, fingerprint FROM s WHERE fingerprint NOT IN (SELECT fingerprint FROM k)""")
def fresh_sources(spark, sf_dir):
    """Sources that no cached analysis of this version and kind covers."""
    name = lambda c: F.concat(F.lit("f"), (F.col(c) % 400).cast("string")).alias("fingerprint")
    cache = read(spark, sf_dir, "orders").where("o_orderkey % 16 = 5").select(name("o_custkey"), (F.col("o_orderkey") % 3).cast("int").alias("version"), F.lit(True).alias("remove_blank"))
    return analysis.fresh_sources(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("source"), name("c_custkey")), cache, 1, True).select("source", "fingerprint")


_PREPARED = f"""{LINES_SQL}, l AS (SELECT *, min(CASE WHEN oid % 11 = 0 THEN -1.0{D} ELSE 0.0{D} END) OVER (PARTITION BY oid) AS low, max(t1) OVER (PARTITION BY oid) - CASE WHEN oid % 7 = 0 THEN 1 ELSE 0 END AS high,
t0 - CASE WHEN part % 40 = 0 THEN 0.5{D} ELSE 0 END AS s, CASE WHEN supp % 50 = 0 THEN 0 ELSE t1 - t0 END AS d, t0 + CASE WHEN part % 30 = 0 THEN 1000 ELSE 0 END AS t, CASE WHEN part % 37 = 0 THEN 1.5{D} ELSE discount * 5 END AS a, tax * 5 AS c,
t0 + CASE WHEN supp % 45 = 0 THEN -1 ELSE 0.5{D} END AS peak FROM lines),
p AS (SELECT *, coalesce(lag(s + d) OVER w, low) AS s_from, coalesce(lag(t) OVER w, -1) AS t_from FROM l WINDOW w AS (PARTITION BY oid ORDER BY idx)),
r AS (SELECT oid, bool_or(low < 0 OR high <= low OR oid % 13 = 0) AS scene, bool_or(s < s_from - 1e-7 OR d <= 0 OR s + d > high + 0.051{D}) AS fragment, bool_or(t < t_from OR t < low OR t > high OR a > 1 OR c > 1) AS motion,
bool_or(t0 < low - 1e-4 OR t1 > high + 1e-4 OR peak < t0 - 1e-4 OR peak > t1 + 1e-4) AS act FROM p GROUP BY oid)"""


@query(f"WITH {_PREPARED} SELECT oid, 'scene' AS rule FROM r WHERE scene UNION ALL SELECT oid, 'fragment' FROM r WHERE fragment UNION ALL SELECT oid, 'motion' FROM r WHERE motion UNION ALL SELECT oid, 'action' FROM r WHERE act")
def prepared_rules(spark, sf_dir):
    """An order is a prepared scene, its lines are the fragments, motion samples and actions."""
    k, part, supp = F.col("oid"), F.col("part"), F.col("supp")
    own = F.struct(
        "idx", (F.col("t0") - F.when(part % 40 == 0, 0.5).otherwise(0.0)).alias("s"), F.when(supp % 50 == 0, 0.0).otherwise(F.col("t1") - F.col("t0")).alias("d"), (F.col("t0") + F.when(part % 30 == 0, 1000.0).otherwise(0.0)).alias("t"),
        F.when(part % 37 == 0, 1.5).otherwise(F.col("discount") * 5).alias("a"), (F.col("tax") * 5).alias("c"), "t0", "t1", (F.col("t0") + F.when(supp % 45 == 0, -1.0).otherwise(0.5)).alias("peak"), "discount",
    )
    made = lines(spark, sf_dir).groupBy("oid").agg(F.array_sort(F.collect_list(own)).alias("own"), F.max("t1").alias("last"))
    fields = lambda **names: F.transform("own", lambda x: F.struct(*(x[c].alias(n) for n, c in names.items())))
    scene = made.select(
        F.lit(0).alias("plan"), "oid", F.when(k % 11 == 0, -1.0).otherwise(0.0).alias("source_start"), (F.col("last") - F.when(k % 7 == 0, 1.0).otherwise(0.0)).alias("source_end"), F.when(k % 13 == 0, 0.0).otherwise(30.0).alias("fps"),
        fields(start="s", duration="d").alias("fragments"), fields(time="t", activity="a", confidence="c").alias("motion"), fields(start="t0", end="t1", peak="peak", activity="discount").alias("actions"),
    )
    return validation.prepared_errors(scene, ["plan"], "oid").where("oid is not null").select("oid", "rule")


@query(f"""WITH {SCENES_SQL}, s AS (SELECT cid, oid, row_number() OVER (PARTITION BY cid ORDER BY a0, oid) - 1 AS n, row_number() OVER (PARTITION BY cid ORDER BY price DESC, oid) - 1 AS pos, price FROM scenes)
SELECT cid, oid, CASE WHEN price > 100000 THEN pos ELSE n END AS place FROM s""")
def scene_places(spark, sf_dir):
    """Dear orders are the selected scenes, the dearest first."""
    number = lambda *by: (F.row_number().over(Window.partitionBy("cid").orderBy(*by)) - 1).cast("long")
    made = scenes(spark, sf_dir).select("cid", "oid", F.col("oid").alias("source_id"), number("a0", "oid").alias("scene_id"), number(F.desc("price"), "oid").alias("position"), "price")
    picked = made.where("price > 100000").select("cid", "source_id", "scene_id", "position")
    return analysis.by_selection(made.drop("position"), picked, ["cid"]).select("cid", "oid", "place")


@query(f"""WITH x AS (SELECT user_id AS tid, max(event_id) FILTER (event_id % 9 = 1) AS t, max(event_id) FILTER (event_id % 9 = 2) AS e FROM events GROUP BY user_id)
SELECT tid, 'said ' || t AS text, CAST(t AS DOUBLE) + 0.5{D} AS duration, CAST(CASE WHEN t IS NOT NULL THEN 2 ELSE 0 END AS INT) AS segments, 'w' || t AS word, CASE WHEN t IS NULL THEN 'no ' || e END AS error FROM x""")
def transcript_results(spark, sf_dir):
    """Events are the lines a speech process prints: progress, transcripts, errors and broken results."""
    i = F.col("event_id").cast("string")
    said = F.concat(
        F.lit('RESULT:{"language":"en","duration":'), i, F.lit('.5,"text":"said '), i, F.lit('","segments":[{"start":0.0,"end":1.5,"text":"one","words":[{"word":"w'), i,
        F.lit('","start":0.25,"end":0.5,"probability":0.5}]},{"start":1.5,"end":2.0,"text":"two","words":[]}]}'),
    )
    turn = F.col("event_id") % 9
    line = F.when(turn == 1, said).when(turn == 2, F.concat(F.lit('RESULT:{"error":"no '), i, F.lit('"}'))).when(turn == 3, "RESULT:{broken").when(turn == 4, 'RESULT:{"text":"half"}').otherwise(F.concat(F.lit("PROGRESS:50:"), i))
    made = words.transcripts(read(spark, sf_dir, "events").select(F.col("user_id").alias("tid"), "event_id", line.alias("line")), ["tid"], "event_id", "line")
    t = F.col("transcript")
    return made.select("tid", t["text"].alias("text"), t["duration"].alias("duration"), F.when(t.isNotNull(), F.size(t["segments"])).otherwise(0).alias("segments"), t["segments"][0]["words"][0]["word"].alias("word"), "error")


_KINDS = " ".join(f"WHEN h % 100 < {bound} THEN '{name}'" for bound, name in ev.TRANSITIONS["HYBRID"])


@query(f"""WITH {_SEG}, {hash_sql("seg", "sh", "t0", "999")}, x AS (SELECT tid, idx, CASE WHEN idx % 13 = 4 THEN 'WARP_BUBBLE' WHEN idx = 0 THEN NULL {_KINDS} END AS type, CASE WHEN tid % 3 > 0 THEN CAST(tid % 50 AS DOUBLE) END AS p FROM sh)
SELECT tid, idx, type, CASE type WHEN 'WARP_BUBBLE' THEN coalesce(p / 50, 0.5{D}) WHEN 'SLIDE_SHAKE' THEN 100.0{D} END AS amplitude, CASE type WHEN 'WARP_BUBBLE' THEN 1.2{D} END AS frequency, CASE type WHEN 'WAVE_WARP' THEN coalesce(p * 10, 280.0{D}) END AS height,
CASE type WHEN 'WAVE_WARP' THEN 20.0{D} END AS speed FROM x WHERE type IS NOT NULL""")
def transition_parameters(spark, sf_dir):
    """Transitions of a hybrid plan with two parameters of its own, or none."""
    seg, _ = _segments(spark, sf_dir)
    made = ev.transitions(seg.withColumn("wrap", F.col("idx") % 13 == 4), ["tid"], "HYBRID", "wrap")
    p = F.when(F.col("tid") % 3 > 0, (F.col("tid") % 50).cast("double"))
    rows = ev.transition_params(made, {"warp_amplitude": p / 50, "wave_height": p * 10})
    return rows.select("tid", "idx", "type", *(F.try_element_at("params", F.lit(n)).alias(n) for n in ("amplitude", "frequency", "height", "speed")))


_SWITCHES = [*presets.OVER_ALL, "anti_flash"]
_STYLED = lambda name: f"CASE style WHEN 'SMOOTH' THEN {presets.parameters('SMOOTH')[name]}{D} WHEN 'HYBRID' THEN {presets.parameters('HYBRID')[name]}{D} ELSE {presets.parameters('HARD')[name]}{D} END"


_NUMBERS = ["amplitude", "hz", "peak", "flashes", "alpha", "depth", "r", "inversions", "vignette", "scanlines"]


@query(f"""WITH o AS (SELECT o_orderkey AS oid, upper(['HARD', 'smooth', 'HYBRID', 'ODD'][CAST(o_orderkey % 4 AS INT) + 1]) AS style, CASE WHEN o_orderkey % 3 > 0 THEN CAST(o_custkey % 9 AS DOUBLE) / 10 END AS p, CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE 2 END AS beats,
{", ".join(f"(o_custkey // {2 ** i}) % 2 = 1 AS {name}" for i, name in enumerate(_SWITCHES))} FROM orders),
a AS (SELECT oid, style, p, beats, {" OR ".join(presets.OVER_ALL)} AS has, flicker AND NOT anti_flash AS fl, exposure_flash AND NOT anti_flash AS ex, echo_trail AND p IS NOT NULL AS ec, tint AS ti, tint AND NOT anti_flash AS inv, vignette AS vi, scanlines AS sc, cc_deep_dark AS dd FROM o),
b AS (SELECT oid, has, CASE WHEN fl THEN coalesce(p, {_STYLED("flicker_amplitude")}) ELSE 0 END AS amplitude, {_STYLED("flicker_hz")} AS hz, CASE WHEN ex THEN coalesce(p / 2, {_STYLED("flash_peak")}) ELSE 0 END AS peak, CASE WHEN ex THEN beats ELSE 0 END AS flashes, ec AS echo, CASE WHEN ec THEN p ELSE 0.3{D} END AS alpha, 3 AS depth,
CASE WHEN ti THEN CAST(coalesce(p * 10, 0) AS INT) ELSE 0 END AS r, inv AS invert, CASE WHEN inv THEN beats ELSE 0 END AS inversions, CASE WHEN vi THEN coalesce(p, 0.3{D}) ELSE 0 END AS vignette, CASE WHEN sc THEN coalesce(p / 3, 0) ELSE 0 END AS scanlines, dd AS deep_dark FROM a)
SELECT oid, has, {", ".join(f"CASE WHEN has THEN {c} ELSE -1 END AS {c}" for c in _NUMBERS)}, {", ".join(f"has AND {c} AS {c}" for c in ("echo", "invert", "deep_dark"))},
CASE WHEN has THEN CAST(amplitude > 0 AS INT) + CAST(flashes > 0 AS INT) + CAST(echo AS INT) + CAST(r <> 0 AS INT) + CAST(vignette > 0 AS INT) + CAST(scanlines > 0 AS INT) ELSE 0 END AS effects FROM b""")
def plan_ambiance(spark, sf_dir):
    """Orders are plans; the bits of a customer's number are its toggles. Numbers of a plan without an ambiance are -1 here."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    style = F.element_at(F.array(*map(F.lit, ["HARD", "smooth", "HYBRID", "ODD"])), (k % 4 + 1).cast("int"))
    on = {name: F.floor(c / 2**i) % 2 == 1 for i, name in enumerate(_SWITCHES)}
    p = F.when(k % 3 > 0, (c % 9).cast("double") / 10)
    beats = F.when(k % 5 == 0, F.array().cast("array<double>")).otherwise(F.array(F.lit(0.0), F.lit(2.0)))
    # A tenth times ten isn't always whole: the shift is given as the whole number it is.
    given = {"flicker_amplitude": p, "flash_peak": p / 2, "echo_alpha": p, "tint_r": F.when(k % 3 > 0, c % 9), "vignette": p, "scanlines": p / 3}
    a = F.col("a")
    rows = read(spark, sf_dir, "orders").select(k.alias("oid"), presets.ambiance(style, on, beats, given).alias("a"))
    numbers = [
        a["flicker"]["amplitude"], a["flicker"]["hz"], a["flash"]["peak"], F.size(a["flash"]["times"]), a["echo"]["alpha"], a["echo"]["depth"], a["tint"]["r"], F.size(a["tint"]["times"]), a["vignette"], a["scanlines"],
    ]
    flags = {"echo": a["echo"]["enabled"], "invert": a["tint"]["invert"], "deep_dark": a["deep_dark"]}
    has = a.isNotNull()
    shown = [F.when(has, x).otherwise(-1).alias(n) for n, x in zip(_NUMBERS, numbers, strict=True)]
    return rows.select("oid", has.alias("has"), *shown, *(F.coalesce(x, F.lit(False)).alias(n) for n, x in flags.items()), presets.active(a).alias("effects"))


@query(f"""WITH {SCENES_SQL}, d AS (SELECT cid % 50 AS tid, oid, unnest(range(CAST(a0 AS BIGINT), CAST(a1 AS BIGINT))) AS day FROM scenes), m AS (SELECT *, min(oid) OVER (PARTITION BY tid, day) < oid AS again FROM d)
SELECT tid, oid, CAST(count(CASE WHEN again THEN 1 END) AS DOUBLE) / count(*) AS reused FROM m GROUP BY tid, oid""")
def reused_fraction(spark, sf_dir):
    """Orders are the shots of fifty plans, in order of their numbers; what they use of the footage are whole days."""
    shots = scenes(spark, sf_dir).select((F.col("cid") % 50).alias("tid"), "oid", "a0", "a1")
    return folds.reused(shots, ["tid"], ["oid"]).select("tid", "oid", "reused")
