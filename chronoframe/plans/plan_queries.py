"""Queries of plans, schedules and their rules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronoframe.functions import curves as cv
from chronoframe.functions.numbers import half_up, to_places
from chronoframe.operators import facts, planning, render, schedule, signal
from chronoframe.plans import document, validation
from chronoframe.plans.event_queries import D, half_up_sql, out6, r6
from chronoframe.plans.registry import query
from chronoframe.plans.signal_queries import greedy
from chronoframe.sources.tables import LINES_SQL, SCENES_SQL, TIMELINE_SQL, lines, motion, read, scenes, timeline


def _plans(spark, sf_dir, mode: str, style: str, video: float, strong: bool):
    """A plan per timeline: clicks are beats, purchases downbeats, sign-ups scene boundaries; hours are seconds."""
    rows = timeline(spark, sf_dir).withColumn("t", F.col("t") / 3600.0)
    times = lambda kind: F.array_sort(F.collect_list(F.when(F.col("type") == kind, F.col("t"))))
    own = rows.groupBy("tid").agg((F.max("t") + 1).alias("target"), times("click").alias("beats"), times("purchase").alias("downbeats"), times("signup").alias("scenes"))
    none = F.array().cast("array<double>")
    return own.select(
        F.col("tid").alias("plan_id"), F.lit(style).alias("style"), F.lit(16).alias("fps"), "target", F.lit(video).alias("video"), F.lit(mode).alias("mode"), F.lit("mid").alias("rhythm"),
        "beats", (F.col("downbeats") if strong else none).alias("downbeats"), F.concat(F.array(F.lit(0.0)), "scenes", F.array(F.lit(video))).alias("scenes"),
    )


_EFF = f"50.0{D}"


@query(f"""WITH RECURSIVE {TIMELINE_SQL}, q AS (SELECT tid, eid, t / 3600.0{D} AS t, type, max(t / 3600.0{D}) OVER (PARTITION BY tid) + 1 AS target FROM tl), c AS (SELECT tid, eid, t FROM q WHERE type = 'click' AND t > 0 AND t < target), {greedy("c", f"(3.0{D} / 16)", f"0.0{D}")},
tg AS (SELECT DISTINCT tid, target FROM q), lastb AS (SELECT k.tid, max(t) AS m FROM k WHERE kept GROUP BY k.tid), b AS (SELECT tid, 0.0{D} AS t FROM tg UNION ALL SELECT k.tid, k.t FROM k JOIN tg ON k.tid = tg.tid JOIN lastb l ON l.tid = k.tid WHERE kept AND NOT (k.t = l.m AND tg.target - k.t < 3.0{D} / 16) UNION ALL SELECT tid, target FROM tg),
u AS (SELECT tid, t, 0 AS w FROM b UNION ALL SELECT tid, n * {_EFF}, 1 FROM tg, range(1, 1000) r(n) WHERE n * {_EFF} < target - 1e-6), o AS (SELECT tid, t AS t0, lead(t) OVER (PARTITION BY tid ORDER BY t, w) AS t1, row_number() OVER (PARTITION BY tid ORDER BY t, w) - 1 AS idx FROM u)
SELECT tid AS plan_id, idx, {r6("t0")} AS t0, {r6("t1")} AS t1, floor((t0 - floor(t0 / {_EFF} + 1e-9) * {_EFF}) * 1000.0{D} + 0.5{D}) / 1000.0{D} AS s0, floor((t1 - floor(t0 / {_EFF} + 1e-9) * {_EFF}) * 1000.0{D} + 0.5{D}) / 1000.0{D} AS s1 FROM o WHERE t1 IS NOT NULL""")
def plan_no_change(spark, sf_dir):
    """Without scenes and downbeats the walk has a closed form: output time modulo the source's length."""
    made = planning.plan(_plans(spark, sf_dir, "no_change", "HARD", 50.0, False))
    return made.select("plan_id", "idx", out6(F.col("t0")).alias("t0"), out6(F.col("t1")).alias("t1"), "s0", "s1")


@query()
def plan_scenepack(spark, sf_dir):
    return planning.plan(_plans(spark, sf_dir, "scenepack", "HYBRID", 720.0, True))


@query()
def plan_long_clip(spark, sf_dir):
    return planning.plan(_plans(spark, sf_dir, "long_clip", "SMOOTH", 5000.0, True))


@query()
def plan_documents(spark, sf_dir):
    """Plans as JSON and read back: what a reader finds in each."""
    plans = _plans(spark, sf_dir, "scenepack", "HARD", 720.0, True)
    docs = document.parse(document.assemble(plans, planning.plan(plans)))
    return docs.select("plan_id", "schema_version", "style", "fps", "loops", F.size("segments").alias("segments"), out6(F.element_at("segments", -1)["t1"]).alias("end"), F.sha2("doc", 256).alias("digest"))


def _jobs(spark, sf_dir, smart: bool):
    """Jobs of all scenes of a source: its motion cut into scenes of 40 s, scheduled for 30 s."""
    m = motion(spark, sf_dir).withColumn("scene", F.floor(F.col("t") / 240).cast("int")).withColumn("t", (F.col("t") - F.col("scene") * 240) / 6.0 + F.col("scene") * 50.0)
    frag = m.select("tid", "scene").distinct().select("tid", F.col("scene").alias("fragment"), (F.col("scene") * 50.0).alias("a0"), (F.col("scene") * 50.0 + 40.0).alias("a1"))
    samples = m.where(F.col("t") < F.col("scene") * 50.0 + 40.0).select("tid", F.col("scene").alias("fragment"), "t", F.col("activity"), F.col("confidence"))
    actions = signal.action_windows(samples.select("tid", "fragment", "t", (F.col("activity") * F.col("confidence")).alias("activity")), frag, ["tid"], "fragment")
    by_scene = samples.groupBy("tid", "fragment").agg(F.array_sort(F.collect_list(F.struct(F.col("t").alias("time"), "activity", "confidence"))).alias("motion"))
    acts = actions.groupBy("tid", "fragment").agg(F.array_sort(F.collect_list(F.struct("start", "end", "peak", "activity"))).alias("actions"))
    rows = frag.join(by_scene, ["tid", "fragment"], "left").join(acts, ["tid", "fragment"], "left")
    scene = F.struct(
        F.col("fragment").alias("scene_id"), F.col("fragment").alias("source_id"), F.col("a1").alias("source_end"), F.array(F.struct(F.col("a0").alias("start"), (F.col("a1") - F.col("a0")).alias("duration"))).alias("fragments"),
        F.coalesce("motion", F.array().cast(rows.schema["motion"].dataType)).alias("motion"), F.coalesce("actions", F.array().cast(rows.schema["actions"].dataType)).alias("actions"),
    )
    bounds = F.concat(F.transform(F.sequence(F.lit(1), F.lit(59)), lambda i: i * 0.5), F.array(F.lit(30.0)))
    cadence = cv.preferred_cadence(F.lit(0.5), F.lit("mid"), F.col("n"), F.lit(30.0), F.lit("HARD"), F.lit(smart))
    jobs = rows.groupBy("tid").agg(F.array_sort(F.collect_list(scene)).alias("scenes")).withColumn("n", F.size("scenes"))
    return jobs.select(F.col("tid").alias("job"), F.lit(30.0).alias("target"), cadence.alias("preferred"), F.lit(1.0).alias("rate"), F.lit(smart).alias("smart"), F.lit(False).alias("long_clip"), bounds.alias("bounds"), F.transform(F.sequence(F.lit(1), F.lit(14)), lambda i: i * 2.0).alias("downbeats"), "scenes")


@query()
def adaptive_schedule(spark, sf_dir):
    return schedule.schedule(_jobs(spark, sf_dir, True))


@query()
def no_repeat_schedule(spark, sf_dir):
    return schedule.schedule(_jobs(spark, sf_dir, False))


@query(f"""WITH {LINES_SQL}, p AS (SELECT oid, idx, 'shake_a0' AS name, discount * 400 AS value FROM lines UNION ALL SELECT oid, idx, 'bouncy_amplitude', price / 1000 FROM lines UNION ALL SELECT oid, idx, 'zoom_end', 0.75{D} + tax * 12 FROM lines UNION ALL SELECT oid, idx, 'vignette', discount * 11 FROM lines UNION ALL SELECT oid, idx, 'unheard_of', tax * 15 FROM lines),
l(name, low, high) AS (VALUES ('shake_a0', 0, 30), ('bouncy_amplitude', 0, 60), ('zoom_end', 0.8{D}, 1.5{D}), ('vignette', 0, 1))
SELECT p.oid, p.idx, p.name AS rule FROM p LEFT JOIN l ON p.name = l.name WHERE NOT (value >= coalesce(low, 0) AND value <= coalesce(high, 1))
UNION ALL SELECT oid, idx, 'curve' FROM lines WHERE flag = 'R' AND status = 'F' AND idx % 2 = 0 UNION ALL SELECT oid, idx, 'source' FROM lines WHERE price / 1000 + (t1 - t0) > 100.0{D} + 0.051{D}""")
def plan_validation(spark, sf_dir):
    rows = lines(spark, sf_dir)
    p = rows.select("oid", "idx", F.explode(F.array(*(F.struct(F.lit(n).alias("name"), v.alias("value")) for n, v in [("shake_a0", F.col("discount") * 400), ("bouncy_amplitude", F.col("price") / 1000), ("zoom_end", 0.75 + F.col("tax") * 12), ("vignette", F.col("discount") * 11), ("unheard_of", F.col("tax") * 15)]))).alias("p")).select("oid", "idx", "p.*")
    params = validation.parameter_errors(p.withColumn("k", F.struct("oid", "idx")), "k").select("k.*", "rule")
    curve = F.when((F.col("flag") == "R") & (F.col("status") == "F") & (F.col("idx") % 2 == 0), "wobble").otherwise("snap")
    seg = rows.select("oid", "idx", "t0", "t1", (F.col("price") / 1000).alias("s0"), (F.col("price") / 1000 + (F.col("t1") - F.col("t0"))).alias("s1"), curve.alias("curve"), F.max("t1").over(Window.partitionBy("oid")).alias("target"), F.lit(100.0).alias("video"))
    return params.union(validation.segment_errors(seg, ["oid"], "idx", "target", "video"))


@query(f"""WITH {LINES_SQL} SELECT oid, count(*) + count(CASE WHEN discount > 0.05{D} THEN 1 END) + max(CASE WHEN flag = 'R' THEN 1 ELSE 0 END) + max(CASE WHEN status = 'F' THEN 1 ELSE 0 END) AS effects, count(CASE WHEN tax > 0.04{D} THEN 1 END) AS loops, {r6("sum(t1 - t0)")} AS selected, {half_up_sql(f"sum(price) / 1048576.0{D} * 100")} / 100 AS mib, {r6(f"count(*) / greatest(sum(tax), 0.001{D})")} AS fps FROM lines GROUP BY oid""")
def effects_count(spark, sf_dir):
    """Counts and totals of a plan's rows: effects with one more for each ambiance that is on, repeats, selected time, volume."""
    on = lambda test: F.max(F.when(test, 1).otherwise(0))
    return lines(spark, sf_dir).groupBy("oid").agg(
        (F.count("*") + F.count(F.when(F.col("discount") > 0.05, 1)) + on(F.col("flag") == "R") + on(F.col("status") == "F")).alias("effects"), F.count(F.when(F.col("tax") > 0.04, 1)).alias("loops"),
        out6(F.sum(F.col("t1") - F.col("t0"))).alias("selected"), (half_up(F.sum("price") / 1048576.0 * 100) / 100).alias("mib"), out6(F.count("*") / F.greatest(F.sum("tax"), F.lit(0.001))).alias("fps"),
    )


@query(f"""WITH {LINES_SQL}, x AS (SELECT *, CASE WHEN supp <> lag(supp) OVER w OR abs(t0 - lag(t1) OVER w) >= 0.003 OR lag(t1) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM (SELECT oid, idx, t0, t1, supp % 2 AS supp FROM lines) l WINDOW w AS (PARTITION BY oid ORDER BY idx)), y AS (SELECT *, sum(fresh) OVER (PARTITION BY oid ORDER BY idx ROWS UNBOUNDED PRECEDING) AS shot FROM x)
SELECT oid, CAST(shot AS BIGINT) AS shot, min(t0) AS t0, max(t1) AS t1, count(*) AS segments FROM y GROUP BY oid, shot""")
def legacy_shots(spark, sf_dir):
    """Segments of one scene that follow each other without a gap are one shot."""
    return facts.shots_of(lines(spark, sf_dir).select("oid", "idx", "t0", "t1", (F.col("supp") % 2).alias("scene")), ["oid"], "idx", "scene")


@query(f"""WITH p AS (SELECT p_partkey, CAST(p_size AS DOUBLE) / 30.0{D} AS beat, CASE p_partkey % 3 WHEN 0 THEN 'fast' WHEN 1 THEN 'mid' ELSE 'slow' END AS rhythm, 1 + p_partkey % 12 AS scenes, p_retailprice / 100.0{D} AS target, p_partkey % 2 = 0 AS smart, p_partkey % 5 = 0 AS smooth FROM part),
c AS (SELECT *, CASE rhythm WHEN 'fast' THEN beat WHEN 'slow' THEN greatest(beat * 8.0{D}, 3.0{D}) ELSE beat * 4.0{D} END AS cad FROM p), d AS (SELECT *, least(greatest(cad, least(8.0{D} / scenes, 5.5{D})), 6.0{D}) AS cov FROM c)
SELECT p_partkey, {r6(f"least(CASE WHEN smart THEN greatest(sqrt((CASE WHEN smooth THEN cad * 2.0{D} ELSE cad END) * cov), 0.35{D}) ELSE cov END, target)")} AS preferred FROM d""")
def preferred_cadence(spark, sf_dir):
    i = F.col("p_partkey")
    rhythm = F.when(i % 3 == 0, "fast").when(i % 3 == 1, "mid").otherwise("slow")
    c = cv.preferred_cadence(F.col("p_size").cast("double") / 30.0, rhythm, 1 + i % 12, F.col("p_retailprice") / 100.0, F.when(i % 5 == 0, "SMOOTH").otherwise("HARD"), i % 2 == 0)
    return read(spark, sf_dir, "part").select("p_partkey", to_places(c, 6).alias("preferred"))


@query(f"""WITH {SCENES_SQL}, s AS (SELECT cid, oid, a0, a1, price, row_number() OVER (PARTITION BY cid ORDER BY a0, oid) - 1 AS clip, sum(a1 - a0) OVER (PARTITION BY cid ORDER BY a0, oid ROWS UNBOUNDED PRECEDING) AS total FROM scenes)
SELECT cid, clip, oid, total - (a1 - a0) AS clip_start, total AS clip_end, floor((a0 + (a1 - a0) * 0.35{D}) * 1000.0{D} + 0.5{D}) / 1000.0{D} AS thumb_t FROM s""")
def scene_clips(spark, sf_dir):
    """Gallery rows: each source's clip with its place on the timeline of all, and the time of its picture."""
    made = facts.gallery(scenes(spark, sf_dir), ["cid"], ["a0", "oid"], "a0", "a1")
    return made.select("cid", "clip", "oid", "clip_start", "clip_end", "thumb_t")


@query(f"""WITH e AS (SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, value FROM events), c AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN k * 4.0{D} END AS header, CASE WHEN event_id % 3 <> 2 THEN value END AS probe, value / 7.0{D} AS packets, 23.9{D} + CAST(event_id % 20 AS DOUBLE) * 0.01{D} AS fps FROM e)
SELECT event_id, {r6("coalesce(header, probe, packets)")} AS duration, {r6(f"CASE WHEN abs(fps - {half_up_sql('fps')}) < 0.05{D} THEN {half_up_sql('fps')} ELSE fps END")} AS fps, CASE WHEN header IS NOT NULL THEN 'header' WHEN probe IS NOT NULL THEN 'probe' ELSE 'packets' END AS prober FROM c""")
def probe_chain(spark, sf_dir):
    """Facts of a source from the first prober that has them; rates next to a whole number are that number."""
    k = F.get_json_object("props", "$.k").try_cast("double")
    i = F.col("event_id")
    e = read(spark, sf_dir, "events").select("event_id", F.when(i % 3 == 0, k * 4.0).alias("header"), F.when(i % 3 != 2, F.col("value")).alias("probe"), (F.col("value") / 7.0).alias("packets"), (23.9 + (i % 20).cast("double") * 0.01).alias("fps"))
    made = facts.probed(e, ["header", "probe", "packets"], "fps")
    return made.select("event_id", out6(F.col("duration")).alias("duration"), out6(F.col("fps")).alias("fps"), "prober")


@query(f"""WITH {LINES_SQL}, s AS (SELECT oid, idx, t0, t1, price / 100.0{D} AS s0, price / 100.0{D} + (t1 - t0) * (0.5{D} + tax * 20.0{D}) AS s1, max(idx) OVER (PARTITION BY oid) = idx AS lst FROM lines),
f AS (SELECT oid, idx, t0, t1, s0, s1, unnest(range(CAST(ceil(t0 / 2.0{D} - 1e-9) AS BIGINT), CAST(CASE WHEN lst THEN ceil(t1 / 2.0{D} - 0.5{D}) ELSE ceil(t1 / 2.0{D} - 1e-9) END AS BIGINT))) AS frame FROM s),
x AS (SELECT *, least(greatest(greatest(frame * 2.0{D} - t0, 0.0{D}) / greatest(t1 - t0, 1e-6), 0.0{D}), 1.0{D}) AS x FROM f), y AS (SELECT *, x * x * (3.0{D} - 2.0{D} * x) AS u, 6.0{D} * x * (1.0{D} - x) AS sl FROM x), z AS (SELECT *, abs(s1 - s0) / greatest(t1 - t0, 1e-6) * sl AS v FROM y)
SELECT oid, frame, idx, {r6("s0 + (s1 - s0) * u")} AS source_t, {r6("v")} AS speed, CASE WHEN v <= 1.0{D} THEN 1 ELSE CAST(least(1 + floor(v), 4) AS INTEGER) END AS blend FROM z""")
def frame_table(spark, sf_dir):
    """Output frames of segments that ease in and out, one every two units of time."""
    s0 = F.col("price") / 100.0
    none = F.lit(None).cast("double")
    seg = lines(spark, sf_dir).select(
        "oid", "idx", (F.col("t0") / 2.0).alias("t0"), (F.col("t1") / 2.0).alias("t1"), s0.alias("s0"), (s0 + (F.col("t1") - F.col("t0")) * (0.5 + F.col("tax") * 20.0)).alias("s1"), F.lit("saddle").alias("curve"), none.alias("strength"), none.alias("phase_start"), none.alias("phase_end")
    )
    made = render.frame_table(seg, ["oid"], 1)
    return made.select("oid", "frame", "idx", out6(F.col("source_t")).alias("source_t"), out6(F.col("speed") / 2.0).alias("speed"), cv.blur_frames(F.col("speed") / 2.0, F.lit(True)).alias("blend"))
