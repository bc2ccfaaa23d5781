"""Queries of runs, cuts, motion, beats and sessions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronoframe.functions.numbers import to_places
from chronoframe.operators import facts, folds, signal
from chronoframe.operators import intervals as iv
from chronoframe.plans.registry import query
from chronoframe.sources.tables import MOTION_SQL, TIMELINE_SQL, motion, timeline


def r6(x: str) -> str:
    return f"floor({x} * 1e6 + 0.5::DOUBLE) / 1e6"


@query(f"""WITH {TIMELINE_SQL}, f AS (SELECT *, type = 'error' AS blank, max(t) OVER (PARTITION BY tid) + 1 AS duration FROM tl),
r AS (SELECT *, sum(CAST(blank AS INT)) OVER (PARTITION BY tid ORDER BY t, eid ROWS UNBOUNDED PRECEDING) AS run, min(CASE WHEN blank THEN t END) OVER (PARTITION BY tid ORDER BY t, eid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nxt FROM f)
SELECT tid, min(t) AS "start", coalesce(min(nxt), max(duration)) AS "end", count(*) AS frames FROM r WHERE NOT blank GROUP BY tid, run HAVING coalesce(min(nxt), max(duration)) > min(t)""")
def valid_runs(spark, sf_dir):
    tl = timeline(spark, sf_dir)
    frames = tl.withColumn("blank", F.col("type") == "error").withColumn("duration", F.max("t").over(Window.partitionBy("tid")) + 1)
    return signal.valid_runs(frames, ["tid"], "t", "blank", "duration", ["eid"])


_GREEDY = """x AS (SELECT tid, eid, t, row_number() OVER (PARTITION BY tid ORDER BY t, eid) AS i FROM {rows}),
RECURSIVE_k AS (SELECT tid, eid, t, i, {first} AS kept, CASE WHEN {first} THEN t ELSE {start} END AS held FROM x WHERE i = 1
  UNION ALL SELECT x.tid, x.eid, x.t, x.i, x.t - k.held >= {gap}, CASE WHEN x.t - k.held >= {gap} THEN x.t ELSE k.held END FROM RECURSIVE_k k JOIN x ON x.tid = k.tid AND x.i = k.i + 1)"""


def greedy(rows: str, gap: str, start: str | None) -> str:
    """CTEs that keep a row `gap` after the last kept one; without a start the first row is kept."""
    first = "true" if start is None else f"t - {start} >= {gap}"
    return _GREEDY.replace("RECURSIVE_k", "k").format(rows=rows, gap=gap, first=first, start=start or "t")


@query(f"""WITH RECURSIVE {TIMELINE_SQL}, c AS (SELECT * FROM (SELECT *, max(t) OVER (PARTITION BY tid) AS d FROM tl) q WHERE type IN ('signup', 'error') AND t < d - 3600), {greedy("c", "86400::DOUBLE", "0::DOUBLE")} SELECT tid, eid, t FROM k WHERE kept""")
def cut_points_min_gap(spark, sf_dir):
    tl = timeline(spark, sf_dir).withColumn("d", F.max("t").over(Window.partitionBy("tid")))
    scored = tl.withColumn("score", F.when(F.col("type").isin("signup", "error"), 0.9).otherwise(0.1))
    return signal.cuts(scored, ["tid"], "t", "score", "d", least=86400.0, tail=3600.0).select("tid", "eid", "t")


@query(f"""WITH RECURSIVE {TIMELINE_SQL}, x AS (SELECT tid, eid, t, type = 'signup' AS cut, row_number() OVER (PARTITION BY tid ORDER BY t, eid) AS i FROM tl),
k AS (SELECT tid, eid, t, i, true AS kept, t AS held FROM x WHERE i = 1 UNION ALL SELECT x.tid, x.eid, x.t, x.i, x.t - k.held >= 43200 OR x.cut, CASE WHEN x.t - k.held >= 43200 OR x.cut THEN x.t ELSE k.held END FROM k JOIN x ON x.tid = k.tid AND x.i = k.i + 1)
SELECT tid, eid, t FROM k WHERE kept""")
def motion_downsample(spark, sf_dir):
    scored = timeline(spark, sf_dir).withColumn("score", (F.col("type") == "signup").cast("double"))
    return folds.sampled(scored, ["tid"], "t", "score", 43200.0, signal.CUT_SCORE, ["eid"]).select("tid", "eid", "t")


@query(f"""WITH {TIMELINE_SQL}, {MOTION_SQL},
ep AS (SELECT m.*, (SELECT count(*) FROM motion r WHERE r.tid = m.tid AND r.type = 'error' AND r.t <= m.t) AS e FROM motion m WHERE type <> 'error'),
n AS (SELECT *, coalesce(abs(lag(t) OVER w - t) <= 8, false) AS p, coalesce(abs(lead(t) OVER w - t) <= 8, false) AS q, lag(activity) OVER w AS la, lead(activity) OVER w AS na, lag(confidence) OVER w AS lc, lead(confidence) OVER w AS nc FROM ep WINDOW w AS (PARTITION BY tid, e ORDER BY t))
SELECT tid, t, {r6("((CASE WHEN p THEN la ELSE 0 END) + activity + (CASE WHEN q THEN na ELSE 0 END)) / (1 + CAST(p AS INT) + CAST(q AS INT))")} AS activity,
{r6("((CASE WHEN p THEN lc ELSE 0 END) + confidence + (CASE WHEN q THEN nc ELSE 0 END)) / (1 + CAST(p AS INT) + CAST(q AS INT))")} AS confidence FROM n""")
def motion_smoothing(spark, sf_dir):
    m = motion(spark, sf_dir)
    out = signal.smooth_motion(m.where("type <> 'error'"), m.where("type = 'error'").select("tid", "t"), ["tid"], reach=8.0)
    return out.select("tid", "t", to_places(F.col("activity"), 6).alias("activity"), to_places(F.col("confidence"), 6).alias("confidence"))


_RUNS = f"""{TIMELINE_SQL}, {MOTION_SQL}, fr AS (SELECT DISTINCT tid, floor(t / 240) AS fragment, floor(t / 240) * 240 AS a0, floor(t / 240) * 240 + 200 AS a1 FROM motion),
s AS (SELECT m.tid, f.fragment, m.t, m.activity * m.confidence AS v, a0, a1 FROM motion m JOIN fr f ON m.tid = f.tid AND m.t >= a0 AND m.t < a1)"""


def _fragments(m):
    f = F.floor(F.col("t") / 240)
    fragments = m.select("tid", f.alias("fragment")).distinct().select("tid", "fragment", (F.col("fragment") * 240.0).alias("a0"), (F.col("fragment") * 240.0 + 200.0).alias("a1"))
    samples = m.withColumn("fragment", f).where(F.col("t") < F.col("fragment") * 240.0 + 200.0).select("tid", "fragment", "t", (F.col("activity") * F.col("confidence")).alias("activity"))
    return fragments, samples


@query(f"""WITH {_RUNS}, a AS (SELECT * FROM (SELECT *, max(v) OVER (PARTITION BY tid) AS pk FROM s) q WHERE v >= greatest(pk * 0.35::DOUBLE, 0.015::DOUBLE)),
b AS (SELECT *, CASE WHEN t > least(lag(t) OVER w + 0.4::DOUBLE, a1) + 0.2::DOUBLE OR lag(t) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM a WINDOW w AS (PARTITION BY tid, fragment ORDER BY t)),
c AS (SELECT *, sum(fresh) OVER (PARTITION BY tid, fragment ORDER BY t ROWS UNBOUNDED PRECEDING) AS se FROM b),
d AS (SELECT tid, fragment, greatest(min(t) - 0.35::DOUBLE, min(a0)) AS "start", least(max(t) + 0.4::DOUBLE, min(a1)) AS "end", max(v) AS activity, arg_min(t, (-v, t)) AS peak FROM c GROUP BY tid, fragment, se),
e AS (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY activity DESC, "start") AS rnk FROM d)
SELECT tid, fragment, "start", "end", activity, peak, rnk AS rank FROM e WHERE rnk <= 64""")
def action_windows(spark, sf_dir):
    fragments, samples = _fragments(motion(spark, sf_dir))
    made = signal.action_windows(samples, fragments, ["tid"], "fragment")
    return made.select("tid", F.col("fragment").cast("double").alias("fragment"), "start", "end", "activity", "peak", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {_RUNS}, j AS (SELECT f.tid, f.fragment, m.activity * m.confidence AS v FROM fr f LEFT JOIN motion m ON m.tid = f.tid AND m.t >= a0 AND m.t <= a1)
SELECT tid, fragment, coalesce({r6("avg(least(v / 0.18::DOUBLE, 1.0::DOUBLE))")}, 0.0::DOUBLE) AS activity, coalesce({r6("avg(CASE WHEN v > 0.015::DOUBLE THEN 1.0::DOUBLE WHEN v IS NOT NULL THEN 0.0::DOUBLE END)")}, 0.0::DOUBLE) AS active, count(v) AS samples FROM j GROUP BY tid, fragment""")
def activity_profile(spark, sf_dir):
    m = motion(spark, sf_dir)
    fragments, _ = _fragments(m)
    samples = m.select("tid", "t", (F.col("activity") * F.col("confidence")).alias("value"))
    made = signal.activity_profile(samples, fragments, ["tid"], ["fragment"], 240.0)
    return made.select("tid", F.col("fragment").cast("double").alias("fragment"), to_places(F.col("activity"), 6).alias("activity"), to_places(F.col("active"), 6).alias("active"), F.col("samples").cast("long").alias("samples"))


@query(f"""WITH {TIMELINE_SQL}, {MOTION_SQL}, x AS (SELECT tid, t, activity * confidence AS v, max(t) OVER (PARTITION BY tid) + 1 AS d FROM motion), b AS (SELECT *, least(floor(t / d * 8), 7) AS bin FROM x),
p AS (SELECT tid, bin, d, max((v, t)) AS m FROM b GROUP BY tid, bin, d)
SELECT tid, CAST(bin AS BIGINT) AS bin, m[2] AS peak, m[1] AS value, greatest(m[2] - 0.35::DOUBLE, bin * d / 8) AS shot_start FROM p""".replace("max((v, t)) AS m", "max(struct_pack(v := v, t := t)) AS m").replace("m[2]", "m.t").replace("m[1]", "m.v"))
def bin_peaks(spark, sf_dir):
    m = motion(spark, sf_dir).withColumn("value", F.col("activity") * F.col("confidence")).withColumn("from", F.lit(0.0)).withColumn("d", F.max("t").over(Window.partitionBy("tid")) + 1)
    return signal.bin_peaks(m, ["tid"], "from", "d", 8).withColumn("bin", F.col("bin").cast("long"))


@query(f"""WITH {TIMELINE_SQL}, {MOTION_SQL}, a AS (SELECT tid, arg_min(t, (-(activity * confidence), t)) AS peak, max(activity * confidence) AS v FROM motion WHERE type IN ('click', 'purchase') GROUP BY tid), e AS (SELECT DISTINCT tid FROM motion)
SELECT e.tid, coalesce(peak, 0.0::DOUBLE) AS thumb_t, coalesce(v, 0.0::DOUBLE) AS activity FROM e LEFT JOIN a ON e.tid = a.tid""")
def thumbnail_peak(spark, sf_dir):
    """The time of the strongest action of each source, its start where it has none."""
    m = motion(spark, sf_dir).withColumn("v", F.when(F.col("type").isin("click", "purchase"), F.col("activity") * F.col("confidence")))
    return facts.strongest(m, ["tid"], "t", "v")


@query(f"""WITH {TIMELINE_SQL}, {MOTION_SQL}, v AS (SELECT tid, eid, t, activity * confidence AS value FROM motion)
SELECT tid, eid, greatest(max(value) OVER (PARTITION BY tid ORDER BY t ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 0) AS nearby FROM v""")
def activity_at(spark, sf_dir):
    m = motion(spark, sf_dir).withColumn("value", F.col("activity") * F.col("confidence"))
    return signal.around(m, ["tid"]).select("tid", "eid", "nearby")


@query(f"""WITH RECURSIVE {TIMELINE_SQL}, b AS (SELECT tid, min(eid) AS eid, t, row_number() OVER (PARTITION BY tid ORDER BY t) AS n FROM tl WHERE type = 'click' AND t > 0 GROUP BY tid, t), h AS (SELECT tid, eid, t FROM b WHERE n % 2 = 1), {greedy("h", "43200::DOUBLE", "0::DOUBLE")}
SELECT tid, t, coalesce(lead(t) OVER (PARTITION BY tid ORDER BY t), t + 43200) AS t_next FROM k WHERE kept""")
def beat_bounds_merged(spark, sf_dir):
    """Every second beat, without those too close to the last bound kept."""
    beats = timeline(spark, sf_dir).where("type = 'click' and t > 0").select("tid", "t").distinct()
    n = F.row_number().over(Window.partitionBy("tid").orderBy("t"))
    half = beats.withColumn("n", n).where("n % 2 = 1").drop("n")
    kept = folds.min_gap(half, ["tid"], "t", 43200.0, start=0.0)
    return kept.select("tid", "t", F.coalesce(F.lead("t").over(Window.partitionBy("tid").orderBy("t")), F.col("t") + 43200.0).alias("t_next"))


@query(f"""WITH RECURSIVE {TIMELINE_SQL}, u AS (SELECT DISTINCT tid, t FROM tl WHERE type IN ('click', 'purchase') AND t > 0 UNION SELECT tid, max(t) + 10 FROM tl GROUP BY tid), v AS (SELECT tid, 0 AS eid, t FROM u), {greedy("v", "3600::DOUBLE", None)} SELECT tid, t FROM k WHERE kept""")
def boundary_union_dedup(spark, sf_dir):
    tl = timeline(spark, sf_dir)
    marks = tl.where("type in ('click', 'purchase') and t > 0").select("tid", "t").union(tl.groupBy("tid").agg((F.max("t") + 10).alias("t"))).distinct()
    return folds.min_gap(marks, ["tid"], "t", 3600.0)


@query(f"""WITH {TIMELINE_SQL}, s AS (SELECT tid, eid, t AS t0, lead(t) OVER (PARTITION BY tid ORDER BY t, eid) AS t1 FROM tl WHERE type <> 'purchase'), g AS (SELECT * FROM s WHERE t1 IS NOT NULL), d AS (SELECT tid, t FROM tl WHERE type = 'purchase'),
f AS (SELECT g.*, EXISTS (SELECT 1 FROM d WHERE d.tid = g.tid AND (abs(d.t - g.t0) < 30 OR (d.t >= g.t0 - 1e-4 AND d.t < g.t1 - 1e-4))) AS on_beat FROM g)
SELECT tid, eid, on_beat, CAST(sum(CAST(on_beat AS BIGINT)) OVER w AS BIGINT) AS beats, (on_beat AND (sum(CAST(on_beat AS BIGINT)) OVER w) % 5 = 1) AS reversed FROM f WINDOW w AS (PARTITION BY tid ORDER BY t0, eid ROWS UNBOUNDED PRECEDING)""")
def on_beat_flags(spark, sf_dir):
    """A segment is on a downbeat that lies in it or within a tolerance of its start: the next and the previous downbeat decide, by two as-of joins."""
    tl = timeline(spark, sf_dir)
    w = Window.partitionBy("tid").orderBy("t", "eid")
    segments = tl.where("type <> 'purchase'").withColumn("t1", F.lead("t").over(w)).where("t1 is not null").select("tid", "eid", F.col("t").alias("t0"), "t1", (F.col("t") - 1e-4).alias("t"))
    beats = tl.where("type = 'purchase'").select("tid", "t", F.col("t").alias("beat"))
    near = iv.forward(iv.backward(segments, beats, ["tid"], "t", ["beat"], strict=True).withColumnRenamed("beat", "earlier"), beats, ["tid"], "t", ["beat"])
    hit = F.coalesce(F.abs(F.col("earlier") - F.col("t0")) < 30, F.lit(False)) | F.coalesce((F.abs(F.col("beat") - F.col("t0")) < 30) | (F.col("beat") < F.col("t1") - 1e-4), F.lit(False))
    flagged = near.withColumn("on_beat", hit)
    count = F.sum(F.col("on_beat").cast("long")).over(Window.partitionBy("tid").orderBy("t0", "eid").rowsBetween(Window.unboundedPreceding, 0))
    return flagged.select("tid", "eid", "on_beat", count.alias("beats"), (F.col("on_beat") & (count % 5 == 1)).alias("reversed"))


@query(f"""WITH {TIMELINE_SQL}, x AS (SELECT tid, t, CASE WHEN t > lag(t) OVER (PARTITION BY tid ORDER BY t) + 1800 OR lag(t) OVER (PARTITION BY tid ORDER BY t) IS NULL THEN 1 ELSE 0 END AS fresh FROM tl), y AS (SELECT *, sum(fresh) OVER (PARTITION BY tid ORDER BY t ROWS UNBOUNDED PRECEDING) AS s FROM x)
SELECT tid, min(t) AS "start", max(t) AS "end", count(*) AS events FROM y GROUP BY tid, s""")
def sessions(spark, sf_dir):
    """Rows of a timeline with gaps of half an hour at most."""
    return facts.sessions(timeline(spark, sf_dir), ["tid"], "t", 1800.0)


@query(f"""WITH {TIMELINE_SQL}, h AS (SELECT tid, eid, t, type, row_number() OVER (PARTITION BY tid ORDER BY t, eid) - row_number() OVER (PARTITION BY tid, type ORDER BY t, eid) AS g, value FROM tl)
SELECT tid, eid, {r6("sum(value) OVER (PARTITION BY tid, type, g ORDER BY t, eid ROWS UNBOUNDED PRECEDING)")} AS held FROM h""")
def consecutive_hold(spark, sf_dir):
    """How much of the same kind has come in a row, up to each row."""
    made = facts.held(timeline(spark, sf_dir), ["tid"], ["t", "eid"], "type", "value")
    return made.select("tid", "eid", to_places(F.col("held"), 6).alias("held"))
