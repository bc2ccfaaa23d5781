"""Queries of interval algebra and lookups."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronoframe.functions.numbers import half_up, to_places
from chronoframe.operators import intervals as iv
from chronoframe.plans.registry import query
from chronoframe.sources.tables import LINES_SQL, SCENES_SQL, TIMELINE_SQL, lines, read, scenes, timeline


def r3(x: str) -> str:
    return f"floor({x} * 1000.0::DOUBLE + 0.5::DOUBLE) / 1000.0::DOUBLE"


@query(f"""WITH {SCENES_SQL}, p AS (SELECT cid, a0 - min(a0) OVER (PARTITION BY cid) AS t, max(a1) OVER (PARTITION BY cid) - min(a0) OVER (PARTITION BY cid) - 1 AS duration FROM scenes),
m AS (SELECT cid, duration, least(greatest(t, 0), duration) AS s, least(greatest(lead(t) OVER (PARTITION BY cid ORDER BY t), 0), duration) AS e FROM p)
SELECT cid, s AS "start", e AS "end" FROM m WHERE e > s
UNION ALL SELECT cid, 0.0::DOUBLE, max(duration) FROM m GROUP BY cid HAVING count(CASE WHEN e > s THEN 1 END) = 0""")
def scene_ranges_clamped(spark, sf_dir):
    w = Window.partitionBy("cid")
    points = scenes(spark, sf_dir).select("cid", (F.col("a0") - F.min("a0").over(w)).alias("t"), (F.max("a1").over(w) - F.min("a0").over(w) - 1).alias("duration"))
    return iv.scene_ranges(points, ["cid"], "t", "duration")


@query(f"""WITH {LINES_SQL}, p AS (SELECT oid, idx // 2 AS pair, max(CASE WHEN idx % 2 = 0 THEN price END) AS s, max(CASE WHEN idx % 2 = 1 THEN price END) AS e FROM lines GROUP BY oid, idx // 2)
SELECT oid, pair, s AS "start", e AS "end", (e IS NOT NULL AND s >= 0 AND coalesce(e > s, false)) AS valid FROM p""")
def pair_intervals(spark, sf_dir):
    made = iv.pair_intervals(lines(spark, sf_dir), ["oid"], ["idx"], "price")
    return made.withColumn("valid", F.coalesce("valid", F.lit(False)))


_ALL = f"""WITH {SCENES_SQL}, placed AS (SELECT cid, oid, a1 - a0 AS duration, coalesce(sum(a1 - a0) OVER (PARTITION BY cid ORDER BY oid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM scenes)"""


def _concatenated(spark, sf_dir):
    """Each customer's scenes one after the other, and the requests against that timeline: a window of 5 days every 8."""
    own = scenes(spark, sf_dir).select("cid", "oid", (F.col("a1") - F.col("a0")).alias("duration"))
    total = own.groupBy("cid").agg(F.sum("duration").alias("total"))
    asked = total.select("cid", "total", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("total") / 8))).alias("n"))
    asked = asked.select("cid", "n", (F.col("n") * 8.0).alias("a0"), F.least(F.col("n") * 8.0 + 5.0, F.col("total")).alias("a1")).where("a1 > a0")
    return own, asked


@query(f"""{_ALL}, asked AS (SELECT cid, n, n * 8.0::DOUBLE AS a0, least(n * 8.0::DOUBLE + 5.0::DOUBLE, total) AS a1 FROM (SELECT cid, sum(duration) AS total FROM placed GROUP BY cid) q, range(0, 100000) r(n) WHERE n <= floor(total / 8))
SELECT a.cid, a.n, p.oid, greatest(a.a0, p.before) - p.before AS "start", least(a.a1, p.before + p.duration) - greatest(a.a0, p.before) AS duration
FROM asked a JOIN placed p ON a.cid = p.cid AND a.a0 < p.before + p.duration AND p.before < a.a1 WHERE a.a1 > a.a0""")
def migrate_intervals(spark, sf_dir):
    own, asked = _concatenated(spark, sf_dir)
    return iv.migrate_intervals(asked, own, ["cid"], "oid", 8.0).select("cid", "n", "oid", "start", "duration")


@query(f"""{_ALL} SELECT cid, oid, duration, before, before + duration AS after, floor(before / 2) AS first_block FROM placed""")
def fragment_offsets(spark, sf_dir):
    own, _ = _concatenated(spark, sf_dir)
    placed = iv.offsets(own, ["cid"], ["oid"], "duration")
    return placed.select("cid", "oid", "duration", "before", (F.col("before") + F.col("duration")).alias("after"), F.floor(F.col("before") / 2).cast("double").alias("first_block"))


@query(f"""{_ALL}, f AS (SELECT placed.*, CAST(floor(before * 24 + 0.5) AS BIGINT) AS first_frame, greatest(1, CAST(floor(duration * 24 + 0.5) AS BIGINT)) AS frames FROM placed),
asked AS (SELECT cid, n, n * 1.7::DOUBLE AS t FROM (SELECT cid, sum(duration) AS total FROM placed GROUP BY cid) q, range(0, 100000) r(n) WHERE n <= floor(total / 1.7::DOUBLE))
SELECT a.cid, a.n, a.t, f.oid, f.first_frame AS first, f.first_frame + f.frames - 1 AS last, least(greatest(f.first_frame + CAST(floor((a.t - f.before) * 24.0::DOUBLE + 0.5::DOUBLE) AS BIGINT), f.first_frame), f.first_frame + f.frames - 1) AS frame
FROM asked a ASOF JOIN f ON a.cid = f.cid AND a.t >= f.before""")
def frame_at_time(spark, sf_dir):
    own, _ = _concatenated(spark, sf_dir)
    placed = iv.offsets(own, ["cid"], ["oid"], "duration").withColumn("first", half_up(F.col("before") * 24).cast("long")).withColumn("frames", F.greatest(F.lit(1), half_up(F.col("duration") * 24)).cast("long"))
    total = own.groupBy("cid").agg(F.sum("duration").alias("total"))
    asked = total.select("cid", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("total") / 1.7))).alias("n")).select("cid", "n", (F.col("n") * 1.7).alias("t"))
    met = iv.backward(asked, placed.withColumn("t", F.col("before")), ["cid"], "t", ["oid", "before", "first", "frames"])
    last = F.col("first") + F.col("frames") - 1
    frame = F.least(F.greatest(F.col("first") + half_up((F.col("t") - F.col("before")) * 24.0).cast("long"), F.col("first")), last)
    return met.select("cid", "n", "t", "oid", "first", last.alias("last"), frame.alias("frame"))


_REQUESTS = """asked AS (SELECT cid, min(a0) + 100.0::DOUBLE * k AS b0, min(a0) + 100.0::DOUBLE * k + 40.0::DOUBLE AS b1, k FROM scenes, range(0, 24) r(k) GROUP BY cid, k)"""


def _requests(own):
    starts = own.groupBy("cid").agg(F.min("a0").alias("first"))
    dealt = starts.select("cid", "first", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(23).cast("long"))).alias("k"))
    return dealt.select("cid", (F.col("first") + F.col("k") * 100.0).alias("b0"), (F.col("first") + F.col("k") * 100.0 + 40.0).alias("b1"), "k")


@query(f"""WITH {SCENES_SQL}, {_REQUESTS} SELECT s.cid, s.oid, a.k, greatest(a0, b0) AS "start", least(a1, b1) AS "end" FROM scenes s JOIN asked a ON s.cid = a.cid AND a0 < b1 AND b0 < a1 WHERE least(a1, b1) > greatest(a0, b0) + 1e-7""")
def prepare_clip(spark, sf_dir):
    own = scenes(spark, sf_dir)
    return iv.clip(own, _requests(own), ["cid"], 50.0).select("cid", "oid", "k", "start", "end")


@query(f"""WITH {SCENES_SQL}, {_REQUESTS}, o AS (SELECT s.oid, sum(least(a1, b1) - greatest(a0, b0)) AS taken FROM scenes s JOIN asked a ON s.cid = a.cid AND a0 < b1 AND b0 < a1 GROUP BY s.oid)
SELECT cid, s.oid, least(coalesce(taken, 0), a1 - a0) AS taken, least(coalesce(taken, 0), a1 - a0) / (a1 - a0) AS reused FROM scenes s LEFT JOIN o ON s.oid = o.oid""")
def interval_overlap(spark, sf_dir):
    own = scenes(spark, sf_dir)
    met = iv.overlap(own.select("cid", "oid", "a0", "a1"), _requests(own), ["cid"], ["oid"], 50.0)
    return met.select("cid", "oid", "taken", (F.col("taken") / (F.col("a1") - F.col("a0"))).alias("reused"))


@query(f"""WITH {SCENES_SQL}, x AS (SELECT *, CASE WHEN a0 > max(a1) OVER (PARTITION BY cid ORDER BY a0, a1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1e-7 THEN 1 WHEN row_number() OVER (PARTITION BY cid ORDER BY a0, a1) = 1 THEN 1 ELSE 0 END AS fresh FROM scenes),
y AS (SELECT *, sum(fresh) OVER (PARTITION BY cid ORDER BY a0, a1 ROWS UNBOUNDED PRECEDING) AS island FROM x)
SELECT cid, min(a0) AS a0, max(a1) AS a1, count(*) AS merged FROM y GROUP BY cid, island""")
def coverage_union(spark, sf_dir):
    return iv.coverage_union(scenes(spark, sf_dir), ["cid"], "a0", "a1")


@query(f"""WITH {SCENES_SQL}, frag AS (SELECT cid, k, min(a0) + 60.0::DOUBLE * k AS f0, min(a0) + 60.0::DOUBLE * k + 30.0::DOUBLE AS f1 FROM scenes, range(0, 4) r(k) GROUP BY cid, k),
cov AS (SELECT cid, a0 AS b0, a1 AS b1 FROM scenes WHERE oid % 2 = 0),
edges AS (SELECT f.cid, k, f0, f1, least(greatest(b0, f0), f1) AS s, least(greatest(b1, f0), f1) AS e FROM frag f JOIN cov c ON f.cid = c.cid AND b1 > f0 AND b0 < f1 UNION ALL SELECT cid, k, f0, f1, f1, f1 FROM frag),
g AS (SELECT *, greatest(f0, coalesce(max(e) OVER (PARTITION BY cid, k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), f0)) AS cursor FROM edges)
SELECT cid, min(k * 30.0::DOUBLE + cursor - f0) AS "offset" FROM g WHERE s > cursor + 0.04::DOUBLE GROUP BY cid""")
def first_unused_gap(spark, sf_dir):
    own = scenes(spark, sf_dir)
    starts = own.groupBy("cid").agg(F.min("a0").alias("first"))
    fragments = starts.select("cid", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"), "first").select("cid", "k", (F.col("first") + F.col("k") * 60.0).alias("a0"), (F.col("first") + F.col("k") * 60.0 + 30.0).alias("a1"))
    covered = iv.coverage_union(own.where("oid % 2 = 0").select("cid", F.col("a0").alias("b0"), F.col("a1").alias("b1")), ["cid"], "b0", "b1").drop("merged")
    return iv.first_unused(fragments, covered, ["cid"], "k")


@query(f"""WITH {TIMELINE_SQL}, b AS (SELECT DISTINCT tid, t FROM tl WHERE type = 'click'), p AS (SELECT tid, eid, t FROM tl WHERE type = 'view'), d AS (SELECT tid, max(t) AS d FROM tl GROUP BY tid),
lo AS (SELECT p.*, b.t AS low FROM p ASOF LEFT JOIN b ON p.tid = b.tid AND p.t > b.t), hi AS (SELECT lo.*, b.t AS high FROM lo ASOF LEFT JOIN b ON lo.tid = b.tid AND lo.t <= b.t)
SELECT hi.tid, eid, hi.t, least(coalesce(CASE WHEN high IS NULL THEN low WHEN low IS NULL THEN high WHEN t - low <= high - t THEN low ELSE high END, t), d) AS nearest FROM hi JOIN d ON hi.tid = d.tid""")
def nearest_boundary(spark, sf_dir):
    tl = timeline(spark, sf_dir)
    last = Window.partitionBy("tid")
    points = tl.withColumn("d", F.max("t").over(last)).where("type = 'view'").select("tid", "eid", "t", "d")
    marks = tl.where("type = 'click'").select("tid", "t", F.col("t").alias("b")).distinct()
    return iv.nearest(points, marks, ["tid"], "t", "b", F.col("d")).select("tid", "eid", "t", "nearest")


@query(f"""WITH {LINES_SQL}, n AS (SELECT oid, CAST(max(t1) AS BIGINT) AS n FROM lines GROUP BY oid), g AS (SELECT oid, f, f * 4.0::DOUBLE AS t FROM n, range(0, 2000) r(f) WHERE f * 4 <= n),
hit AS (SELECT g.oid, g.f, g.t, l.idx, l.t0, l.t1, l.price FROM g LEFT JOIN lines l ON g.oid = l.oid AND g.t >= l.t0 AND g.t < l.t1),
lst AS (SELECT oid, max(idx) AS idx FROM lines GROUP BY oid), full_ AS (SELECT h.oid, f, t, coalesce(h.idx, z.idx) AS idx FROM hit h JOIN lst z ON h.oid = z.oid)
SELECT x.oid, f AS frame, t, x.idx, {r3("(t - l.t0) / greatest(l.t1 - l.t0, 1e-6)")} AS x FROM full_ x JOIN lines l ON x.oid = l.oid AND x.idx = l.idx""")
def segment_lookup(spark, sf_dir):
    """Every segment names its own frames, so the lookup of a frame's segment is an expansion and no join; the last one also takes the frame at the end."""
    rows = lines(spark, sf_dir).withColumn("last", F.max("idx").over(Window.partitionBy("oid")) == F.col("idx"))
    first = F.ceil(F.col("t0") / 4)
    after = F.when(F.col("last"), F.floor(F.col("t1") / 4)).otherwise(F.ceil(F.col("t1") / 4) - 1)
    frames = rows.where(after >= first).select("oid", "idx", "t0", "t1", F.explode(F.sequence(first, after)).alias("frame"))
    t = F.col("frame") * 4.0
    return frames.select("oid", "frame", t.alias("t"), "idx", to_places((t - F.col("t0")) / F.greatest(F.col("t1") - F.col("t0"), F.lit(1e-6)), 3).alias("x"))


@query(f"""WITH {SCENES_SQL}, m AS (SELECT cid, oid, a0, price, row_number() OVER (PARTITION BY cid ORDER BY a0, oid) AS seq FROM scenes)
SELECT cid, oid, min(a0) OVER w AS first_a0, price - coalesce(lag(price) OVER w, price) AS step, sum(price) OVER (w ROWS UNBOUNDED PRECEDING) >= 200000 AS late, seq - 1 AS pos FROM m WINDOW w AS (PARTITION BY cid ORDER BY seq)""".replace("price - coalesce(lag(price) OVER w, price) AS step", f"{r3('price')} AS price"))
def selection_order(spark, sf_dir):
    """Scenes in order of selection, with what each knows of those before."""
    w = Window.partitionBy("cid").orderBy("a0", "oid")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    return scenes(spark, sf_dir).select("cid", "oid", F.min("a0").over(so_far).alias("first_a0"), to_places(F.col("price"), 3).alias("price"), (F.sum("price").over(so_far) >= 200000).alias("late"), (F.row_number().over(w) - 1).cast("long").alias("pos"))


@query("""WITH now AS (SELECT doc_id, source || ':' || n_chars || ':' || lang AS stamp, source, n_chars FROM documents), old AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN stamp || '!' ELSE stamp END AS stamp FROM now WHERE doc_id % 5 <> 0)
SELECT n.doc_id, n.stamp, (o.doc_id IS NULL) AS fresh FROM now n LEFT JOIN old o ON n.doc_id = o.doc_id WHERE o.stamp IS NULL OR o.stamp <> n.stamp""")
def stale_sources(spark, sf_dir):
    """Sources to analyse again: those without a stored stamp, or with another one."""
    now = read(spark, sf_dir, "documents").select("doc_id", F.concat_ws(":", "source", "n_chars", "lang").alias("stamp"))
    old = now.where("doc_id % 5 <> 0").select("doc_id", F.when(F.col("doc_id") % 7 == 0, F.concat("stamp", F.lit("!"))).otherwise(F.col("stamp")).alias("kept"))
    return now.join(old, "doc_id", "left").where("kept is null or kept <> stamp").select("doc_id", "stamp", F.col("kept").isNull().alias("fresh"))
