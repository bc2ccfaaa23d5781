"""Queries over transcripts, names and JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoframe.functions import text as tx
from chronoframe.functions.numbers import to_places
from chronoframe.operators import words as wd
from chronoframe.plans.event_queries import D, r6
from chronoframe.plans.registry import query
from chronoframe.sources.tables import read

_SEGMENTS = f"""seg AS (SELECT conv_id, turn, text, CAST(turn AS DOUBLE) * 10.0{D} AS s, CAST(turn AS DOUBLE) * 10.0{D} + 8.0{D} AS e FROM conversations),
lst AS (SELECT conv_id, turn, s, e, list_filter(regexp_split_to_array(trim(text, ' '), '\\s+'), lambda w: w <> '') AS ws FROM seg),
w AS (SELECT conv_id, turn, unnest(range(0, len(ws))) AS pos, unnest(ws) AS word, s, greatest(0.2{D}, e - s) / greatest(1, len(ws)) AS d FROM lst WHERE len(ws) > 0),
words AS (SELECT conv_id, turn, pos, word, floor((s + pos * d) * 1000.0{D} + 0.5{D}) / 1000.0{D} AS "start", floor((s + (pos + 1) * d) * 1000.0{D} + 0.5{D}) / 1000.0{D} AS "end" FROM w)"""


def _words(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    start = F.col("turn").cast("double") * 10.0
    return wd.split_words(c.select("conv_id", "turn", "text", start.alias("start"), (start + 8.0).alias("end")), ["conv_id"], ["turn"])


@query(f"""WITH {_SEGMENTS} SELECT conv_id, turn, CAST(pos AS INTEGER) AS pos, word, "start", "end" FROM words""")
def transcript_words(spark, sf_dir):
    return _words(spark, sf_dir)


@query(f"""WITH RECURSIVE {_SEGMENTS}, n AS (SELECT *, row_number() OVER o AS i, (coalesce(lead("start") OVER o - "end" > 0.35{D}, false) OR regexp_matches(word, '[.!?]$')) AS brk FROM words WINDOW o AS (PARTITION BY conv_id ORDER BY turn, pos)),
k AS (SELECT conv_id, i, 0 AS block, 1 AS held, brk FROM n WHERE i = 1 UNION ALL SELECT n.conv_id, n.i, CASE WHEN k.held >= 7 OR (k.held >= 3 AND k.brk) THEN k.block + 1 ELSE k.block END, CASE WHEN k.held >= 7 OR (k.held >= 3 AND k.brk) THEN 1 ELSE k.held + 1 END, n.brk FROM k JOIN n ON n.conv_id = k.conv_id AND n.i = k.i + 1),
b AS (SELECT k.conv_id, CAST(k.block AS BIGINT) AS block, n.word, n."start", n."end", n.i FROM k JOIN n ON k.conv_id = n.conv_id AND k.i = n.i)
SELECT conv_id, block, string_agg(word, ' ' ORDER BY i) AS text, CAST(count(*) AS INTEGER) AS words, floor(arg_min("start", i) * 100.0{D} + 0.5{D}) / 100.0{D} AS "start", floor((arg_max("end", i) + 0.15{D}) * 100.0{D} + 0.5{D}) / 100.0{D} AS "end", block % 4 AS layout FROM b GROUP BY conv_id, block""")
def word_blocks(spark, sf_dir):
    grouped = wd.blocks(_words(spark, sf_dir), ["conv_id"], ["turn", "pos"])
    return wd.block_rows(grouped, ["conv_id"], ["turn", "pos"])


@query(f"""WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') AS ws FROM documents), e AS (SELECT doc_id, CASE WHEN len(ws) > 0 THEN ws ELSE ['FREESTYLE', 'VOCALS', 'DEMO', 'TRACK'] END AS ws FROM d), n AS (SELECT *, CAST(ceil(len(ws) / 5.0{D}) AS BIGINT) AS n FROM e), b AS (SELECT doc_id, ws, n, unnest(range(0, n)) AS block FROM n)
SELECT doc_id, block, array_to_string(ws[block * 5 + 1 : block * 5 + 5], ' ') AS text, floor(block * (120.0{D} / n) * 100.0{D} + 0.5{D}) / 100.0{D} AS "start", floor((block + 1) * (120.0{D} / n) * 100.0{D} + 0.5{D}) / 100.0{D} AS "end", block % 4 AS layout FROM b""")
def fallback_blocks(spark, sf_dir):
    return wd.fallback_blocks(read(spark, sf_dir, "documents"), ["doc_id"], "text", F.lit(120.0))


@query(f"""WITH {_SEGMENTS}, l AS (SELECT conv_id, turn, list(word ORDER BY pos) AS ws, list("start" ORDER BY pos) AS ss, min("start") AS s, max("end") AS e FROM words GROUP BY conv_id, turn), p AS (SELECT *, s + (e - s) * 0.6{D} AS t FROM l)
SELECT conv_id, turn, array_to_string(list_transform(list_filter(list_zip(ws, ss), lambda z: z[2] <= t), lambda z: z[1]), ' ') AS shown, array_to_string(ws[1 : least(len(ws), CAST(floor((t - s) / greatest(0.04{D}, (e - s) / len(ws))) AS BIGINT) + 1)], ' ') AS evenly,
array_to_string(ws[1 : greatest(1, len(ws) // 2)], ' ') AS line1, array_to_string(ws[greatest(1, len(ws) // 2) + 1 : len(ws)], ' ') AS line2 FROM p""")
def word_reveal(spark, sf_dir):
    own = _words(spark, sf_dir).groupBy("conv_id", "turn").agg(F.array_sort(F.collect_list(F.struct("pos", "word", "start"))).alias("w"), F.min("start").alias("s"), F.max("end").alias("e"))
    ws = F.transform("w", lambda x: x["word"])
    t = F.col("s") + (F.col("e") - F.col("s")) * 0.6
    first, second = wd.verse(ws)
    return own.select("conv_id", "turn", wd.revealed(F.col("w"), t).alias("shown"), wd.revealed_evenly(ws, t, F.col("s"), F.col("e")).alias("evenly"), first.alias("line1"), second.alias("line2"))


@query()
def puzzle_layout(spark, sf_dir):
    """Layouts of the blocks of each transcript: every block's rows lie on the stage, one under the other."""
    blocks = wd.block_rows(wd.blocks(_words(spark, sf_dir), ["conv_id"], ["turn", "pos"]), ["conv_id"], ["turn", "pos"])
    made = blocks.select("conv_id", "block", F.split("text", " ").alias("ws"), "layout")
    return wd.puzzle(made, ["conv_id", "block"], F.col("ws"), "layout")


@query(f"""SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), 7.0{D}) AS k, coalesce(TRY_CAST(json_extract_string(props, '$.none') AS DOUBLE), 0.5{D}) AS missing, json_extract_string(props, '$.k') AS raw, '["' || event_type || '","' || CAST(user_id AS VARCHAR) || '"]' AS cache_key FROM events""")
def json_params(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return e.select("event_id", tx.number_or(F.col("props"), "$.k", 7.0).alias("k"), tx.number_or(F.col("props"), "$.none", 0.5).alias("missing"), F.get_json_object("props", "$.k").alias("raw"), tx.cache_key(F.col("event_type"), F.col("user_id").cast("string")).alias("cache_key"))


_LINE = "CASE event_id % 4 WHEN 0 THEN 'PROGRESS:' || CAST(event_id % 100 AS VARCHAR) || ':step ' || event_type WHEN 1 THEN 'RESULT:' || props WHEN 2 THEN 'noise pts_time:' || CAST(event_id AS VARCHAR) || '.5 other' ELSE 'noise pts_time:nan x' END"


@query(f"""WITH l AS (SELECT event_id, {_LINE} AS line FROM events) SELECT event_id, CASE WHEN starts_with(line, 'PROGRESS:') THEN TRY_CAST(split_part(line, ':', 2) AS DOUBLE) END AS percent, CASE WHEN starts_with(line, 'PROGRESS:') THEN split_part(line, ':', 3) END AS message,
CASE WHEN starts_with(line, 'RESULT:') THEN substr(line, 8) END AS result, CASE WHEN contains(line, 'pts_time:') AND NOT isnan(coalesce(TRY_CAST(regexp_extract(line, 'pts_time:\\s*(\\S+)', 1) AS DOUBLE), 'nan'::DOUBLE)) THEN TRY_CAST(regexp_extract(line, 'pts_time:\\s*(\\S+)', 1) AS DOUBLE) END AS pts FROM l""")
def protocol_lines(spark, sf_dir):
    i = F.col("event_id")
    line = F.when(i % 4 == 0, F.concat(F.lit("PROGRESS:"), (i % 100).cast("string"), F.lit(":step "), F.col("event_type"))).when(i % 4 == 1, F.concat(F.lit("RESULT:"), F.col("props"))).when(i % 4 == 2, F.concat(F.lit("noise pts_time:"), i.cast("string"), F.lit(".5 other"))).otherwise("noise pts_time:nan x")
    rows = read(spark, sf_dir, "events").select("event_id", line.alias("line"))
    return rows.select("event_id", tx.progress(F.col("line")).alias("p"), tx.metadata_value(F.col("line"), "pts_time:").alias("pts")).select("event_id", "p.*", "pts")


_HEX = "CASE p_partkey % 4 WHEN 0 THEN '#' || upper(lpad(to_hex(p_partkey * 7919 % 16777216), 6, '0')) WHEN 1 THEN '#FF' || upper(lpad(to_hex(p_partkey * 104729 % 16777216), 6, '0')) WHEN 2 THEN 'zzzzzz' ELSE NULL END"


@query(f"""WITH h AS (SELECT p_partkey, {_HEX} AS h, p_size, p_brand, p_name, p_retailprice FROM part), g AS (SELECT *, CASE WHEN p_partkey % 4 < 2 THEN right(h, 6) END AS body FROM h)
SELECT p_partkey, coalesce(CAST(('0x' || substr(body, 1, 2)) AS INTEGER), 255) AS r, coalesce(CAST(('0x' || substr(body, 3, 2)) AS INTEGER), 255) AS g, coalesce(CAST(('0x' || substr(body, 5, 2)) AS INTEGER), 255) AS b, CAST(floor(p_retailprice / 60) AS BIGINT) || ':' || lpad(CAST(CAST(floor(p_retailprice) AS BIGINT) % 60 AS VARCHAR), 2, '0') || '.' || CAST(CAST(floor((p_retailprice - floor(p_retailprice)) * 10) AS BIGINT) AS VARCHAR) AS clock,
regexp_matches(p_brand, '^[A-Za-z0-9-]{{1,100}}$') AS job_ok, (CASE p_partkey % 3 WHEN 0 THEN 'H264' WHEN 1 THEN 'VP9' ELSE 'AV1' END IN ('H264', 'H265', 'HEVC', 'VP9') AND (p_size % 3 <> 2 OR p_partkey % 3 = 1) AND p_size BETWEEN 1 AND 100) AS export_ok,
CASE WHEN p_size % 4 = 0 THEN 'no_repeat' WHEN p_size % 4 = 1 AND p_partkey % 2 = 0 THEN 'smart' WHEN p_partkey % 3 <> 0 THEN 'no_repeat' ELSE 'classic' END AS policy FROM g""")
def format_rules(spark, sf_dir):
    i, size = F.col("p_partkey"), F.col("p_size")
    colour = F.when(i % 4 == 0, F.concat(F.lit("#"), F.lpad(F.hex(i * 7919 % 16777216), 6, "0"))).when(i % 4 == 1, F.concat(F.lit("#FF"), F.lpad(F.hex(i * 104729 % 16777216), 6, "0"))).when(i % 4 == 2, "zzzzzz")
    codec = F.when(i % 3 == 0, "h.264").when(i % 3 == 1, "vp9").otherwise("av1")
    container = F.when(size % 3 == 0, "mp4").when(size % 3 == 1, "mkv").otherwise("webm")
    mode = F.when(size % 4 == 0, "long_clip").when(size % 4 == 1, "scenepack").otherwise("no_change")
    rows = read(spark, sf_dir, "part").select(
        "p_partkey", tx.hex_colour(colour).alias("c"), tx.clock(F.col("p_retailprice")).alias("clock"), tx.valid_job_id(F.col("p_brand")).alias("job_ok"), tx.valid_export(codec, container, size).alias("export_ok"), tx.policy(mode, i % 3 != 0, i % 2 == 0).alias("policy")
    )
    return rows.select("p_partkey", "c.r", "c.g", "c.b", "clock", "job_ok", "export_ok", "policy")


@query("""SELECT page_id, lower(regexp_extract(url, '\\.([^./\\\\]+)$', 1)) AS ending, coalesce(lower(regexp_extract(url, '\\.([^./\\\\]+)$', 1)) IN ('mp4', 'mkv', 'webm', 'mov', 'avi'), false) AS video, url || ':' || CAST(length(html) AS VARCHAR) || ':' || CAST(page_id AS VARCHAR) AS fingerprint, base64(encode(substr(url, 1, 24))) AS thumb FROM pages""")
def source_listing(spark, sf_dir):
    p = read(spark, sf_dir, "pages")
    return p.select("page_id", tx.ending(F.col("url")).alias("ending"), tx.accepted(F.col("url"), tx.VIDEO).alias("video"), tx.fingerprint(F.col("url"), F.length("html"), F.col("page_id")).alias("fingerprint"), F.base64(F.substring("url", 1, 24).cast("binary")).alias("thumb"))


@query(f"""WITH {_SEGMENTS} SELECT conv_id, count(*) AS words, max("end") AS last_end, {r6(f'sum("end" - "start")')} AS spoken, string_agg(word, ' ' ORDER BY turn, pos) AS text FROM words GROUP BY conv_id""")
def transcript_totals(spark, sf_dir):
    own = _words(spark, sf_dir).groupBy("conv_id").agg(F.count("*").alias("words"), F.max("end").alias("last_end"), F.sum(F.col("end") - F.col("start")).alias("spoken"), F.array_sort(F.collect_list(F.struct("turn", "pos", "word"))).alias("w"))
    return own.select("conv_id", "words", "last_end", to_places(F.col("spoken"), 6).alias("spoken"), F.array_join(F.transform("w", lambda x: x["word"]), " ").alias("text"))
