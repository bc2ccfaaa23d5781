import json

import pytest
from pyspark.sql import functions as F

from chronoframe.operators import planning, words
from chronoframe.plans import document, presets, validation


def rules(df):
    return sorted(r["rule"] for r in df.collect())


GOOD = (1, 2, "HARD", 320, 180, 16, 10.0, 20.0, "vp9", "webm", 12)
KIND = "id int, schema_version int, style string, w int, h int, fps int, target double, video double, codec string, format string, bitrate int"


@pytest.mark.parametrize(("change", "rule"), [({}, []), ({8: "h.264"}, ["export"]), ({3: 0}, ["size"]), ({3: 321}, ["size"]), ({2: "odd"}, ["style"]), ({5: 121}, ["rate"]), ({6: float("nan")}, ["target"]), ({7: -1.0}, ["video"]), ({1: 5}, ["version"]), ({10: None}, ["export"])])
def test_plan_rules(spark, change, rule):
    row = tuple(change.get(i, v) for i, v in enumerate(GOOD))
    assert rules(validation.plan_errors(spark.createDataFrame([row], KIND), "id")) == rule


def test_segment_rules(spark):
    rows = [(1, 0, 0.0, 1.0, 0.0, 1.0, "snap"), (1, 1, 1.1, 2.0, 0.0, 30.0, "odd"), (2, 0, 0.0, 4.0, float("nan"), 1.0, "snap")]
    df = spark.createDataFrame(rows, "p int, idx int, t0 double, t1 double, s0 double, s1 double, curve string").withColumn("target", F.lit(2.0)).withColumn("video", F.lit(10.0))
    assert rules(validation.segment_errors(df.where("p = 1"), ["p"], "idx", "target", "video")) == ["contiguous", "curve", "source"]
    assert set(rules(validation.segment_errors(df.where("p = 2"), ["p"], "idx", "target", "video"))) >= {"coverage", "finite"}


def test_parameters_ranges_events_and_the_gate(spark):
    p = spark.createDataFrame([(1, "echo_alpha", 2.0), (1, "shake_a0", 8.0), (2, "shake_a0", float("nan")), (3, "new", 0.5)], "id int, name string, value double")
    assert sorted((r["id"], r["rule"]) for r in validation.parameter_errors(p, "id").collect()) == [(1, "echo_alpha"), (2, "shake_a0")]
    r = spark.createDataFrame([(1, 0.0, 10.05, 10.0), (2, 0.0, 10.06, 10.0), (3, -1.0, 1.0, 10.0), (4, 0.0, 0.0, 10.0), (5, 0.0, 1.0, None)], "id int, s double, d double, all double")
    assert sorted(x["id"] for x in validation.range_errors(r, ["id"], "s", "d", "all").collect()) == [2, 3, 4, 5]
    e = spark.createDataFrame([(1, "a", 0.0, 2.0, 9.0), (1, "a", 1.0, 3.0, 9.0), (1, "b", 1.0, 3.0, 9.0)], "id int, kind string, t0 double, t1 double, target double")
    assert [(x["kind"], x["t0"]) for x in validation.event_errors(e, ["id"], "target").collect()] == [("a", 1.0)]
    plans = spark.createDataFrame([(1,), (2,)], "id int")
    bad = spark.createDataFrame([(2, "x")], "id int, rule string")
    assert validation.gate(plans, bad.where("id > 5"), "id", "invalid plan").count() == 2
    with pytest.raises(Exception, match="invalid plan"):
        validation.gate(plans, bad, "id", "invalid plan").collect()


def test_documents_round_trip_and_default(spark, tmp_path):
    plans = spark.createDataFrame([(1, "HARD", 16, 7.0, 60.0, "no_change", "mid", [0.5 * i for i in range(1, 14)], [1.0, 2.0], None)], "plan_id long, style string, fps int, target double, video double, mode string, rhythm string, beats array<double>, downbeats array<double>, scenes array<double>")
    rows = planning.plan(plans)
    docs = document.assemble(plans, rows)
    got = document.parse(docs).first()
    assert got["schema_version"] == 2 and len(got["segments"]) == rows.count() and got["segments"][0]["t0"] == 0.0 and got["segments"][0]["remap"] is None
    old = document.parse(spark.createDataFrame([('{"schema_version": 1}',), ("no json",)], "doc string")).collect()
    assert (old[0]["style"], old[0]["fps"], old[0]["segments"]) == ("HARD", 30, []) and old[1]["schema_version"] is None
    events = spark.createDataFrame([(1, 2.0, "INVERT"), (1, 1.0, "FLASH_BLACK")], "plan_id long, t double, type string")
    full = document.with_events(docs, one_framers=events, transitions=events.selectExpr("plan_id + 5 as plan_id", "t", "type", "4 as duration_frames", "false as is_wrap"))
    found = json.loads(full.first()["doc"])
    assert [x["type"] for x in found["one_framers"]] == ["FLASH_BLACK", "INVERT"] and found["transitions"] == [] and len(found["segments"]) == rows.count()
    document.save(docs, str(tmp_path / "plans"))
    assert spark.read.text(str(tmp_path / "plans")).count() == 1
    with pytest.raises(Exception, match="already exists"):
        document.save(docs, str(tmp_path / "plans"))


def test_presets():
    assert not presets.toggles("SMOOTH", True)["exposure_flash"] and presets.toggles("hard", True)["exposure_flash"] and not presets.toggles("HARD", False)["tint"]
    assert presets.parameters("HYBRID")["skew_s0"] == 7.0 and all(low <= a <= high for _, *v, low, high in presets.PARAMETERS for a in v)


def test_blocks_close_by_length_pause_and_stop(spark):
    rows = [(1, i, w, i * 0.3, i * 0.3 + 0.2) for i, w in enumerate("a b c. d e f g h i j k".split())] + [(2, 0, "x", 0.0, 0.1), (2, 1, "y", 0.2, 0.3), (2, 2, "z", 0.4, 0.5), (2, 3, "late", 2.0, 2.1)]
    got = words.block_rows(words.blocks(spark.createDataFrame(rows, "k int, i int, word string, start double, end double"), ["k"], ["i"]), ["k"], ["i"])
    assert [(r["k"], r["text"]) for r in got.orderBy("k", "block").collect()] == [(1, "a b c."), (1, "d e f g h i j"), (1, "k"), (2, "x y z"), (2, "late")]


def test_layout_rows_stay_on_stage(spark):
    texts = [(i, ["word"] * n + ["extraordinarily"] * (i % 2), i) for i, n in enumerate([1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12])]
    got = words.puzzle(spark.createDataFrame(texts, "b int, w array<string>, v int"), ["b"], F.col("w"), "v").orderBy("b", "row").collect()
    for (b, w, _) in texts:
        rows = [r for r in got if r["b"] == b]
        assert [x for r in rows for x in f"{r['left']} {r['right']}".split()] == [x.upper() for x in w]
        assert all(r["x1"] >= 80 and r["w1"] <= 860 for r in rows) and all(a["y"] < c["y"] for a, c in zip(rows, rows[1:], strict=False))


def test_prepared_errors_of_nulls_and_of_too_many_scenes(spark):
    schema = "plan int, scene_id long, source_start double, source_end double, fragments array<struct<start double, duration double>>, motion array<struct<time double, activity double, confidence double>>, actions array<struct<start double, end double, peak double, activity double>>"
    good = (1, 1, 0.0, 4.0, [(0.0, 2.0), (2.0, 2.0)], [(0.5, 0.2, 1.0), (0.5, 0.3, 1.0)], [(0.0, 1.0, 0.5, 0.4)])
    rows = [
        good,
        (1, 2, None, 4.0, [(0.0, 2.0)], None, None),
        (1, 3, 0.0, 4.0, None, [(0.5, float("nan"), 1.0)], []),
        (1, 4, 0.0, 4.0, [(0.0, None)], [], [(0.0, 1.0, 0.5, float("inf"))]),
        (1, 5, 0.0, 4.0, [(0.0, 2.0), (1.9, 1.0)], [(1.0, 0.1, 0.1), (0.9, 0.1, 0.1)], []),
    ]
    prepared = spark.createDataFrame(rows, schema)
    found = {(r["scene_id"], r["rule"]) for r in validation.prepared_errors(prepared, ["plan"], "scene_id").collect()}
    assert found == {(2, "scene"), (2, "fragment"), (3, "scene"), (3, "motion"), (4, "fragment"), (4, "action"), (5, "fragment"), (5, "motion")}
    assert validation.prepared_errors(prepared.limit(0), ["plan"], "scene_id").count() == 0
    many = spark.createDataFrame([good], schema).drop("scene_id").crossJoin(spark.range(validation.MOST_SCENES + 1).withColumnRenamed("id", "scene_id"))
    assert [tuple(r) for r in validation.prepared_errors(many, ["plan"], "scene_id").collect()] == [(1, None, "count")]


def test_ambiance_without_toggles_and_with_nulls(spark):
    rows = spark.createDataFrame([("HARD", True, False, None), ("SMOOTH", None, False, 0.5), ("odd", True, True, 0.5), ("HYBRID", True, False, 0.5)], "style string, on boolean, calm boolean, p double")
    on = {name: F.col("on") for name in ("flicker", "exposure_flash", "echo_trail", "tint")} | {"anti_flash": F.col("calm")}
    given = {"flicker_amplitude": F.col("p"), "echo_alpha": F.col("p"), "tint_g": F.col("p") * 8}
    made = rows.select(presets.ambiance(F.col("style"), on, F.array(F.lit(1.0)), given).alias("a"), presets.ambiance(F.col("style"), {}, F.array(F.lit(1.0))).alias("none")).select("*", presets.active(F.col("a")).alias("n"))
    first, second, third, last = made.collect()
    assert second["a"] is None and second["n"] == 0 and all(r["none"] is None for r in (first, second, third, last))
    assert first["a"]["flicker"]["amplitude"] == 0.15 and first["a"]["flash"]["times"] == [1.0] and not first["a"]["echo"]["enabled"] and first["n"] == 2
    assert third["a"]["flicker"]["amplitude"] == 0.0 and third["a"]["flash"]["times"] == [] and not third["a"]["tint"]["invert"] and third["a"]["tint"]["g"] == 4 and third["n"] == 2
    assert last["a"]["flicker"]["amplitude"] == 0.5 and last["a"]["flicker"]["hz"] == 10.0 and last["a"]["echo"]["enabled"] and last["n"] == 4
