import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoframe.operators import analysis
from chronoframe.sources import frames as fr

W, H = 64, 40
FRAMES = "source int, frame long, t double, score double, duration double, pixels binary"
GBRP16 = fr.layout("gbrp16le", "", W, H)


def native_gaps():
    """20 pictures of 16 bits: black at both ends, white at 8 and 9, and some that are nearly so."""
    y, x = np.mgrid[0:H, 0:W]
    out = []
    for f in range(20):
        v = np.where((x + 2 * f) % 8 < 4, 30000, 50000) + y % 3 * 1500
        if f < 2 or f >= 18:
            v = np.zeros_like(v)
        if f in (8, 9, 11):
            v = np.full_like(v, 65535)
        if f == 11:
            v[39, 63] = 65534
        if f == 10:
            v = np.full_like(v, 65534)
        if f == 12:
            v = np.ones_like(v)
        out.append(np.repeat(v[None], 3, axis=0).astype("<u2").tobytes())
    return out


def analysed(spark, times, pictures, duration, remove_blank=True, scores=None):
    rows = [(0, i, t, (scores or {}).get(i, 0.0), duration, p) for i, (t, p) in enumerate(zip(times, pictures, strict=True))]
    scanned = analysis.scan(spark.createDataFrame(rows, FRAMES).repartition(3), GBRP16, H, W, remove_blank)
    return analysis.analyse(scanned, remove_blank)


def test_blank_frames_leave_gaps(spark):
    a = analysed(spark, [i / 10 for i in range(20)], native_gaps(), 2.0)
    assert tuple(a.counts.first()) == (0, 20, 6, 2.0)
    assert [(round(r["start"], 3), round(r["end"], 3)) for r in a.fragments.orderBy("start").collect()] == [(0.2, 0.8), (1.0, 1.8)]
    request = spark.createDataFrame([(0, 4, 0.5, 2.0)], "source int, scene_id int, b0 double, b1 double")
    scene = analysis.prepare(a, request).first()
    assert [(round(f["start"], 3), round(f["duration"], 3)) for f in scene["fragments"]] == [(0.5, 0.3), (1.0, 0.8)] and scene["usable"] == pytest.approx(1.1)
    assert all(0.5 <= m["time"] < 0.8 or 1.0 <= m["time"] < 1.8 for m in scene["motion"]) and scene["motion"]


def test_variable_rate(spark):
    times = [0.1 * f if f < 10 else 1 + (f - 10) * 0.2 for f in range(20)]
    a = analysed(spark, times, native_gaps(), 3.0)
    assert a.counts.first()["removed"] == 6 and a.fragments.agg(F.max("end")).first()[0] == pytest.approx(2.6)


@pytest.mark.parametrize("value", [0, 65535])
def test_solid_sources_have_nothing_to_show(spark, value):
    picture = np.full((3, H, W), value, dtype="<u2").tobytes()
    a = analysed(spark, [i / 10 for i in range(10)], [picture] * 10, 1.0)
    request = spark.createDataFrame([(0, 0, 0.0, 1.0)], "source int, scene_id int, b0 double, b1 double")
    assert a.fragments.collect() == [] and analysis.prepare(a, request).collect() == []


def test_whole_source_with_blanks_kept_and_scenes_by_cuts(spark):
    a = analysed(spark, [i / 10 for i in range(20)], native_gaps(), 2.0, remove_blank=False, scores={5: 0.9, 6: 0.9, 12: 0.9})
    assert [tuple(r) for r in a.fragments.collect()] == [(0, 0.0, 2.0)]
    assert [r["t"] for r in a.cuts.orderBy("t").collect()] == [0.0, 0.5, 1.2, 2.0]
    whole = spark.createDataFrame([(0, 0.3, 1.9)], "source int, b0 double, b1 double")
    assert [(r["scene_id"], r["b0"], r["b1"]) for r in analysis.by_cuts(whole, a.cuts).orderBy("b0").collect()] == [(0, 0.3, 0.5), (1, 0.5, 1.2), (2, 1.2, 1.9)]


def test_times_must_rise(spark):
    with pytest.raises(Exception, match="do not rise"):
        analysed(spark, [0.0, 0.0], native_gaps()[:2], 2.0).counts.collect()


def test_layouts():
    l420 = fr.layout("yuv420p", "tv", 64, 40)
    assert (l420.black, l420.white, l420.mid, l420.size) == (16, 235, 128, 64 * 40 * 3 // 2)
    assert (fr.layout("yuv420p", "pc", 64, 40).white, fr.layout("yuvj420p", "tv", 64, 40).black) == (255, 0)
    ten = fr.layout("yuv420p10le", "tv", 64, 40)
    assert (ten.depth, ten.black, ten.white, ten.mid, ten.size) == (10, 64, 940, 512, 2 * 64 * 40 * 3 // 2)
    assert fr.layout("rgb48le", "", 4, 4).depth == 16 and not fr.layout("xyz12le", "", 4, 4).classify and fr.layout("gray", "tv", 4, 4).white == 235
    planes = [np.full((40, 64), 16, dtype=np.uint8), np.full(64 * 20, 128, dtype=np.uint8)]
    assert l420.blank(planes) and not l420.blank([planes[0], planes[1] + 1])


def test_layout_names(spark):
    got = fr.layout_names(spark.createDataFrame([("yuv420p10le",), ("yuvj422p",), ("gray",)], "f string"), "f").orderBy("f").collect()
    assert [(r["f"], r["across"], r["down"]) for r in got] == [("gray", None, None), ("yuv420p10le", 2, 2), ("yuvj422p", 2, 1)]


def test_raw_files_blocks_and_pruning(spark, tmp_path):
    l = fr.layout("gray", "pc", 4, 4)  # noqa: E741
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.raw").write_bytes(bytes(range(160)))
    files = spark.read.format("binaryFile").load(str(tmp_path / "in")).select(F.lit(7).alias("source"), "content")
    frames = fr.raw_frames(files, l, 2.0)
    assert frames.count() == 10
    fr.store(frames, str(tmp_path / "out"), 2.0)
    got = fr.fetch(spark, str(tmp_path / "out"), 7, 5, 6, 2.0)
    assert [bytes(r["pixels"])[0] for r in got.orderBy("frame").collect()] == [80, 96]
    assert "PartitionFilters" in got._jdf.queryExecution().executedPlan().toString() and len(got.inputFiles()) <= 3
    assert fr.listed(spark, str(tmp_path / "in")).first()["fingerprint"].endswith(f":160:{fr.listed(spark, str(tmp_path / 'in')).first()['modified']}")
    with pytest.raises(Exception, match="ends within a frame"):
        fr.raw_frames(files, fr.layout("gray", "pc", 5, 5), 2.0).collect()


def test_only_new_sources_are_analysed(spark):
    sources = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "source int, fingerprint string")
    cache = spark.createDataFrame([("a", 2, True), ("b", 1, True), ("c", 2, False)], "fingerprint string, version int, remove_blank boolean")
    assert [r["source"] for r in analysis.fresh_sources(sources, cache, 2, True).orderBy("source").collect()] == [2, 3]
