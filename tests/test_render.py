import base64

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoframe.operators import render

SEGMENTS = "p int, idx int, t0 double, t1 double, s0 double, s1 double, curve string, strength double, phase_start double, phase_end double"


def test_every_output_frame_has_one_row(spark):
    rows = [(1, 0, 0.0, 0.7, 0.0, 0.7, "snap", None, None, None), (1, 1, 0.7, 1.3, 5.0, 4.4, "linear", None, None, None), (1, 2, 1.3, 2.0, 1.0, 4.0, "saddle", 0.5, 0.0, 1.0)]
    got = render.frame_table(spark.createDataFrame(rows, SEGMENTS), ["p"], 10).orderBy("frame").collect()
    assert [r["frame"] for r in got] == list(range(20))
    assert [r["idx"] for r in got] == [0] * 7 + [1] * 6 + [2] * 7
    assert got[0]["source_t"] == 0.0 and got[7]["source_t"] == pytest.approx(5.0, abs=1e-6) and got[7]["source_t"] < 5.0
    assert all(r["blend"] == (1 if r["speed"] <= 1 else min(1 + int(r["speed"]), 4)) for r in got)


def test_alternate_frames_stay_in_their_shot(spark):
    df = spark.createDataFrame([(100, 0, 30.0, False, 90, 110), (100, 4, 30.0, True, 90, 101), (100, 0, 30.0, False, 5, 4), (100, 0, 1.0, False, 0, 200)], "b long, seed long, fps double, r boolean, lo long, hi long")
    got = [r[0] for r in df.select(render.alternate_frame(F.col("b"), F.col("seed"), F.col("fps"), F.col("r"), F.col("lo"), F.col("hi"))).collect()]
    assert got == [98, 101, 100, 99]


def test_bitmap(spark):
    rgb = np.arange(2 * 3 * 3, dtype=np.uint8).reshape(2, 3, 3)
    raw = render.bmp(rgb)
    assert raw[:2] == b"BM" and len(raw) == 54 + 2 * 12 and list(raw[54:57]) == [2, 1, 0] and list(raw[66:69]) == [11, 10, 9]
    url = spark.createDataFrame([(raw,)], "c binary").select(render.data_url(F.col("c"))).first()[0]
    assert base64.b64decode(url.removeprefix("data:image/bmp;base64,")) == raw
