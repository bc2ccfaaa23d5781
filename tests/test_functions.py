import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chronoframe.functions import curves as cv
from chronoframe.functions import numbers as nb
from chronoframe.functions import text as tx


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first()["x"]


def slow_hash(t, salt):
    m = (1 << 64) - 1
    h = (int(math.copysign(math.floor(abs(t * 10000) + 0.5), t)) & m) ^ nb.HASH_START ^ salt
    h = (h * nb.HASH_FIRST + 1) & m
    h ^= h >> 33
    h = h * nb.HASH_SECOND & m
    return h ^ (h >> 28)


def test_hash_wraps_as_64_bits(spark):
    rows = [(float(t), s) for t in (0.0, 0.1, -0.125, 14.315, 86400.0) for s in (0, 100, 999, 2**40)]
    df = spark.createDataFrame(rows, "t double, s long").withColumn("h", nb.position_hash(F.col("t"), F.col("s")))
    for r in df.select("*", nb.unsigned_mod(F.col("h"), 97).alias("m")).collect():
        assert r["h"] & ((1 << 64) - 1) == slow_hash(r["t"], r["s"]) and r["m"] == slow_hash(r["t"], r["s"]) % 97


@settings(max_examples=15, deadline=None)
@given(st.integers(0, 2**32 - 1))
def test_seeds_wrap_as_32_bits(spark, seed):
    v = seed
    v ^= v >> 16
    v = v * 0x7FEB352D & 0xFFFFFFFF
    v ^= v >> 15
    v = v * 0x846CA68B & 0xFFFFFFFF
    v ^= v >> 16
    assert one(spark, nb.lcg(F.lit(seed))) == (seed * 1664525 + 1013904223) % 2**32
    assert one(spark, nb.mix32(F.lit(seed))) == v


def test_rounding_goes_away_from_zero(spark):
    assert [one(spark, nb.half_up(F.lit(x))) for x in (0.5, -0.5, 1.4, -1.6)] == [1.0, -1.0, 1.0, -2.0]
    assert math.copysign(1, one(spark, nb.to_places(F.lit(-1e-9), 3))) == 1.0


def test_curves_rise(spark):
    xs = [i / 200 for i in range(201)]
    df = spark.createDataFrame([(x,) for x in xs], "x double").orderBy("x")
    for name, strict in (("snap", True), ("saddle", False), ("linear", True)):
        got = [r[0] for r in df.select(cv.curve(F.lit(name), F.col("x"))).collect()]
        assert got[0] == 0.0 and got[-1] == 1.0 and all(b > a if strict else b >= a for a, b in zip(got, got[1:], strict=False))


def test_shake_envelope_at_its_corners(spark):
    f = 1 / 16
    for t, y in ((0, 0), (2 * f, 1), (1, 1), (2 - 2 * f, 1), (2, 0)):
        assert one(spark, cv.shake_envelope(F.lit(float(t)), F.lit(2.0), F.lit(16.0))) == pytest.approx(y)


def test_squish_limits(spark):
    x, y = cv.squish(F.lit(1.0), F.lit(0.7), F.lit(1.3))
    assert (one(spark, x), one(spark, y)) == (pytest.approx(1.3), pytest.approx(0.7))
    x, y = cv.squish(F.lit(1.0), F.lit(1.0), F.lit(1.0))
    assert (one(spark, x), one(spark, y)) == (1.0, 1.0)


def test_output_sizes(spark):
    for w, h, out in ((1080, 1080, (1080, 1080)), (16, 9, (1920, 1080)), (9, 16, (1080, 1920)), (1, 1, (1080, 1080)), (321, 201, (320, 200))):
        r = one(spark, cv.output_size(F.lit(w), F.lit(h)))
        assert (r["out_w"], r["out_h"]) == out


def test_inverse_undoes_a_curve(spark):
    for name in ("snap", "saddle", "linear"):
        for value in (0.0, 0.2, 0.77, 1.0):
            p = one(spark, cv.inverse_curve(F.lit(name), F.lit(value), F.lit(1.0)))
            assert one(spark, cv.curve(F.lit(name), F.lit(p))) == pytest.approx(value, abs=1e-9)


def test_neutral_remap_is_the_plain_curve(spark):
    none = F.lit(None).cast("double")
    value, slope = cv.remapped(F.lit("saddle"), F.lit(0.3), none, none, none)
    assert one(spark, value) == pytest.approx(0.216) and one(spark, slope) == pytest.approx(1.26)


def test_mirrors(spark):
    assert [one(spark, cv.edge_mirror(F.lit(c), F.lit(4))) for c in (-5, -1, 0, 3, 4, 5, 9)] == [2, 1, 0, 3, 3, 2, 0]
    assert [one(spark, cv.periodic_mirror(F.lit(c), F.lit(4))) for c in (-1, 0, 3, 4, 6, 7)] == [1, 0, 3, 2, 0, 1]


def test_text_rules(spark):
    assert one(spark, tx.metadata_value(F.lit("x score:0.25 y"), "score:")) == 0.25
    assert one(spark, tx.metadata_value(F.lit("x score:nan y"), "score:")) is None and one(spark, tx.metadata_value(F.lit("nothing"), "score:")) is None
    assert tuple(one(spark, tx.hex_colour(F.lit("#80FF0010")))) == (255, 0, 16) and tuple(one(spark, tx.hex_colour(F.lit("#12345")))) == (255, 255, 255)
    assert [one(spark, tx.clock(F.lit(x))) for x in (0.0, 61.25, 600.0)] == ["0:00.0", "1:01.2", "10:00.0"]
    assert one(spark, tx.valid_export(F.lit("h.264"), F.lit("webm"), F.lit(8))) is False and one(spark, tx.valid_export(F.lit("vp9"), F.lit("webm"), F.lit(8))) is True
    assert one(spark, tx.cache_key(F.lit("a|b"), F.lit("c"))) != one(spark, tx.cache_key(F.lit("a"), F.lit("b|c")))
    assert one(spark, tx.policy(F.lit("scenepack"), F.lit(None).cast("boolean"), F.lit(None).cast("boolean"))) == "no_repeat"
    assert one(spark, tx.policy(F.lit("scenepack"), F.lit(False), F.lit(False))) == "classic" and one(spark, tx.policy(F.lit("long_clip"), F.lit(False), F.lit(True))) == "no_repeat"
    assert one(spark, tx.number_or(F.lit('{"a": "x"}'), "$.a", 0.5)) == 0.5
