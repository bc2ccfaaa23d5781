import numpy as np
import pytest

from chronoframe.operators import planning


def grid(seed, seconds=None):
    """Beats of a made-up song: a tempo by the seed, each beat off by a little; every third one is strong."""
    rng = np.random.default_rng(seed)
    step = rng.uniform(0.25, 1.1)
    target = seconds or float(rng.uniform(6, 40))
    beats = (np.arange(1, int(target / step) + 1) * step + rng.normal(0, 0.01, int(target / step))).round(3)
    beats = sorted(b for b in beats.tolist() if 0 < b < target)
    return beats, beats[2::3], target


def slow_loops(rows, rate, total):
    """How often the source is used up, by the time that segments take of it."""
    return int((sum(rate * (r[2] - r[1]) for r in rows) + 1e-6) // total)


@pytest.mark.parametrize("style", ["HARD", "SMOOTH", "HYBRID"])
@pytest.mark.parametrize("seed", range(6))
def test_plans_follow_on_and_stay_in_their_source(style, seed):
    beats, strong, target = grid(seed)
    video = target * (0.2 + 0.3 * seed)
    walk = planning.walked(beats, strong, target, video, 24, style)
    rows, total = walk.rows, min(video, target + 2.0)
    assert rows[0][1] == 0.0 and rows[-1][2] == pytest.approx(target, abs=1e-9)
    assert all(a[2] == pytest.approx(b[1], abs=1e-9) for a, b in zip(rows, rows[1:], strict=False))
    assert all(0 <= min(r[3], r[4]) and max(r[3], r[4]) <= total + 0.001 for r in rows)
    bounds = planning.merged_bounds(beats, target, 24, style)
    assert all(b - a >= 3 / 24 - 1e-9 for a, b in zip(bounds, bounds[1:], strict=False)) and set(bounds) <= {r[1] for r in rows} | {target}
    if style != "HYBRID":
        assert sum(walk.loops) == slow_loops(rows, 0.75 if style == "SMOOTH" else 1.0, total)
    assert any(r[6] for r in rows) == (style != "SMOOTH" and len(strong) > 0) and all((r[4] < r[3]) == r[6] for r in rows if r[3] != r[4])


def test_loops_count_where_the_source_is_used_up_and_nothing_else():
    assert sum(planning.walked([1.0, 2.0, 3.0], [], 8.0, 2.0, 16, "HARD").loops) == 4  # the last just at the end
    assert sum(planning.walked([], [], 7.9, 2.0, 16, "HARD").loops) == 3
    beats, strong, target = grid(3, 20.0)
    scenes = [i * 100.0 for i in range(7)]
    ample = planning.walked(beats, strong, target, 600.0, 16, "HARD", "scenepack", scenes)
    assert any(r[7] for r in ample.rows) and sum(ample.loops) == 0  # switches are no loops
    assert sum(planning.walked(beats, strong, target, 6.0, 16, "HARD", "scenepack", [0, 1, 2, 3, 4, 5, 6], "slow").loops) > 0


@pytest.mark.parametrize("seed", range(4))
def test_scenes_switch_on_beats(seed):
    beats, strong, target = grid(seed)
    jumps = {}
    for rhythm in ("fast", "mid", "slow"):
        rows = planning.segments(beats, strong, target, 900.0, 24, "HARD", "scenepack", [i * 90.0 for i in range(11)], rhythm)
        at = [b[1] for a, b in zip(rows, rows[1:], strict=False) if a[8] != b[8]]
        assert all(min(abs(t - x) for x in beats) < 0.03 for t in at)
        jumps[rhythm] = len(at)
    assert jumps["fast"] >= jumps["mid"] >= jumps["slow"] and jumps["fast"] > jumps["slow"]


@pytest.mark.parametrize("last", [False, True])
def test_plans_of_one_or_two_segments(last):
    for duration in np.geomspace(0.07, 3.0, 5).tolist():
        rows = planning.segments([duration * 0.99] if last else [], [], duration, 5.0, 16, "HARD")
        assert rows[0][1] == 0.0 and rows[-1][2] == duration


def test_sources_of_modes():
    assert planning.source_intervals("no_change", 44.0, 5.5, None) == [(0.0, 7.5)]
    assert planning.source_intervals("scenepack", 44.0, 5.5, [-3, 11, 90, 8]) == [(0, 11), (11, 33.0)]
    for video, audio in ((90.0, 21.0), (400.0, 3.0), (31.0, 30.0)):
        clips = planning.source_intervals("long_clip", video, audio, None)
        assert 2 <= len(clips) <= 8 and clips[0][0] == 0 and clips[-1][0] == pytest.approx(video - 3.5) and sum(clips[-1]) == pytest.approx(video)
    with pytest.raises(ValueError):
        planning.segments([], [], 4.0, 0.0, 16, "HARD")


def test_a_row_per_plan_gives_the_same_rows_however_dealt(spark):
    beats, strong, target = grid(1)
    walk = planning.walked(beats, strong, target, target / 3, 16, "HARD")
    plans = spark.createDataFrame([(i, "HARD", 16, target, target / 3, "no_change", "mid", beats, strong, None) for i in range(5)], "plan_id long, style string, fps int, target double, video double, mode string, rhythm string, beats array<double>, downbeats array<double>, scenes array<double>")
    for n in (1, 4):
        got = planning.plan(plans.repartition(n)).orderBy("plan_id", "idx").collect()
        assert [tuple(r)[1:-1] for r in got] == walk.rows * 5 and sum(r["loops"] for r in got) == 5 * sum(walk.loops)
