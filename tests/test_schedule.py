import numpy as np
import pytest

from chronoframe.operators import schedule


def scene(number, duration, moving, fragments=None):
    times = np.arange(0, duration, 1 / 12)
    values = np.full(len(times), 0.27 if moving else 0.0)
    actions = np.array([[0.0, duration, 0.6 * duration, 0.27]]) if moving else np.zeros((0, 4))
    return schedule.Scene(number, number, np.array([[number, a, b] for a, b in fragments or [(0.0, duration)]], dtype=float), times, values, actions, duration)


def job(smart, scenes=None, target=19.3, preferred=2.0):
    beats = np.array([0.48 * i for i in range(1, int(target / 0.48))] + [target])
    return schedule.Job(scenes or [scene(0, 4.3, True), scene(1, 5.7, True), scene(2, 3.6, False)], beats, beats[3::4], target, preferred, 1.0, smart)


@pytest.mark.parametrize("smart", [True, False])
def test_shots_cover_the_output_at_fair_speeds(smart):
    shots = job(smart).shots()
    assert shots[0].t0 == 0.0 and shots[-1].t1 == pytest.approx(19.3, abs=1e-6)
    assert all(a.t1 == b.t0 for a, b in zip(shots, shots[1:], strict=False))
    assert all(0.67 - 1e-2 <= s.span / (s.t1 - s.t0) <= 1.5 + 1e-9 for s in shots)
    assert [(s.scene, s.start, s.t1) for s in job(smart).shots()] == [(s.scene, s.start, s.t1) for s in shots]


def test_fresh_before_replay():
    shots = job(True).shots()
    assert all(s.reused < 0.5 for s in shots[:3]) and any(s.reused > 0.5 for s in shots)


def test_no_shot_shows_a_gap():
    gapped = scene(0, 6.0, True, [(0.0, 2.0), (3.0, 6.0)])
    for s in job(False, [gapped], target=8.0).shots():
        for _, a, b in s.pieces:
            assert (a >= 0.0 and b <= 2.0 + 1e-9) or (a >= 3.0 - 1e-9 and b <= 6.0 + 1e-9)


def test_scene_times():
    s = scene(0, 6.0, False, [(0.0, 2.0), (3.0, 6.0)])
    assert s.duration == 5.0 and s.to_source(2.5) == 3.5 and s.to_local(3.5) == 2.5 and s.to_local(2.5) is None
    assert s.pieces(1.5, 1.0).tolist() == [[0, 1.5, 2.0], [0, 3.0, 3.5]]
    assert s.first_unused(np.array([[0, 0.0, 2.0], [0, 3.0, 4.0]])) == 3.0 and s.first_unused(np.array([[0, 0.0, 6.0]])) is None


def test_arrays_score_as_single_pieces():
    s = scene(0, 6.0, True, [(0.0, 2.0), (3.0, 6.0)])
    used = np.array([[0, 0.5, 3.5], [0, 5.0, 5.5], [1, 0.0, 9.0]])
    starts, spans = np.array([0.0, 1.5, 2.2, 4.0]), np.array([1.0, 1.0, 2.0, 1.0])
    low, high = s.stretch(starts, spans)
    assert s.covered(low, high, used) == pytest.approx([schedule.taken(s.pieces(a, b), used) for a, b in zip(starts, spans, strict=True)])
    mean, active = s.activities(low, high)
    for i, (a, b) in enumerate(zip(starts, spans, strict=True)):
        assert (mean[i], active[i]) == pytest.approx(s.activity(a, b))
    assert s.to_sources(starts) == pytest.approx([s.to_source(t) for t in starts])


def test_shots_become_segments_that_only_go_on():
    j = job(True)
    shots = j.shots()
    template = [{"t0": t, "t1": t + 0.96, "curve": "saddle", "reverse": False} for t in np.arange(0, 19.3, 0.96).tolist()]
    rows = j.materialised(shots, template)
    assert rows[0]["t0"] == 0.0 and rows[-1]["t1"] == pytest.approx(19.3)
    assert all(a["t1"] == pytest.approx(b["t0"], abs=1e-9) for a, b in zip(rows, rows[1:], strict=False))
    assert all(r["s1"] >= r["s0"] - 1e-9 and 0.0 <= r["strength"] <= 0.85 for r in rows)


def test_segments_of_a_plan_become_shots():
    shots = job(False).from_segments([(0.0, 1.0, 0.0, 1.0), (1.0, 2.0, 1.0, 2.0), (2.0, 3.0, 5.0, 6.0)])
    assert [(s.scene, s.t0, s.t1) for s in shots] == [(0, 0.0, 2.0), (1, 2.0, 3.0)]


def test_jobs_in_spark(spark):
    scenes = [{"scene_id": i, "source_id": i, "source_end": 5.0, "fragments": [{"start": 0.0, "duration": 5.0}], "motion": [{"time": k / 12, "activity": 0.3, "confidence": 0.9} for k in range(60)], "actions": []} for i in range(2)]
    kind = "scenes array<struct<scene_id:int,source_id:int,source_end:double,fragments:array<struct<start:double,duration:double>>,motion:array<struct<time:double,activity:double,confidence:double>>,actions:array<struct<start:double,end:double,peak:double,activity:double>>>>"
    jobs = spark.createDataFrame([(k, 6.0, 2.0, 1.0, True, False, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0], [2.0], scenes) for k in (1, 2)], f"job long, target double, preferred double, rate double, smart boolean, long_clip boolean, bounds array<double>, downbeats array<double>, {kind}")
    got = schedule.schedule(jobs).orderBy("job", "idx").collect()
    assert [tuple(r)[1:] for r in got if r["job"] == 1] == [tuple(r)[1:] for r in got if r["job"] == 2]
    assert [r["t1"] for r in got if r["job"] == 1][-1] == 6.0


def test_jobs_have_all_scenes_of_a_long_timeline(spark, monkeypatch):
    from chronoframe.plans import plan_queries

    rows = [(tid, float(t), 0.5, 0.9) for tid, end in ((1, 600), (2, 1300)) for t in range(0, end, 5)]
    monkeypatch.setattr(plan_queries, "motion", lambda spark, sf_dir: spark.createDataFrame(rows, "tid long, t double, activity double, confidence double"))
    jobs = {r["job"]: r["scenes"] for r in plan_queries._jobs(spark, "", False).collect()}
    assert [len(jobs[1]), len(jobs[2])] == [3, 6]
    assert sum(len(s["motion"]) for s in jobs[2]) == 260


@pytest.mark.parametrize("smart", [True, False])
def test_nothing_is_tried_twice(smart, monkeypatch):
    seen, ends = [], schedule.Job.ends
    monkeypatch.setattr(schedule.Job, "ends", lambda self, s, start, time: seen.append((s.scene_id, start, time)) or ends(self, s, start, time))
    assert job(smart).shots() and len(seen) == len(set(seen))


def test_few_rows_are_dealt_to_all_cores(spark):
    kind = "scenes array<struct<scene_id:int,source_id:int,source_end:double,fragments:array<struct<start:double,duration:double>>,motion:array<struct<time:double,activity:double,confidence:double>>,actions:array<struct<start:double,end:double,peak:double,activity:double>>>>"
    rows = spark.createDataFrame([], f"job long, target double, preferred double, rate double, smart boolean, long_clip boolean, bounds array<double>, downbeats array<double>, {kind}").coalesce(1)
    assert schedule.schedule(rows).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
