import random
import time

import numpy as np
import pyarrow as pa
import pytest

from chronoframe.operators import schedule, walks

NUMBERS = pa.list_(pa.float64())
SCENES = pa.list_(
    pa.struct({
        "scene_id": pa.int32(), "source_id": pa.int32(), "source_end": pa.float64(), "fragments": pa.list_(pa.struct({"start": pa.float64(), "duration": pa.float64()})),
        "motion": pa.list_(pa.struct({"time": pa.float64(), "activity": pa.float64(), "confidence": pa.float64()})), "actions": pa.list_(pa.struct({"start": pa.float64(), "end": pa.float64(), "peak": pa.float64(), "activity": pa.float64()})),
    })
)
JOBS = pa.schema({"job": pa.int64(), "target": pa.float64(), "preferred": pa.float64(), "rate": pa.float64(), "smart": pa.bool_(), "long_clip": pa.bool_(), "bounds": NUMBERS, "downbeats": NUMBERS, "scenes": SCENES})


def scene(r, number, source, at, duration, fragments=1):
    """A scene with actions and motion, some of them outside of it."""
    times = sorted(at + r.uniform(-1.0, duration + 1.0) for _ in range(r.choice([0, 1, 8, 40])))
    begun = sorted(at + r.uniform(-0.5, duration) for _ in range(r.choice([0, 1, 5, 11])))
    ends = [b + r.uniform(0.1, duration / 2) for b in begun]
    part = duration / fragments
    return {
        "scene_id": number, "source_id": source, "source_end": at + duration, "fragments": [{"start": at + 2 * part * k, "duration": part} for k in range(fragments)],
        "motion": [{"time": t, "activity": round(r.random(), 1), "confidence": round(r.random(), 1)} for t in times] or None,
        "actions": [{"start": b, "end": e, "peak": b + (e - b) * r.random(), "activity": round(r.random(), 1)} for b, e in zip(begun, ends, strict=True)],
    }


def jobs(n, seed, smart, long_clip, fragments=1):
    r = random.Random(seed)
    rows = []
    for k in range(n):
        target = r.choice([1.0, 7.3, 30.0, 45.0])
        # Scenes of one source overlap, and some have the same number too.
        scenes = [scene(r, r.choice([i, 0]), r.choice([i, 0]), r.uniform(0, 30), r.uniform(4.0, 40.0), fragments) for i in range(r.randint(1, 5))]
        step = r.choice([0.3, 0.48, 0.5, 2.0])
        beats = [step * i for i in range(1, int(target / step))] + [target]
        rows.append({"job": k * 7, "target": target, "preferred": r.choice([0.8, 2.0, 3.1]), "rate": r.choice([1.0, 0.9, 1.2]), "smart": smart, "long_clip": long_clip, "bounds": beats, "downbeats": r.sample(beats, len(beats) // 3), "scenes": scenes})
    return pa.RecordBatch.from_pylist(rows, schema=JOBS)


def by_job(found):
    out = {}
    for row in zip(*(x if isinstance(x, list) else x.tolist() for x in found), strict=True):
        out.setdefault(row[0], []).append(row[1:])
    return out


def rows_of(batches):
    return by_job([sum((b.column(i).to_pylist() for b in batches), []) for i in range(11)])


@pytest.mark.parametrize("smart", [True, False])
@pytest.mark.parametrize("long_clip", [True, False])
def test_jobs_in_step_have_the_shots_of_jobs_alone(smart, long_clip):
    batch = jobs(30, 3, smart, long_clip)
    can = []
    for k in range(batch.num_rows):
        try:
            can.append(walks.alone(batch.slice(k, 1)) and k)
        except ValueError:
            with pytest.raises(ValueError, match="no valid shot can follow"):
                walks.columns(batch.slice(k, 1), smart, long_clip)
    assert len(can) > 15
    batch = batch.take(pa.array(can))
    assert walks.in_step(batch).all()
    assert by_job(walks.columns(batch, smart, long_clip)) == by_job(walks.alone(batch))


def test_every_job_of_a_batch_is_walked(monkeypatch):
    parts = [jobs(6, seed, smart, False, fragments).to_pylist() for seed, smart, fragments in ((1, True, 1), (2, False, 1), (5, True, 2))]
    rows = []
    for r in sum(parts, []):
        try:
            schedule.job_of(r).shots()
        except ValueError:
            continue
        rows.append(r | {"job": len(rows)})
    batch = pa.RecordBatch.from_pylist(rows, schema=JOBS)
    fit = walks.in_step(batch)
    assert fit.any() and not fit.all()
    expected = by_job(walks.alone(batch))
    monkeypatch.setattr(walks, "TOGETHER", 5)
    assert rows_of(list(walks.walked(batch))) == expected and len(expected) == len(rows)


@pytest.mark.parametrize("field", ["motion", "actions"])
def test_jobs_with_unknown_numbers_are_not_walked_in_step(field):
    rows = jobs(40, 4, True, False).to_pylist()
    broken = next(i for i, r in enumerate(rows) if any(s[field] for s in r["scenes"]))
    next(s for s in rows[broken]["scenes"] if s[field])[field][0]["activity"] = None
    assert np.flatnonzero(~walks.in_step(pa.RecordBatch.from_pylist(rows, schema=JOBS))).tolist() == [broken]


def test_jobs_with_motion_out_of_order_are_not_walked_in_step():
    rows = jobs(40, 4, True, False).to_pylist()
    broken = next(i for i, r in enumerate(rows) if any(s["motion"] and len(s["motion"]) > 1 for s in r["scenes"]))
    next(s for s in rows[broken]["scenes"] if s["motion"] and len(s["motion"]) > 1)["motion"].reverse()
    assert np.flatnonzero(~walks.in_step(pa.RecordBatch.from_pylist(rows, schema=JOBS))).tolist() == [broken]


def test_no_job_and_no_scene():
    assert list(walks.walked(jobs(1, 1, True, False).slice(0, 0))) == []
    rows = jobs(2, 1, True, False).to_pylist()
    rows[1]["scenes"] = []
    assert walks.in_step(pa.RecordBatch.from_pylist(rows, schema=JOBS)).tolist() == [True, False]


def test_jobs_in_step_take_a_fraction_of_the_time():
    r = random.Random(9)
    rows = [jobs(1, 0, True, False).to_pylist()[0] | {"job": k, "target": 30.0, "preferred": 2.3, "bounds": [0.5 * i for i in range(1, 61)], "scenes": [scene(r, i, i, 50.0 * i, 40.0) for i in range(3)]} for k in range(80)]
    batch = pa.RecordBatch.from_pylist(rows, schema=JOBS)
    took = time.process_time()
    alone = walks.alone(batch.slice(0, 8))
    took, began = time.process_time() - took, time.process_time()
    together = rows_of(list(walks.walked(batch)))
    assert (time.process_time() - began) / 80 < took / 8 / 3
    assert {k: together[k] for k in range(8)} == by_job(alone)
