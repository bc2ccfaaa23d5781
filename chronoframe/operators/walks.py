"""Many jobs of `schedule` walked in step: the same search and the same numbers as Job.shots, each sum over all jobs at once.

A job has a few dozen shots to weigh in a scene, so that alone it spends its time in calls of numpy. Here a step finds the next
shot of every job; what is tried, weighed and looked ahead to lies in flat arrays, one row per candidate.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from chronoframe.operators import schedule as one

INF = math.inf
TOGETHER, MOST_ACTIONS = 768, 64  # scenes walked at once; actions of one of them


def exp(x: np.ndarray) -> np.ndarray:
    """math.exp of each number: numpy's own may differ from it in the last bit."""
    return np.array(list(map(math.exp, x.ravel().tolist())), dtype=float).reshape(x.shape)


def search(values: np.ndarray, first: np.ndarray, last: np.ndarray, x: np.ndarray, right: bool = False) -> np.ndarray:
    """For each x its place in values[first:last], which is sorted, counted from the start of values."""
    low, high = first.copy(), last.copy()
    if not len(values):
        return low
    for _ in range(int((high - low).max(initial=0)).bit_length()):
        middle = (low + high) >> 1
        v = values[np.minimum(middle, len(values) - 1)]
        before = ((v <= x) if right else (v < x)) & (low < high)
        low, high = np.where(before, middle + 1, low), np.where(before, high, np.minimum(middle, high))
    return low


def thinned(values: np.ndarray, gap: float) -> tuple[np.ndarray, np.ndarray]:
    """Each row sorted (infinite: no value), and which of its values are kept: those not nearer than gap to the last one kept."""
    columns = np.ascontiguousarray(np.sort(values, axis=1).T)
    keep = np.empty(columns.shape, dtype=bool)
    last = np.full(len(values), -INF)
    for v, k in zip(columns, keep, strict=True):
        np.logical_and(v < INF, np.abs(v - last) >= gap, out=k)
        last = np.where(k, v, last)
    return columns.T, keep.T


def runs(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups of these sizes laid end to end: the group of each row and its number in the group."""
    group = np.repeat(np.arange(len(counts)), counts)
    return group, np.arange(len(group)) - np.repeat(np.cumsum(counts) - counts, counts)


def offsets(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def _lists(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    return pc.fill_null(column.value_lengths(), 0).to_numpy(zero_copy_only=False).astype(np.int64), column.flatten()


def _numbers(column: pa.Array) -> np.ndarray:
    return pc.cast(column, pa.float64()).to_numpy(zero_copy_only=False)


def in_step(batch: pa.RecordBatch) -> np.ndarray:
    """Which jobs can be walked in step: up to SCENES scenes of one fragment and few actions each, and every number known and finite."""
    n = batch.num_rows
    good = np.ones(n, dtype=bool)
    for name in ("job", "smart", "long_clip"):
        good &= batch.column(name).is_valid().to_numpy(zero_copy_only=False)
    for name in ("target", "preferred", "rate"):
        x = _numbers(batch.column(name))
        good &= np.isfinite(x) & (x > 0)
    for name in ("bounds", "downbeats"):
        count, values = _lists(batch.column(name))
        good &= np.bincount(np.repeat(np.arange(n), count)[~np.isfinite(_numbers(values))], minlength=n) == 0
        good &= (count > 0) | (name == "downbeats")
    count, scenes = _lists(batch.column("scenes"))
    good &= (count > 0) & (count <= one.SCENES)
    owner = np.repeat(np.arange(n), count)
    if not len(scenes):
        return good
    odd = [owner[~scenes.is_valid().to_numpy(zero_copy_only=False)]]
    field = lambda name: pc.struct_field(scenes, name)
    odd += [owner[~field(name).is_valid().to_numpy(zero_copy_only=False)] for name in ("scene_id", "source_id")]
    odd.append(owner[~np.isfinite(_numbers(field("source_end")))])
    for name in ("fragments", "motion", "actions"):
        inner, values = _lists(field(name))
        whose = np.repeat(owner, inner)
        if name == "fragments":
            odd.append(owner[inner != 1])
            start, duration = (_numbers(pc.struct_field(values, x)) for x in ("start", "duration"))
            odd.append(whose[~((start + duration) - start > 0)])
        if name == "motion":
            times, scene = _numbers(pc.struct_field(values, "time")), np.repeat(np.arange(len(owner)), inner)
            odd.append(whose[1:][(scene[1:] == scene[:-1]) & (times[1:] < times[:-1])])
        if name == "actions":
            odd.append(owner[inner > MOST_ACTIONS])
        odd += [whose[~np.isfinite(_numbers(pc.struct_field(values, f.name)))] for f in values.type]
    good[np.concatenate(odd)] = False
    return good


@dataclass
class Weighed:
    """Candidates without regard to what was shown before, by scene, time, start, end and span; costs in the order they are added."""

    scene: np.ndarray
    start: np.ndarray
    end: np.ndarray
    span: np.ndarray
    duration: np.ndarray
    low: np.ndarray
    high: np.ndarray
    activity: np.ndarray
    moving: np.ndarray
    fresh: np.ndarray | None
    beat: np.ndarray
    costs: list[np.ndarray]


@dataclass
class Tried:
    """Candidates of states, by state, scene, start, end and span: their rows among those weighed, reused shares and scores."""

    state: np.ndarray
    row: np.ndarray
    reused: np.ndarray
    score: np.ndarray
    weighed: Weighed

    def of(self, rows: np.ndarray) -> Tried:
        return Tried(self.state[rows], self.row[rows], self.reused[rows], self.score[rows], self.weighed)


@dataclass
class Last:
    """The shot a state ends with: scene, start, span, times, and its piece in source time."""

    scene: np.ndarray
    start: np.ndarray
    span: np.ndarray
    t0: np.ndarray
    t1: np.ndarray
    low: np.ndarray
    high: np.ndarray


class Walks:
    """Jobs that agree in smart and long_clip, as `in_step` picks them from a batch."""

    def __init__(self, batch: pa.RecordBatch, smart: bool, long_clip: bool) -> None:
        self.smart, self.long_clip = smart, long_clip
        self.slack = 1e-7 if smart else 0.001
        self.jobs = batch.column("job").to_numpy(zero_copy_only=False)
        self.target, self.preferred, self.rate = (_numbers(batch.column(x)) for x in ("target", "preferred", "rate"))
        self._times(batch)
        count, scenes = _lists(batch.column("scenes"))
        self.first, self.count = offsets(count), count
        field = lambda name: pc.struct_field(scenes, name)
        self.scene_id, self.source = (field(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("scene_id", "source_id"))
        self.stop = _numbers(field("source_end"))
        own, rows = _lists(field("fragments"))
        self.a = _numbers(pc.struct_field(rows, "start"))
        self.b = self.a + _numbers(pc.struct_field(rows, "duration"))
        self.length = self.b - self.a
        owner, _ = runs(count)
        # Scenes of one source share what has been used of it; scenes of one source and number are one to the repetition rules.
        self.slot = self._codes(owner, self.source)
        self.ident = self._codes(owner, self.source, self.scene_id)
        self.slots = int(self.slot.max()) + 1
        self.base = np.concatenate([np.cumsum(np.concatenate([[0.0], self.length[i:j]]))[:-1] for i, j in zip(self.first[:-1], self.first[1:], strict=True)])
        self.total = self.base[self.first[1:] - 1] + self.length[self.first[1:] - 1]
        self._motion(*_lists(field("motion")))
        self._actions(*_lists(field("actions")))
        parts = [np.zeros((len(self.a), 1)), self._bins(6) if smart else np.zeros((len(self.a), 0)), self.ranked_starts, self._bins(8) if long_clip else np.zeros((len(self.a), 0))]
        self.starts = np.concatenate(parts, axis=1)

    @staticmethod
    def _codes(owner: np.ndarray, *keys: np.ndarray) -> np.ndarray:
        """Numbers from 0 in each job for the distinct keys of its scenes."""
        _, code = np.unique(np.stack([owner, *keys], axis=1), axis=0, return_inverse=True)
        code = code.ravel()
        least = np.full(int(owner.max()) + 1, len(code))
        np.minimum.at(least, owner, code)
        return code - least[owner]

    def _times(self, batch: pa.RecordBatch) -> None:
        known: dict[bytes, np.ndarray] = {}
        bounds = []
        count, values = _lists(batch.column("bounds"))
        values, at = _numbers(values), offsets(count)
        for i, j in zip(at[:-1], at[1:], strict=True):
            key = values[i:j].tobytes()
            if key not in known:
                known[key] = np.array(one.thinned(values[i:j].tolist(), 0.01), dtype=float)
            bounds.append(known[key])
        self.bounds, self.bounds_at = np.concatenate(bounds), offsets(np.array([len(x) for x in bounds]))
        count, values = _lists(batch.column("downbeats"))
        values = _numbers(values)
        self.beats, self.beats_at = values[np.lexsort((values, np.repeat(np.arange(len(count)), count)))], offsets(count)

    def _motion(self, count: np.ndarray, rows: pa.Array) -> None:
        self.times = _numbers(pc.struct_field(rows, "time"))
        self.values = _numbers(pc.struct_field(rows, "activity")) * _numbers(pc.struct_field(rows, "confidence"))
        self.motion_at = offsets(count)
        capped, active = np.minimum(self.values / 0.18, 1.0), self.values > 0.015
        ranges = list(zip(self.motion_at[:-1].tolist(), self.motion_at[1:].tolist(), strict=True))
        zero = np.zeros(1)
        self.capped = np.concatenate([x for i, j in ranges for x in (zero, np.cumsum(capped[i:j]))])
        # Counts of active samples are whole numbers: sums over all scenes give the same differences.
        self.active = np.insert(np.cumsum(active), self.motion_at[:-1], np.concatenate([[0], np.cumsum(active)])[self.motion_at[:-1]])

    def _actions(self, count: np.ndarray, rows: pa.Array) -> None:
        start, end, peak, activity = (_numbers(pc.struct_field(rows, x)) for x in ("start", "end", "peak", "activity"))
        scene, number = runs(count)
        scenes, most = len(count), int(count.max(initial=0))
        local = lambda t: np.where((t >= self.a[scene]) & (t <= self.b[scene]), t - self.a[scene], INF)
        self.ends, self.local_ends = np.full((scenes, most), -INF), np.full((scenes, most), INF)
        self.ends[scene, number], self.local_ends[scene, number] = end, local(end)
        ranked = np.lexsort((start, -activity, scene))
        self.ranked_starts = np.full((scenes, min(one.ACTIONS, most)), INF)
        first = number < one.ACTIONS
        self.ranked_starts[scene[first], number[first]] = local(start[ranked])[first]
        # A time lies in a part of an action that must not be cut if of those begun before it the one open longest is open still.
        by_start = np.lexsort((start, scene))
        open_until = np.full((scenes, most), -INF)
        open_until[scene, number] = np.minimum(peak + 0.15, end - 0.05)[by_start]
        self.open_until = np.maximum.accumulate(open_until, axis=1)[scene, number] if most else np.zeros(0)
        self.action_starts, self.actions_at = start[by_start], offsets(count)

    def to_source(self, scene: np.ndarray, t: np.ndarray) -> np.ndarray:
        length = self.length[scene]
        return np.where(length + 1e-9 < t, self.stop[scene], self.a[scene] + np.minimum(np.maximum(t, 0.0), length))

    def _bins(self, number: int) -> np.ndarray:
        """As Scene.bins, a row per scene."""
        k = np.arange(number)
        scene, low, high = np.repeat(np.arange(len(self.a)), number), self.length[:, None] * k / number, self.length[:, None] * (k + 1) / number
        i, j = (search(self.times, self.motion_at[scene], self.motion_at[scene + 1], self.to_source(scene, x.ravel())) for x in (low, high))
        part, step = runs(np.maximum(j - i, 0))
        at = i[part] + step
        best = np.full(len(scene), -INF)
        np.maximum.at(best, part, self.values[at])
        last = np.full(len(scene), -1)
        same = self.values[at] == best[part]
        np.maximum.at(last, part[same], at[same])
        t = self.times[np.maximum(last, 0)] if len(self.times) else np.zeros(len(last))
        inside = (last >= 0) & (t >= self.a[scene]) & (t <= self.b[scene])
        return np.maximum(np.where(inside, t - self.a[scene], low.ravel()) - 0.35, low.ravel()).reshape(-1, number)

    def snapped(self, job: np.ndarray, t: np.ndarray) -> np.ndarray:
        first, last = self.bounds_at[job], self.bounds_at[job + 1]
        i = search(self.bounds, first, last, t)
        before, after = self.bounds[np.maximum(i - 1, first)], self.bounds[np.minimum(i, last - 1)]
        return np.minimum(np.where(t - before <= after - t, before, after), self.target[job])

    def _starts(self, state: np.ndarray, scene: np.ndarray, used: np.ndarray, last: Last | None) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of state and scene with the starts worth trying: number of the pair and start."""
        a, b = self.a[scene], self.b[scene]
        cursor, going = a.copy(), np.ones(len(a), dtype=bool)
        own = used[state, self.slot[scene]]
        for k in range(own.shape[1]):
            going &= own[:, k, 0] <= cursor + 0.04
            cursor = np.where(going, np.maximum(cursor, own[:, k, 1]), cursor)
        columns = [self.starts[scene], np.where(cursor < b - 0.04, cursor - a, INF)[:, None]]
        if last is not None:
            on = last.start[state] + last.span[state]
            columns.append(np.where((last.scene[state] == scene) & (on < self.length[scene] - 0.03), on, INF)[:, None])
        v, keep = thinned(np.concatenate(columns, axis=1), 0.03)
        pair, column = np.nonzero(keep)
        start = v[pair, column]
        long = self.length[scene[pair]] - start >= 0.001
        return pair[long], start[long]

    def _ends(self, job: np.ndarray, scene: np.ndarray, start: np.ndarray, time: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As Job.ends: number of the row and end."""
        target, preferred, rate, slack = self.target[job], self.preferred[job], self.rate[job], self.slack
        left, room = target - time, self.length[scene] - start
        most = room / one.SLOWEST
        limit = np.minimum(np.minimum(preferred * 2.5, 6.0), left) if self.smart else left
        hold = np.minimum(np.minimum(preferred * 0.65, self.length[scene] / one.SLOWEST), left) if self.smart else np.zeros(len(job))
        later = self.ends[scene] > self.to_source(scene, start)[:, None]
        rank = np.cumsum(later, axis=1)
        row, action = np.nonzero(later & (rank <= 4))
        after = np.full((len(job), 4), INF)
        after[row, rank[row, action] - 1] = self.local_ends[scene[row], action]
        lengths = np.concatenate([np.stack([preferred * 0.65, preferred, preferred * 1.5, room / rate, left], axis=1), (after - start[:, None]) / rate[:, None]], axis=1)
        lengths = np.where(lengths > 0.04, lengths, INF)
        row, column = np.nonzero(lengths < INF)
        wanted = time[row] + np.minimum(lengths[row, column], np.minimum(np.minimum(most, left), limit)[row])
        end, now = self.snapped(job[row], wanted), time[row]
        if self.smart:
            end = np.where((end <= now + 0.025) | (end - now > np.minimum(limit, most)[row] + slack), wanted, end)
        good = (end > now + 0.025) & (hold[row] - slack <= end - now) & (end - now <= most[row] + slack)
        out = np.full((len(job), lengths.shape[1] + 1), INF)
        out[row[good], column[good]] = end[good]
        out[:, -1] = np.where((left <= most) & (left <= limit), target, INF)
        none = (out == INF).all(axis=1) & (most >= hold - slack)
        out[none, -1] = (time + np.minimum(np.minimum(np.maximum(room / rate, hold), limit), most))[none]
        v, keep = thinned(out, 0.01)
        row, column = np.nonzero(keep)
        return row, v[row, column]

    def _spans(self, job: np.ndarray, scene: np.ndarray, start: np.ndarray, duration: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As Job.spans: number of the row and span."""
        room = self.length[scene] - start
        ends = self.local_ends[scene, :8]
        out = np.concatenate([np.stack([np.minimum(duration * self.rate[job], room), np.minimum(duration, room), np.where(room / duration <= one.FASTEST, room, INF)], axis=1), np.where(ends > start[:, None], ends - start[:, None], INF)], axis=1)
        v, keep = thinned(out, 0.02)
        row, column = np.nonzero(keep)
        x = v[row, column]
        share = x / duration[row]
        good = (x > 1e-6) & (x <= room[row] + 1e-6) & (one.SLOWEST - self.slack <= share) & (share <= one.FASTEST)
        return row[good], x[good]

    def rated(self, job: np.ndarray, time: np.ndarray, used: np.ndarray, last: Last | None, past: np.ndarray) -> Tried:
        """All candidates of each state, scored. used: states x sources x ranges; past: columns of the shots before.

        States of a job that end at the same time mostly have the same starts to try in a scene: those are weighed once.
        """
        state, number = runs(self.count[job])
        scene = self.first[job[state]] + number
        pair, start = self._starts(state, scene, used, last)
        order = np.lexsort((start, time[state[pair]], scene[pair]))
        rows = np.stack([scene[pair], time[state[pair]], start])[:, order]
        fresh = np.concatenate([np.ones(min(len(order), 1), dtype=bool), (rows[:, 1:] != rows[:, :-1]).any(axis=0)])
        same = np.empty(len(order), dtype=np.int64)
        same[order] = np.cumsum(fresh) - 1
        first = order[fresh]
        weighed, count = self._weighed(job[state[pair[first]]], scene[pair[first]], start[first], time[state[pair[first]]])
        at, step = runs(count[same])
        return self._scored(job, time, used, last, past, state, scene, pair[at], (np.cumsum(count) - count)[same[at]] + step, weighed)

    def _weighed(self, job: np.ndarray, scene: np.ndarray, start: np.ndarray, time: np.ndarray) -> tuple[Weighed, np.ndarray]:
        """What can be shown in scenes from starts and times on, and how many candidates each of them has."""
        at, end = self._ends(job, scene, start, time)
        beat = np.where(self._on_beat(job[at], end), 0.3, 0.1)
        row, span = self._spans(job[at], scene[at], start[at], end - time[at])
        begun = search(self.times, self.motion_at[scene], self.motion_at[scene + 1], np.maximum(start, 0.0) + self.a[scene])
        end, beat, of = end[row], beat[row], at[row]
        count = np.bincount(of, minlength=len(job))
        job, c, start, now = job[of], scene[of], start[of], time[of]
        preferred, duration = self.preferred[job], end - now
        low = np.maximum(start, 0.0)
        high = np.minimum(start + span, self.length[c])
        high = np.where(high > low + 1e-9, high, low)
        low, high = low + self.a[c], high + self.a[c]
        i, k = begun[of], search(self.times, self.motion_at[c], self.motion_at[c + 1], high, right=True)
        k = np.where(high > low, np.maximum(i, k), i)
        many = np.maximum(k - i, 1)
        activity, active = (np.where(k > i, (x[k + c] - x[i + c]) / many, 0.0) for x in (self.capped, self.active))
        cut = np.zeros(len(c), dtype=bool)
        if len(self.action_starts):
            t = self.to_source(c, start + span)
            begun = search(self.action_starts, self.actions_at[c], self.actions_at[c + 1], t)
            cut = (begun > self.actions_at[c]) & (self.open_until[np.maximum(begun - 1, 0)] > t)
        length = duration / preferred
        costs = [
            (1.6 if self.smart else 0.6) * np.abs(np.log(length)), 1.5 * (1.0 - active) * np.minimum(length, 2.0), 1.8 * np.abs(np.log(span / duration / self.rate[job])),
            np.where(cut, 0.45 if self.smart else 0.9, 0.0),
        ]
        if self.long_clip:
            costs.append(5.0 * np.abs((self.base[c] + start + span * 0.5) / self.total[job] - (now + duration * 0.5) / self.target[job]))
        fresh = None if self.smart else np.minimum(span / preferred, 2.0)
        return Weighed(c, start, end, span, duration, low, high, activity, 2.5 * activity + 0.9 * active, fresh, beat, costs), count

    def _on_beat(self, job: np.ndarray, end: np.ndarray) -> np.ndarray:
        if not len(self.beats):
            return np.zeros(len(end), dtype=bool)
        i = search(self.beats, self.beats_at[job], self.beats_at[job + 1], end)
        near = lambda at, there: there & (np.abs(self.beats[np.clip(at, 0, len(self.beats) - 1)] - end) < 0.03)
        return near(i - 1, i > self.beats_at[job]) | near(i, i < self.beats_at[job + 1])

    def _scored(self, job, time, used, last, past, state, scene, pair, row, w) -> Tried:  # noqa: PLR0913
        """Scores of the candidates w has in these rows, for the states and scenes of pairs."""
        s, span = state[pair], w.span[row]
        # What has been shown: ranges of the source, and the last time of the scene.
        slot = self.slot[scene]
        own = used[state, slot]
        ranges = (own[:, :, 0] < INF).sum(axis=1)
        covered, rows = np.zeros(len(s)), np.flatnonzero(ranges[pair] > 0)
        low, high = w.low[row], w.high[row]
        for r in range(own.shape[1]):
            rows = rows[ranges[pair[rows]] > r]
            covered[rows] += np.maximum(np.minimum(high[rows], own[pair[rows], r, 1]) - np.maximum(low[rows], own[pair[rows], r, 0]), 0.0)
        reused = np.clip(np.minimum(covered, high - low) / span, 0.0, 1.0)
        seen, held, recent = self._memory(job, state, scene, last, past)
        gain = w.moving[row] + (1.0 - reused if self.smart else (1.0 - reused) * w.fresh[row]) + np.where(np.isnan(seen), 0.65, 0.0)[pair]
        weight = 0.3 if self.long_clip else 2.0 if self.smart else 1.3
        known = np.flatnonzero(~np.isnan(seen))
        again = np.zeros(len(state))
        again[known] = weight * exp(-np.maximum(time[state[known]] - seen[known], 0.0) / (self.preferred[job[state[known]]] * 2.0 if self.smart else 4.0))
        cost = again[pair]
        if last is not None and not self.smart:
            goes_on = (last.scene[s] == scene[pair]) & (np.abs((last.start + last.span)[s] - w.start[row]) < 0.03)
            gain = gain + np.where(goes_on, 0.3 if self.long_clip else 1.1, 0.0)
            cost = np.where(goes_on, 0.0, cost)
        gain = gain + w.beat[row]
        rows = np.flatnonzero(reused > 0)
        if len(rows):
            window = np.minimum(np.maximum(self.preferred[job] * 3.0, 2.0), 5.0) if self.smart else np.full(len(job), one.RECURRENCE)
            repeat = (4.0 if self.smart else 8.0) / (1.0 + exp(np.minimum((time - window) / 1.5, 700.0)))
            replay = np.zeros(len(rows))
            of, low, high = s[rows], low[rows], high[rows]
            own_slot, most = slot[pair[rows]], high - low
            for t1, from_slot, piece_low, piece_high, there in recent:
                fading = np.where(there, 4.0 * exp(-np.maximum(time - t1, 0.0) / window), 0.0)
                meets = np.flatnonzero(own_slot == from_slot[of])
                mine = of[meets]
                shown = np.minimum(high[meets], piece_high[mine]) - np.maximum(low[meets], piece_low[mine])
                replay[meets] = np.maximum(replay[meets], np.where(np.minimum(shown, most[meets]) > 0.001, fading[mine], 0.0))
            cost[rows] = reused[rows] * (((3.0 if self.smart else 4.0) + repeat)[of] + replay) + cost[rows]
        for more in w.costs:
            cost = cost + more[row]
        if self.smart:
            cost = cost + np.maximum((held[pair] + w.duration[row]) / self.preferred[job][s] - 1.5, 0.0) * 1.4
        return Tried(s, row, reused, gain - cost, w)

    def _memory(self, job: np.ndarray, state: np.ndarray, scene: np.ndarray, last: Last | None, past: np.ndarray):
        """Of each pair when the scene ended last (nan: not lately) and how long it has been held; of each state its recent shots."""
        seen, held = np.full(len(state), math.nan), np.zeros(len(state))
        if last is None:
            return seen, held, []
        recent, total, runs_on = [], last.t1 - last.t0, np.ones(len(job), dtype=bool)
        shown = self.ident[last.scene]
        for k in past[::-1]:
            h = self.history[:, k][:, job]
            there = last.t1 - h[4] < 2 * one.RECURRENCE
            number = h[0].astype(np.int64)
            runs_on &= there & (self.ident[number] == shown)
            total = np.where(runs_on, total + (h[4] - h[3]), total)
            recent.append((h[4], self.slot[number], h[5], h[6], there & (h[6] > h[5]), self.ident[number]))
        recent.insert(0, (last.t1, self.slot[last.scene], last.low, last.high, last.high > last.low, shown))
        ident = self.ident[scene]
        for n, (t1, _, _, _, _, whose) in reversed(list(enumerate(recent))):
            lately = (last.t1 - t1 < 2 * one.RECURRENCE) | (n == 0)
            seen = np.where(lately[state] & (whose[state] == ident), t1[state], seen)
        held = np.where(shown[state] == ident, total[state], 0.0)
        return seen, held, [r[:5] for r in recent]

    def _used(self, used: np.ndarray, slot: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """used with one more range in a source of each row; ranges that touch become one."""
        rows = np.arange(len(used))
        new = np.stack([low, np.where(high > low, high, INF)], axis=1)
        new[~(high > low)] = INF
        ranges = np.concatenate([used[rows, slot], new[:, None]], axis=1)
        ranges = np.take_along_axis(ranges, np.argsort(ranges[:, :, 0], axis=1, kind="stable")[:, :, None], axis=1)
        out = np.full(ranges.shape, INF)
        at = np.full(len(used), -1)
        end = np.full(len(used), -INF)
        for k in range(ranges.shape[1]):
            a, b = ranges[:, k, 0], ranges[:, k, 1]
            there = a < INF
            joins = there & (a <= end + 1e-7)
            end = np.where(joins, np.maximum(end, b), np.where(there, b, end))
            at = at + (there & ~joins)
            opened = there & ~joins
            out[rows[opened], at[opened], 0] = a[opened]
            out[rows[there], at[there], 1] = end[there]
        grown = out[:, : int(at.max(initial=-1)) + 1]
        if grown.shape[1] > used.shape[2]:
            used = np.concatenate([used, np.full((*used.shape[:2], grown.shape[1] - used.shape[2], 2), INF)], axis=2)
        else:
            used = used.copy()
        used[rows, slot] = INF
        used[rows, slot, : grown.shape[1]] = grown
        return used

    def shots(self) -> list[np.ndarray]:
        """Columns of all shots: place of the job, idx, scene, start, span, t0, t1, reused, activity, score."""
        jobs = len(self.jobs)
        self.history = np.zeros((7, 16, jobs))
        out: list[list[np.ndarray]] = []
        walking, time, n = np.arange(jobs), np.zeros(jobs), 0
        walking = walking[time < self.target - 1e-7]
        used = np.full((len(walking), self.slots, 0, 2), INF)
        known = self.rated(walking, time[walking], used, None, np.zeros(0, dtype=np.int64))
        while len(walking):
            order = np.lexsort((-known.score, known.state))
            kept = known.of(order[runs(np.bincount(known.state, minlength=len(walking)))[1] < one.KEPT])
            if len(np.unique(kept.state)) < len(walking):
                raise ValueError("no valid shot can follow")
            if n >= one.MOST_SHOTS:
                raise ValueError("too many shots")
            w, row = kept.weighed, kept.row
            scene, start, span, end = w.scene[row], w.start[row], w.span[row], w.end[row]
            job, a = walking[kept.state], self.a[scene]
            low, high = np.maximum(start, 0.0), np.minimum(start + span, self.length[scene])
            high = np.where(high > low + 1e-9, high, low)
            last = Last(scene, start, span, time[job], end, a + low, a + high)
            after = self._used(used[kept.state], self.slot[scene], last.low, last.high)
            # Shots before the earliest that any state can still recall are of no account to all of them.
            lately = (last.t1[None, :] - self.history[4, :n][:, job] < 2 * one.RECURRENCE).any(axis=1)
            goes_on = np.flatnonzero(end < self.target[job] - 1e-7)
            mine = Last(*(x[goes_on] for x in vars(last).values()))
            follow = self.rated(job[goes_on], end[goes_on], after[goes_on], mine, np.flatnonzero(lately))
            best = np.full(len(goes_on), -INF)
            np.maximum.at(best, follow.state, follow.score)
            ahead = np.zeros(len(job))
            ahead[goes_on] = np.where(best == -INF, -8.0, best)
            ahead[end >= self.target[job] - 0.025] = 0.0
            chosen = np.lexsort((-(kept.score + 0.35 * ahead), kept.state))
            chosen = chosen[np.concatenate([[True], np.diff(kept.state[chosen]) > 0])]
            job = walking
            if n == self.history.shape[1]:
                self.history = np.concatenate([self.history, np.zeros_like(self.history)], axis=1)
            for i, x in enumerate(vars(last).values()):
                self.history[i, n, job] = x[chosen]
            out.append([job, np.full(len(job), n), *(x[chosen] for x in (scene, start, span, last.t0, last.t1, kept.reused, w.activity[row], kept.score))])
            time[job] = end[chosen]
            n += 1
            on = time[job] < self.target[job] - 1e-7
            walking, used = job[on], after[chosen[on]]
            # What was looked ahead to behind the chosen shots is what the next step tries.
            place = np.full(len(goes_on), -1)
            at = np.full(len(kept.state), -1)
            at[goes_on] = np.arange(len(goes_on))
            place[at[chosen[on]]] = np.arange(len(walking))
            known = follow.of(np.flatnonzero(place[follow.state] >= 0)) if len(goes_on) else follow
            known.state = place[known.state]
        return [np.concatenate(x) for x in zip(*out, strict=True)]


def columns(batch: pa.RecordBatch, smart: bool, long_clip: bool) -> list[np.ndarray]:
    """The columns of `schedule` for jobs that agree in smart and long_clip; each job's shots in order."""
    w = Walks(batch, smart, long_clip)
    made = w.shots()
    job, idx, scene = made[:3]
    order = np.lexsort((idx, job))
    return [x[order] for x in (w.jobs[job], idx, w.scene_id[scene], w.source[scene], *made[3:])]


def alone(batch: pa.RecordBatch) -> list[list]:
    """The same columns for any jobs, one after the other."""
    rows = []
    for r in batch.to_pylist():
        job = one.job_of(r)
        for i, s in enumerate(job.shots()):
            own = job.scenes[s.scene]
            rows.append((r["job"], i, own.scene_id, own.source, s.start, s.span, s.t0, s.t1, s.reused, s.activity, s.score))
    return [[row[i] for row in rows] for i in range(11)]


def walked(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The shots of all jobs of a batch: in step where that can be done, about as many scenes at once as fit a task easily."""
    names = [x.split()[0] for x in one.SHOTS.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), *[pa.float64()] * 7]
    made = lambda found: pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(found, kinds, strict=True)], names=names)
    if not batch.num_rows:
        return
    fit = in_step(batch)
    if not fit.all():
        yield made(alone(batch.filter(pa.array(~fit))))
    for smart in (True, False):
        for long_clip in (True, False):
            flags = [pc.equal(batch.column(name), pa.scalar(x)) for name, x in (("smart", smart), ("long_clip", long_clip))]
            mine = batch.filter(pc.and_(pa.array(fit), pc.fill_null(pc.and_(*flags), False)))
            if not mine.num_rows:
                continue
            part = np.cumsum(mine.column("scenes").value_lengths().to_numpy(zero_copy_only=False)) // TOGETHER
            at = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), mine.num_rows]
            for i, j in zip(at, at[1:], strict=False):
                yield made(columns(mine.slice(i, j - i), smart, long_clip))
