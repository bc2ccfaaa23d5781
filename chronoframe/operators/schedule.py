"""Shots by scored search: which part of which scene is shown when. A row per job in, a row per shot out.

Each step lists the starts, ends and lengths worth trying in the best scenes as arrays, scores them all at once, keeps the
best six and looks one shot ahead. A job is one walk; jobs are the unit of parallelism.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SLOWEST, FASTEST = 0.67, 1.5
RECURRENCE = 8.0
SCENES, ACTIONS, KEPT, MOST_SHOTS = 48, 4, 6, 100_000
Ranges = np.ndarray  # rows of source, start, end, sorted


def taken(pieces: Ranges, used: Ranges) -> float:
    """Seconds of the pieces that lie in used ranges, a piece's own length at most."""
    if not len(pieces) or not len(used):
        return 0.0
    meets = np.minimum(pieces[:, None, 2], used[None, :, 2]) - np.maximum(pieces[:, None, 1], used[None, :, 1])
    meets = np.where(pieces[:, None, 0] == used[None, :, 0], np.maximum(meets, 0.0), 0.0)
    return float(np.minimum(meets.sum(axis=1), pieces[:, 2] - pieces[:, 1]).sum())


def union(a: Ranges, b: Ranges) -> Ranges:
    rows = np.concatenate([a, b])
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    out: list[list[float]] = []
    for source, start, end in rows.tolist():
        if out and out[-1][0] == source and start <= out[-1][2] + 1e-7:
            out[-1][2] = max(out[-1][2], end)
        else:
            out.append([source, start, end])
    return np.array(out, dtype=float).reshape(-1, 3)


def thinned(values: list[float], gap: float) -> list[float]:
    """Sorted, without those nearer than gap to the last one kept."""
    out: list[float] = []
    for v in sorted(values):
        if not out or abs(v - out[-1]) >= gap:
            out.append(v)
    return out


@dataclass
class Scene:
    """A scene's fragments, motion (times, values) and actions (start, end, peak, activity), and its place among all."""

    scene_id: int
    source: int
    fragments: Ranges
    times: np.ndarray
    values: np.ndarray
    actions: np.ndarray
    end: float
    base: float = 0.0
    starts: list[float] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.lengths = self.fragments[:, 2] - self.fragments[:, 1]
        self.after = np.cumsum(self.lengths)
        self.duration = float(self.after[-1])
        self.capped = np.concatenate([[0.0], np.cumsum(np.minimum(self.values / 0.18, 1.0))])
        self.active = np.concatenate([[0.0], np.cumsum(self.values > 0.015)])
        # Plain numbers for what is asked one at a time: a call of numpy costs more than the sum itself.
        self._rows, self._lengths, self._after = self.fragments.tolist(), self.lengths.tolist(), self.after.tolist()
        self._over = (self.after + 1e-9).tolist()
        self.ends = self.actions[:, 1].tolist() if len(self.actions) else []
        self.local_ends = [self.to_local(e) for e in self.ends]
        self.ranked = self.actions[np.lexsort((self.actions[:, 0], -self.actions[:, 3]))] if len(self.actions) else self.actions
        self.ranked_starts = [x for x in (self.to_local(a) for a in self.ranked[:ACTIONS, 0].tolist()) if x is not None] if len(self.actions) else []

    def to_source(self, t: float) -> float:
        i = bisect_left(self._over, t)
        if i >= len(self._after):
            return self.end
        return self._rows[i][1] + min(max(t - (self._after[i] - self._lengths[i]), 0.0), self._lengths[i])

    def to_local(self, t: float) -> float | None:
        inside = np.flatnonzero((t >= self.fragments[:, 1]) & (t <= self.fragments[:, 2]))
        return float(self.after[inside[0]] - self.lengths[inside[0]] + t - self.fragments[inside[0], 1]) if len(inside) else None

    def pieces(self, start: float, span: float) -> Ranges:
        before = self.after - self.lengths
        low, high = np.maximum(start, before), np.minimum(start + span, self.after)
        keep = high > low + 1e-9
        return np.stack([self.fragments[keep, 0], self.fragments[keep, 1] + (low - before)[keep], self.fragments[keep, 1] + (high - before)[keep]], axis=1)

    def stretch(self, starts: np.ndarray, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where stretches lie in each fragment, in source time: arrays of stretches x fragments, empty where high is not above low."""
        before = self.after - self.lengths
        low, high = np.maximum(starts[:, None], before), np.minimum((starts + spans)[:, None], self.after)
        high = np.where(high > low + 1e-9, high, low)
        shift = self.fragments[:, 1] - before
        return low + shift, high + shift

    def own(self, used: Ranges) -> Ranges:
        return used[used[:, 0] == self.source]

    def covered(self, low: np.ndarray, high: np.ndarray, used: Ranges) -> np.ndarray:
        own = self.own(used)
        if not len(own):
            return np.zeros(len(low))
        meets = np.maximum(np.minimum(high[..., None], own[:, 2]) - np.maximum(low[..., None], own[:, 1]), 0.0).sum(axis=2)
        return np.minimum(meets, high - low).sum(axis=1)

    def activities(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean capped activity and active share of many stretches, by prefix sums over the motion."""
        a, b = np.searchsorted(self.times, low), np.searchsorted(self.times, high, side="right")
        b = np.where(high > low, np.maximum(a, b), a)
        count = (b - a).sum(axis=1)
        mean = lambda sums: np.where(count > 0, (sums[b] - sums[a]).sum(axis=1) / np.maximum(count, 1), 0.0)
        return mean(self.capped), mean(self.active)

    def to_sources(self, t: np.ndarray) -> np.ndarray:
        i = np.searchsorted(self.after + 1e-9, t)
        j = np.minimum(i, len(self.after) - 1)
        inside = self.fragments[j, 1] + np.clip(t - (self.after[j] - self.lengths[j]), 0.0, self.lengths[j])
        return np.where(i >= len(self.after), self.end, inside)

    def activity(self, start: float, span: float) -> tuple[float, float]:
        """Mean capped activity, and the share of active samples, of a stretch."""
        met = [self.values[np.searchsorted(self.times, a) : np.searchsorted(self.times, b, side="right")] for _, a, b in self.pieces(start, span)]
        v = np.concatenate([np.zeros(0), *met])
        return (float(np.minimum(v / 0.18, 1.0).mean()), float((v > 0.015).mean())) if len(v) else (0.0, 0.0)

    def activity_at(self, t: float) -> float:
        i = int(np.searchsorted(self.times, t))
        return float(max(self.values[max(i - 2, 0) : i + 2], default=0.0))

    def bins(self, count: int) -> list[float]:
        """A start for each equal part: a little before its strongest sample, the last of equals."""
        out = []
        for k in range(count):
            low, high = self.duration * k / count, self.duration * (k + 1) / count
            a, b = np.searchsorted(self.times, [self.to_source(low), self.to_source(high)])
            at = None
            if b > a:
                v = self.values[a:b]
                at = self.to_local(float(self.times[a + len(v) - 1 - int(np.argmax(v[::-1]))]))
            out.append(max((low if at is None else at) - 0.35, low))
        return out

    def first_unused(self, used: Ranges) -> float | None:
        """The local offset of the first stretch of 0.04 s or more that nothing covers."""
        own = self.own(used).tolist()
        for (_, start, end), after, length in zip(self._rows, self._after, self._lengths, strict=True):
            cursor = start
            for _, a, b in own:
                if a > cursor + 0.04:
                    break
                cursor = max(cursor, b)
            if cursor < end - 0.04:
                return after - length + cursor - start
        return None


@dataclass
class Shot:
    scene: int
    start: float
    span: float
    t0: float
    t1: float
    reused: float = 0.0
    activity: float = 0.0
    score: float = 0.0
    pieces: Ranges = None
    sources: frozenset = frozenset()


@dataclass
class Tried:
    """Starts, ends and spans of the shots worth trying in a scene from a time on, and what of their score depends on no state."""

    starts: np.ndarray
    ends: np.ndarray
    spans: np.ndarray
    durations: np.ndarray
    low: np.ndarray
    high: np.ndarray
    activity: np.ndarray
    moving: np.ndarray
    freshness: np.ndarray | float
    beat: np.ndarray
    length_cost: np.ndarray
    costs: list[np.ndarray]


@dataclass
class State:
    """What has been shown: the union of all of it, and the shots of the last 16 seconds."""

    used: Ranges = field(default_factory=lambda: np.zeros((0, 3)))
    recent: list[tuple[int, int, Shot]] = field(default_factory=list)

    def after(self, shot: Shot, scene: Scene) -> State:
        kept = [r for r in self.recent if shot.t1 - r[2].t1 < 2 * RECURRENCE]
        return State(union(self.used, shot.pieces), [*kept, (scene.source, scene.scene_id, shot)])

    def last_of(self, scene: Scene) -> Shot | None:
        return next((s for source, number, s in reversed(self.recent) if (source, number) == (scene.source, scene.scene_id)), None)

    def held(self, scene: Scene) -> float:
        total = 0.0
        for source, number, s in reversed(self.recent):
            if (source, number) != (scene.source, scene.scene_id):
                break
            total += s.t1 - s.t0
        return total


@dataclass
class Job:
    scenes: list[Scene]
    bounds: np.ndarray
    downbeats: np.ndarray
    target: float
    preferred: float
    rate: float = 1.0
    smart: bool = True
    long_clip: bool = False

    def __post_init__(self) -> None:
        base = 0.0
        for s in self.scenes:
            s.base = base
            base += s.duration
            s.starts = (s.bins(6) if self.smart else []) + s.ranked_starts + (s.bins(8) if self.long_clip else [])
        self.total = base
        self._bounds = self.bounds.tolist()
        # By scene, start and time: many states come by the same ones. What lies before the time reached is dropped.
        self._lengths: dict[tuple, list[tuple[float, float, float]]] = {}
        self._tried: dict[tuple, Tried | None] = {}

    def snapped(self, t: float) -> float:
        i = bisect_left(self._bounds, t)
        near = self._bounds[max(i - 1, 0) : i + 1]
        if len(near) == 2:
            return min(near[0] if t - near[0] <= near[1] - t else near[1], self.target)
        return min(near[0] if near else t, self.target)

    def order(self, state: State, before: Shot | None) -> list[int]:
        """The most promising scenes: unseen, not recent, with strong action; the one being shown is always among them."""
        if len(self.scenes) <= SCENES:
            return list(range(len(self.scenes)))
        value = [1.0 - taken(s.fragments, state.used) / s.duration + (0.0 if state.last_of(s) else 0.5) + (s.ranked[0, 3] if len(s.ranked) else 0.0) for s in self.scenes]
        best = sorted(range(len(value)), key=lambda i: (-value[i], i))[:SCENES]
        return best if before is None or before.scene in best else [*best, before.scene]

    def starts(self, number: int, state: State, before: Shot | None) -> list[float]:
        s = self.scenes[number]
        out = [0.0, *s.starts]
        unused = s.first_unused(state.used)
        out += [unused] if unused is not None else []
        if before is not None and before.scene == number and before.start + before.span < s.duration - 0.03:
            out.append(before.start + before.span)
        return thinned(out, 0.03)

    def ends(self, s: Scene, start: float, time: float) -> list[float]:
        left, room = self.target - time, s.duration - start
        most = room / SLOWEST
        limit = min(self.preferred * 2.5, 6.0, left) if self.smart else left
        slack = 1e-7 if self.smart else 0.001
        hold = min(self.preferred * 0.65, s.duration / SLOWEST, left) if self.smart else 0.0
        source = s.to_source(start)
        later = [x for x, e in zip(s.local_ends, s.ends, strict=True) if e > source][:4]
        lengths = [self.preferred * 0.65, self.preferred, self.preferred * 1.5, room / self.rate, *((x - start) / self.rate for x in later if x is not None), left]
        out, most_of_all = [], min(most, left, limit)
        for wanted in {time + min(length, most_of_all) for length in lengths if length > 0.04}:
            end = self.snapped(wanted)
            if self.smart and (end <= time + 0.025 or end - time > min(limit, most) + slack):
                end = wanted
            if end > time + 0.025 and hold - slack <= end - time <= most + slack:
                out.append(end)
        if left <= most and left <= limit:
            out.append(self.target)
        if not out and most >= hold - slack:
            out.append(time + min(max(room / self.rate, hold), limit, most))
        return thinned(out, 0.01)

    def spans(self, s: Scene, start: float, duration: float) -> list[float]:
        room, slack = s.duration - start, 1e-7 if self.smart else 0.001
        out = [min(duration * self.rate, room), min(duration, room)] + ([room] if room / duration <= FASTEST else [])
        out += [x - start for x in s.local_ends[:8] if x is not None and x > start]
        return [x for x in thinned(out, 0.02) if 1e-6 < x <= room + 1e-6 and SLOWEST - slack <= x / duration <= FASTEST]

    def lengths(self, number: int, start: float, time: float) -> list[tuple[float, float, float]]:
        """start, end and span of each shot worth trying in a scene from a start and a time on."""
        key = time, number, start
        if key not in self._lengths:
            s = self.scenes[number]
            self._lengths[key] = [(start, end, span) for end in self.ends(s, start, time) for span in self.spans(s, start, end - time)] if s.duration - start >= 0.001 else []
        return self._lengths[key]

    def tried(self, number: int, starts: list[float], time: float) -> Tried | None:
        key = time, number, tuple(starts)
        if key not in self._tried:
            rows = [row for start in starts for row in self.lengths(number, start, time)]
            self._tried[key] = self._weighed(number, *np.array(rows).T, time) if rows else None
        return self._tried[key]

    def _weighed(self, number: int, starts: np.ndarray, ends: np.ndarray, spans: np.ndarray, time: float) -> Tried:
        s = self.scenes[number]
        durations = ends - time
        low, high = s.stretch(starts, spans)
        activity, active = s.activities(low, high)
        cuts_action = np.zeros(len(starts), dtype=bool)
        if len(s.actions):
            at = s.to_sources(starts + spans)[:, None]
            cuts_action = ((at > s.actions[:, 0]) & (at < s.actions[:, 2] + 0.15) & (at < s.actions[:, 1] - 0.05)).any(axis=1)
        on_beat = (np.abs(self.downbeats[None, :] - ends[:, None]) < 0.03).any(axis=1)
        length = durations / self.preferred
        costs = [1.5 * (1.0 - active) * np.minimum(length, 2.0), 1.8 * np.abs(np.log(spans / durations / self.rate)), np.where(cuts_action, 0.45 if self.smart else 0.9, 0.0)]
        if self.long_clip:
            costs.append(5.0 * np.abs((s.base + starts + spans * 0.5) / self.total - (time + durations * 0.5) / self.target))
        freshness = 1.0 if self.smart else np.minimum(spans / self.preferred, 2.0)
        return Tried(starts, ends, spans, durations, low, high, activity, 2.5 * activity + 0.9 * active, freshness, np.where(on_beat, 0.3, 0.1), (1.6 if self.smart else 0.6) * np.abs(np.log(length)), costs)

    def scored(self, number: int, t: Tried, time: float, state: State, before: Shot | None) -> tuple[np.ndarray, np.ndarray]:
        """Score and reused share of many candidate shots of one scene at once."""
        s = self.scenes[number]
        last = state.last_of(s)
        reused = np.clip(s.covered(t.low, t.high, state.used) / t.spans, 0.0, 1.0)
        gain = t.moving + (1.0 - reused) * t.freshness + (0.0 if last else 0.65)
        weight = 0.3 if self.long_clip else 2.0 if self.smart else 1.3
        cost = weight * math.exp(-max(time - last.t1, 0.0) / (self.preferred * 2.0 if self.smart else 4.0)) if last else 0.0
        if before is not None and before.scene == number and not self.smart:
            goes_on = np.abs(before.start + before.span - t.starts) < 0.03
            gain = gain + np.where(goes_on, 0.3 if self.long_clip else 1.1, 0.0)
            cost = np.where(goes_on, 0.0, cost)
        gain = gain + t.beat
        if reused.any():  # else nothing is shown again
            window = min(max(self.preferred * 3.0, 2.0), 5.0) if self.smart else RECURRENCE
            again = (4.0 if self.smart else 8.0) / (1.0 + math.exp(min((time - window) / 1.5, 700.0)))
            replay = np.zeros(len(t.starts))
            for _, _, r in state.recent:
                if s.source in r.sources:
                    fading = 4.0 * math.exp(-max(time - r.t1, 0.0) / window)
                    replay = np.maximum(replay, np.where(s.covered(t.low, t.high, r.pieces) > 0.001, fading, 0.0))
            cost = reused * ((3.0 if self.smart else 4.0) + again + replay) + cost
        cost = cost + t.length_cost
        for more in t.costs:
            cost = cost + more
        if self.smart:
            cost = cost + np.maximum((state.held(s) + t.durations) / self.preferred - 1.5, 0.0) * 1.4
        return gain - cost, reused

    def rated(self, state: State, time: float, before: Shot | None) -> list[tuple[int, Tried, np.ndarray, np.ndarray]]:
        """Scene, what is tried in it, scores and reused shares, for each scene that has anything to try."""
        found = []
        for number in self.order(state, before):
            t = self.tried(number, self.starts(number, state, before), time)
            if t is not None:
                found.append((number, t, *self.scored(number, t, time, state, before)))
        return found

    def kept(self, rated: list[tuple[int, Tried, np.ndarray, np.ndarray]], time: float) -> list[Shot]:
        """The best of what was rated."""
        found = []
        for number, t, score, reused in rated:
            best = np.lexsort((t.ends, t.starts, -score))[:KEPT]
            found += zip((-score[best]).tolist(), [number] * len(best), t.starts[best].tolist(), t.ends[best].tolist(), t.spans[best].tolist(), reused[best].tolist(), t.activity[best].tolist(), strict=True)
        out = []
        for score, number, start, end, span, reused, activity in sorted(found, key=lambda c: c[:4])[:KEPT]:
            pieces = self.scenes[number].pieces(start, span)
            out.append(Shot(number, start, span, time, end, reused, activity, -score, pieces, frozenset(pieces[:, 0].tolist())))
        return out

    def shots(self) -> list[Shot]:
        """One shot after the other, each the best together with 0.35 of the best that can follow it."""
        state, out, time, known = State(), [], 0.0, None
        while time < self.target - 1e-7:
            best = None
            for c in self.kept(self.rated(state, time, out[-1] if out else None) if known is None else known, time):
                ahead, after, follow = 0.0, state.after(c, self.scenes[c.scene]), None
                if c.t1 < self.target - 0.025:
                    follow = self.rated(after, c.t1, c)
                    ahead = max(float(score.max()) for _, _, score, _ in follow) if follow else -8.0
                if best is None or c.score + 0.35 * ahead > best[0]:
                    best = (c.score + 0.35 * ahead, c, after, follow)
            if best is None:
                raise ValueError("no valid shot can follow")
            if len(out) >= MOST_SHOTS:
                raise ValueError("too many shots")
            out.append(best[1])
            # What was looked ahead to behind the chosen shot is what the next step would try.
            time, state, known = best[1].t1, best[2], best[3]
            self._lengths = {k: v for k, v in self._lengths.items() if k[0] >= time}
            self._tried = {k: v for k, v in self._tried.items() if k[0] >= time}
        return out

    def from_segments(self, segments: list[tuple[float, float, float, float]]) -> list[Shot]:
        """Shots of a plan made without search: segments (t0, t1, s0, s1) that go on in a scene are one shot, moved to the scene's strongest action."""
        ends = np.array([s.base + s.duration for s in self.scenes])
        out: list[Shot] = []
        for t0, t1, s0, s1 in segments:
            low, high = min(s0, s1), max(s0, s1)
            number = min(int(np.searchsorted(ends, low + 1e-7, side="right")), len(ends) - 1)
            local = low - self.scenes[number].base
            if out and out[-1].scene == number and abs(out[-1].start + out[-1].span - local) < 0.003:
                out[-1].span, out[-1].t1 = high - self.scenes[number].base - out[-1].start, t1
            else:
                out.append(Shot(number, local, high - low, t0, t1))
        state = State()
        for shot in out:
            s = self.scenes[shot.scene]
            if len(s.actions):
                strongest = s.actions[len(s.actions) - 1 - int(np.argmax(s.actions[::-1, 3]))]
                at = s.to_local(float(strongest[0]))
                shot.start = shot.start if at is None else min(at, max(s.duration - shot.span, 0.0))
            shot.span = min(shot.span, s.duration - shot.start)
            shot.pieces = s.pieces(shot.start, shot.span)
            shot.activity = s.activity(shot.start, shot.span)[0]
            shot.reused = min(max(taken(shot.pieces, state.used) / shot.span, 0.0), 1.0) if shot.span > 0 else 0.0
            state = state.after(shot, s)
        return out

    def materialised(self, shots: list[Shot], template: list[dict]) -> list[dict]:
        """Segments of shots: cut at the template's starts, positions drawn to motion, and split where a fragment ends.

        template: rows t0, t1, curve, reverse. Each segment has strength, phase_start and phase_end of its remap.
        """
        out, at = [], 0
        for shot in shots:
            s = self.scenes[shot.scene]
            times = [shot.t0, *(r["t0"] for r in template if shot.t0 + 1e-7 < r["t0"] < shot.t1 - 1e-7), shot.t1]
            places = self._places(s, shot, times)
            for (t0, t1), (p0, p1) in zip(zip(times, times[1:], strict=False), zip(places, places[1:], strict=False), strict=True):
                while at + 1 < len(template) and template[at]["t1"] <= t0 + 1e-7:
                    at += 1
                row = template[at]
                ending = s.activity_at(s.to_source(p0 if row["reverse"] else p1))
                strength = 0.0 if ending < 0.015 else min(ending / 0.18, 0.85)
                s0, s1 = (s.base + p1, s.base + p0) if row["reverse"] else (s.base + p0, s.base + p1)
                inside = [b for b in (s.base + s.after).tolist() if min(s0, s1) + 1e-7 < b < max(s0, s1) - 1e-7]
                phases = sorted([0.0, *(inverse(row["curve"], strength, (b - s0) / (s1 - s0)) for b in inside), 1.0])
                eased = lambda x, r=row, k=strength: x * (1.0 - k) + k * ease(r["curve"], x)
                for a, b in zip(phases, phases[1:], strict=False):
                    out.append({"t0": t0 + (t1 - t0) * a, "t1": t0 + (t1 - t0) * b, "s0": s0 + (s1 - s0) * eased(a), "s1": s0 + (s1 - s0) * eased(b), "curve": row["curve"], "reverse": row["reverse"], "strength": strength, "phase_start": a, "phase_end": b})
        return out

    @staticmethod
    def _places(s: Scene, shot: Shot, times: list[float]) -> list[float]:
        out, length = [shot.start], shot.t1 - shot.t0
        for i in range(1, len(times) - 1):
            wanted = shot.start + shot.span * (times[i] - shot.t0) / length
            low = out[-1] + shot.span * (times[i] - times[i - 1]) / length * 0.25
            high = shot.start + shot.span - (shot.t1 - times[i]) / length * shot.span * 0.35
            reach, centre = min((times[i] - times[i - 1]) * 0.35, 0.45), s.to_source(wanted)
            a, b = np.searchsorted(s.times, centre - reach), np.searchsorted(s.times, centre + reach, side="right")
            best = None
            for t, v in zip(s.times[a:b].tolist(), s.values[a:b].tolist(), strict=True):
                local = s.to_local(t)
                if local is not None and low <= local <= high and v > 0.015 and (best is None or v - abs(local - wanted) * 0.03 >= best[0]):
                    best = (v - abs(local - wanted) * 0.03, local)
            out.append(min(max(best[1] if best else wanted, low), high))
        return [*out, shot.start + shot.span]


def ease(curve: str, x: float) -> float:
    x = min(max(x, 0.0), 1.0)
    return {"snap": 1.0 - (1.0 - x) ** 3, "saddle": x * x * (3.0 - 2.0 * x)}.get(curve.lower(), x)


def inverse(curve: str, strength: float, value: float, steps: int = 40) -> float:
    low, high = 0.0, 1.0
    for _ in range(steps):
        middle = (low + high) * 0.5
        if middle * (1.0 - strength) + strength * ease(curve, middle) < value:
            low = middle
        else:
            high = middle
    return (low + high) * 0.5


def scene_of(row: dict) -> Scene:
    """From a prepared scene: scene_id, source_id, source_end, fragments (start, duration), motion (time, activity, confidence), actions."""
    fragments = np.array([[row["source_id"], f["start"], f["start"] + f["duration"]] for f in row["fragments"]], dtype=float)
    motion = row["motion"] or []
    actions = np.array([[a["start"], a["end"], a["peak"], a["activity"]] for a in row["actions"] or []], dtype=float).reshape(-1, 4)
    return Scene(row["scene_id"], row["source_id"], fragments, np.array([m["time"] for m in motion], dtype=float), np.array([m["activity"] * m["confidence"] for m in motion], dtype=float), actions, row["source_end"])


SHOTS = "job long, idx long, scene_id int, source_id int, start double, span double, t0 double, t1 double, reused double, activity double, score double"


def schedule(jobs: DataFrame) -> DataFrame:
    """jobs: job, target, preferred, rate, smart, long_clip, bounds, downbeats and scenes (an array of prepared scenes). A row per shot.

    A walk takes far more time than its row has bytes, so jobs are dealt to four partitions a core: partitions by size would
    leave most cores idle. A partition streams its rows, so its memory does not grow with their number. Jobs are walked many in
    step; those that can't be (scenes of several fragments, very many scenes or actions, numbers unknown) one by one.
    """
    from chronoframe.operators import walks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from walks.walked(batch)

    parts = 4 * jobs.sparkSession.sparkContext.defaultParallelism
    return jobs.select("job", "target", "preferred", "rate", "smart", "long_clip", "bounds", "downbeats", "scenes").repartition(parts, "job").mapInArrow(run, SHOTS)


def job_of(r: dict) -> Job:
    """From a row of jobs."""
    return Job([scene_of(s) for s in r["scenes"]], np.array(thinned(r["bounds"], 0.01), dtype=float), np.array(r["downbeats"] or [], dtype=float), r["target"], r["preferred"], r["rate"], r["smart"], r["long_clip"])
