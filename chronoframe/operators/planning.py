"""Segment plans: a row per plan in, a row per segment out. A plan is one ordered walk, so plans are the unit of parallelism.

Bounds come from beats, the walk maps output time to source time, wraps where a source ends, and switches scenes by rhythm.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

TOL = 1e-9
SEGMENTS = "plan_id long, idx long, t0 double, t1 double, s0 double, s1 double, curve string, reverse boolean, wraps boolean, scene int, loops long"


def merged_bounds(beats: list[float], target: float, fps: int, style: str) -> list[float]:
    """0, the beats (every second one for smooth plans) at least three frames apart, and the target, which takes the place of a bound too near to it."""
    usable = sorted(b for b in beats if 0.0 < b < target)
    if style.upper() == "SMOOTH":
        usable = usable[::2]
    least, out = 3.0 / fps, [0.0]
    for b in usable:
        if b - out[-1] >= least:
            out.append(b)
    if target - out[-1] < least and len(out) > 1:
        out.pop()
    return [*out, target]


def source_intervals(mode: str, video: float, audio: float, scenes: list[float] | None) -> list[tuple[float, float]]:
    """(start, length) of the parts of the source that a plan may use."""
    if mode == "scenepack":
        marks = [min(max(x, 0.0), video) for x in scenes or []]
        found = [(a, b - a) for a, b in zip(marks, marks[1:], strict=False) if b > a]
        return found or [(0.0, video)]
    if mode == "long_clip" and video > audio:
        count = min(max(int(audio / 3.25 + 0.5), 2), 8)
        step = max(video - 3.5, 0.0) / max(count - 1, 1)
        return [(i * step, min(4.0, video - i * step)) for i in range(count)]
    return [(0.0, min(video, audio + 2.0))]


def touches(marks: np.ndarray, t0: float, t1: float) -> bool:
    """Whether a mark is at the start of a segment, give or take, or inside it."""
    return bool(((np.abs(marks - t0) < 0.03) | ((marks >= t0 - 1e-4) & (marks < t1 - 1e-4))).any())


@dataclass
class Walk:
    """Where a plan stands in its source."""

    style: str
    mode: str
    ranges: list[tuple[float, float]]
    total: float
    rhythm: str
    scene: int = 0
    cursor: float = 0.0
    switched: float = 0.0
    strong: int = 0
    wrapped: bool = False
    loops: list[int] = field(default_factory=lambda: [0])  # how often the source was used up, after each row; first: before any
    rows: list[tuple] = field(default_factory=list)

    @property
    def limit(self) -> float:
        return self.ranges[self.scene][1] if self.mode == "scenepack" else self.total

    def next_scene(self) -> None:
        self.scene = (self.scene + 1) % len(self.ranges)
        self.cursor = self.ranges[self.scene][0]

    def exhausted(self) -> None:
        """Go on with the next scene, or from the start of what is used; a loop, whether the segment ended just there or not."""
        self.loops[-1] += 1
        if self.mode == "scenepack":
            self.next_scene()
        else:
            self.cursor = 0.0

    def maybe_switch(self, t0: float, on_beat: bool, on_strong: bool) -> None:
        since = t0 - self.switched
        if self.mode == "scenepack" and len(self.ranges) > 1 and t0 > 0.0:
            due = {"fast": on_beat, "slow": on_strong and since >= 3.0}.get(self.rhythm, on_strong)
            if due or self.cursor >= self.limit - 0.05:
                self.next_scene()
                self.switched, self.wrapped = t0, True
        elif self.mode == "long_clip" and self.scene + 1 < len(self.ranges) and since >= 3.0 and (on_strong or since >= 4.0):
            self.scene += 1
            self.cursor = self.ranges[self.scene][0]
            self.switched, self.wrapped = t0, True

    def reverses(self, on_strong: bool) -> bool:
        self.strong += on_strong
        every = {"HARD": 5, "HYBRID": 10}.get(self.style)
        return bool(on_strong and every and self.strong % every == 1)

    def emit(self, t0: float, t1: float, s0: float, s1: float, curve: str, reverse: bool) -> None:
        places = lambda s: float(np.floor(s * 1000.0 + 0.5) / 1000.0)
        a, b = (s1, s0) if reverse else (s0, s1)
        self.rows.append((len(self.rows), t0, t1, places(a), places(b), curve, reverse, self.wrapped, self.scene))
        self.loops.append(0)
        self.wrapped = False

    def segment(self, t0: float, t1: float, on_beat: bool, on_strong: bool) -> None:
        self.maybe_switch(t0, on_beat, on_strong)
        smooth = self.style == "SMOOTH" or (self.style == "HYBRID" and len(self.rows) % 2 == 1)
        curve, rate = ("saddle", 0.75) if smooth else ("snap", 1.0)
        reverse = self.reverses(on_strong)
        while t0 < t1 - TOL:
            span, limit = rate * (t1 - t0), self.limit
            if self.cursor + span <= limit + TOL:
                start = self.cursor
                self.cursor += span
                self.emit(t0, t1, start, self.cursor, curve, reverse)
                if abs(self.cursor - limit) < TOL:
                    self.exhausted()
                return
            left = limit - self.cursor
            if left > 1e-6:
                self.emit(t0, t0 + left / rate, self.cursor, limit, curve, reverse)
                t0 += left / rate
            self.exhausted()
            self.wrapped = True


def walked(beats: list[float], downbeats: list[float], target: float, video: float, fps: int, style: str, mode: str = "no_change", scenes: list[float] | None = None, rhythm: str = "mid") -> Walk:
    """The walk of a plan to its end."""
    if not (1 <= fps <= 120 and 0 < video < float("inf") and 0 < target <= 86400):
        raise ValueError("a plan needs 1 to 120 frames a second, a source, and at most a day of output")
    parts = source_intervals(mode, video, target, scenes)
    ends = np.cumsum([d for _, d in parts]).tolist()
    ranges = list(zip([0.0, *ends], ends, strict=False))
    walk = Walk(style.upper(), mode, ranges if mode in ("scenepack", "long_clip") else ranges[:1], ends[-1], rhythm.lower())
    bounds = merged_bounds(beats, target, fps, style)
    b, d = np.array(beats, dtype=float), np.array(downbeats, dtype=float)
    for t0, t1 in zip(bounds, bounds[1:], strict=False):
        walk.segment(t0, t1, touches(b, t0, t1), touches(d, t0, t1))
    return walk


def segments(*args, **options) -> list[tuple]:
    """idx, t0, t1, s0, s1, curve, reverse, wraps, scene of each segment; source times on the compacted source. Arguments are those of walked."""
    return walked(*args, **options).rows


def plan(plans: DataFrame) -> DataFrame:
    """plans: plan_id, style, fps, target, video, mode, rhythm, beats, downbeats and scenes (arrays, may be null). A row per segment.

    loops: how often the source was used up with this segment; the first has those before any, so a plan's are their sum.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("plan_id", pa.int64()), ("idx", pa.int64()), ("t0", pa.float64()), ("t1", pa.float64()), ("s0", pa.float64()), ("s1", pa.float64()), ("curve", pa.string()), ("reverse", pa.bool_()), ("wraps", pa.bool_()), ("scene", pa.int32()), ("loops", pa.int64())])
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                walk = walked(r["beats"] or [], r["downbeats"] or [], r["target"], r["video"], r["fps"], r["style"], r["mode"], r["scenes"], r["rhythm"])
                loops = [walk.loops[0] + walk.loops[1], *walk.loops[2:]]
                out += [(r["plan_id"], *row, n) for row, n in zip(walk.rows, loops, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], f.type) for i, f in enumerate(schema)], schema=schema)

    return plans.select("plan_id", "style", "fps", "target", "video", "mode", "rhythm", "beats", "downbeats", "scenes").mapInArrow(run, SEGMENTS)
