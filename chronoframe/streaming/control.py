"""Progress, cancellation and admission of jobs, by Spark's own means."""

from __future__ import annotations

import re
import threading
from collections import deque
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQueryListener

_ID = re.compile(r"[A-Za-z0-9-]{1,100}\Z")
#: Jobs that may wait, and cancellations of jobs that haven't begun.
MOST_WAITING, MOST_EARLY = 16, 64


class Progress(StreamingQueryListener):
    """Calls tell(rows so far) after micro-batches, at most once for each `step` rows."""

    def __init__(self, tell: Callable[[int], None], step: int = 1):
        self.tell, self.step, self.rows, self.told = tell, step, 0, 0

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.rows += event.progress.numInputRows
        if self.rows - self.told >= self.step:
            self.told = self.rows
            self.tell(self.rows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if self.rows != self.told:
            self.told = self.rows
            self.tell(self.rows)


class Jobs:
    """Jobs by id: so many at a time, a bounded queue, and cancellation that also holds for a job that is yet to begin."""

    def __init__(self, spark: SparkSession, at_once: int = 2):
        self.spark, self.free, self.lock = spark, threading.Semaphore(at_once), threading.Lock()
        self.active: set[str] = set()
        self.waiting = 0
        self.early: deque[str] = deque(maxlen=MOST_EARLY)

    @contextmanager
    def run(self, job: str) -> Iterator[None]:
        """Everything that Spark runs inside carries the job's tag. An id in use, a full queue or an early cancellation is an error."""
        if not _ID.match(job):
            raise ValueError("a job id has 1 to 100 letters, digits and hyphens")
        with self.lock:
            if job in self.early:
                self.early.remove(job)
                raise InterruptedError(f"job {job} was cancelled")
            if job in self.active:
                raise ValueError(f"job {job} is running")
            if self.waiting >= MOST_WAITING:
                raise RuntimeError("too many jobs wait")
            self.active.add(job)
            self.waiting += 1
        try:
            self.free.acquire()
            with self.lock:
                self.waiting -= 1
            context = self.spark.sparkContext
            context.addJobTag(f"job-{job}")
            context.setInterruptOnCancel(True)
            try:
                yield
            finally:
                context.setInterruptOnCancel(False)
                context.removeJobTag(f"job-{job}")
                self.free.release()
        finally:
            with self.lock:
                self.active.discard(job)

    def cancel(self, job: str) -> None:
        with self.lock:
            if job not in self.active:
                self.early.append(job)
                return
        self.spark.sparkContext.cancelJobsWithTag(f"job-{job}")
