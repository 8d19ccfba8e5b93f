"""Cancelling and following a scan's jobs."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import SparkSession


class Cancelled(RuntimeError):
    """The one error that a cancelled run raises."""


@dataclass(frozen=True)
class Progress:
    stage: str
    current: int
    total: int
    message: str = ""

    @property
    def percent(self) -> int:
        return min(100, int(self.current / self.total * 100)) if self.total > 0 else 0


class Phases:
    """Progress over a scan's three phases, frames, features and pairs: each counts as many units as there are files."""

    ORDER = ("frames", "features", "pairs")

    def __init__(self, tell: Callable[[Progress], None] | None):
        self.tell, self.total = tell, 0

    def watcher(self, phase: str) -> Callable[[Progress], None] | None:
        """Turns what is known of a phase's tasks into units of the whole."""
        if self.tell is None:
            return None
        done, n = self.ORDER.index(phase), max(1, self.total)

        def report(tasks: Progress) -> None:
            share = tasks.current / tasks.total if tasks.total else 0.0
            self.tell(Progress(phase, done * n + int(n * share), len(self.ORDER) * n, tasks.stage))

        return report


class Run:
    """A piece of work whose jobs carry a tag: it can be cancelled from another thread, and reports its tasks."""

    def __init__(self, spark: SparkSession, name: str = "scan"):
        self.spark, self.name, self.tag = spark, name, f"{name}-{uuid.uuid4().hex}"
        self._cancelled = threading.Event()

    def cancel(self) -> None:
        self._cancelled.set()
        self.spark.sparkContext.cancelJobsWithTag(self.tag)

    def __call__(self, work: Callable[[], object], report: Callable[[Progress], None] | None = None, every: float = 0.5) -> object:
        if self._cancelled.is_set():
            raise Cancelled(self.name)
        done, watcher = threading.Event(), None
        if report:
            watcher = threading.Thread(target=self._watch, args=(report, every, done), daemon=True)
            watcher.start()
        self.spark.sparkContext.addJobTag(self.tag)
        try:
            found = work()
            if self._cancelled.is_set():
                raise Cancelled(self.name)
            return found
        except Cancelled:
            raise
        except Exception as error:
            if self._cancelled.is_set():
                raise Cancelled(self.name) from error
            raise
        finally:
            self.spark.sparkContext.removeJobTag(self.tag)
            done.set()
            if watcher:
                watcher.join()

    def _watch(self, report: Callable[[Progress], None], every: float, done: threading.Event) -> None:
        tracker = self.spark.sparkContext.statusTracker()
        while not done.is_set():
            for stage in tracker.getActiveStageIds():
                info = tracker.getStageInfo(stage)
                if info:
                    report(Progress(info.name, info.numCompletedTasks, info.numTasks))
            time.sleep(every)
        report(Progress(self.name, 1, 1))
