"""Work that tells how far it is and can be stopped: a thread beside it watches its Spark jobs."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

from .changes import Reporter

#: Seconds between two looks at the jobs.
LOOK_S = 0.2


class Stopped(Exception):
    """The caller asked to stop."""


class Running:
    """While it is entered, the Spark jobs of this thread, and of pools that it starts, have a tag. A thread asks stop() now and then; once
    it says so, all jobs with the tag are cancelled, and what fails then ends the block without an error; `stopped` tells. Between
    times it reports the phase with the tasks that are done and all tasks of the stages at work."""

    def __init__(self, spark: SparkSession, stop: Callable[[], bool] = lambda: False, reporter: Reporter | None = None):
        self.sc, self.stop, self.reporter = spark.sparkContext, stop, reporter or Reporter()
        self.tag, self.stopped, self.now = f"lodestone-{uuid.uuid4().hex}", False, "scanning"
        self._end = threading.Event()
        self._thread = threading.Thread(target=self._look, daemon=True)

    def phase(self, name: str) -> None:
        """The next phase begins: scanning, embedding, building_fts or ready."""
        if self.stopped or self.stop():
            self.stopped = True
            raise Stopped
        self.now = name
        self.reporter.report(name, 0, 0)

    def _look(self) -> None:
        tracker = self.sc.statusTracker()
        while not self._end.wait(LOOK_S):
            try:
                if self.stopped or self.stop():
                    self.stopped = True
                    self.sc.cancelJobsWithTag(self.tag)
                elif self.reporter.listeners:
                    stages = [s for s in map(tracker.getStageInfo, tracker.getActiveStageIds()) if s]
                    if stages:
                        self.reporter.report(self.now, sum(s.numCompletedTasks for s in stages), sum(s.numTasks for s in stages))
            except Exception:  # noqa: BLE001  the context may end while it is looked at
                return

    def __enter__(self) -> "Running":
        self.sc.addJobTag(self.tag)
        self._thread.start()
        return self

    def __exit__(self, kind, error, trace) -> bool:
        self._end.set()
        self._thread.join()
        self.sc.removeJobTag(self.tag)
        return error is not None and self.stopped and isinstance(error, Exception)
