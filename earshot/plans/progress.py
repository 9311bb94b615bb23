"""How far a running plan is: tasks done over all tasks of its stages.

``Watch`` puts the jobs of a block into a group of its own, asks the status tracker for their stages
while they run and hands what it sees to ``report``; its snapshots are rows that
``operators.relational.progress`` sums up like any other stages.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

SNAPSHOT = "poll long, stage long, tasks long, completed long, active boolean"


class Watch:
    """``with Watch(spark, report) as w: ...`` calls ``report(completed, tasks)`` every ``every`` seconds
    while the block's jobs run, and once more at their end.

    A stage counts once a task of it runs or is done, so stages that are skipped never do.  The last
    report waits up to ``settle`` seconds for the counts of what has just ended."""

    def __init__(self, spark: SparkSession, report: Callable[[int, int], None] | None = None, every: float = 0.5, description: str = "earshot", settle: float = 5.0):
        self.context, self.report, self.every, self.settle = spark.sparkContext, report, every, settle
        self.group, self.description = f"earshot-{uuid.uuid4().hex}", description
        self.snapshots: list[list[tuple[int, int, int, bool]]] = []
        self._seen: dict[int, tuple[int, int]] = {}
        self._end = threading.Event()

    def stages(self) -> list[tuple[int, int, int, bool]]:
        """(stage, tasks, completed, active) of the group's stages that have begun."""
        tracker = self.context.statusTracker()
        for job in tracker.getJobIdsForGroup(self.group):
            info = tracker.getJobInfo(job)
            for stage in info.stageIds if info else ():
                s = tracker.getStageInfo(stage)
                if s and (s.numCompletedTasks or s.numActiveTasks or s.numFailedTasks):
                    self._seen[stage] = (s.numTasks, s.numCompletedTasks)
        # A stage the tracker has dropped since stays as it was last seen.
        return [(k, tasks, done, done < tasks) for k, (tasks, done) in sorted(self._seen.items())]

    def poll(self) -> tuple[int, int]:
        now = self.stages()
        self.snapshots.append(now)
        done, tasks = sum(s[2] for s in now), sum(s[1] for s in now)
        if self.report and tasks:
            self.report(done, tasks)
        return done, tasks

    def __enter__(self) -> Watch:
        self.context.setJobGroup(self.group, self.description)
        self._thread = threading.Thread(target=self._watch, daemon=True)
        self._thread.start()
        return self

    def _watch(self) -> None:
        while not self._end.wait(self.every):
            self.poll()

    def __exit__(self, failed, *_) -> None:
        self._end.set()
        self._thread.join()
        self.context.setLocalProperty("spark.jobGroup.id", None)
        self.context.setLocalProperty("spark.job.description", None)
        until = time.monotonic() + (0 if failed else self.settle)
        while any(s[3] for s in self.stages()) and time.monotonic() < until:
            time.sleep(0.05)
        self.poll()

    def frame(self, spark: SparkSession) -> DataFrame:
        """All snapshots as rows (poll, stage, tasks, completed, active)."""
        rows = [(i, *s) for i, stages in enumerate(self.snapshots) for s in stages]
        return spark.createDataFrame(rows, SNAPSHOT)
