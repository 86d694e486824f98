"""What a query leaves out, told beside its rows; how far a running one is, and how to end it."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


@dataclass
class QueryReport:
    """Counters of one run.  ``truncated`` is known once the observed rows were computed."""

    limit: int | None = None
    findings: list[str] = field(default_factory=list)
    observation: Observation | None = None

    @property
    def rows(self) -> int | None:
        return None if self.observation is None else self.observation.get["rows"]

    @property
    def truncated(self) -> bool:
        return self.limit is not None and self.rows is not None and self.rows > self.limit


def capped(df: DataFrame, limit: int) -> tuple[DataFrame, QueryReport]:
    """The first ``limit`` rows, and a report that tells whether more were there."""
    seen = Observation()
    looked = df.limit(limit + 1).observe(seen, F.count("*").alias("rows"))
    return looked.limit(limit), QueryReport(limit, observation=seen)


@dataclass(frozen=True)
class Progress:
    """Spark jobs and tasks of a run so far; ``tasks`` grows while later stages are planned."""

    jobs: int
    tasks: int
    done: int
    failed: int


class Run:
    """An action in a thread of its own that can be watched and ended: ``Run(spark, lambda: df.write.parquet(path))``.

    ``result()`` waits for what the action returns or raises.  ``cancel()`` ends the Spark jobs that this run has at work
    and no other's; ``cancelled`` can be given as ``stop`` to operators that work in rounds, which then return what they
    have.  Progress can be read before, during and after.
    """

    def __init__(self, spark: SparkSession, action: Callable, name: str = "run"):
        self._context, self.group, self._cancelled = spark.sparkContext, f"{name}-{uuid.uuid4().hex}", False
        pool = ThreadPoolExecutor(1, thread_name_prefix=name)

        def work():
            self._context.setJobGroup(self.group, name, interruptOnCancel=True)
            return action()

        self._future: Future = pool.submit(inheritable_thread_target(spark)(work))
        pool.shutdown(wait=False)

    def cancelled(self) -> bool:
        return self._cancelled

    def cancel(self, jobs: bool = True) -> None:
        """Ends the run; with ``jobs`` false the jobs at work are let finish and only ``cancelled`` tells of it."""
        self._cancelled = True
        if jobs:
            self._context.cancelJobGroup(self.group)

    def done(self) -> bool:
        return self._future.done()

    def result(self, timeout: float | None = None):
        return self._future.result(timeout)

    def progress(self) -> Progress:
        tracker = self._context.statusTracker()
        jobs = tracker.getJobIdsForGroup(self.group)
        infos = [info for j in jobs if (info := tracker.getJobInfo(j))]
        # What a job reuses of an earlier one is among its stages but has no task run.
        over = {s for i in infos if i.status == "SUCCEEDED" for s in i.stageIds}
        stages = [info for s in {s for i in infos for s in i.stageIds} if (info := tracker.getStageInfo(s)) and (s not in over or info.numCompletedTasks)]
        return Progress(len(jobs), sum(s.numTasks for s in stages), sum(s.numCompletedTasks for s in stages), sum(s.numFailedTasks for s in stages))
