"""What the Spark jobs of a piece of work have done so far, and an end to them on request."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Cancelled(Exception):
    """Work that was ended on request."""


@dataclass(frozen=True)
class Done:
    """Tasks of the step's jobs, and the rows and bytes that they have read and written so far."""

    step: str
    tasks: int
    all_tasks: int
    rows_read: int
    rows_written: int
    bytes_read: int


class Watch:
    """Tags the jobs of each step of some work, tells what they have done and cancels them.

    ``tell`` gets a :class:`Done` every ``every`` seconds while jobs run and after each step; ``cancelled`` is asked as often,
    and where it says so the running jobs of the step are cancelled and the step ends by :class:`Cancelled`.
    """

    def __init__(self, spark: SparkSession, tell: Callable[[Done], None] | None = None, cancelled: Callable[[], bool] | None = None, every: float = 0.25):
        self.spark, self.tell, self.cancelled, self.every = spark, tell, cancelled, every

    def _done(self, step: str, tag: str) -> Done:
        sc = self.spark.sparkContext._jsc.sc()
        store, totals = sc.statusStore(), [0] * 5
        for job in sc.statusTracker().getJobIdsForTag(tag):
            stages = store.job(job).stageIds()
            for k in range(stages.size()):
                try:
                    stage = store.lastStageAttempt(stages.apply(k))
                except Py4JJavaError:
                    continue  # not known yet
                if stage.status().toString() == "SKIPPED":
                    continue
                own = (stage.numCompleteTasks(), stage.numTasks(), stage.inputRecords(), stage.outputRecords(), stage.inputBytes())
                totals = [a + b for a, b in zip(totals, own)]
        return Done(step, *totals)

    def step(self, name: str, work: Callable[[], object]) -> object:
        """The result of ``work``, whose jobs are watched."""
        if self.tell is None and self.cancelled is None:
            return work()
        sc, tag, over, ended = self.spark.sparkContext, f"tidemark-{uuid.uuid4().hex}", threading.Event(), threading.Event()
        if self.cancelled is not None and self.cancelled():
            raise Cancelled(name)

        def look() -> None:
            while not over.wait(self.every):
                if self.tell is not None:
                    self.tell(self._done(name, tag))
                if self.cancelled is not None and self.cancelled():
                    ended.set()
                    sc.cancelJobsWithTag(tag)  # again, as a step may begin another job

        watcher = threading.Thread(target=look, daemon=True)
        sc.addJobTag(tag)
        watcher.start()
        try:
            out = work()
        except Exception as e:
            if ended.is_set():
                raise Cancelled(name) from e
            raise
        finally:
            over.set()
            watcher.join()
            sc.removeJobTag(tag)
        if ended.is_set():
            raise Cancelled(name)
        if self.tell is not None:
            self.tell(self._done(name, tag))
        return out
