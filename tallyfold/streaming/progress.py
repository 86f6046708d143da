"""Progress of a tagged scan, and its cancellation."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

#: Phase -> share of the whole, from and to, in percent.
PHASES = {"collect": (0, 15), "hash": (15, 75), "compare": (75, 99), "done": (100, 100)}


@contextmanager
def tagged(spark: SparkSession, tag: str) -> Iterator[str]:
    """All jobs inside carry ``tag``."""
    spark.addTag(tag)
    try:
        yield tag
    finally:
        spark.removeTag(tag)


def cancel(spark: SparkSession, tag: str) -> list[str]:
    """Stop whatever carries ``tag``; the operations stopped."""
    return list(spark.interruptTag(tag))


def percent(phase: str, done: int, total: int) -> int:
    """Where a scan stands."""
    lo, hi = PHASES[phase]
    return hi if total <= 0 else int(lo + (hi - lo) * min(done, total) / total)


def job_progress(spark: SparkSession) -> tuple[int, int]:
    """(finished, all) tasks of the stages now running."""
    status = spark.sparkContext.statusTracker()
    stages = [s for i in status.getActiveStageIds() if (s := status.getStageInfo(i))]
    return sum(s.numCompletedTasks for s in stages), sum(s.numTasks for s in stages)
