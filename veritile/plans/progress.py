"""How far a batch is, on standard error."""

from __future__ import annotations

import sys
import threading
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


def tasks(spark: SparkSession) -> tuple[int, int]:
    """Tasks that are done and all tasks, over the stages that run now."""
    tracker = spark.sparkContext.statusTracker()
    known = [s for s in map(tracker.getStageInfo, tracker.getActiveStageIds()) if s]
    return sum(s.numCompletedTasks for s in known), sum(s.numTasks for s in known)


@contextmanager
def shown(spark: SparkSession, every: float = 1.0, out=None) -> Iterator[None]:
    """While the block runs, a line tells how many tasks are done; it ends with the block."""
    stream, ended, said = out or sys.stderr, threading.Event(), []

    def watch() -> None:
        while not ended.wait(every):
            done, total = tasks(spark)
            if total:
                stream.write(f"\r{done}/{total} tasks done")
                stream.flush()
                said.append(done)

    thread = threading.Thread(target=watch, daemon=True)
    thread.start()
    try:
        yield
    finally:
        ended.set()
        thread.join()
        if said:
            stream.write("\n")
