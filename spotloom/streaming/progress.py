"""How far work has come: of stages that run, asked of Spark's status, and of streams, as Spark tells it."""

from __future__ import annotations

import contextlib
import threading
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.streaming.listener import QueryIdleEvent, QueryProgressEvent, QueryStartedEvent, QueryTerminatedEvent, StreamingQueryListener

#: A stage's number, tasks that are done, and all of its tasks.
Tell = Callable[[int, int, int], None]


@contextlib.contextmanager
def watched(spark: SparkSession, tell: Tell, every: float = 0.2) -> Iterator[None]:
    """Within, tells of each running stage whenever more of its tasks are done."""
    over, last = threading.Event(), {}
    status = spark.sparkContext.statusTracker()

    def look() -> None:
        for stage in status.getActiveStageIds():
            info = status.getStageInfo(stage)
            if info is not None and last.get(stage) != info.numCompletedTasks:
                last[stage] = info.numCompletedTasks
                tell(stage, info.numCompletedTasks, info.numTasks)

    def poll() -> None:
        while not over.wait(every):
            look()

    thread = threading.Thread(target=poll, daemon=True)
    thread.start()
    try:
        yield
    finally:
        over.set()
        thread.join()


@contextlib.contextmanager
def between(spark: SparkSession, tell: Callable[[int, str], None], low: int, high: int, label: str) -> Iterator[None]:
    """Within, tells percents that rise from low towards high as tasks of stages get done, and high at the end.

    How many stages a step has is not known ahead, so each stage takes half of what is left.
    """
    tell(low, label)
    told, floor, stages = low, {}, []

    def hear(stage: int, done: int, tasks: int) -> None:
        nonlocal told
        if stage not in floor:
            floor[stage] = high - (high - low) / 2 ** len(stages)
            stages.append(stage)
        percent = int(floor[stage] + (high - floor[stage]) / 2 * done / max(1, tasks))
        if percent > told:
            told = percent
            tell(percent, label)

    with watched(spark, hear):
        yield
    tell(high, label)


class StreamProgress(StreamingQueryListener):
    """Tells of each micro-batch of each stream: its query's name, number, rows read and rows a second."""

    def __init__(self, tell: Callable[[str, int, int, float], None]) -> None:
        self.tell = tell

    def onQueryStarted(self, event: QueryStartedEvent) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event: QueryProgressEvent) -> None:  # noqa: N802
        p = event.progress
        self.tell(p.name or str(p.id), p.batchId, p.numInputRows, p.processedRowsPerSecond)

    def onQueryIdle(self, event: QueryIdleEvent) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event: QueryTerminatedEvent) -> None:  # noqa: N802
        pass
