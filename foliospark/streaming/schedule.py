"""Running the indexing job again and again: a rate stream is the clock, each micro-batch is one run."""

from __future__ import annotations

import threading

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from foliospark.config import Settings
from foliospark.plans.indexing import run_indexing

_RUNNING = threading.Lock()


def run_once(spark: SparkSession, settings: Settings, job_type: str = "manual") -> dict[str, int] | None:
    """One run, or None while another is under way."""
    if not _RUNNING.acquire(blocking=False):
        return None
    try:
        return run_indexing(spark, settings, job_type)
    finally:
        _RUNNING.release()


def start(spark: SparkSession, settings: Settings, seconds: int = 300, checkpoint: str | None = None) -> StreamingQuery:
    """A streaming query that runs the job every ``seconds``; stop it with ``query.stop()``.

    The folder is listed in full each time, since a file stream reports neither changed nor deleted files.
    """
    if not 10 <= seconds <= 86400:
        raise ValueError("seconds must be between 10 and 86400")
    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    writer = clock.writeStream.foreachBatch(lambda _, n: run_once(spark, settings, "startup" if n == 0 else "periodic"))
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    return writer.trigger(processingTime=f"{seconds} seconds").start()
