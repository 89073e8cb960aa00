"""Stored rows as a paced stream: at most so many a trigger, in their order, clocks set to the time of sending.

Spark's rate source counts, and each number is joined with the stored row of that position,
so a replay that is started again on its checkpoint goes on where it stopped.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import ranks


class Sent(NamedTuple):
    """Rows sent by this call, seconds, rows a second."""

    emitted: int
    seconds: float
    rate: float


def store(rows: DataFrame, path: str, *order: str) -> int:
    """Writes rows with their positions for replays, and returns how many."""
    placed = ranks.numbered(rows, f"{path}/ordered", *order)
    placed.write.parquet(f"{path}/rows")
    return placed.sparkSession.read.parquet(f"{path}/rows").count()


def paced(spark: SparkSession, path: str, per_trigger: int, clocks: tuple[str, ...] = ()) -> DataFrame:
    """The stored rows as a stream of at most per_trigger rows a trigger; clocks that a row has become the time of sending."""
    counted = spark.readStream.format("rate-micro-batch").options(rowsPerBatch=per_trigger, numPartitions=1).load()
    stored = spark.read.parquet(f"{path}/rows")
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    stamps = {c: F.when(F.col(c).isNotNull(), now) for c in clocks if c in stored.columns}
    return counted.select(F.col("value").alias("position")).join(stored, "position").withColumns(stamps)


def replay(spark: SparkSession, path: str, sink: Callable[[DataFrame, int], None], checkpoint: str, per_trigger: int, every: str = "1 second", clocks: tuple[str, ...] = (), limit: int | None = None, patience: float = 3600) -> Sent:
    """Sends all stored rows (or the first ones up to limit) to a foreachBatch sink, then stops; a batch may come again after a failure, with its number."""
    stored = spark.read.parquet(f"{path}/rows")
    total = stored.count() if limit is None else min(limit, stored.count())
    done, emitted = threading.Event(), [0]

    def run(batch: DataFrame, batch_id: int) -> None:
        start, end = batch_id * per_trigger, min((batch_id + 1) * per_trigger, total)
        if start < end:
            sink(batch.where(F.col("position") < total), batch_id)
            emitted[0] += end - start
        if end >= total:
            done.set()

    began = time.monotonic()
    q = paced(spark, path, per_trigger, clocks).writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
    try:
        while not done.wait(0.2):
            if not q.isActive or time.monotonic() - began > patience:
                raise RuntimeError(f"replay stopped after {emitted[0]} rows: {q.exception()}")
    finally:
        q.stop()
    seconds = max(time.monotonic() - began, 0.001)
    return Sent(emitted[0], seconds, emitted[0] / seconds)
