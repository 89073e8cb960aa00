"""What became of each event of a stream, by the order of arrival: exact late counts in a stateful operator.

Spark's own watermark moves once a trigger and counts nothing an event. Here each stream key
(a partition of the source, in which alone arrival has an order) has its newest event time
and the ids that it has seen in state, and every event gets a fate against the events
before it, whatever the triggers: the same rows in any number of triggers, before or after
a restart, have the same fates.

ignored: another kind of event; repeated: the source sent this position before;
duplicate: its id has been accepted; late_dropped: older than the newest time by more than
the delay; late_accepted: older, but not by so much; accepted: all others. Events without a
time are accepted, events without an id are never duplicates. An id is remembered until its
time is older than the watermark by more than `remember` seconds; ids that are forgotten
count as new from then on, whenever their entry is deleted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tidemark.streaming.reviews import KINDS

FATES = ("accepted", "late_accepted", "late_dropped", "duplicate", "repeated", "ignored")
#: stream_key, position, event_key, event_time (microseconds), event_type, and what fates() adds.
INPUT = ("stream_key", "position", "event_key", "event_time", "event_type")
OUTPUT = "stream_key string, position long, event_key string, event_time long, fate string, watermark long"
#: Settings that a query takes over when it starts: the store that the operator needs, and no batches for timers alone, which would have no end.
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}
SECOND = 1_000_000


class Fates(StatefulProcessor):
    """One stream key: newest event time, last position, ids with their times."""

    def __init__(self, delay: int, remember: int, cleaning: int = 600) -> None:
        self.delay, self.remember, self.cleaning = delay * SECOND, remember * SECOND, cleaning * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.clock = handle.getValueState("clock", "newest long, last long")
        self.seen = handle.getMapState("seen", "event_key string", "event_time long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        newest, last = self.clock.get() if self.clock.exists() else (None, None)
        if last is None and not list(self.handle.listTimers()):
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.cleaning)
        arrived = pd.concat(list(rows)).sort_values("position", kind="stable")  # a trigger's rows of one source partition
        fates, marks = [], []
        for position, ident, at, kind in zip(arrived["position"], arrived["event_key"], arrived["event_time"], arrived["event_type"], strict=True):
            at = None if pd.isna(at) else int(at)
            fate, newest = self._fate(position, None if pd.isna(ident) else ident, at, None if pd.isna(kind) else kind, newest, last)
            last = position if last is None else max(last, position)
            fates.append(fate)
            marks.append(None if newest is None else newest - self.delay)
        self.clock.update((newest, int(last)))
        out = arrived[["stream_key", "position", "event_key", "event_time"]].assign(fate=fates, watermark=pd.array(marks, "Int64"))
        yield out.assign(event_time=out["event_time"].astype("Int64"))

    def _fate(self, position: int, ident: str | None, at: int | None, kind: str | None, newest: int | None, last: int | None) -> tuple[str, int | None]:
        if last is not None and position <= last:
            return "repeated", newest
        if kind is not None and kind.upper() not in KINDS:
            return "ignored", newest
        if ident is not None and self.seen.containsKey((ident,)):
            (before,) = self.seen.getValue((ident,))
            if before is None or newest is None or before >= newest - self.delay - self.remember:
                return "duplicate", newest
        fate = "accepted"
        if at is not None and newest is not None and at < newest:
            if at < newest - self.delay:
                return "late_dropped", newest
            fate = "late_accepted"
        if ident is not None:
            self.seen.updateValue((ident,), (at,))
        return fate, newest if at is None else at if newest is None else max(newest, at)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        """Deletes the ids that are forgotten already; no fate depends on when."""
        newest = self.clock.get()[0] if self.clock.exists() else None
        if newest is not None:
            old = [k for k, (at,) in self.seen.iterator() if at is not None and at < newest - self.delay - self.remember]
            for k in old:
                self.seen.removeKey(k)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.cleaning)
        return iter([])

    def close(self) -> None:
        pass


def fates(events: DataFrame, delay: int = 600, remember: int = 86_400) -> DataFrame:
    """A stream of events (INPUT; event_time a timestamp) with fate and watermark; reviews.lateness() counts in a batch."""
    rows = events.select(F.col("stream_key").cast("string").alias("stream_key"), F.col("position").cast("long").alias("position"), F.col("event_key").cast("string").alias("event_key"), F.unix_micros(F.col("event_time").cast("timestamp")).alias("event_time"), F.col("event_type").cast("string").alias("event_type"))
    judged = rows.groupBy("stream_key").transformWithStateInPandas(Fates(delay, remember), OUTPUT, "Append", "ProcessingTime")
    return judged.withColumns({"event_time": F.timestamp_micros("event_time"), "watermark": F.timestamp_micros("watermark")})


def with_settings(spark: SparkSession, work: Callable[[], StreamingQuery]) -> StreamingQuery:
    """work() under SETTINGS; other queries of the session keep theirs."""
    before = {k: spark.conf.get(k) for k in SETTINGS}
    try:
        for k, v in SETTINGS.items():
            spark.conf.set(k, v)
        return work()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def start(events: DataFrame, path: str, checkpoint: str, delay: int = 600, remember: int = 86_400, every: str | None = None) -> StreamingQuery:
    """Writes fates below path, a folder a batch, which a batch that comes again overwrites; every: a trigger's interval, else all that is there now."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    trigger = {"processingTime": every} if every else {"availableNow": True}
    writer = fates(events, delay, remember).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(**trigger)
    return with_settings(events.sparkSession, writer.start)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("batch")


def counts(judged: DataFrame) -> DataFrame:
    """stream_key and its events by fate, with the newest watermark."""
    return judged.groupBy("stream_key").agg(*[F.count_if(F.col("fate") == f).alias(f) for f in FATES], F.max("watermark").alias("watermark"))
