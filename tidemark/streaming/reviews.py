"""Review events as streams: sources, validation, event-time windows, de-duplication, sinks.

Works on streaming and on batch DataFrames alike, so that a stream can be held against the
batch result.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions import values as V
from tidemark.operators import silver
from tidemark.sources import keyed

# Reasons in order, event kinds, window and watermark, source groups.
REASONS = ("INVALID_TYPE_RATING", "INVALID_TYPE_TIMESTAMP", "MISSING_REVIEW_ID", "MISSING_PRODUCT_ID", "MISSING_REVIEW_TEXT", "INVALID_RATING_OUT_OF_RANGE", "MISSING_EVENT_TIME", "INVALID_SOURCE_METADATA")
KINDS = ("NEW_REVIEW", "REVIEW_UPDATED", "REPLAY_REVIEW", "EVENT")
WINDOW, WATERMARK, TRIGGER = "1 minute", "10 minutes", "30 seconds"
WINDOW_BUCKETS = 16
GROUPS = {"marketplace": ("live", "snapshot_replay"), "simulation": ("generated",)}
FIELDS = ("review_id", "product_id", "rating", "review_text", "review_date", "user_id")
SOURCE = ("source_group", "acquisition_method")
PERSONAL = (*silver.PERSONAL, "user_id")

_PAYLOAD = ", ".join(f"{c} string" for c in (*FIELDS, *SOURCE))
MESSAGE = f"event_id string, event_type string, source string, event_time string, {_PAYLOAD}, payload struct<{_PAYLOAD.replace(' string', ':string')}>"


def from_kafka(spark: SparkSession, servers: str, *topics: str, starting: str = "earliest") -> DataFrame:
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", ",".join(topics)).option("startingOffsets", starting).option("failOnDataLoss", "false").load()
    return raw.select(F.col("key").cast("string"), F.col("value").cast("string"), "topic", "partition", "offset", "timestamp")


def from_files(spark: SparkSession, path: str, per_trigger: int | None = None) -> DataFrame:
    """JSON lines as value, with the file's path."""
    reader = spark.readStream.option("maxFilesPerTrigger", per_trigger) if per_trigger else spark.readStream
    return reader.text(path).select("value", F.col("_metadata.file_path").alias("topic"))


def from_json_files(spark: SparkSession, path: str, schema: str = MESSAGE, per_trigger: int | None = None, multi_line: bool = True) -> DataFrame:
    """JSON documents (an object or an array a file) or lines of that schema as value, nulls included, with the file's path; other fields are left out."""
    reader = spark.readStream.schema(schema).option("multiLine", str(multi_line).lower()).option("recursiveFileLookup", "true")
    rows = (reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader).json(path)
    return rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"), F.col("_metadata.file_path").alias("topic"))


def parsed(raw: DataFrame) -> DataFrame:
    """Messages (value: JSON, flat or with a payload) as columns; a payload's fields are authoritative, nulls included.

    conflict: the envelope and the payload name different source groups. payload_sha256 tells equal messages.
    """
    m = raw.select(F.from_json("value", MESSAGE).alias("m"), "value")
    nested = F.col("m.payload").isNotNull()
    fields = [F.when(nested, F.col(f"m.payload.{c}")).otherwise(F.col(f"m.{c}")).alias(c) for c in FIELDS]
    source = [F.coalesce(f"m.payload.{c}", f"m.{c}").alias(c) for c in SOURCE]
    conflict = F.coalesce(F.col("m.payload.source_group") != F.col("m.source_group"), F.lit(False))
    return m.select("m.event_id", "m.event_type", F.col("m.event_time").alias("event_time_raw"), *fields, *source, conflict.alias("conflict"), F.sha2("value", 256).alias("payload_sha256"), "value")


def judged(events: DataFrame) -> DataFrame:
    """Typed rating and event_time, and reason: the first that holds, or null."""
    number = V.number(F.trim("rating"))
    clock = F.coalesce(F.when(~V.blank(F.col("review_date")), F.col("review_date")), F.col("event_time_raw"))
    at = V.instant(clock)
    group, method = F.coalesce("source_group", F.lit("unverified")), F.col("acquisition_method")
    fits = group == "unverified"
    for name, methods in GROUPS.items():
        fits = fits | ((group == name) & F.coalesce(method.isin(*methods), F.lit(True)))
    holds = dict(
        zip(
            REASONS,
            (~V.blank(F.col("rating")) & ~V.finite(number), ~V.blank(clock) & at.isNull(), V.blank(F.col("review_id")), V.blank(F.col("product_id")), V.blank(F.col("review_text")), ~F.coalesce(number.between(1, 5), F.lit(False)), at.isNull(), ~fits | F.col("conflict")),
            strict=True,
        )
    )
    reason = F.lit(None).cast("string")
    for name in reversed(REASONS):
        reason = F.when(F.coalesce(holds[name], F.lit(False)), F.lit(name)).otherwise(reason)
    events = events.withColumn("reason", V.once(reason))
    return events.withColumns({"event_time": at, "source_group": group, "rating_raw": F.col("rating"), "rating": F.when(number.between(1, 5), number)})


def split(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid events, and quarantined ones with their reason and a payload without personal fields."""
    rows = judged(events)
    public = F.pandas_udf(_public, "envelope string, payload string")
    bad = rows.where("reason IS NOT NULL").select("payload_sha256", "reason", "source_group", public("value").alias("p"))
    return rows.where("reason IS NULL"), bad.select("payload_sha256", "reason", "source_group", "p.envelope", "p.payload", F.current_timestamp().alias("quarantined_at"))


def scrubbed(x: object) -> object:
    """JSON data without its personal fields, however deep they are."""
    if isinstance(x, dict):
        return {k: scrubbed(v) for k, v in x.items() if k.lower() not in PERSONAL}
    return [scrubbed(v) for v in x] if isinstance(x, list) else x


def _public(values: pd.Series) -> pd.DataFrame:
    """Of messages the envelope's and the payload's fields but the personal ones; null for what is no object."""

    def text(x: object) -> str | None:
        return json.dumps(scrubbed(x), ensure_ascii=False, separators=(",", ":")) if isinstance(x, dict) else None

    def parts(value: str | None) -> tuple[str | None, str | None]:
        try:
            whole = json.loads(value or "null")
            inner = whole.pop("payload", None) if isinstance(whole, dict) else None
            return text(whole), text(inner)
        except (ValueError, RecursionError):  # unreadable or nested without end: nothing of it is shown
            return None, None

    return pd.DataFrame([parts(v) for v in values], columns=["envelope", "payload"], dtype=object)


def distinct_reviews(events: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """The first event of each group and review; a stream remembers keys within the watermark."""
    late = events.withWatermark("event_time", watermark)
    return late.dropDuplicatesWithinWatermark(["source_group", "review_id"]) if events.isStreaming else late.dropDuplicates(["source_group", "review_id"])


def tumbling(events: DataFrame, window: str = WINDOW, *by: str) -> DataFrame:
    """Reviews, mean rating and negative ratings by window, product and group."""
    keys = by or ("product_id", "source_group")
    n = events.groupBy(F.window("event_time", window).alias("w"), *keys).agg(F.count("*").alias("review_count"), V.half_up(F.avg("rating")).alias("avg_rating"), F.count_if(F.col("rating") <= 2).alias("negative_count"))
    return n.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "review_count", "avg_rating", "negative_count")


def windowed_reviews(events: DataFrame, window: str = WINDOW, watermark: str = WATERMARK) -> DataFrame:
    return tumbling(distinct_reviews(events, watermark), window)


def value_windows(events: DataFrame, seconds: int, clock: Column, value: Column) -> DataFrame:
    """Any value by tumbling window: events with a clock, those with a finite value, their mean, events a second."""
    rows = events.select(clock.alias("t"), value.cast("double").alias("v")).where("t IS NOT NULL")
    fit = F.when(V.finite(F.col("v")), F.col("v"))
    n = rows.groupBy(F.window("t", f"{seconds} seconds").alias("w")).agg(F.count("*").alias("event_count"), F.count(fit).alias("sample_size"), V.half_up(F.avg(fit)).alias("mean_value"))
    return n.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "event_count", "sample_size", "mean_value", V.half_up(F.col("event_count") / seconds, 4).alias("rate_per_second"))


def lateness(events: DataFrame, delay_seconds: int = 600) -> DataFrame:
    """One row: events of other kinds, accepted late and dropped late against the running largest event time per partition key.

    Batch only. events: stream_key, position, event_type, event_time; position gives the order of arrival in its key.
    """
    from pyspark.sql import Window

    known = F.col("event_type").isNull() | F.col("event_type").isin(*KINDS)
    w = Window.partitionBy("stream_key").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    x = events.withColumn("ignored", ~known).withColumn("top", F.max(F.when(known, F.unix_timestamp("event_time"))).over(w)).withColumn("t", F.unix_timestamp("event_time"))
    behind = ~F.col("ignored") & (F.col("t") < F.col("top"))
    dropped = behind & (F.col("t") < F.col("top") - delay_seconds)
    return x.agg(F.count("*").alias("events"), F.count_if("ignored").alias("ignored"), F.count_if(behind & ~dropped).alias("late_accepted"), F.count_if(dropped).alias("late_dropped"))


def window_sink(path: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch: windows into a keyed table in buckets of a day and a hash of the product; only buckets that a batch touches are rewritten, and a batch that comes again changes nothing.

    A batch with several source groups is an error.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        rows = batch.persist()  # the groups are looked at before the windows are written
        try:
            groups = [r[0] for r in rows.select("source_group").distinct().limit(3).collect()]
            if len(groups) > 1:
                raise ValueError(f"mixed source groups: {sorted(groups)}")
            if groups:
                bucket = F.concat_ws("-", F.date_format("window_start", "yyyy-MM-dd"), keyed.hashed("product_id", buckets=WINDOW_BUCKETS))
                keyed.merge(rows, path, ["window_start", "product_id", "source_group"], bucket=bucket, batch_id=batch_id)
        finally:
            rows.unpersist()

    return run


def read_windows(spark: SparkSession, path: str) -> DataFrame:
    """The newest state of every window, from the folders that the last commit lists."""
    return keyed.read(spark, path)


def quarantine_sink(path: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch: quarantined messages, once each by digest over all batches, the newest sight of each kept; a batch that comes again changes nothing."""

    def run(batch: DataFrame, batch_id: int) -> None:
        keyed.merge(batch, path, ["payload_sha256"], "quarantined_at", bucket=keyed.prefix("payload_sha256"), batch_id=batch_id)

    return run


def read_quarantine(spark: SparkSession, path: str) -> DataFrame:
    return keyed.read(spark, path)


def start(raw: DataFrame, path: str, checkpoint: str, window: str = WINDOW, watermark: str = WATERMARK, mode: str = "update", available_now: bool = False, every: str = TRIGGER) -> tuple[StreamingQuery, StreamingQuery]:
    """Two queries over a raw stream, with checkpoints of their own: windows and quarantine. Started again on the same checkpoints they go on."""
    good, bad = split(parsed(raw))
    trigger = {"availableNow": True} if available_now else {"processingTime": every}
    one = windowed_reviews(good, window, watermark).writeStream.outputMode(mode).foreachBatch(window_sink(f"{path}/windows")).option("checkpointLocation", f"{checkpoint}/windows").trigger(**trigger).start()
    two = bad.writeStream.outputMode("append").foreachBatch(quarantine_sink(f"{path}/quarantine")).option("checkpointLocation", f"{checkpoint}/quarantine").trigger(**trigger).start()
    return one, two


def replayable(quarantined: DataFrame) -> DataFrame:
    """value: quarantined payloads that may be sent again, marked as a replay of a snapshot; those with unreadable payloads stay."""
    fields = F.from_json("payload", "map<string,string>")
    marked = F.map_concat(F.map_filter(fields, lambda k, _: k != "acquisition_method"), F.create_map(F.lit("acquisition_method"), F.lit("snapshot_replay")))
    return quarantined.where(fields.isNotNull()).select(F.to_json(marked).alias("value"), "reason")
