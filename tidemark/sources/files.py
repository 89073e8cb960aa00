"""Reading raw files of several formats, and making test data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources import delimited

# Identity columns that are text in every format.
IDENTITIES = ("product_id", "review_id", "user_id", "price_id", "event_id", "customer_id", "seller_id")


def read_json(spark: SparkSession, *paths: str, schema: T.StructType | str | None = None, lines: bool = False) -> DataFrame:
    """JSON files (one document each, an array or an object) and JSON lines (.jsonl, .ndjson, also gzipped), by name below the paths; malformed text is an error.

    lines: all files are JSON lines whatever their names, as Spark's own writer makes them.
    """
    base = spark.read.option("recursiveFileLookup", "true").option("mode", "FAILFAST")
    if schema is not None:
        base = base.schema(schema)
    if lines:
        return base.json(list(paths))
    found = [p for p in ("*.json", "*.json.gz") if _any(spark, paths, p)]
    by_line = [p for p in ("*.jsonl", "*.ndjson", "*.jsonl.gz", "*.ndjson.gz") if _any(spark, paths, p)]
    frames = []
    if found:
        frames.append(base.option("multiLine", "true").option("pathGlobFilter", "*.{json,json.gz}").json(list(paths)))
    if by_line:
        frames.append(base.option("multiLine", "false").option("pathGlobFilter", "*.{jsonl,ndjson,jsonl.gz,ndjson.gz}").json(list(paths)))
    if not frames:
        if schema is None:
            raise FileNotFoundError(f"no JSON below {', '.join(paths)}")
        return spark.createDataFrame([], schema)
    out = frames[0]
    return out.unionByName(frames[1], allowMissingColumns=True) if len(frames) > 1 else out


def _any(spark: SparkSession, paths: tuple[str, ...], pattern: str) -> bool:
    names = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(list(paths)).select("path")
    return not names.isEmpty()


def load(spark: SparkSession, path: str, kind: str | None = None, sep: str | None = None, encoding: str | None = None) -> DataFrame:
    """A CSV, TSV, JSON, JSON lines or Parquet file or folder; identity columns are text. CSV has a header and text columns only; its encoding and separator are found if they aren't stated."""
    kind = kind or path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind in ("csv", "tsv", "txt"):
        return delimited.read(spark, path, encoding=encoding, separator=sep or ("\t" if kind == "tsv" else None), pattern="*")
    if kind == "parquet":
        df = spark.read.parquet(path)
    elif kind in ("json", "jsonl", "ndjson"):
        df = spark.read.option("multiLine", str(kind == "json").lower()).option("mode", "FAILFAST").json(path)
    else:
        raise ValueError(f"unknown kind {kind}")
    renamed = df.toDF(*[c.lstrip(delimited.MARK).strip() for c in df.columns])
    return renamed.withColumns({c: F.col(c).cast("string") for c in IDENTITIES if c in renamed.columns})


def records(df: DataFrame) -> DataFrame:
    """value: each row as JSON without its null fields."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "true"}).alias("value"))


def envelope(df: DataFrame, event_type: str, source: str, clock: str, schema_version: str = "1.0") -> DataFrame:
    """Rows as messages: event_id (digest of the payload), type, version, source, clocks, payload."""
    payload = F.struct(*[F.col(c) for c in df.columns])
    return df.select(
        F.sha2(F.concat_ws("|", F.lit(event_type), F.to_json(payload)), 256).alias("event_id"), F.lit(event_type).alias("event_type"), F.lit(schema_version).alias("schema_version"),
        F.lit(source).alias("source"), F.col(clock).cast("string").alias("event_time"), F.current_timestamp().cast("string").alias("ingested_at"), payload.alias("payload"),
    )


def recent(spark: SparkSession, path: str, n: int = 100) -> DataFrame:
    """The n newest rows by their files' modification time."""
    df = spark.read.option("recursiveFileLookup", "true").json(path)
    return df.select("*", F.col("_metadata.file_modification_time").alias("_at"), F.col("_metadata.file_path").alias("_file")).orderBy(F.desc("_at"), "_file").limit(n).drop("_at", "_file")


def layer_stats(spark: SparkSession, path: str) -> DataFrame:
    """files, bytes below a folder, without reading contents."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def _uniform(seed: int, *parts: str) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), *[F.col(p) for p in parts]), F.lit(1_000_000)) / 1_000_000


def make_products(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """Deterministic products, whatever the partitions."""
    pick = lambda xs, salt: F.get(F.array(*[F.lit(x) for x in xs]), F.floor(_uniform(seed + salt, "id") * len(xs)).cast("int"))
    return spark.range(n).select(
        F.format_string("P%06d", "id").alias("product_id"), F.format_string("Product %d", "id").alias("product_name"), pick(["Apple", "Samsung", "Xiaomi", "Sony"], 1).alias("brand"),
        pick(["Smartphone", "Laptop", "Tablet", "Accessories"], 2).alias("category"), F.round(50 + 1950 * _uniform(seed + 3, "id"), 2).alias("price"), F.lit("USD").alias("currency"), F.lit("simulation").alias("source_group"),
    )


def make_reviews(spark: SparkSession, n: int, products: int, seed: int = 42, dirty: float = 0.05, repeated: float = 0.03, days: int = 60) -> DataFrame:
    """Deterministic reviews as text, with shares of broken and repeated rows."""
    u = {k: _uniform(seed + i, "id") for i, k in enumerate(("product", "rating", "time", "dirty", "repeat"))}
    ident = F.when(u["repeat"] < repeated, F.greatest(F.col("id") - 1, F.lit(0))).otherwise(F.col("id"))
    broken = u["dirty"] < dirty
    at = F.timestamp_seconds(F.lit(1_767_225_600) + F.floor(u["time"] * days * 86400))
    return spark.range(n).select(
        F.format_string("R%09d", ident).alias("review_id"), F.format_string("P%06d", F.floor(u["product"] * products)).alias("product_id"),
        F.when(broken, F.lit("9")).otherwise((1 + F.floor(u["rating"] * 5)).cast("string")).alias("rating"), F.concat(F.lit("review "), F.col("id").cast("string")).alias("review_text"),
        F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("review_date"), F.concat(F.lit("user"), (F.col("id") % 997).cast("string")).alias("user_id"),
    )


def amplified(base: DataFrame, n: int, ident: str, prefix: str) -> DataFrame:
    """About n rows, a whole number of copies of each of base's, with ids of their own (the old one and the copy's number)."""
    size = base.count()
    copies = -(-n // size) if size else 0
    return base.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(copies)))).withColumn(ident, F.concat_ws("-", F.lit(prefix), F.col(ident), "_copy")).drop("_copy") if copies else base


def spread(i: Column, share: float) -> Column:
    """Whether row i (from 0) is one of a share of rows, evenly spread: of the first n rows always floor(n * share) are."""
    exact = F.lit(str(share)).cast("decimal(20,12)")
    upto = lambda x: F.floor(x.cast("decimal(18,0)") * exact)
    return upto(i + 1) > upto(i)


# The first time of a simulation, seconds between its rows, values of dirty rows.
SIMULATED_FROM, SIMULATED_EVERY = 1_790_841_600, 2
DIRTY = (("rating", 99.0), ("price", -50000.0))


def simulated(base: DataFrame, n: int, ident: str, prefix: str, order: list[str], at: str, dirty: float = 0.01) -> DataFrame:
    """n rows from base's in turn with ids of their own; copies get new times, a share of rows an impossible rating or price, evenly spread; the first two rows stand once more, if there are five.

    Written below at on the way, to number base's rows by order.
    """
    from tidemark.operators import ranks

    if not 0 <= dirty <= 1 or n < 0:
        raise ValueError("dirty is a share, n no negative number")
    size = base.count()
    if not size or not n:
        return base.limit(0)
    numbers = base.sparkSession.range(n).select("id", (F.col("id") % size).alias("position"))
    rows = ranks.numbered(base, f"{at}/base", *order).join(numbers, "position")
    new = {ident: F.format_string(f"{prefix}_sim_%07d", "id")}
    clock = next((c for c in ("review_date", "timestamp") if c in base.columns), None)
    if clock:
        sent = F.date_format(F.timestamp_seconds(F.lit(SIMULATED_FROM) + F.col("id") * SIMULATED_EVERY), "yyyy-MM-dd'T'HH:mm:ss'Z'")
        new[clock] = F.when(F.col("id") >= size, sent).otherwise(F.col(clock).cast("string"))
    value = next(((c, v) for c, v in DIRTY if c in base.columns), None)
    if value:
        kind = base.schema[value[0]].dataType
        new[value[0]] = F.when(spread(F.col("id"), dirty), F.lit(value[1]).cast(kind)).otherwise(F.col(value[0]))
    made = rows.withColumns(new)
    return (made.union(made.where("id < 2")) if n >= 5 else made).select(base.columns)


def make_prices(spark: SparkSession, products: int, days: int = 30, seed: int = 42, glitch_every: int = 7) -> DataFrame:
    """A price a product and day that moves by up to 2 percent about its level; every so many products have one day at a tenth of it."""
    base = 50 + 1950 * _uniform(seed + 3, "p")
    day = spark.range(products).withColumnRenamed("id", "p").withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(days - 1))))
    glitch = (F.col("p") % glitch_every == 0) & (F.col("d") == F.floor(_uniform(seed + 5, "p") * days))
    price = F.round(base * (0.98 + 0.04 * _uniform(seed + 7, "p", "d")) * F.when(glitch, 0.1).otherwise(1.0), 2)
    at = F.timestamp_seconds(F.lit(1_767_225_600) + F.col("d") * 86400)
    return day.select(F.format_string("PR%06d%03d", "p", "d").alias("price_id"), F.format_string("P%06d", "p").alias("product_id"), price.alias("price"), F.lit("USD").alias("currency"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), glitch.alias("glitch"))


def make_bursts(spark: SparkSession, products: int, hours: int = 48, seed: int = 42, burst_every: int = 5, size: int = 40) -> DataFrame:
    """One or two reviews a product and hour; every so many products have one hour, in the second half, of many reviews with one star."""
    hour = spark.range(products).withColumnRenamed("id", "p").withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(hours - 1))))
    burst = (F.col("p") % burst_every == 0) & (F.col("h") == hours // 2 + F.floor(_uniform(seed + 5, "p") * (hours - hours // 2)))
    n = F.when(burst, size).otherwise(1 + F.floor(_uniform(seed + 7, "p", "h") * 2)).cast("int")
    rows = hour.withColumn("burst", burst).withColumn("i", F.explode(F.sequence(F.lit(1), n)))
    at = F.timestamp_seconds(F.lit(1_767_225_600) + F.col("h") * 3600 + F.col("i"))
    stars = F.when(F.col("burst"), 1).otherwise(3 + F.floor(_uniform(seed + 9, "p", "h", "i") * 3))
    return rows.select(F.format_string("R%06d-%03d-%03d", "p", "h", "i").alias("review_id"), F.format_string("P%06d", "p").alias("product_id"), stars.cast("string").alias("rating"), F.lit("text").alias("review_text"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("review_date"), "burst")


def stream_events(reviews: DataFrame, source: str = "simulation") -> DataFrame:
    """value: reviews as messages of a stream."""
    return records(envelope(reviews, "NEW_REVIEW", source, "review_date"))


def parquet_if_present(spark: SparkSession, path: str) -> DataFrame | None:
    """A Parquet table, or None where there is no such path; any other failure is raised."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def restamped(df: DataFrame, clocks: list[str]) -> DataFrame:
    """Rows for a replay: each clock is moved by one span, so that the newest value of the first clock becomes now."""
    at = df.agg(F.max(F.col(clocks[0]).cast("timestamp")).alias("_newest"))  # one row
    moved = {c: F.timestamp_micros(F.unix_micros(F.col(c).cast("timestamp")) + F.unix_micros(F.current_timestamp()) - F.unix_micros("_newest")) for c in clocks}
    return df.crossJoin(F.broadcast(at)).withColumns(moved).drop("_newest")


def to_kafka(messages: DataFrame, servers: str, topic: str, key: str = "event_id") -> None:
    """Sends envelopes as JSON, acknowledged by all replicas."""
    out = messages.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct("*")).alias("value"))
    out.write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).option("kafka.acks", "all").save()


def mapped(df: DataFrame, fields: dict[str, list[str]]) -> DataFrame:
    """Columns by name from the first of several sources that isn't null: a column, a nested field (a.b), or a path into a JSON text column (a:$.b[0].c)."""

    def pick(source: str) -> Column:
        column, _, path = source.partition(":")
        return F.get_json_object(column, path) if path else F.col(column).cast("string")

    return df.select(*[F.coalesce(*map(pick, sources)).alias(name) for name, sources in fields.items()])
