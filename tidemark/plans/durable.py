"""Queries whose results outlive a batch: late counts of a stream, keyed and appended tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import values as V
from tidemark.operators import alerts, marts, quality, serving, snapshots
from tidemark.plans.adapters import frame, rounded, with_views
from tidemark.plans.scratch import folder
from tidemark.sources import generations, keyed, published
from tidemark.streaming import arrival
from tidemark.streaming import reviews as streams

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


#: Events arrive up to 22 places late; every tenth is sent once more, 50 places later; a seventh of the users send other kinds.
_PLACE = "(event_id + event_id * 7919 % 23) * 4096 + event_id % 4096"
_KIND = "CASE WHEN user_id % 7 = 0 THEN 'OTHER' ELSE 'EVENT' END"


@query(f"""WITH e AS (SELECT event_type AS stream_key, {_PLACE} AS place, event_id, {_KIND} AS kind, CAST(ts AS TIMESTAMP) AS t FROM events),
r AS (SELECT *, max(CASE WHEN kind = 'EVENT' THEN t END) OVER (PARTITION BY stream_key ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM e),
f AS (SELECT stream_key, event_id, t, kind, CASE WHEN kind = 'OTHER' THEN 'ignored' WHEN t < top - INTERVAL 600 SECOND THEN 'late_dropped' WHEN t < top THEN 'late_accepted' ELSE 'accepted' END AS fate FROM r),
a AS (SELECT stream_key, fate FROM f UNION ALL SELECT stream_key, CASE WHEN fate IN ('accepted', 'late_accepted') THEN 'duplicate' ELSE fate END FROM f WHERE event_id % 10 = 0)
SELECT stream_key, {', '.join(f"sum(CASE WHEN fate = '{x}' THEN 1 ELSE 0 END)::BIGINT AS {x}" for x in arrival.FATES)}, strftime((SELECT max(t) FROM f WHERE f.stream_key = a.stream_key AND kind = 'EVENT') - INTERVAL 600 SECOND, '%Y-%m-%d %H:%M:%S.%f') AS watermark FROM a GROUP BY stream_key""")
def stream_lateness(spark: SparkSession, sf: str) -> DataFrame:
    """Late counts of a stream that is stopped and started again on its checkpoint, where the source sends the second part's first events twice."""
    at = folder(spark)
    e = spark.read.parquet(f"{sf}/events.parquet").selectExpr("event_type AS stream_key", f"{_PLACE} AS position", "CAST(event_id AS STRING) AS event_key", f"{_KIND} AS event_type", "CAST(ts AS TIMESTAMP) AS event_time", "event_id")
    sent = e.union(e.where("event_id % 10 = 0").withColumn("position", F.col("position") + 50 * 4096)).drop("event_id")
    middle = sent.agg(F.max("position")).first()[0] // 2
    parts = [sent.where(F.col("position") < middle), sent.where(F.col("position") >= middle)]
    for part in parts:
        part.write.mode("append").parquet(f"{at}/in")
        arrival.start(spark.readStream.schema(sent.schema).parquet(f"{at}/in"), f"{at}/out", f"{at}/checkpoint", remember=366 * 86_400).awaitTermination()
    counts = arrival.counts(arrival.read(spark, f"{at}/out"))
    return counts.withColumn("watermark", F.date_format("watermark", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@query(f"""{with_views('raw_reviews')}, m AS (SELECT sha256(coalesce(product_id, '') || '|' || coalesce(rating, '')) AS payload_sha256, ingested_at AS quarantined_at FROM raw_reviews)
SELECT payload_sha256, max(quarantined_at) AS quarantined_at FROM m GROUP BY 1""")
def quarantine_across_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Messages of three batches, the second of which comes twice: one row a digest, the newest sight of each."""
    at = folder(spark)
    rows = frame(spark, sf, "raw_reviews").select(F.sha2(F.concat_ws("|", F.coalesce("product_id", F.lit("")), F.coalesce("rating", F.lit(""))), 256).alias("payload_sha256"), F.col("ingested_at").alias("quarantined_at"))
    sink = streams.quarantine_sink(at)
    year = F.substring("quarantined_at", 1, 4)
    batches = [rows.where(year < "1995"), rows.where(year > "1996"), rows.where((year >= "1995") & (year <= "1996"))]
    for n in (0, 1, 1, 2):
        sink(batches[n], n)
    return streams.read_quarantine(spark, at).select("payload_sha256", "quarantined_at")


@query(f"{with_views('prices')} SELECT CAST(extract(year FROM timestamp) AS VARCHAR) AS batch_id, 'prices' AS dataset, count(*) AS total, {rounded('100.0 * sum(CASE WHEN price BETWEEN 5000 AND 50000 THEN 1 ELSE 0 END) / count(*)')} AS dq_score FROM prices GROUP BY 1")
def quality_history(spark: SparkSession, sf: str) -> DataFrame:
    """A report a year, each first made over half of its rows and then again over all: the later one of a batch stays."""
    at = folder(spark)
    prices = frame(spark, sf, "prices").select("price", F.date_format("timestamp", "yyyy").alias("batch_id"))
    fit = F.count_if(F.col("price").between(5000, 50000))
    measured = lambda df: df.groupBy("batch_id").agg(F.lit("prices").alias("dataset"), F.count("*").alias("total"), F.round(100 * fit / F.count("*"), 2).alias("dq_score"))
    for run, df in enumerate((prices.where("price > 20000"), prices)):
        quality.save_reports(measured(df).withColumns({"run_id": F.lit(f"run-{run}"), "measured_at": F.timestamp_seconds(F.lit(run))}), at)
    return quality.saved_reports(spark, at).select("batch_id", "dataset", "total", "dq_score")


@query(f"{with_views('prices')}, v AS (SELECT year(timestamp) AS y, count(*) AS n, sum(price) AS s FROM prices GROUP BY 1) SELECT CAST(a.y - (SELECT min(y) FROM v) AS BIGINT) AS version, CAST(sum(b.n) AS BIGINT) AS n_rows, CAST(count(*) AS BIGINT) AS n_folders FROM v a JOIN v b ON b.y <= a.y GROUP BY a.y")
def appended_versions(spark: SparkSession, sf: str) -> DataFrame:
    """A year an append: every version is readable, and each append has written its own rows only."""
    at = folder(spark)
    prices = frame(spark, sf, "prices").withColumn("y", F.year("timestamp"))
    for y in [r[0] for r in prices.select("y").distinct().orderBy("y").collect()]:
        published.publish(prices.where(F.col("y") == y), at, "append")
    out = None
    for c in published.history(spark, at):  # a row a version
        n = published.read(spark, at, c["version"]).agg(F.lit(c["version"]).cast("long").alias("version"), F.count("*").alias("n_rows"), F.lit(len(published.folders(c))).cast("long").alias("n_folders"))
        out = n if out is None else out.union(n)
    return out


@query(f"{with_views('prices')} SELECT price_id, product_id, price FROM prices QUALIFY row_number() OVER (PARTITION BY price_id ORDER BY timestamp DESC, product_id DESC, price DESC) = 1")
def keyed_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Prices merged year by year into a keyed table, the years in falling order: the newest row of a key stays."""
    at = folder(spark)
    prices = frame(spark, sf, "prices").select("price_id", "product_id", "price", "timestamp").withColumn("y", F.year("timestamp"))
    for n, y in enumerate([r[0] for r in prices.select("y").distinct().orderBy(F.desc("y")).collect()]):
        keyed.merge(prices.where(F.col("y") == y).drop("y"), at, ["price_id"], "timestamp", "product_id", "price", batch_id=n)
    return keyed.read(spark, at).select("price_id", "product_id", "price")


_DAILY = "SELECT product_id, count(*) AS n, {total} AS total FROM prices GROUP BY 1"


@query(f"{with_views('prices')} {_DAILY.format(total=rounded('sum(price)'))}")
def generation_in_use(spark: SparkSession, sf: str) -> DataFrame:
    """Totals rebuilt twice and promoted; then a plan of other settings is promoted and taken back, and one whose replays differ is refused."""
    at = folder(spark)
    prices = frame(spark, sf, "prices")

    def build(times: int):
        return lambda x: {"totals": x["prices"].groupBy("product_id").agg(F.count("*").alias("n"), F.sum(F.col("price").cast("decimal(28,10)") * times).alias("total"))}

    plans = {1: generations.plan({"prices": prices}, {"times": 1})}
    plans[2] = generations.varied(plans[1], {"times": 2})
    for name, plan, times in (("a", 1, 1), ("b", 1, 1), ("c", 2, 2), ("d", 2, 2), ("e", 2, 3)):
        generations.replay(spark, at, name, plans[plan], {"prices": prices}, build(times))
    generations.promote(spark, at, "a", "b", expected=None)
    generations.promote(spark, at, "c", "d", expected="a")
    try:
        generations.promote(spark, at, "c", "e", expected="c")
        raise AssertionError("replays that differ were promoted")
    except generations.Refused:
        generations.rollback(spark, at)
    return generations.read(spark, at, "totals").select("product_id", "n", F.round("total", 2).cast("double").alias("total"))


_BROKEN = {
    "INVALID_TYPE_RATING": ("rating", "'bad'"), "INVALID_TYPE_TIMESTAMP": ("review_date", "'soon'"), "MISSING_REVIEW_ID": ("review_id", "' '"), "MISSING_PRODUCT_ID": ("product_id", "NULL"),
    "MISSING_REVIEW_TEXT": ("review_text", "''"), "INVALID_RATING_OUT_OF_RANGE": ("rating", "'9'"), "MISSING_EVENT_TIME": ("review_date", "NULL"), "INVALID_SOURCE_METADATA": ("acquisition_method", "'generated'"),
}


@query("SELECT event_id, CASE event_id % 9 " + " ".join(f"WHEN {i} THEN '{r}'" for i, r in enumerate(_BROKEN)) + " END AS reason, 0 AS leaks, CASE WHEN event_id % 9 < 8 THEN event_type END AS kept FROM events")
def stream_reasons(spark: SparkSession, sf: str) -> DataFrame:
    """Messages with one fault of each kind and personal fields three levels deep: their reasons, and what the quarantine shows of them."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    plain = {"review_id": "CAST(event_id AS STRING)", "product_id": "event_type", "rating": "'4'", "review_text": "'t'", "review_date": "CAST(ts AS STRING)", "source_group": "'marketplace'", "acquisition_method": "'live'"}
    made = {c: "CASE event_id % 9 " + " ".join(f"WHEN {i} THEN {v}" for i, (f, v) in enumerate(_BROKEN.values()) if f == c) + f" ELSE {x} END" if any(f == c for f, _ in _BROKEN.values()) else x for c, x in plain.items()}
    deep = "named_struct('id', event_id, 'list', array(named_struct('Email', 'secret', 'contact', named_struct('ip_address', 'secret', 'kind', event_type)))) AS trace"
    value = e.selectExpr("event_id", *[f"{x} AS {c}" for c, x in made.items()], "'secret' AS user_id", deep)
    fields = F.struct(*[c for c in value.columns if c != "event_id"])
    messages = value.select(F.to_json(F.struct(fields.alias("payload"), F.lit("secret").alias("avatar_url"))).alias("value"))
    good, bad = streams.split(streams.parsed(messages))
    at = lambda path: F.get_json_object("payload", path)
    shown = bad.select(at("$.trace.id").cast("long").alias("event_id"), "reason", F.when(F.concat("payload", F.coalesce("envelope", F.lit(""))).contains("secret"), 1).otherwise(0).alias("leaks"), at("$.trace.list[0].contact.kind").alias("kept"))
    return good.select(F.col("review_id").cast("long").alias("event_id"), F.lit(None).cast("string").alias("reason"), F.lit(0).alias("leaks"), F.lit(None).cast("string").alias("kept")).union(shown)


_NOW = "TIMESTAMP '1998-08-03 00:00:00'"


@query(f"""{with_views('runs')}, r AS (SELECT pipeline, source, status, ended_at, run FROM runs), s AS (SELECT pipeline, source, arg_max(status, struct_pack(e := ended_at, r := run)) AS last_status, max(CASE WHEN status = 'success' THEN ended_at END) AS last_success FROM r GROUP BY 1, 2)
SELECT pipeline, source, 'failed' AS alert, 'critical' AS severity FROM s WHERE last_status = 'failed' UNION ALL SELECT pipeline, source, 'stale', 'warning' FROM s WHERE epoch({_NOW}) - epoch(last_success) > 93600 UNION ALL SELECT pipeline, source, 'never_succeeded', 'warning' FROM s WHERE last_success IS NULL""")
def pipeline_alerts(spark: SparkSession, sf: str) -> DataFrame:
    """Pipelines whose last run failed, or that have had no success for 26 hours."""
    runs = frame(spark, sf, "runs")
    status = runs.groupBy("pipeline", "source").agg(F.max_by("status", F.struct("ended_at", "run")).alias("last_status"), F.max(F.when(F.col("status") == "success", F.col("ended_at"))).alias("last_success"), F.min("ended_at").alias("expected_since"))
    return alerts.pipeline_alerts(status, F.expr(_NOW))


@query("""WITH e AS (SELECT 'consumer_lag' AS metric, event_type AS labels, CAST(ts AS TIMESTAMP) AS t, event_id, CASE WHEN event_id % 97 = 5 THEN 0 ELSE 900 + value * 10 END AS v FROM events),
n AS (SELECT labels, max(t) AS newest, arg_max(v, t) AS v, max(CASE WHEN NOT v > 1000 THEN t END) AS broken FROM e GROUP BY 1),
s AS (SELECT n.labels, newest, n.v, min(t) AS since FROM n JOIN e ON e.labels = n.labels AND (broken IS NULL OR e.t > broken) GROUP BY 1, 2, 3)
SELECT 'consumer_backlog' AS alert, labels, strftime(since, '%Y-%m-%d %H:%M:%S') AS since, v AS value FROM s WHERE epoch(date_trunc('second', newest)) - epoch(date_trunc('second', since)) >= 600""")
def metric_alerts(spark: SparkSession, sf: str) -> DataFrame:
    """Events as samples of a backlog: kinds that have been above the threshold for ten minutes and still are."""
    e = spark.read.parquet(f"{sf}/events.parquet").selectExpr("'consumer_lag' AS metric", "event_type AS labels", "CAST(ts AS TIMESTAMP) AS at", "CASE WHEN event_id % 97 = 5 THEN 0 ELSE 900 + value * 10 END AS value")
    return alerts.fired(e).select("alert", "labels", F.date_format("since", "yyyy-MM-dd HH:mm:ss").alias("since"), "value")


_LEFT, _RIGHT = "CAST(product_id AS BIGINT) % 13 > 0", "CAST(product_id AS BIGINT) % 17 > 0"


@query(f"""{with_views('products')}, b AS (SELECT product_id, brand, price FROM products WHERE {_LEFT}), a AS (SELECT product_id, brand, CASE WHEN CAST(product_id AS BIGINT) % 11 = 0 THEN price + 1 ELSE price END AS price FROM products WHERE {_RIGHT}),
d AS (SELECT coalesce(a.product_id, b.product_id) AS k, CASE WHEN b.product_id IS NULL THEN 'added' WHEN a.product_id IS NULL THEN 'removed' WHEN a.price <> b.price THEN 'changed' END AS c FROM a FULL JOIN b ON a.product_id = b.product_id)
SELECT 'products' AS table_name, (SELECT count(*) FROM b) AS rows_before, (SELECT count(*) FROM a) AS rows_after, sum(CASE WHEN c = 'added' THEN 1 ELSE 0 END)::BIGINT AS added_keys, sum(CASE WHEN c = 'removed' THEN 1 ELSE 0 END)::BIGINT AS removed_keys, sum(CASE WHEN c = 'changed' THEN 1 ELSE 0 END)::BIGINT AS changed_keys,
 (SELECT string_agg('{{"product_id":"' || k || '"}}', ' ' ORDER BY '{{"product_id":"' || k || '"}}') FROM (SELECT k FROM d WHERE c = 'changed' ORDER BY '{{"product_id":"' || k || '"}}' LIMIT 10)) AS changed_examples, 'changed' AS status FROM d
UNION ALL SELECT 'same', count(*), count(*), 0, 0, 0, '', 'equal' FROM b""")
def snapshot_report(spark: SparkSession, sf: str) -> DataFrame:
    products = frame(spark, sf, "products").select("product_id", "brand", "price")
    after = products.where(_RIGHT).withColumn("price", F.when(F.expr("CAST(product_id AS BIGINT) % 11 = 0"), F.col("price") + 1).otherwise(F.col("price")))
    before = products.where(_LEFT)
    out = snapshots.comparison_report({"products": (before, after, ["product_id"]), "same": (before, before, ["product_id"])})
    return out.select(F.col("table").alias("table_name"), "rows_before", "rows_after", "added_keys", "removed_keys", "changed_keys", F.array_join("changed_examples", " ").alias("changed_examples"), "status")


@query(f"{with_views('raw_reviews')} SELECT review_id, count(*) AS n FROM raw_reviews GROUP BY 1 HAVING count(*) > 1")
def repeated_keys(spark: SparkSession, sf: str) -> DataFrame:
    return marts.repeated(frame(spark, sf, "raw_reviews"), "review_id")


@query(f"{with_views('raw_prices')} SELECT price_id, sha256('{{{{\"price_id\":\"' || price_id || '\",\"product_id\":\"' || product_id || '\"}}}}') AS digest FROM raw_prices".replace("{{", "{").replace("}}", "}"))
def record_ids(spark: SparkSession, sf: str) -> DataFrame:
    """A row's own digest over its fields in name order."""
    return frame(spark, sf, "raw_prices").select("price_id", V.record_digest("product_id", "price_id").alias("digest"))


@query(f"{with_views('products')} SELECT product_id, product_name FROM products WHERE contains(lower(product_name), 'a') AND lower(source_group) = 'marketplace' AND price >= 910")
def filtered_search(spark: SparkSession, sf: str) -> DataFrame:
    """A text in any case, an equality in any case, a floor, and all that is found."""
    rows = frame(spark, sf, "products").withColumn("rating", F.col("price"))
    return serving.find(rows, "A", ["product_name"], min_rating=910, filters={"source_group": "MarketPlace"}, limit=2**31 - 1).select("product_id", "product_name")
