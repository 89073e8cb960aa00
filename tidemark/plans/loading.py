"""Queries of cleaning, contracts, envelopes and raw files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import rules as R
from tidemark.functions import values as V
from tidemark.operators import cleaning, silver
from tidemark.plans.adapters import frame, with_views
from tidemark.plans.commerce import _PARSED, _SPLIT
from tidemark.plans.scratch import folder
from tidemark.sources import delimited, files, published
from tidemark.streaming import replay

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


@query(f"{with_views('raw_reviews')} SELECT review_id, CAST(trim(rating) AS DOUBLE) AS rating, trim(review_text) AS review_text, CASE WHEN verified_purchase = 'maybe' THEN 'No Title' ELSE verified_purchase END AS review_title FROM raw_reviews WHERE trim(review_text) <> '' AND TRY_CAST(trim(rating) AS DOUBLE) BETWEEN 1 AND 5")
def clean_reviews(spark: SparkSession, sf: str) -> DataFrame:
    raw = frame(spark, sf, "raw_reviews").withColumn("review_title", F.when(F.col("verified_purchase") == "maybe", " ").otherwise(F.col("verified_purchase")))
    return cleaning.clean_reviews(raw).select("review_id", "rating", "review_text", "review_title")


@query(f"{with_views('raw_prices')}, {_SPLIT}, p AS (SELECT price_id, product_id, price, {_PARSED} AS v FROM up) SELECT price_id, product_id, CASE WHEN v > 0 THEN v END AS price, CASE WHEN v > 0 THEN NULL ELSE 'INVALID_PRICE' END AS reason FROM p")
def price_split(spark: SparkSession, sf: str) -> DataFrame:
    good, bad = cleaning.split_prices(frame(spark, sf, "raw_prices"))
    columns = ["price_id", "product_id", "price", "reason"]
    return good.withColumn("reason", F.lit(None).cast("string")).select(columns).union(bad.select(columns))


@query(f"""{with_views('prices', 'products')} SELECT price_id, product_id, CASE WHEN price BETWEEN 5000 AND 50000 THEN '' ELSE 'in_range(price)' END || CASE WHEN NOT price BETWEEN 5000 AND 50000 AND product_id NOT IN (SELECT product_id FROM products) THEN ',' ELSE '' END || CASE WHEN product_id NOT IN (SELECT product_id FROM products) THEN 'ORPHAN' ELSE '' END AS faults FROM prices""")
def contract_guard(spark: SparkSession, sf: str) -> DataFrame:
    out = cleaning.contract(frame(spark, sf, "prices"), [R.not_null("product_id"), R.in_range("price", 5000, 50000)], frame(spark, sf, "products"))
    return out.select("price_id", "product_id", F.array_join("faults", ",").alias("faults"))


_SCHEMA = {"required": ["review_id"], "properties": {"review_id": {"type": "string"}, "rating": {"type": "number", "minimum": 1, "maximum": 5}, "verified_purchase": {"enum": ["true", "false"]}, "review_text": {"type": "string", "minLength": 1}}}


@query(f"""{with_views('raw_reviews')} SELECT review_id, concat_ws(',', CASE WHEN TRY_CAST(rating AS DOUBLE) IS NULL THEN 'type(rating)' END, CASE WHEN NOT coalesce(TRY_CAST(rating AS DOUBLE) BETWEEN 1 AND 5, false) THEN 'limits(rating)' END,
 CASE WHEN verified_purchase NOT IN ('true', 'false') THEN 'enum(verified_purchase)' END, CASE WHEN trim(review_text) = '' THEN 'length(review_text)' END) AS faults FROM raw_reviews""")
def schema_check(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, sf, "raw_reviews").select("review_id", F.array_join(R.failed(R.schema_rules(_SCHEMA)), ",").alias("faults"))


@query("SELECT CAST(event_id AS VARCHAR) AS event_id, CASE WHEN event_id % 7 = 0 THEN 'MISSING_SOURCE' ELSE '' END || CASE WHEN event_id % 7 = 0 AND event_id % 5 = 0 THEN ',' ELSE '' END || CASE WHEN event_id % 5 = 0 THEN 'UNSUPPORTED_VERSION' ELSE '' END AS faults FROM events")
def envelope_check(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet").selectExpr(
        "CAST(event_id AS STRING) AS event_id", "event_type", "CASE WHEN event_id % 5 = 0 THEN '2.0' ELSE '1.0' END AS schema_version", "CASE WHEN event_id % 7 = 0 THEN ' ' ELSE 's' END AS source", "CAST(ts AS STRING) AS event_time", "props AS payload"
    )
    return cleaning.envelope_faults(e).select("event_id", F.array_join("faults", ",").alias("faults"))


@query("SELECT event_type || '-reviews' AS topic, count(*) AS n, sum(CASE WHEN event_id % 5 < 3 THEN 1 ELSE 0 END)::BIGINT AS eligible, sum(CASE WHEN event_id % 5 >= 3 THEN 1 ELSE 0 END)::BIGINT AS exhausted FROM events GROUP BY 1")
def topic_counts(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.topic_counts(spark.read.parquet(f"{sf}/events.parquet").selectExpr("event_type || '-reviews' AS topic", "event_id % 5 AS tries"))


@query("SELECT CAST(event_id AS VARCHAR) AS review_id, event_type AS product_id, CAST(1 + event_id % 5 AS BIGINT) AS rating, 'events' AS source FROM events")
def bronze_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Enveloped, written as JSON by event hour, read again and unpacked."""
    at = folder(spark)
    e = spark.read.parquet(f"{sf}/events.parquet").selectExpr("CAST(event_id AS STRING) AS review_id", "event_type AS product_id", "1 + event_id % 5 AS rating", "CAST(ts AS TIMESTAMP) AS review_date")
    published.write_bronze(files.envelope(e, "NEW_REVIEW", "events", "review_date"), at, "event_time")
    schema = "event_id string, event_type string, source string, event_time string, ingested_at string, payload struct<review_id:string,product_id:string,rating:bigint,review_date:string>"
    return silver.unpack_envelope(files.read_json(spark, at, schema=schema, lines=True)).select("review_id", "product_id", "rating", "source")


@query(f"{with_views('raw_prices')} SELECT price_id, CASE WHEN c IS NULL OR c = t THEN coalesce(t, c) WHEN t IS NULL THEN c END AS currency FROM (SELECT price_id, {{case}} AS c, CASE WHEN contains(price, '$') THEN 'USD' WHEN contains(price, '€') THEN 'EUR' WHEN contains(price, 'VND') THEN 'VND' END AS t FROM raw_prices)".replace("{case}", "CASE lower(trim(currency)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in V.CURRENCY_ALIASES.items()) + " ELSE CASE WHEN regexp_matches(trim(currency), '^[A-Za-z]{3}$') THEN upper(trim(currency)) END END"))
def observed_currency(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, sf, "raw_prices").select("price_id", V.observed_currency(F.col("currency"), F.col("price")).alias("currency"))


@query("SELECT review_id, product_id FROM (SELECT CAST(event_id AS VARCHAR) AS review_id, event_type AS product_id, event_id FROM events)")
def quarantine_replay(spark: SparkSession, sf: str) -> DataFrame:
    """Quarantined messages, sent again and read."""
    from tidemark.streaming import reviews as streams

    e = spark.read.parquet(f"{sf}/events.parquet").selectExpr("CAST(event_id AS STRING) AS review_id", "event_type AS product_id", "'9' AS rating", "'t' AS review_text", "CAST(ts AS STRING) AS review_date", "'marketplace' AS source_group")
    wrapped = e.select(F.to_json(F.struct(F.struct("*").alias("payload"))).alias("value"))
    _, bad = streams.split(streams.parsed(wrapped))
    return streams.parsed(streams.replayable(bad)).where("acquisition_method = 'snapshot_replay'").select("review_id", "product_id")


@query("SELECT CAST(event_id AS VARCHAR) AS id, coalesce(json_extract_string(props, '$.k'), event_type) AS detail, event_type AS kind FROM events")
def field_mapping(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet")
    return files.mapped(e, {"id": ["event_id"], "detail": ["props:$.k", "event_type"], "kind": ["props:$.none", "event_type"]})


@query("SELECT 'run-1' AS run_id, product_id, product_count FROM (SELECT CAST(p_brand AS VARCHAR) AS product_id, count(*) AS product_count FROM part GROUP BY 1)")
def published_marts(spark: SparkSession, sf: str) -> DataFrame:
    at = folder(spark)
    mart = frame(spark, sf, "products").groupBy(F.col("brand").alias("product_id")).agg(F.count("*").alias("product_count")).withColumn("run_id", F.lit("run-1"))
    published.publish_marts({"brands": mart}, {"brands": ["product_id"]}, at, "run-1")
    return published.read_group(spark, at, "run-1")["brands"].select("run_id", "product_id", "product_count")


_WRITTEN = "p_name || ' é, \"x\"; y'"


@query(f"SELECT CAST(p_partkey AS VARCHAR) AS product_id, CASE WHEN p_size % 7 = 0 THEN NULL ELSE {_WRITTEN} END AS product_name, CASE WHEN p_partkey % 3 = 2 THEN p_brand END AS brand FROM part")
def delimited_files(spark: SparkSession, sf: str) -> DataFrame:
    """Products written in three ways (commas in UTF-8, semicolons in ISO-8859-1, tabs and one more column) and read by what the files themselves show."""
    at = folder(spark)
    parts = spark.read.parquet(f"{sf}/part.parquet").selectExpr("CAST(p_partkey AS STRING) AS product_id", f"CASE WHEN p_size % 7 = 0 THEN NULL ELSE {_WRITTEN} END AS product_name", "p_brand AS brand", "p_partkey % 3 AS way")
    for way, (sep, encoding, columns) in enumerate(((",", "UTF-8", ["product_id", "product_name"]), (";", "ISO-8859-1", ["product_name", "product_id"]), ("\t", "UTF-8", ["product_id", "product_name", "brand"]))):
        parts.where(F.col("way") == way).select(columns).write.options(header="true", sep=sep, encoding=encoding, escape='"').csv(f"{at}/{way}")
    return delimited.read(spark, at).select("product_id", "product_name", "brand")


@query("SELECT p_partkey AS product_id, (row_number() OVER (ORDER BY p_partkey) - 1) // CAST(ceil((SELECT count(*) FROM part) / 3) AS BIGINT) AS batch FROM part")
def paced_replay(spark: SparkSession, sf: str) -> DataFrame:
    """Products sent as a stream in three triggers, in order, at most a third of them each."""
    at = folder(spark)
    n = replay.store(spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").alias("product_id")), at, "product_id")
    replay.replay(spark, at, lambda batch, i: batch.write.mode("overwrite").parquet(f"{at}/out/batch={i}"), f"{at}/check", per_trigger=-(-n // 3), every="0 seconds")
    return spark.read.schema("product_id long, position long, batch long").parquet(f"{at}/out").select("product_id", "batch")


_NESTED = {
    "required": ["review"],
    "properties": {
        "review": {"type": "object", "required": ["product_id"], "properties": {"rating": {"type": "number", "minimum": 1, "maximum": 5}}},
        "flags": {"type": "array", "items": {"type": "object", "properties": {"purchase": {"enum": ["true", "false"]}, "texts": {"type": "array", "items": {"type": "string", "minLength": 1}}}}},
    },
}


@query(f"""{with_views('raw_reviews')} SELECT review_id, concat_ws(',', CASE WHEN TRY_CAST(rating AS DOUBLE) IS NULL THEN 'type(review.rating)' END, CASE WHEN NOT coalesce(TRY_CAST(rating AS DOUBLE) BETWEEN 1 AND 5, false) THEN 'limits(review.rating)' END,
 CASE WHEN product_id IS NULL THEN 'required(review.product_id)' END, CASE WHEN verified_purchase NOT IN ('true', 'false') THEN 'enum(flags[1].purchase)' END, CASE WHEN trim(review_text) = '' THEN 'length(flags[1].texts[1])' END) AS faults FROM raw_reviews""")
def nested_schema(spark: SparkSession, sf: str) -> DataFrame:
    """Rules of a schema of objects in arrays, which name the places where they are broken."""
    rows = frame(spark, sf, "raw_reviews").selectExpr("review_id", "named_struct('review', named_struct('product_id', product_id, 'rating', rating), 'flags', array(named_struct('purchase', 'true', 'texts', array('x')), named_struct('purchase', verified_purchase, 'texts', array('y', review_text)))) AS r")
    return rows.select("review_id", F.array_join(R.schema_faults(_NESTED, F.col("r"), rows.schema["r"].dataType), ",").alias("faults"))


@query("""WITH b AS (SELECT p_partkey, p_retailprice, row_number() OVER (ORDER BY p_partkey) - 1 AS k, count(*) OVER () AS size FROM part), i AS (SELECT unnest(range(0, (SELECT 2 * count(*) + 5 FROM part))) AS i),
r AS (SELECT i, CASE WHEN floor((i + 1) * 0.03::DECIMAL(20, 12)) > floor(i * 0.03::DECIMAL(20, 12)) THEN -50000.0 ELSE p_retailprice END AS price FROM i JOIN b ON i % size = k)
SELECT printf('part_sim_%07d', i) AS product_id, CAST(price AS DOUBLE) AS price FROM r UNION ALL SELECT printf('part_sim_%07d', i), CAST(price AS DOUBLE) FROM r WHERE i < 2""")
def simulated_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Twice the products and five more, three in a hundred with an impossible price, the first two rows once more."""
    base = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").cast("string").alias("product_id"), F.col("p_retailprice").cast("double").alias("price"), F.col("p_partkey").alias("n"))
    return files.simulated(base, 2 * base.count() + 5, "product_id", "part", ["n"], folder(spark), 0.03).select("product_id", "price")
