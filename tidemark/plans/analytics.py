"""Queries of summaries, trends, anomalies, streams and serving."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import anomaly, descriptive, marts, quality, serving, trends
from tidemark.plans.adapters import VIEWS, frame, rounded, with_views
from tidemark.plans.scratch import folder
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


def text(c: str, pattern: str = "yyyy-MM-dd") -> Column:
    return F.date_format(c, pattern).alias(c)


def both(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return frame(spark, sf, "products"), frame(spark, sf, "reviews")


@query(f"""{with_views('products', 'reviews')} SELECT * FROM (SELECT count(*) AS total_products, count(DISTINCT brand) AS brands, count(DISTINCT category) AS categories, {rounded('min(price)')} AS min_price, {rounded('max(price)')} AS max_price, {rounded('avg(price)')} AS avg_price, {rounded('median(price)')} AS median_price FROM products),
(SELECT count(*) AS total_reviews, {rounded('avg(rating)')} AS avg_rating, {rounded('median(rating)')} AS median_rating FROM reviews)""")
def dataset_summary(spark: SparkSession, sf: str) -> DataFrame:
    return descriptive.dataset_summary(*both(spark, sf))


@query(f"{with_views('reviews')} SELECT CAST(rating AS INTEGER) AS stars, count(*) AS n, {rounded('count(*) / (SELECT count(*) FROM reviews)', 4)} AS ratio FROM reviews GROUP BY 1")
def star_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return descriptive.star_distribution(frame(spark, sf, "reviews"))


@query(f"""{with_views('products', 'reviews')}, r AS (SELECT product_id, count(*) AS n, avg(rating) AS av, stddev_samp(rating) AS sd, sum(CASE WHEN rating >= 4 THEN 1 ELSE 0 END) AS good, sum(CASE WHEN rating <= 2 THEN 1 ELSE 0 END) AS bad FROM reviews GROUP BY 1)
SELECT product_id, product_name, brand, category, coalesce(n, 0) AS review_count, {rounded('av')} AS avg_rating, {rounded('sd')} AS rating_std, {rounded('good / n', 4)} AS positive_ratio, {rounded('bad / n', 4)} AS negative_ratio, CASE WHEN n IS NULL THEN 'unavailable' ELSE 'available' END AS rating_availability_status FROM products LEFT JOIN r USING (product_id)""")
def product_metrics(spark: SparkSession, sf: str) -> DataFrame:
    products, reviews = both(spark, sf)
    return descriptive.product_metrics(reviews, products)


def _comparison(name: str) -> str:
    return f"""{with_views('products', 'reviews')}, r AS (SELECT product_id, sum(rating) AS s, count(*) AS n FROM reviews GROUP BY 1)
SELECT {name}, count(*) AS product_count, {rounded('avg(price)')} AS avg_price, {rounded('min(price)')} AS min_price, {rounded('max(price)')} AS max_price, CAST(coalesce(sum(n), 0) AS BIGINT) AS review_count, {rounded('sum(s) / sum(n)')} AS avg_rating FROM products LEFT JOIN r USING (product_id) GROUP BY 1"""


@query(_comparison("brand"))
def brand_comparison(spark: SparkSession, sf: str) -> DataFrame:
    return descriptive.compare_by(*both(spark, sf), "brand")


@query(_comparison("category"))
def category_comparison(spark: SparkSession, sf: str) -> DataFrame:
    return descriptive.compare_by(*both(spark, sf), "category")


@query(f"{with_views('prices')} SELECT strftime(timestamp, '%Y-%m-%d') AS date, product_id, {rounded('min(price)')} AS min_price, {rounded('max(price)')} AS max_price, {rounded('avg(price)')} AS avg_price, count(*) AS data_points FROM prices WHERE product_id = '7' GROUP BY 1, 2")
def price_trajectory(spark: SparkSession, sf: str) -> DataFrame:
    return trends.price_trajectory(frame(spark, sf, "prices"), "7").withColumn("date", text("date"))


@query(f"{with_views('prices')} SELECT product_id, count(*) AS data_points, {rounded('avg(price)')} AS avg_price, {rounded('stddev_samp(price)')} AS price_std, {rounded('CASE WHEN count(*) >= 2 THEN stddev_samp(price) / avg(price) END', 4)} AS volatility, CASE WHEN count(*) >= 2 THEN 'available' ELSE 'insufficient_data' END AS volatility_status FROM prices GROUP BY 1")
def price_volatility(spark: SparkSession, sf: str) -> DataFrame:
    return trends.price_volatility(frame(spark, sf, "prices"))


_DAILY = f"m AS (SELECT CAST(review_date AS DATE) AS date, product_id, count(*) AS review_count, {rounded('avg(rating)')} AS avg_rating FROM reviews GROUP BY 1, 2)"


_SCORE = "SELECT 100.0 * (sum(n) - sum(greatest(n - 1, q))) / sum(n) AS s FROM (SELECT k, count(*) AS n, sum(CASE WHEN unfit THEN 1 ELSE 0 END) AS q FROM {flags} GROUP BY 1)"


@query(f"""{with_views('products', 'reviews', 'prices', 'raw_prices')}, {_DAILY},
d1 AS (SELECT review_id AS k, product_id IS NULL OR coalesce(rating NOT BETWEEN 2 AND 5, false) AS unfit FROM reviews), d2 AS (SELECT price_id AS k, product_id IS NULL OR coalesce(price NOT BETWEEN 5000 AND 50000, false) AS unfit FROM prices),
d3 AS (SELECT price_id AS k, coalesce(trim(brand), '') = '' OR coalesce(trim(category), '') = '' AS unfit FROM raw_prices)
SELECT CAST(sum(review_count) AS BIGINT) AS total_reviews, count(DISTINCT product_id) AS total_products, {rounded('sum(avg_rating * review_count) / sum(review_count)')} AS avg_rating,
(SELECT count(DISTINCT brand) FROM products WHERE product_id IN (SELECT product_id FROM m)) AS total_brands,
(SELECT {rounded('avg(s)')} FROM (SELECT {rounded('s')} AS s FROM ({" UNION ALL ".join(_SCORE.format(flags=d) for d in ("d1", "d2", "d3"))}))) AS avg_dq_score FROM m""")
def kpi_summary(spark: SparkSession, sf: str) -> DataFrame:
    products, reviews = both(spark, sf)
    scores = [
        quality.evaluate(reviews, "reviews", "review_id", ["review_id", "product_id"], {}, {"rating": (2, 5)}),
        quality.evaluate(frame(spark, sf, "prices"), "prices", "price_id", ["price_id", "product_id"], {}, {"price": (5000, 50000)}),
        quality.evaluate(frame(spark, sf, "raw_prices"), "raw_prices", "price_id", ["price_id", "brand", "category"], {}, {}),
    ]
    return descriptive.kpi_summary(marts.product_daily_stats(reviews), marts.brand_daily_stats(reviews, products), reduce(DataFrame.unionByName, scores))


@query(f"{with_views('runs')} SELECT pipeline, source, run, strftime(ended_at, '%Y-%m-%d') AS ended_at FROM runs r WHERE ended_at = (SELECT max(ended_at) FROM runs s WHERE s.pipeline = r.pipeline)")
def latest_report_per_dataset(spark: SparkSession, sf: str) -> DataFrame:
    return descriptive.latest_reports(frame(spark, sf, "runs"), "pipeline", "ended_at").select("pipeline", "source", "run", text("ended_at"))


@query(f"""{with_views('runs')} SELECT pipeline, source, strftime(max(ended_at), '%Y-%m-%d') AS last_run, strftime(max(CASE WHEN status = 'success' THEN ended_at END), '%Y-%m-%d') AS last_success, sum(CASE WHEN status = 'failed' THEN 1 ELSE 0 END)::BIGINT AS failures FROM runs GROUP BY 1, 2""")
def run_status(spark: SparkSession, sf: str) -> DataFrame:
    return descriptive.run_status(frame(spark, sf, "runs")).select("pipeline", "source", text("last_run"), text("last_success"), "failures")


_DAYS = "w AS (SELECT *, sum(n) OVER r AS wn, sum(s) OVER r AS ws, count(*) OVER r AS k FROM d WINDOW r AS (ORDER BY date RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW))"


@query(f"""{with_views('reviews')}, d AS (SELECT CAST(review_date AS DATE) AS date, count(*) AS n, sum(rating) AS s, sum(CASE WHEN rating >= 4 THEN 1 ELSE 0 END) AS good, sum(CASE WHEN rating <= 2 THEN 1 ELSE 0 END) AS bad FROM reviews GROUP BY 1), {_DAYS}
SELECT strftime(date, '%Y-%m-%d') AS date, n AS review_count, {rounded('s / n')} AS avg_rating, {rounded('good / n', 4)} AS positive_ratio, {rounded('bad / n', 4)} AS negative_ratio, {rounded('ws / wn')} AS rolling_avg_rating, {rounded('wn / k', 1)} AS rolling_avg_count, k AS observed_days, 7 - k AS missing_days,
strftime(date - INTERVAL 6 DAYS, '%Y-%m-%d') AS baseline_start, CASE WHEN k >= 2 AND wn >= 2 THEN 'sufficient' ELSE 'insufficient' END AS baseline_status FROM w""")
def daily_review_trend(spark: SparkSession, sf: str) -> DataFrame:
    out = trends.daily_review_trend(frame(spark, sf, "reviews"))
    return out.withColumns({"date": text("date"), "baseline_start": text("baseline_start"), "missing_days": F.col("missing_days").cast("bigint")})


@query(f"""{with_views('reviews')}, d AS (SELECT CAST(review_date AS DATE) AS date, count(*) AS n, 0 AS s FROM reviews GROUP BY 1), {_DAYS}
SELECT strftime(date, '%Y-%m-%d') AS date, n AS review_count, {rounded('wn / k', 1)} AS rolling_avg_count, k AS observed_days, 7 - k AS missing_days, CASE WHEN k >= 2 THEN 'sufficient' ELSE 'insufficient' END AS baseline_status FROM w""")
def daily_volume_trend(spark: SparkSession, sf: str) -> DataFrame:
    mart = marts.product_daily_stats(frame(spark, sf, "reviews"))
    return trends.daily_volume_trend(mart).withColumns({"date": text("date"), "missing_days": F.col("missing_days").cast("bigint")})


def _event(kind: str, *parts: str) -> str:
    return f"'anom_' || substring(sha256('PRODUCT|' || product_id || '|{kind}|' || " + " || '|' || ".join(parts) + "), 1, 20) AS event_id"


# by brand, as single products have too few reviews a day
_BUSY = "(SELECT p.brand AS product_id, CAST(review_date AS DATE) AS date, rating FROM reviews r JOIN products p ON r.product_id = p.product_id)"


@query(f"""{with_views('reviews', 'products')}, d AS (SELECT product_id, date, sum(rating) AS s, count(*) AS n FROM {_BUSY} GROUP BY 1, 2),
w AS (SELECT *, sum(s) OVER r AS bs, sum(n) OVER r AS bn, count(*) OVER r AS k FROM d WINDOW r AS (PARTITION BY product_id ORDER BY date RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND INTERVAL 1 DAYS PRECEDING))
SELECT {_event('RATING_DROP', "strftime(date, '%Y-%m-%d')")}, product_id, strftime(date, '%Y-%m-%d') AS date, {rounded('bs / bn - s / n')} AS score, {rounded('s / n')} AS avg_rating, {rounded('bs / bn')} AS baseline_mean, n AS current_sample_size, CAST(bn AS BIGINT) AS baseline_sample_size, k AS baseline_days FROM w WHERE k >= 2 AND n >= 3 AND bs / bn - s / n >= 0.5""")
def rating_drop(spark: SparkSession, sf: str) -> DataFrame:
    products, reviews = both(spark, sf)
    rows = reviews.drop("brand").join(products.select("product_id", "brand"), "product_id").drop("product_id").withColumnRenamed("brand", "product_id")
    return anomaly.rating_drops(rows).withColumn("date", text("date"))


@query(f"""{with_views('stream_reviews')}, h AS (SELECT product_id, CAST(floor(epoch(event_time) / 3600) AS BIGINT) AS h, count(*) AS c, sum(rating) AS s FROM stream_reviews GROUP BY 1, 2),
g AS (SELECT a.product_id, a.h, a.c, a.s, (SELECT min(h) FROM h b WHERE b.product_id = a.product_id) AS f FROM h a),
b AS (SELECT g.product_id, g.h, g.c, g.s, x.t, coalesce(p.c, 0) AS pc, p.c IS NOT NULL AS seen FROM g, LATERAL (SELECT unnest(generate_series(greatest(g.f, g.h - 24), g.h - 1)) AS t) x LEFT JOIN h p ON p.product_id = g.product_id AND p.h = x.t),
m AS (SELECT product_id, h, any_value(c) AS c, any_value(s) AS s, count(*) AS nb, avg(pc) AS mean, stddev_samp(pc) AS sd, sum(CASE WHEN seen THEN 1 ELSE 0 END) AS k FROM b GROUP BY 1, 2)
SELECT product_id, h AS bucket, CASE WHEN s / c <= 2.5 THEN 'REVIEW_BOMBING' ELSE 'REVIEW_BURST' END AS anomaly_type, c AS review_count, {rounded('c / greatest(mean, 1)')} AS score, {rounded('mean', 4)} AS baseline_mean, nb AS baseline_buckets, {rounded('s / c')} AS avg_rating
FROM m WHERE k >= 2 AND c >= greatest(CASE WHEN sd = 0 THEN 2 * mean ELSE mean + 3 * sd END, 5)""")
def review_burst(spark: SparkSession, sf: str) -> DataFrame:
    out = anomaly.review_bursts(frame(spark, sf, "stream_reviews"))
    return out.select("product_id", F.floor(F.unix_timestamp("bucket_start") / 3600).alias("bucket"), "anomaly_type", "review_count", "score", "baseline_mean", "baseline_buckets", "avg_rating")


_OTHERS = "x AS (SELECT row_number() OVER () AS id, price_id, product_id, price, timestamp FROM prices WHERE price > 0), o AS (SELECT a.id, a.price_id, a.product_id, a.price, a.timestamp, {agg}, count(*) AS k FROM x a JOIN x b ON a.product_id = b.product_id AND a.id <> b.id GROUP BY ALL HAVING count(*) >= 2)"


@query(f"""{with_views('prices')}, {_OTHERS.format(agg='avg(b.price) AS m, stddev_samp(b.price) AS sd, min(b.price) AS lo, max(b.price) AS hi')},
z AS (SELECT *, CASE WHEN lo = hi THEN CASE WHEN abs(price - lo) / lo >= 0.10 THEN (price - lo) / greatest(0.01 * lo, 1e-9) END ELSE (price - m) / sd END AS z FROM o)
SELECT product_id, strftime(timestamp, '%Y-%m-%d') AS at, price, {rounded('abs(z)')} AS score, {rounded('m')} AS baseline_mean, {rounded('CASE WHEN lo = hi THEN 0 ELSE sd END')} AS baseline_std, k AS baseline_points FROM z WHERE abs(z) >= 2.5""")
def price_zscore_loo(spark: SparkSession, sf: str) -> DataFrame:
    out = anomaly.price_zscores(frame(spark, sf, "prices"), threshold=2.5)
    return out.select("product_id", F.date_format("timestamp", "yyyy-MM-dd").alias("at"), "price", "score", "baseline_mean", "baseline_std", "baseline_points")


@query(f"""{with_views('prices')}, {_OTHERS.format(agg='quantile_cont(b.price, 0.25) AS q1, quantile_cont(b.price, 0.5) AS md, quantile_cont(b.price, 0.75) AS q3')}
SELECT product_id, strftime(timestamp, '%Y-%m-%d') AS at, price, {rounded('abs(price - md) / (q3 - q1)')} AS score, {rounded('q1')} AS q1, {rounded('q3')} AS q3, k AS baseline_points FROM o WHERE q3 > q1 AND (price < q1 - 0.75 * (q3 - q1) OR price > q3 + 0.75 * (q3 - q1))""")
def price_iqr_loo(spark: SparkSession, sf: str) -> DataFrame:
    out = anomaly.price_iqr_outliers(frame(spark, sf, "prices"), factor=0.75)
    return out.select("product_id", F.date_format("timestamp", "yyyy-MM-dd").alias("at"), "price", "score", "q1", "q3", "baseline_points")


_TUMBLING = f"""{with_views('stream_reviews')} SELECT strftime(time_bucket(INTERVAL 1 HOUR, event_time), '%Y-%m-%d %H:%M:%S') AS window_start, product_id, source_group, count(*) AS review_count, {rounded('avg(rating)')} AS avg_rating, sum(CASE WHEN rating <= 2 THEN 1 ELSE 0 END)::BIGINT AS negative_count FROM stream_reviews GROUP BY 1, 2, 3"""


def _shown(windows: DataFrame) -> DataFrame:
    return windows.select(text("window_start", "yyyy-MM-dd HH:mm:ss"), "product_id", "source_group", "review_count", "avg_rating", "negative_count")


@query(_TUMBLING)
def tumbling_window(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(streams.tumbling(frame(spark, sf, "stream_reviews"), "1 hour"))


def _stream(spark: SparkSession, sf: str) -> DataFrame:
    table, columns = VIEWS["stream_reviews"]
    schema = spark.read.parquet(f"{sf}/{table}.parquet").schema
    raw = spark.readStream.schema(T.StructType(schema.fields)).option("pathGlobFilter", f"{table}.parquet*").option("recursiveFileLookup", "true").parquet(sf)
    return raw.selectExpr(*[f"{e} AS {c}" for c, e in columns.items()])


def _drained(df: DataFrame, mode: str, at: str) -> None:
    def sink(batch: DataFrame, batch_id: int) -> None:
        if mode == "complete":
            batch.write.mode("overwrite").parquet(f"{at}/out")
        else:
            batch.write.mode("overwrite").parquet(f"{at}/out/batch={batch_id}")

    q = df.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()


@query(_TUMBLING)
def stream_tumbling_window(spark: SparkSession, sf: str) -> DataFrame:
    at = folder(spark)
    _drained(streams.tumbling(_stream(spark, sf).withWatermark("event_time", "10 minutes"), "1 hour"), "complete", at)
    return _shown(spark.read.parquet(f"{at}/out"))


_COPY = "CAST(review_id AS BIGINT) % 5"


@query(f"""{with_views('stream_reviews')} SELECT source_group, review_id, product_id, strftime(event_time, '%Y-%m-%d %H:%M:%S') AS at FROM stream_reviews
UNION ALL SELECT source_group, review_id, product_id, strftime(event_time + INTERVAL 400 DAY, '%Y-%m-%d %H:%M:%S') FROM stream_reviews WHERE {_COPY} = 0 AND event_time + INTERVAL 20 MINUTE <= (SELECT max(event_time) FROM stream_reviews)""")
def stream_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Events of which every fifth comes twice; after a restart come copies that are too late, and copies of a later time, whose ids are forgotten but for the newest."""
    at = folder(spark)
    rows = frame(spark, sf, "stream_reviews").select("source_group", "review_id", "product_id", "event_time")
    later = rows.where(f"{_COPY} = 0").withColumn("event_time", F.col("event_time") + F.expr("INTERVAL 400 DAY"))
    for part in (rows.union(rows.where(f"{_COPY} = 0")), later.union(rows.where(f"{_COPY} = 1"))):
        part.write.mode("append").parquet(f"{at}/in")
        _drained(streams.distinct_reviews(spark.readStream.schema(rows.schema).parquet(f"{at}/in")), "append", at)
    return spark.read.parquet(f"{at}/out").select("source_group", "review_id", "product_id", text("event_time", "yyyy-MM-dd HH:mm:ss").alias("at"))


@query(f"{with_views('stream_reviews')} SELECT strftime(time_bucket(INTERVAL 60 SECONDS, event_time), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS event_count, count(value) AS sample_size, {rounded('avg(value)')} AS mean_value, {rounded('count(*) / 60', 4)} AS rate_per_second FROM stream_reviews GROUP BY 1")
def value_windows(spark: SparkSession, sf: str) -> DataFrame:
    out = streams.value_windows(frame(spark, sf, "stream_reviews"), 60, F.col("event_time"), F.col("value"))
    return out.select(text("window_start", "yyyy-MM-dd HH:mm:ss"), "event_count", "sample_size", "mean_value", "rate_per_second")


@query("SELECT quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events")
def percentiles(spark: SparkSession, sf: str) -> DataFrame:
    return descriptive.percentiles(spark.read.parquet(f"{sf}/events.parquet"), "value")


@query("SELECT sum(CASE WHEN event_id % 7 > 1 THEN 1 ELSE 0 END)::BIGINT AS timed_rows, sum(CASE WHEN event_id % 7 = 1 THEN 1 ELSE 0 END)::BIGINT AS untimed_rows, sum(CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END)::BIGINT AS unknown_rows, sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END)::BIGINT AS fallback_rows, sum(user_id)::BIGINT AS samples, strftime(max(ts), '%Y-%m-%d') AS data_as_of FROM events")
def coverage(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet").selectExpr("CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_id % 7 > 1 END AS time_available", "CASE WHEN event_type = 'view' THEN 'catalog_fallback' ELSE 'observed' END AS price_source", "user_id AS rating_sample_size", "CAST(ts AS DATE) AS date")
    return descriptive.coverage(e).withColumn("data_as_of", text("data_as_of"))


@query("SELECT count(*) AS total, sum(CASE WHEN event_id % 4 = 0 THEN 1 ELSE 0 END)::BIGINT AS price, sum(CASE WHEN event_id % 4 = 1 THEN 1 ELSE 0 END)::BIGINT AS rating, sum(CASE WHEN event_id % 4 > 1 THEN 1 ELSE 0 END)::BIGINT AS volume FROM events")
def anomaly_counts(spark: SparkSession, sf: str) -> DataFrame:
    kinds = "CASE event_id % 4 WHEN 0 THEN 'PRICE_ANOMALY' WHEN 1 THEN 'RATING_DROP' WHEN 2 THEN 'REVIEW_BURST' ELSE 'REVIEW_BOMBING' END AS anomaly_type"
    return descriptive.anomaly_counts(spark.read.parquet(f"{sf}/events.parquet").selectExpr(kinds))


# as the category mart counts: products of the catalog with a review that has an id and a rating from 1 to 5
@query(f"""{with_views('reviews', 'products')}, m AS (SELECT CAST(review_date AS DATE) AS date, category, count(DISTINCT product_id) AS product_count FROM reviews JOIN products USING (product_id) WHERE trim(review_id) <> '' AND rating BETWEEN 1 AND 5 GROUP BY 1, 2)
SELECT strftime(date, '%Y-%m-%d') AS date, CAST(sum(product_count) AS BIGINT) AS product_count FROM m WHERE date = (SELECT max(date) FROM m) GROUP BY 1""")
def latest_total(spark: SparkSession, sf: str) -> DataFrame:
    products, reviews = both(spark, sf)
    return descriptive.latest_total(marts.category_daily_stats(reviews, products)).withColumn("date", text("date"))


@query("SELECT CASE WHEN event_type = 'view' THEN 'unknown' WHEN event_id % 2 = 0 THEN 'verified' ELSE 'unverified' END AS status, count(*) AS n FROM events GROUP BY 1")
def purchase_status(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet").selectExpr("CASE WHEN event_type = 'view' THEN NULL ELSE event_id % 2 = 0 END AS verified")
    return descriptive.histogram(e, descriptive.purchase_status(F.col("verified")), "status")


@query(f"{with_views('prices')} SELECT price_id, product_id, price FROM prices ORDER BY price DESC, price_id, product_id LIMIT 100")
def top_n(spark: SparkSession, sf: str) -> DataFrame:
    return serving.top(frame(spark, sf, "prices"), 100, F.desc("price"), F.col("price_id"), F.col("product_id")).select("price_id", "product_id", "price")


@query(f"{with_views('products')} SELECT product_id, product_name, price FROM products ORDER BY price DESC, product_id LIMIT 20 OFFSET 40")
def paged_slice(spark: SparkSession, sf: str) -> DataFrame:
    return serving.page(frame(spark, sf, "products"), 3, 20, F.desc("price"), F.col("product_id")).select("product_id", "product_name", "price")


@query("SELECT doc_id, lang FROM documents WHERE contains(replace(strip_accents(lower(text)), 'đ', 'd'), 'cion')")
def search_contains(spark: SparkSession, sf: str) -> DataFrame:
    return serving.search(spark.read.parquet(f"{sf}/documents.parquet"), " CIÓN ", ["text"]).select("doc_id", "lang")


@query(f"{with_views('products')} SELECT product_id, brand FROM products WHERE source_group = 'marketplace'")
def scope_filter(spark: SparkSession, sf: str) -> DataFrame:
    return serving.in_scope(frame(spark, sf, "products"), "real").select("product_id", "brand")


@query(f"{with_views('products')}, b AS (SELECT DISTINCT brand FROM products ORDER BY 1 LIMIT 3) SELECT product_id, brand, category FROM products WHERE brand IN ('Brand#11', 'Brand#12', 'Brand#13') AND CAST(product_id AS BIGINT) % 5 >= 3")
def filter_catalog(spark: SparkSession, sf: str) -> DataFrame:
    rated = frame(spark, sf, "products").withColumn("rating", F.expr("CAST(CAST(product_id AS BIGINT) % 5 AS DOUBLE)"))
    return serving.filter_catalog(rated, brands=["Brand#11", "Brand#12", "Brand#13"], minimum_rating=3).select("product_id", "brand", "category")


@query(f"{with_views('products')} SELECT DISTINCT category FROM products")
def option_list(spark: SparkSession, sf: str) -> DataFrame:
    return serving.options(frame(spark, sf, "products"), "category")


@query("SELECT doc_id, CASE WHEN regexp_matches(ltrim(text), '^[=+@-]') THEN '''' || text ELSE text END AS text FROM documents")
def csv_safe(spark: SparkSession, sf: str) -> DataFrame:
    return serving.csv_safe(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"))


@query(f"{with_views('products')} SELECT product_id, price FROM products WHERE price > 0 AND CAST(product_id AS BIGINT) % 7 BETWEEN 1 AND 5")
def comparable_rows(spark: SparkSession, sf: str) -> DataFrame:
    rated = frame(spark, sf, "products").withColumn("rating", F.expr("CAST(CAST(product_id AS BIGINT) % 7 AS DOUBLE)"))
    return serving.comparable(rated).select("product_id", "price")
