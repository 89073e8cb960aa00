"""Queries of marts, normalisation, validation, merging and quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import rules as R
from tidemark.functions import values as V
from tidemark.operators import marts, quality, serving, silver
from tidemark.plans.adapters import frame, rounded, with_views

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


def day(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


_OBSERVED = "seen AS (SELECT CAST(review_date AS DATE) AS d, product_id, rating FROM reviews WHERE trim(review_id) <> '' AND rating BETWEEN 1 AND 5)"
_PRICED = f"priced AS (SELECT CAST(timestamp AS DATE) AS d, product_id, min(price) AS lo, max(price) AS hi, avg(price) AS av, stddev_samp(price) AS sd, count(*) AS n FROM prices WHERE price > 0 GROUP BY 1, 2)"


@query(f"""{with_views('prices')}, {_PRICED}
SELECT strftime(d, '%Y-%m-%d') AS date, product_id, {rounded('lo')} AS min_price, {rounded('hi')} AS max_price, {rounded('av')} AS avg_price, {rounded('sd')} AS price_std, n AS data_points FROM priced""")
def price_daily_stats(spark: SparkSession, sf: str) -> DataFrame:
    return marts.price_daily_stats(frame(spark, sf, "prices")).withColumn("date", day("date"))


_RATED = f"""rated AS (SELECT d, product_id, count(*) AS n, avg(rating) AS av, stddev_samp(rating) AS sd, sum(CASE WHEN rating >= 4 THEN 1 ELSE 0 END) AS good, sum(CASE WHEN rating <= 2 THEN 1 ELSE 0 END) AS bad FROM seen GROUP BY 1, 2)"""


# reviews of unknown products and of days without a price make all three sources occur
@query(f"""{with_views('reviews', 'prices', 'products')}, {_OBSERVED}, {_PRICED}, {_RATED}
SELECT strftime(r.d, '%Y-%m-%d') AS date, r.product_id, r.n AS review_count, r.n AS rating_sample_size, {rounded('r.av')} AS avg_rating, {rounded('r.sd')} AS rating_std,
 {rounded('r.good / r.n', 4)} AS positive_ratio, {rounded('r.bad / r.n', 4)} AS negative_ratio, {rounded('r.av')} AS weighted_avg_rating, {rounded('r.good / r.n', 4)} AS high_rating_ratio, {rounded('r.bad / r.n', 4)} AS low_rating_ratio,
 {rounded('coalesce(p.lo, c.price)')} AS min_price, {rounded('coalesce(p.hi, c.price)')} AS max_price, {rounded('coalesce(p.av, c.price)')} AS avg_price,
 CASE WHEN p.av IS NOT NULL THEN 'observed' WHEN c.price IS NOT NULL THEN 'catalog_fallback' ELSE 'unavailable' END AS price_source
FROM rated r LEFT JOIN priced p ON r.d = p.d AND r.product_id = p.product_id
LEFT JOIN products c ON r.product_id = c.product_id""")
def product_daily_stats(spark: SparkSession, sf: str) -> DataFrame:
    return marts.product_daily_stats(frame(spark, sf, "reviews"), frame(spark, sf, "products"), frame(spark, sf, "prices")).withColumn("date", day("date"))


def _dimension(name: str) -> str:
    return f"""{with_views('reviews', 'products')}, {_OBSERVED}, once AS (SELECT d, product_id, sum(rating) AS s, count(*) AS n FROM seen GROUP BY 1, 2)
SELECT strftime(d, '%Y-%m-%d') AS date, {name}, count(*) AS product_count, CAST(sum(n) AS BIGINT) AS review_count, CAST(sum(n) AS BIGINT) AS rating_sample_size,
 {rounded('sum(s) / sum(n)')} AS avg_rating, {rounded('sum(s) / sum(n)')} AS weighted_avg_rating, {rounded('avg(price)')} AS avg_price
FROM once JOIN products USING (product_id) GROUP BY 1, 2"""


@query(_dimension("brand"))
def brand_daily_stats(spark: SparkSession, sf: str) -> DataFrame:
    return marts.brand_daily_stats(frame(spark, sf, "reviews"), frame(spark, sf, "products")).withColumn("date", day("date"))


@query(_dimension("category"))
def category_daily_stats(spark: SparkSession, sf: str) -> DataFrame:
    return marts.category_daily_stats(frame(spark, sf, "reviews"), frame(spark, sf, "products")).withColumn("date", day("date"))


#: A tenth each of the rows stands twice, lacks its product, has no number for a price, or a price below zero.
_FAULTY = (
    "CASE WHEN CAST(product_id AS BIGINT) % 10 = 2 THEN NULL ELSE product_id END AS product_id",
    "CASE WHEN CAST(product_id AS BIGINT) % 10 = 3 THEN CAST('NaN' AS DOUBLE) ELSE avg_price END AS avg_price",
    "CASE WHEN CAST(product_id AS BIGINT) % 10 = 4 THEN -1.0 ELSE min_price END AS min_price", "data_points",
)
_FAULTY_SQL = ", ".join(_FAULTY)


@query(f"""{with_views('prices')}, {_PRICED}, m AS (SELECT d AS date, product_id, av AS avg_price, lo AS min_price, n AS data_points FROM priced), f AS (SELECT date, {_FAULTY_SQL} FROM m UNION ALL SELECT date, {_FAULTY_SQL} FROM m WHERE CAST(product_id AS BIGINT) % 10 = 1)
SELECT sum(CASE WHEN product_id IS NULL THEN 1 ELSE 0 END)::BIGINT AS null_grain, count(*) - (SELECT count(*) FROM (SELECT DISTINCT date, product_id FROM f)) AS repeated_grain, sum(CASE WHEN isnan(avg_price) THEN 1 ELSE 0 END)::BIGINT AS not_finite, sum(CASE WHEN min_price <= 0 THEN 1 ELSE 0 END)::BIGINT AS out_of_range FROM f""")
def mart_faults(spark: SparkSession, sf: str) -> DataFrame:
    mart = marts.price_daily_stats(frame(spark, sf, "prices"))
    twice = mart.unionByName(mart.where("CAST(product_id AS BIGINT) % 10 = 1"))
    return marts.mart_faults(twice.selectExpr("date", *_FAULTY), ["date", "product_id"]).select(*[F.col(c).cast("bigint") for c in ("null_grain", "repeated_grain", "not_finite", "out_of_range")])


@query(f"""{with_views('prices')}, {_PRICED}
SELECT strftime(d, '%Y-%m-%d') AS date, product_id, n AS data_points, strftime((SELECT max(d) FROM priced), '%Y-%m-%d') AS data_as_of, true AS time_available, 'USD' AS currency, 'simulation' AS source_group, 'run-1' AS run_id, CAST(NULL AS VARCHAR) AS source_run_id FROM priced""")
def mart_lineage(spark: SparkSession, sf: str) -> DataFrame:
    mart = marts.price_daily_stats(frame(spark, sf, "prices")).select("date", "product_id", "data_points")
    out = marts.with_lineage(mart, "run-1", source_group="simulation", currency="USD")
    return out.withColumns({"date": day("date"), "data_as_of": day("data_as_of")})


_SPLIT = "up AS (SELECT *, upper(trim(price)) AS t FROM raw_prices)"
#: By the shapes that the view writes, not by the engine's reading.
_PARSED = """CASE WHEN t LIKE '%E%' THEN TRY_CAST(t AS DOUBLE) WHEN t LIKE '$%' THEN TRY_CAST(replace(substring(t, 2), ',', '') AS DOUBLE) WHEN t LIKE '% €' THEN TRY_CAST(replace(replace(replace(t, ' €', ''), '.', ''), ',', '.') AS DOUBLE)
 WHEN t LIKE '% VND' THEN TRY_CAST(replace(replace(t, ' VND', ''), '.', '') AS DOUBLE) ELSE TRY_CAST(t AS DOUBLE) END"""


@query(f"{with_views('raw_prices')}, {_SPLIT} SELECT price_id, price AS written, {_PARSED} AS amount, CASE WHEN ({_PARSED}) > 0 THEN {_PARSED} END AS price FROM up")
def price_text_parse(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, sf, "raw_prices").select("price_id", F.col("price").alias("written"), V.amount(F.col("price")).alias("amount"), V.price(F.col("price")).alias("price"))


_INSTANT = r"""CASE WHEN TRY_CAST(trim({c}) AS DOUBLE) IS NOT NULL THEN epoch_ms(CAST(TRY_CAST(trim({c}) AS DOUBLE) * 1000 AS BIGINT))
 WHEN regexp_matches(trim({c}), '^[0-9]{{4}}[-/]') AND regexp_matches(trim({c}), '([+-][0-9]{{2}}:[0-9]{{2}}|Z)$') THEN CAST(CAST(trim({c}) AS TIMESTAMPTZ) AT TIME ZONE 'UTC' AS TIMESTAMP)
 WHEN regexp_matches(trim({c}), '^[0-9]{{4}}[-/]') THEN TRY_CAST(replace(trim({c}), '/', '-') AS TIMESTAMP)
 ELSE try_strptime(trim({c}), '%d/%m/%Y') END"""


@query(f"{with_views('raw_reviews')} SELECT review_id, review_date AS written, strftime({_INSTANT.format(c='review_date')}, '%Y-%m-%d %H:%M:%S') AS instant FROM raw_reviews")
def timestamp_parse(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, sf, "raw_reviews").select("review_id", F.col("review_date").alias("written"), F.date_format(V.instant(F.col("review_date")), "yyyy-MM-dd HH:mm:ss").alias("instant"))


def _case(column: str, names: dict[str, str]) -> str:
    return f"CASE lower(trim({column})) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items())


@query(f"{with_views('raw_prices')} SELECT price_id, currency AS written, {_case('currency', V.CURRENCY_ALIASES)} ELSE CASE WHEN regexp_matches(trim(currency), '^[A-Za-z]{{3}}$') THEN upper(trim(currency)) END END AS currency FROM raw_prices")
def currency_normalize(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, sf, "raw_prices").select("price_id", F.col("currency").alias("written"), V.currency(F.col("currency")).alias("currency"))


def _title(c: str) -> str:
    return f"upper(substring(trim({c}), 1, 1)) || lower(substring(trim({c}), 2))"


@query(f"""{with_views('raw_prices')} SELECT price_id, CASE WHEN brand IS NULL OR trim(brand) = '' THEN 'Unknown' ELSE {_case('brand', V.BRAND_ALIASES)} ELSE {_title('brand')} END END AS brand,
 CASE WHEN category IS NULL OR trim(category) = '' THEN 'Other' ELSE {_case('category', V.CATEGORY_ALIASES)} ELSE {_title('category')} END END AS category FROM raw_prices""")
def brand_alias(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, sf, "raw_prices").select("price_id", V.brand(F.col("brand")).alias("brand"), V.category(F.col("category")).alias("category"))


@query(f"{with_views('raw_reviews')} SELECT review_id, CASE WHEN trim(user_id) IN ('', 'none') THEN 'anon_redacted' ELSE 'anon_' || substring(sha256('salt:' || trim(user_id)), 1, 16) END AS user_id FROM raw_reviews")
def pii_hash(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, sf, "raw_reviews").select("review_id", V.pseudonymous_user(F.col("user_id"), "salt").alias("user_id"))


@query(f"{with_views('raw_reviews')} SELECT review_id, md5(lower(trim(coalesce(product_id, ''))) || '|' || lower(trim(coalesce(review_text, ''))) || '|' || substring(lower(trim(coalesce(ingested_at, ''))), 1, 10)) AS digest FROM raw_reviews")
def composite_md5(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, sf, "raw_reviews").select("review_id", V.composite_digest(F.col("product_id"), F.col("review_text"), F.col("ingested_at"), date_last=True).alias("digest"))


_READ = f"""typed AS (SELECT *, TRY_CAST(trim(rating) AS DOUBLE) AS num, {_INSTANT.format(c='review_date')} AS seen_at FROM raw_reviews),
judged AS (SELECT *, CASE WHEN num BETWEEN 1 AND 5 THEN num END AS value,
 CASE WHEN trim(rating) <> '' AND num IS NULL THEN 'INVALID_TYPE_RATING' WHEN seen_at IS NULL THEN 'INVALID_TYPE_TIMESTAMP' WHEN num IS NULL OR num NOT BETWEEN 1 AND 5 THEN 'INVALID_RATING_OUT_OF_RANGE'
 WHEN trim(review_text) = '' THEN 'MISSING_REVIEW_TEXT' WHEN product_id IS NULL THEN 'MISSING_PRODUCT_ID' WHEN trim(review_id) = '' THEN 'MISSING_REVIEW_ID' END AS reason FROM typed)"""


@query(f"{with_views('raw_reviews')}, {_READ} SELECT trim(review_id) AS review_id, trim(product_id) AS product_id, value AS rating, rating AS rating_raw, trim(review_text) AS review_text, strftime(seen_at, '%Y-%m-%d %H:%M:%S') AS review_date, reason AS quarantine_reason FROM judged")
def validate_split(spark: SparkSession, sf: str) -> DataFrame:
    rows = silver.judged(silver.standardise(frame(spark, sf, "raw_reviews"), "reviews"), "reviews")
    return rows.select("review_id", "product_id", "rating", "rating_raw", "review_text", F.date_format("review_date", "yyyy-MM-dd HH:mm:ss").alias("review_date"), "quarantine_reason")


@query(f"{with_views('raw_reviews')}, {_READ} SELECT reason AS quarantine_reason, count(*) AS n FROM judged WHERE reason IS NOT NULL GROUP BY 1")
def quarantine_histogram(spark: SparkSession, sf: str) -> DataFrame:
    _, bad = silver.split(silver.standardise(frame(spark, sf, "raw_reviews"), "reviews"), "reviews")
    return silver.reason_histogram(bad)


@query(f"""{with_views('raw_reviews')}, {_READ}, codes AS (SELECT CASE WHEN trim(rating) = '' THEN 'MISSING_RATING' WHEN value IS NULL THEN 'INVALID_RATING' END AS code FROM judged UNION ALL SELECT CASE WHEN seen_at IS NULL THEN 'INVALID_REVIEW_DATE' END FROM judged)
SELECT code, count(*) AS n FROM codes WHERE code IS NOT NULL GROUP BY 1""")
def error_code_explode(spark: SparkSession, sf: str) -> DataFrame:
    return silver.error_histogram(silver.standardise(frame(spark, sf, "raw_reviews"), "reviews"))


_NULLS = ("review_id", "product_id", "rating", "review_text")


@query(f"{with_views('raw_reviews')} " + " UNION ALL ".join([f"SELECT '{c}' AS field, sum(CASE WHEN {c} IS NULL OR trim({c}) = '' THEN 1 ELSE 0 END)::BIGINT AS n_null, count(*) AS n_rows FROM raw_reviews" for c in _NULLS] + ["SELECT NULL, sum(CASE WHEN " + " OR ".join(f"{c} IS NULL OR trim({c}) = ''" for c in _NULLS) + " THEN 1 ELSE 0 END)::BIGINT, count(*) FROM raw_reviews"]))
def field_null_stats(spark: SparkSession, sf: str) -> DataFrame:
    return silver.null_counts(frame(spark, sf, "raw_reviews").select(*_NULLS), list(_NULLS))


_LATEST = "SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY price_id ORDER BY timestamp DESC NULLS LAST, product_id DESC, price DESC, currency DESC) AS k FROM {t}) WHERE k = 1"


@query(f"{with_views('prices')}, best AS ({_LATEST.format(t='prices')}) SELECT price_id, product_id, price, strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS at, currency FROM best")
def latest_wins_dedup(spark: SparkSession, sf: str) -> DataFrame:
    out = silver.latest(frame(spark, sf, "prices"), ["price_id"], "timestamp")
    return out.select("price_id", "product_id", "price", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("at"), "currency")


_HALVES = "old AS (SELECT * FROM prices WHERE year(timestamp) < 1996), new AS (SELECT * FROM prices WHERE year(timestamp) >= 1996)"


def _halves(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    prices = frame(spark, sf, "prices")
    return prices.where("year(timestamp) < 1996"), prices.where("year(timestamp) >= 1996")


@query(f"{with_views('prices')}, {_HALVES} SELECT DISTINCT price_id FROM new WHERE price_id IN (SELECT price_id FROM old)")
def cross_batch_semi(spark: SparkSession, sf: str) -> DataFrame:
    old, new = _halves(spark, sf)
    return new.select("price_id").join(old.select("price_id"), "price_id", "left_semi").distinct()


@query(f"{with_views('prices')}, {_HALVES}, ranked AS (SELECT *, row_number() OVER (PARTITION BY price_id ORDER BY incoming DESC, timestamp DESC NULLS LAST, product_id DESC, price DESC, currency DESC) AS k FROM (SELECT *, 0 AS incoming FROM old UNION ALL SELECT *, 1 FROM new)) SELECT price_id, product_id, price, strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS at FROM ranked WHERE k = 1")
def merge_upsert(spark: SparkSession, sf: str) -> DataFrame:
    old, new = _halves(spark, sf)
    return silver.merged(old, new, ["price_id"], "timestamp").select("price_id", "product_id", "price", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("at"))


@query(f"""{with_views('prices')}, {_HALVES}, k AS (SELECT price_id, count(*) AS n, (SELECT count(*) FROM old) AS o FROM new GROUP BY 1), oldk AS (SELECT DISTINCT price_id FROM old),
s AS (SELECT (SELECT count(*) FROM new) AS v, (SELECT count(*) FROM k) AS d, (SELECT count(*) FROM k WHERE price_id IN (SELECT price_id FROM oldk)) AS x, (SELECT count(*) FROM oldk) AS p)
SELECT v AS input_rows, CAST(0 AS BIGINT) AS quarantined, v - d AS intra_batch_duplicates, x AS cross_batch_duplicates, d - x AS new_rows, p AS previous_rows, p + d - x AS written_rows, {rounded('100.0 * d / v')} AS dq_score FROM s""")
def merge_accounting(spark: SparkSession, sf: str) -> DataFrame:
    old, new = _halves(spark, sf)
    return silver.accounted(old, new, new.where("price IS NULL"), "price_id")


@query(f"{with_views('prices', 'products')} SELECT price_id, product_id FROM prices WHERE product_id NOT IN (SELECT product_id FROM products)")
def orphan_anti(spark: SparkSession, sf: str) -> DataFrame:
    return serving.orphans(frame(spark, sf, "prices"), frame(spark, sf, "products"), "product_id").select("price_id", "product_id")


@query(f"{with_views('raw_reviews')}, n AS (SELECT review_id, row_number() OVER (PARTITION BY review_id ORDER BY ingested_at, product_id NULLS FIRST, rating, review_date, user_id, verified_purchase, review_text) AS k FROM raw_reviews) SELECT review_id, k > 1 AS is_duplicate, count(*) AS n FROM n GROUP BY 1, 2")
def first_occurrence_dup_flag(spark: SparkSession, sf: str) -> DataFrame:
    flagged = quality.flag_duplicates(frame(spark, sf, "raw_reviews"), "review_id", "ingested_at", "product_id", "rating", "review_date", "user_id", "verified_purchase", "review_text")
    return flagged.groupBy("review_id", "is_duplicate").agg(F.count("*").alias("n"))


@query(f"""{with_views('raw_reviews')}, f AS (SELECT review_id AS k, (trim(review_id) = '' OR product_id IS NULL OR trim(rating) = '' OR trim(review_text) = '') AS lacking,
 (trim(rating) <> '' AND TRY_CAST(trim(rating) AS DOUBLE) IS NULL OR TRY_CAST(verified_purchase AS BOOLEAN) IS NULL OR ({_INSTANT.format(c='review_date')}) IS NULL) AS bad,
 coalesce(TRY_CAST(trim(rating) AS DOUBLE) NOT BETWEEN 1 AND 5, false) AS outside FROM raw_reviews),
g AS (SELECT k, count(*) AS n, sum(CASE WHEN lacking THEN 1 ELSE 0 END) AS l, sum(CASE WHEN bad THEN 1 ELSE 0 END) AS c, sum(CASE WHEN outside THEN 1 ELSE 0 END) AS r, sum(CASE WHEN lacking OR bad OR outside THEN 1 ELSE 0 END) AS q FROM f GROUP BY 1),
s AS (SELECT sum(n)::BIGINT AS total, sum(greatest(n - 1, q))::BIGINT AS invalid, sum(l)::BIGINT AS missing, sum(c)::BIGINT AS casts, sum(r)::BIGINT AS ranges, sum(q)::BIGINT AS quarantined, sum(n - 1)::BIGINT AS dup FROM g)
SELECT 'reviews' AS dataset, total, total - invalid AS valid, invalid, missing, casts AS cast_errors, ranges AS range_errors, quarantined, dup AS duplicates, {rounded('100.0 * (total - invalid) / total')} AS dq_score, {rounded('missing / total', 4)} AS missing_ratio, {rounded('dup / total', 4)} AS duplicate_ratio FROM s""")
def dq_evaluate(spark: SparkSession, sf: str) -> DataFrame:
    out = quality.evaluate(frame(spark, sf, "raw_reviews"), "reviews", "review_id", ["review_id", "product_id", "rating", "review_text"], {"rating": "double", "verified_purchase": "boolean", "review_date": "timestamp"}, {"rating": (1, 5)})
    return out.select("dataset", *[F.col(c).cast("bigint") for c in ("total", "valid", "invalid", "missing", "cast_errors", "range_errors", "quarantined", "duplicates")], "dq_score", "missing_ratio", "duplicate_ratio")


_FIRST = "first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY price_id ORDER BY timestamp, product_id, price) AS k FROM prices) WHERE k = 1)"


@query(f"""{with_views('prices')}, {_FIRST} SELECT * FROM (SELECT 'not_null(product_id)' AS rule, count(*) AS evaluated, count(*) AS passed, CAST(0 AS BIGINT) AS failed FROM first
UNION ALL SELECT 'in_range(price)', count(*), sum(CASE WHEN price BETWEEN 5000 AND 50000 THEN 1 ELSE 0 END)::BIGINT, sum(CASE WHEN price BETWEEN 5000 AND 50000 THEN 0 ELSE 1 END)::BIGINT FROM first
UNION ALL SELECT 'even_product', count(*), sum(CASE WHEN CAST(product_id AS BIGINT) % 2 = 0 THEN 1 ELSE 0 END)::BIGINT, sum(CASE WHEN CAST(product_id AS BIGINT) % 2 = 0 THEN 0 ELSE 1 END)::BIGINT FROM first)""")
def dq_rule_scorecard(spark: SparkSession, sf: str) -> DataFrame:
    registry = R.Registry()
    registry.register("prices", R.not_null("product_id"), R.in_range("price", 5000, 50000), R.custom("even_product", F.expr("CAST(product_id AS BIGINT) % 2 = 0")))
    return quality.scorecard(frame(spark, sf, "prices"), registry.of("prices"), "price_id", "timestamp", "product_id", "price")


@query(f"{with_views('prices', 'products')} SELECT product_id, price, price_id, CAST(NULL AS VARCHAR) AS brand FROM prices UNION ALL SELECT product_id, price, NULL, brand FROM products")
def union_by_name(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, sf, "prices").select("price_id", "product_id", "price").unionByName(frame(spark, sf, "products").select("product_id", "price", "brand"), allowMissingColumns=True)
