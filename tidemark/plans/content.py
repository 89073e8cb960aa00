"""Queries of articles, snapshots and published tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import articles, product_pages, silver, snapshots
from tidemark.plans.adapters import frame, rounded, with_views
from tidemark.plans.scratch import folder
from tidemark.sources import published

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


_CLOCKED = r"""c AS (SELECT *, CASE WHEN regexp_matches(collected_at, 'Z$') THEN CAST(replace(replace(collected_at, 'T', ' '), 'Z', '') AS TIMESTAMP) END AS collected,
 CASE WHEN regexp_matches(published_at, '[+-][0-9]{2}:[0-9]{2}$') THEN CAST(CAST(published_at AS TIMESTAMPTZ) AT TIME ZONE 'UTC' AS TIMESTAMP) END AS published FROM articles),
j AS (SELECT *, CASE WHEN trim(title) = '' OR body IS NULL OR regexp_matches(body, '^ *$') THEN 'SCHEMA_ERROR' WHEN collected IS NULL THEN 'INVALID_COLLECTED_AT' WHEN published_at = 'yesterday' THEN 'INVALID_PUBLISHED_AT'
 WHEN contains(source_url, 'other.example.net') THEN 'SOURCE_MISMATCH' WHEN content_sha256 = 'wrong' THEN 'BODY_HASH_MISMATCH'
 WHEN min(content_sha256) OVER (PARTITION BY article_id, collected) <> max(content_sha256) OVER (PARTITION BY article_id, collected) THEN 'AMBIGUOUS_VERSION' END AS reason FROM c)"""


@query(f"{with_views('articles')}, {_CLOCKED} SELECT article_id, source_url, strftime(collected, '%Y-%m-%d %H:%M:%S') AS collected, reason FROM j")
def article_checks(spark: SparkSession, sf: str) -> DataFrame:
    out = articles.judged(frame(spark, sf, "articles"))
    return out.select("article_id", "source_url", F.date_format("collected", "yyyy-MM-dd HH:mm:ss").alias("collected"), "reason")


@query(f"{with_views('articles')}, {_CLOCKED}, k AS (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY collected DESC) AS n FROM j WHERE reason IS NULL) SELECT article_id, content_sha256, strftime(collected, '%Y-%m-%d %H:%M:%S') AS collected FROM k WHERE n = 1")
def article_versions(spark: SparkSession, sf: str) -> DataFrame:
    current, _ = articles.versions(frame(spark, sf, "articles"))
    return current.select("article_id", "content_sha256", F.date_format("collected", "yyyy-MM-dd HH:mm:ss").alias("collected"))


@query(f"""{with_views('articles')}, {_CLOCKED}, g AS (SELECT * FROM j WHERE reason IS NULL), s AS (SELECT (SELECT count(*) FROM g) AS v, (SELECT count(*) FROM (SELECT DISTINCT article_id, collected, content_sha256 FROM g)) AS o, (SELECT count(DISTINCT article_id) FROM g) AS a,
 (SELECT count(*) FROM j WHERE reason IS NOT NULL) AS q, (SELECT count(*) FROM g WHERE published IS NULL) AS m)
SELECT v AS valid, v - o AS duplicate, o - a AS superseded, q AS quarantined, m AS missing_clock, {rounded('100.0 * v / (v + q)')} AS dq_score FROM s""")
def article_quality(spark: SparkSession, sf: str) -> DataFrame:
    _, counts = articles.versions(frame(spark, sf, "articles"))
    return counts.select("valid", "duplicate", "superseded", "quarantined", "missing_clock", "dq_score")


@query(f"{with_views('articles')}, {_CLOCKED}, k AS (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY collected DESC, published DESC NULLS LAST, source_url) AS n FROM j WHERE reason IS NULL) SELECT strftime(published, '%Y-%m-%d') AS date, source_name, count(*) AS article_count, sum(length(body))::BIGINT AS total_text_characters FROM j WHERE reason IS NULL AND published IS NOT NULL GROUP BY 1, 2")
def article_daily_stats(spark: SparkSession, sf: str) -> DataFrame:
    good = articles.judged(frame(spark, sf, "articles")).where("reason IS NULL")
    return articles.daily_stats(good).withColumn("date", F.date_format("date", "yyyy-MM-dd"))


_ENTITIES = "replace(replace(replace(replace(replace(replace({}, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&')"


def _visible(c: str) -> str:
    for tag in ("script", "style", "nav", "form", "noscript"):
        c = rf"regexp_replace({c}, '(?is)<{tag}\b.*?</{tag}\s*>', ' ', 'g')"
    return rf"trim(regexp_replace({_ENTITIES.format(rf"regexp_replace({c}, '(?s)<!--.*?-->|<[^>]+>', ' ', 'g')")}, '\s+', ' ', 'g'))"


@query(rf"""SELECT page_id, nullif({_visible(r"regexp_extract(html, '(?is)<h1\b[^>]*>(.*?)</h1\s*>', 1)")}, '') AS title, nullif({_visible(r"regexp_extract(html, '(?is)<article\b[^>]*>(.*?)</article\s*>', 1)")}, '') AS body FROM pages""")
def article_html_parse(spark: SparkSession, sf: str) -> DataFrame:
    return articles.parse_pages(spark.read.parquet(f"{sf}/pages.parquet")).select("page_id", "title", "body")


@query("SELECT p_partkey AS page_id, unnest(['https://shop.example/c' || CAST(p_partkey % 7 AS VARCHAR), 'https://other.example/' || CAST(p_size AS VARCHAR) || '?q=1']) AS link FROM part")
def page_links(spark: SparkSession, sf: str) -> DataFrame:
    pages = frame(spark, sf, "shop_pages")
    return articles.links(pages.select(F.col("page_id").cast("string").alias("url"), "html")).select(F.col("url").cast("bigint").alias("page_id"), "link")


@query("""SELECT CAST(p_partkey AS VARCHAR) AS product_id, CASE WHEN k = 5 THEN p_name || ' 123456' ELSE p_name END AS product_name, CASE WHEN k < 3 THEN p_brand END AS brand, CASE WHEN k IN (1, 4) THEN p_type END AS category,
 CASE k WHEN 0 THEN w + 0.5 WHEN 1 THEN w WHEN 2 THEN w * 1000 WHEN 3 THEN w WHEN 4 THEN w * 1000 END AS price, CASE k WHEN 0 THEN 'EUR' WHEN 2 THEN 'VND' WHEN 3 THEN 'USD' WHEN 4 THEN 'VND' END AS currency,
 CASE WHEN k IN (0, 4) THEN 4.5::DOUBLE END AS rating, CASE k WHEN 0 THEN 1200 + p_size WHEN 4 THEN p_size END AS review_count, CASE k WHEN 0 THEN 'product' WHEN 1 THEN 'candidate' ELSE 'page' END AS evidence
 FROM (SELECT *, p_partkey % 6 AS k, floor(p_retailprice) AS w FROM part)""")
def product_page_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Shop pages of six kinds, made of the products: structured data, embedded data with a decoy, microdata, meta tags, visible text, nothing."""
    out = product_pages.facts(frame(spark, sf, "shop_pages"))
    return out.select("product_id", "product_name", "brand", "category", "price", "currency", "rating", "review_count", "evidence")


def _two(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    products = frame(spark, sf, "products").select("product_id", "brand", "price")
    changed = F.when(F.expr("CAST(product_id AS BIGINT) % 11 = 0"), F.col("price") + 1).otherwise(F.col("price"))
    return products.where("CAST(product_id AS BIGINT) % 13 > 0"), products.where("CAST(product_id AS BIGINT) % 17 > 0").withColumn("price", changed)


@query(f"""{with_views('products')} SELECT product_id, CASE WHEN CAST(product_id AS BIGINT) % 13 = 0 THEN 'added' WHEN CAST(product_id AS BIGINT) % 17 = 0 THEN 'removed' ELSE 'changed' END AS change FROM products
WHERE NOT (CAST(product_id AS BIGINT) % 13 = 0 AND CAST(product_id AS BIGINT) % 17 = 0) AND (CAST(product_id AS BIGINT) % 13 = 0 OR CAST(product_id AS BIGINT) % 17 = 0 OR CAST(product_id AS BIGINT) % 11 = 0)""")
def snapshot_diff(spark: SparkSession, sf: str) -> DataFrame:
    return snapshots.compared(*_two(spark, sf), ["product_id"])


@query(f"""{with_views('products')}, d AS (SELECT substring(sha256('=' || brand || '|=' || category || '|=' || product_id), 1, 15) AS d FROM products)
SELECT count(*) AS row_count, CAST(sum(CAST(CAST('0x' || d AS BIGINT) AS HUGEINT)) AS VARCHAR) AS digest_sum FROM d""")
def table_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    return snapshots.fingerprint(frame(spark, sf, "products").select("product_id", "brand", "category"))


@query(f"""{with_views('prices')}, a AS (SELECT sha256('=' || price_id || '|=' || product_id) AS digest, count(*) AS n FROM prices GROUP BY 1), b AS (SELECT sha256('=' || price_id || '|=' || product_id) AS digest, count(*) AS n FROM prices WHERE price > 20000 GROUP BY 1)
SELECT coalesce(a.digest, b.digest) AS digest, coalesce(a.n, 0) AS n_one, coalesce(b.n, 0) AS n_two FROM a FULL JOIN b ON a.digest = b.digest WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)""")
def multiset_diff(spark: SparkSession, sf: str) -> DataFrame:
    prices = frame(spark, sf, "prices")
    return snapshots.multiset_difference(prices.select("price_id", "product_id"), prices.where("price > 20000").select("price_id", "product_id"))


@query("""WITH r AS (SELECT o_orderkey AS snapshot_id, o_orderdate AS made, CAST(o_orderdate AS DATE) AS d, date_trunc('week', o_orderdate) AS w FROM orders),
dd AS (SELECT d, max(struct_pack(made := made, snapshot_id := snapshot_id)).snapshot_id AS snapshot_id FROM r GROUP BY 1 ORDER BY d DESC LIMIT 7), ww AS (SELECT w, max(struct_pack(made := made, snapshot_id := snapshot_id)).snapshot_id AS snapshot_id FROM r GROUP BY 1 ORDER BY w DESC LIMIT 4)
SELECT snapshot_id, snapshot_id IN (SELECT snapshot_id FROM dd UNION SELECT snapshot_id FROM ww) AS keep FROM r""")
def retention_pick(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("snapshot_id"), F.col("o_orderdate").alias("created_at"))
    return snapshots.retained(rows).select("snapshot_id", "keep")


@query("SELECT l_partkey AS old_id, count(DISTINCT l_suppkey) AS n_new FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1")
def identity_collisions(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_partkey").alias("old_id"), F.col("l_suppkey").alias("new_id"))
    return snapshots.identity_collisions(rows)


@query()
def greedy_dedup(spark: SparkSession, sf: str) -> DataFrame:
    folder(spark)
    rows = frame(spark, sf, "prices").select("price_id", "product_id", "price", "timestamp").withColumn("digest", F.unhex(F.md5(F.concat_ws("|", "product_id", F.date_format("timestamp", "yyyy-MM")))))
    return snapshots.greedy_distinct(rows, "price_id", "digest", F.col("timestamp").cast("long"), F.col("price_id"), F.col("price"), F.col("product_id")).select("price_id", "product_id", "price")


@query(f"{with_views('products')} SELECT product_id, price FROM products WHERE CAST(product_id AS BIGINT) % 2 = 0")
def time_travel_read(spark: SparkSession, sf: str) -> DataFrame:
    at = folder(spark)
    products = frame(spark, sf, "products").select("product_id", "price")
    published.publish(products.where("CAST(product_id AS BIGINT) % 2 = 0"), at)
    published.publish(products.withColumn("price", F.col("price") + 1), at, "upsert", ["product_id"])
    return published.read(spark, at, 0)


@query(f"{with_views('products')} SELECT product_id, CASE WHEN CAST(product_id AS BIGINT) % 3 = 0 THEN price + 1 ELSE price END AS price FROM products")
def published_upsert(spark: SparkSession, sf: str) -> DataFrame:
    at = folder(spark)
    products = frame(spark, sf, "products").select("product_id", "price")
    published.publish(products, at)
    published.publish(products.where("CAST(product_id AS BIGINT) % 3 = 0").withColumn("price", F.col("price") + 1), at, "upsert", ["product_id"], expected=0)
    return published.read(spark, at)


@query("SELECT conv_id, max(turn) AS turn, arg_max(role, turn) AS role, arg_max(text, turn) AS text FROM (SELECT conv_id, turn, max(role) AS role, max(text) AS text FROM conversations GROUP BY 1, 2) GROUP BY 1")
def last_turn(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/conversations.parquet").groupBy("conv_id", "turn").agg(F.max("role").alias("role"), F.max("text").alias("text"))
    return silver.latest(rows, ["conv_id"], "turn")
