"""Articles: reading pages, checking provenance, versions, daily statistics.

Pages are read by regular expressions inside the JVM; a page without an article gives no
row values, and no facts are invented.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import values as V

_OFFSET = r"(?:[Zz]|[+-][0-9]{2}:?[0-9]{2})$"
#: What a product's or review's structured data may hold.
PRODUCT_LD = "`@type` string, name string, sku string, productID string, image string, brand string, offers string, aggregateRating string, review string, `@graph` array<string>"


def _text(html: Column) -> Column:
    """Visible text: without scripts, styles, navigation, forms and tags; white space joined."""
    bare = F.regexp_replace(html, r"(?is)<(script|style|nav|form|noscript)\b.*?</\1\s*>", " ")
    bare = F.regexp_replace(bare, r"(?s)<!--.*?-->|<[^>]+>", " ")
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(sign))
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def structured_data(html: Column) -> Column:
    """The JSON-LD blocks of a page, as text."""
    return F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), 1)


def canonical_url(url: Column) -> Column:
    """Without fragment, query and trailing slash, host in lower case."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), r"[?#].*$", ""), "/+$", "")
    host = F.regexp_extract(bare, r"^(https?://[^/]+)", 1)
    return F.concat(F.lower(host), F.substr(bare, F.length(host) + 1))


def parse_pages(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """article_id, source_name, title, body, content_sha256 of each page; title from structured data, else the first heading; nulls without an article."""
    article = F.regexp_extract(html, r"(?is)<article\b[^>]*>(.*?)</article\s*>", 1)
    blocks = structured_data(F.col(html))
    headline = F.get(F.array_compact(F.transform(blocks, lambda b: F.get_json_object(b, "$.headline"))), 0)
    heading = _text(F.regexp_extract(html, r"(?is)<h1\b[^>]*>(.*?)</h1\s*>", 1))
    body = F.when(article != "", _text(article))
    kept = [c for c in pages.columns if c not in (url, html)]
    read = pages.select(*kept, canonical_url(F.col(url)).alias("source_url"), F.coalesce(headline, F.when(heading != "", heading)).alias("title"), F.when(body != "", body).alias("body"))
    return read.select(
        *kept, F.sha2("source_url", 256).alias("article_id"), "source_url", F.lower(F.parse_url("source_url", F.lit("HOST"))).alias("source_name"),
        "title", "body", F.sha2("body", 256).alias("content_sha256"),
    )


def links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """url, link: distinct absolute links of each page."""
    found = F.array_distinct(F.regexp_extract_all(F.col(html), F.lit(r"""(?i)<a\b[^>]*\bhref\s*=\s*["'](https?://[^"'#]+)"""), 1))
    return pages.select(F.col(url).alias("url"), F.explode(found).alias("link"))


def product_page(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """url and the product facts of its structured data (also inside @graph), else of its Open Graph tags; what isn't stated is null."""
    blocks = structured_data(F.col(html))
    inner = F.flatten(F.transform(blocks, lambda b: F.coalesce(F.from_json(F.get_json_object(b, "$['@graph']"), "array<string>"), F.array(b))))
    product = F.get(F.filter(inner, lambda b: F.coalesce(F.get_json_object(b, "$['@type']") == "Product", F.lit(False))), 0)
    tag = lambda p: F.when(F.regexp_extract(html, p, 1) != "", F.regexp_extract(html, p, 1))
    og = lambda name: tag(rf"""(?i)<meta[^>]*property\s*=\s*["']{name}["'][^>]*content\s*=\s*["']([^"']*)["']""")
    p = pages.select(F.col(url).alias("url"), product.alias("p"), og("og:title").alias("og_title"), og("product:price:amount").alias("og_price"), og("product:price:currency").alias("og_currency"))
    at = lambda path: F.get_json_object("p", path)
    price = F.coalesce(at("$.offers.price"), at("$.offers[0].price"), at("$.offers.lowPrice"), F.col("og_price"))
    unit = F.coalesce(at("$.offers.priceCurrency"), at("$.offers[0].priceCurrency"), F.col("og_currency"))
    return p.select(
        "url", F.coalesce(at("$.sku"), at("$.productID")).alias("product_id"), F.coalesce(at("$.name"), F.col("og_title")).alias("product_name"),
        F.coalesce(at("$.brand.name"), at("$.brand")).alias("brand"), V.price(price).alias("price"), V.currency(unit).alias("currency"),
        V.rating(at("$.aggregateRating.ratingValue")).alias("rating"), at("$.aggregateRating.reviewCount").try_cast("int").alias("review_count"),
    )


def page_reviews(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """url, review_id (stated, else hashed), rating, text, author, date of the reviews in a page's structured data."""
    blocks = structured_data(F.col(html))
    as_array = lambda j: F.coalesce(F.from_json(j, "array<string>"), F.array(j))
    found = F.flatten(F.transform(blocks, lambda b: F.when(F.get_json_object(b, "$.review").isNotNull(), as_array(F.get_json_object(b, "$.review"))).otherwise(F.array().cast("array<string>"))))
    r = pages.select(F.col(url).alias("url"), F.explode(found).alias("r"))
    at = lambda path: F.get_json_object("r", path)
    return r.select(
        "url", F.coalesce(at("$['@id']"), F.substring(F.sha2(F.concat_ws("|", "url", "r"), 256), 1, 20)).alias("review_id"),
        V.rating(F.coalesce(at("$.reviewRating.ratingValue"), at("$.ratingValue"))).alias("rating"), at("$.reviewBody").alias("review_text"),
        F.coalesce(at("$.author.name"), at("$.author")).alias("author"), V.instant(at("$.datePublished")).alias("review_date"),
    )


def clock(c: Column) -> tuple[Column, Column]:
    """The instant, known only with an offset, and the precision: instant, date, timezone_unknown or unknown."""
    t = F.trim(c)
    read = F.when(t.rlike(_OFFSET) & t.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ]"), t.try_cast("timestamp"))
    is_date = t.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & t.try_cast("date").isNotNull()
    naive = t.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ]") & t.try_cast("timestamp_ntz").isNotNull()
    return read, F.when(read.isNotNull(), "instant").when(F.coalesce(is_date, F.lit(False)), "date").when(F.coalesce(naive, F.lit(False)), "timezone_unknown").otherwise("unknown")


def judged(articles: DataFrame) -> DataFrame:
    """articles with collected (instant), precision and reason: the first check that fails, or null.

    articles: article_id, source_name, source_url, title, body, content_sha256, collected_at,
    published_at (texts). Several contents at one id and instant make all of them ambiguous:
    found by a combined least and largest digest, not by a window.
    """
    collected, _ = clock(F.col("collected_at"))
    published, precision = clock(F.col("published_at"))
    host = F.regexp_replace(F.lower(F.parse_url("source_url", F.lit("HOST"))), "^www[.]", "")
    rows = articles.withColumns({"collected": collected, "published": published, "precision": precision})
    spread = rows.where("article_id IS NOT NULL AND collected IS NOT NULL").groupBy("article_id", "collected").agg((F.min("content_sha256") != F.max("content_sha256")).alias("_ambiguous"))
    lacking = F.lit(False)
    for c in ("article_id", "source_name", "source_url", "title", "body", "content_sha256"):
        lacking = lacking | V.blank(F.col(c))
    reason = (
        F.when(lacking, "SCHEMA_ERROR")
        .when(F.col("collected").isNull(), "INVALID_COLLECTED_AT")
        .when(~V.blank(F.col("published_at")) & (F.col("precision") == "unknown"), "INVALID_PUBLISHED_AT")
        .when(~F.coalesce(host == F.regexp_replace(F.lower("source_name"), "^www[.]", ""), F.lit(False)), "SOURCE_MISMATCH")
        .when(F.sha2("body", 256) != F.col("content_sha256"), "BODY_HASH_MISMATCH")
        .when(F.coalesce("_ambiguous", F.lit(False)), "AMBIGUOUS_VERSION")
    )
    return rows.join(spread, ["article_id", "collected"], "left").withColumn("reason", reason).drop("_ambiguous")


def versions(articles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The newest version of each valid article, and one row of counts: valid, duplicate, superseded, quarantined, missing_clock, score."""
    from tidemark.operators.silver import latest

    rows = judged(articles)
    good = rows.where("reason IS NULL")
    once = good.groupBy("article_id", "collected", "content_sha256").agg(F.count("*").alias("n"))
    of_article = once.groupBy("article_id").agg(F.sum("n").alias("n"), F.count("*").alias("v"))
    a = of_article.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("valid"), F.coalesce(F.sum(F.col("n") - F.col("v")), F.lit(0)).alias("duplicate"), F.coalesce(F.sum(F.col("v") - 1), F.lit(0)).alias("superseded"))
    b = rows.agg(F.count("reason").alias("quarantined"), F.count_if(F.col("reason").isNull() & F.col("published").isNull()).alias("missing_clock"))
    total = F.col("valid") + F.col("quarantined")
    counts = a.crossJoin(b).withColumn("dq_score", F.when(total > 0, V.half_up(100 * F.col("valid") / total)))  # one row by one row
    return latest(good, ["article_id"], "collected"), counts


def daily_stats(current: DataFrame) -> DataFrame:
    """Articles and characters by publication date and source."""
    dated = current.where("published IS NOT NULL").select(F.to_date("published").alias("date"), "source_name", F.length("body").alias("n"))
    return dated.groupBy("date", "source_name").agg(F.count("*").alias("article_count"), F.sum("n").alias("total_text_characters"))
