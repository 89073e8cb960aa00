"""Record-level cleaning and contracts: what a loader drops, keeps or refuses before anything is merged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import rules as R
from tidemark.functions import values as V

# Envelope fields, version, event kinds and topics.
ENVELOPE = ("event_id", "event_type", "schema_version", "source", "event_time", "payload")
VERSION = "1.0"
TOPICS = {"product": "product", "review": "review", "price": "price"}
DEFAULT_TITLE = "No Title"


def clean_reviews(reviews: DataFrame, low: float = 1.0, high: float = 5.0, title: str = DEFAULT_TITLE) -> DataFrame:
    """Reviews with text and a rating within bounds; a lacking title gets the default."""
    number = F.trim(F.col("rating").cast("string")).try_cast("double")
    fit = ~V.blank(F.col("review_text")) & V.finite(number) & number.between(low, high)
    return reviews.where(fit).withColumns({"rating": number, "review_text": F.trim("review_text"), "review_title": F.when(V.blank(F.col("review_title")), title).otherwise(F.trim("review_title"))})


def clean_products(products: DataFrame) -> DataFrame:
    """Products with id and name; names, prices and currencies normalised, what can't be read is null."""
    fit = products.where(~V.blank(F.col("product_id")) & ~V.blank(F.col("product_name")))
    numeric = products.schema["price"].dataType.typeName() != "string"
    return fit.withColumns(
        {"product_name": F.trim("product_name"), "brand": V.brand(F.col("brand")), "category": V.category(F.col("category")), "price": V.price(F.col("price"), numeric), "currency": V.currency(F.col("currency"))}
    )


def split_prices(prices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Price rows that may be used (a product, a readable price above zero), and the others with their reason."""
    numeric = prices.schema["price"].dataType.typeName() != "string"
    value = V.price(F.col("price"), numeric)
    reason = F.when(V.blank(F.col("product_id")), "MISSING_PRODUCT_ID").when(V.blank(F.col("price")), "MISSING_PRICE").when(value.isNull(), "INVALID_PRICE")
    rows = prices.withColumns({"price_raw": F.col("price").cast("string"), "reason": reason, "price": value})
    return rows.where("reason IS NULL").drop("reason", "price_raw"), rows.where("reason IS NOT NULL")


def schema_of_topic(topic: str) -> str | None:
    """The dataset whose name a topic holds."""
    return next((name for part, name in TOPICS.items() if part in topic.lower()), None)


def envelope_faults(messages: DataFrame) -> DataFrame:
    """messages with faults: what an envelope lacks or has wrong, empty for a sound one."""
    lacking = [F.when(F.col(c).isNull() if c == "payload" else V.blank(F.col(c)), F.lit(f"MISSING_{c.upper()}")) for c in ENVELOPE]
    wrong = [
        F.when(~V.blank(F.col("schema_version")) & (F.col("schema_version") != VERSION), F.lit("UNSUPPORTED_VERSION")),
        F.when(~V.blank(F.col("event_time")) & V.instant(F.col("event_time")).isNull(), F.lit("INVALID_EVENT_TIME")),
    ]
    return messages.withColumn("faults", F.array_compact(F.array(*lacking, *wrong)))


def contract(df: DataFrame, rules: list[R.Rule], parents: DataFrame | None = None, key: str = "product_id") -> DataFrame:
    """df with faults: the rules that a row breaks, and ORPHAN where its key is no parent's.

    Without any parent (none valid at all) orphans aren't told. Parents' keys are combined
    to distinct ones before the join.
    """
    out = df.withColumn("faults", R.failed(rules))
    if parents is None:
        return out
    known = parents.where(~V.blank(F.col(key))).select(F.col(key).alias("_key")).distinct().withColumn("_known", F.lit(True))
    some = known.agg((F.count("*") > 0).alias("_some"))
    met = out.join(known, F.col(key) == F.col("_key"), "left").crossJoin(F.broadcast(some))  # one row
    orphan = F.when(F.col("_some") & F.col("_known").isNull() & F.col(key).isNotNull(), F.lit("ORPHAN"))
    return met.withColumn("faults", F.array_compact(F.concat("faults", F.array(orphan)))).drop("_key", "_known", "_some")


def topic_counts(messages: DataFrame) -> DataFrame:
    """Per topic: messages, those of a known dataset that may be sent again, those already tried too often."""
    return messages.groupBy("topic").agg(F.count("*").alias("n"), F.count_if(F.lower("topic").rlike("|".join(TOPICS)) & (F.col("tries") < 3)).alias("eligible"), F.count_if(F.col("tries") >= 3).alias("exhausted"))
