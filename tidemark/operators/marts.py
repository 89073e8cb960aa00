"""Daily marts over current-state reviews, products and prices, their lineage and their checks.

Each mart has one row per day and product, brand or category. A day is the UTC date of the
first clock that a row has. What has no observation is null with a status, never zero.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import values as V

# Rating thresholds, clocks and source groups.
POSITIVE, NEGATIVE = 4.0, 2.0
REVIEW_CLOCKS, PRICE_CLOCKS = ("date", "review_date"), ("date", "timestamp")
METHODS = {"marketplace": ("live", "snapshot_replay"), "simulation": ("generated",)}


def with_date(df: DataFrame, clocks: tuple[str, ...]) -> DataFrame:
    """date: of the first clock that can be read, row by row."""
    kinds = {f.name: f.dataType.typeName() for f in df.schema}
    read = [F.to_date(V.instant(F.col(c)) if kinds[c] == "string" else F.col(c).cast("timestamp")) for c in clocks if c in kinds]
    return df.withColumn("date", F.coalesce(*read) if read else F.lit(None).cast("date"))


def review_observations(reviews: DataFrame, ingestion_fallback: bool = False) -> DataFrame:
    """date, product_id, review_id, rating, time_available of reviews that have all four; ingestion_fallback takes ingested_at where no business clock is known."""
    dated = with_date(reviews, REVIEW_CLOCKS).withColumn("time_available", F.col("date").isNotNull())
    if ingestion_fallback and "ingested_at" in reviews.columns:
        dated = dated.withColumn("date", F.coalesce("date", F.to_date(F.col("ingested_at").cast("timestamp"))))
    fit = F.col("date").isNotNull() & ~V.blank(F.col("product_id")) & ~V.blank(F.col("review_id")) & V.finite(F.col("rating").cast("double")) & F.col("rating").between(1, 5)
    return dated.where(fit).select("date", "product_id", "review_id", F.col("rating").cast("double").alias("rating"), "time_available")


def _positive(c: Column) -> Column:
    d = c.cast("double")
    return F.when(V.finite(d) & (d > 0), d)


def catalog(products: DataFrame) -> DataFrame:
    """product_id, brand, category, price of products with an id; a repeated id is an error for the marts' joins, see repeated()."""
    have = products.columns
    text = lambda c: F.col(c) if c in have else F.lit(None).cast("string").alias(c)
    return products.where(~V.blank(F.col("product_id"))).select("product_id", text("brand"), text("category"), _positive(F.col("price")).alias("catalog_price"))


def repeated(df: DataFrame, *key: str) -> DataFrame:
    """Keys that stand in several rows."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def require_unique(df: DataFrame, *key: str) -> None:
    if not repeated(df, *key).isEmpty():
        raise ValueError(f"{', '.join(key)} is not unique")


def _rating_measures() -> list[Column]:
    n = F.count("*")
    return [
        n.alias("review_count"),
        n.alias("rating_sample_size"),
        V.half_up(F.avg("rating")).alias("avg_rating"),
        V.half_up(F.stddev_samp("rating")).alias("rating_std"),
        V.half_up(F.count_if(F.col("rating") >= POSITIVE) / n, 4).alias("positive_ratio"),
        V.half_up(F.count_if(F.col("rating") <= NEGATIVE) / n, 4).alias("negative_ratio"),
    ]


def price_daily_stats(prices: DataFrame) -> DataFrame:
    """Per day and product: least, largest, mean price, deviation (null for one point), number of points."""
    seen = with_date(prices, PRICE_CLOCKS).withColumn("price", _positive(F.col("price")))
    return (
        seen.where("date IS NOT NULL AND price IS NOT NULL")
        .where(~V.blank(F.col("product_id")))
        .groupBy("date", "product_id")
        .agg(
            V.half_up(F.min("price")).alias("min_price"),
            V.half_up(F.max("price")).alias("max_price"),
            V.half_up(F.avg("price")).alias("avg_price"),
            V.half_up(F.stddev_samp("price")).alias("price_std"),
            F.count("*").alias("data_points"),
        )
    )


def product_daily_stats(reviews: DataFrame, products: DataFrame | None = None, prices: DataFrame | None = None) -> DataFrame:
    """Ratings per day and product with that day's observed prices, else the catalog's price, else none.

    Facts are combined map-side to one row a day and product before any join; the catalog
    joins last, by the adaptive plan's choice of strategy.
    """
    rated = review_observations(reviews).groupBy("date", "product_id").agg(*_rating_measures())
    rated = rated.withColumns({"weighted_avg_rating": F.col("avg_rating"), "high_rating_ratio": F.col("positive_ratio"), "low_rating_ratio": F.col("negative_ratio")})
    if prices is not None:
        observed = price_daily_stats(prices).select("date", "product_id", "min_price", "max_price", "avg_price")
        rated = rated.join(observed, ["date", "product_id"], "left")
    else:
        rated = rated.withColumns({c: F.lit(None).cast("double") for c in ("min_price", "max_price", "avg_price")})
    listed = catalog(products).select("product_id", "catalog_price") if products is not None else None
    out = rated.join(listed, "product_id", "left") if listed is not None else rated.withColumn("catalog_price", F.lit(None).cast("double"))
    source = F.when(F.col("avg_price").isNotNull(), "observed").when(F.col("catalog_price").isNotNull(), "catalog_fallback").otherwise("unavailable")
    seen = F.col("avg_price").isNotNull()
    filled = {c: F.when(seen, F.col(c)).otherwise(V.half_up(F.col("catalog_price"))) for c in ("min_price", "max_price", "avg_price")}
    return out.withColumns(filled | {"price_source": source}).drop("catalog_price")


def dimension_daily_stats(reviews: DataFrame, products: DataFrame, dimension: str) -> DataFrame:
    """Per day and brand or category: products and reviews seen, mean rating, mean catalog price with one vote a product and day.

    Reviews are combined per day and product first; sums and counts then roll up to the dimension,
    so one join and one further aggregate suffice.
    """
    of_product = review_observations(reviews).groupBy("date", "product_id").agg(F.sum("rating").alias("s"), F.count("*").alias("n"))
    listed = catalog(products).select("product_id", dimension, "catalog_price")
    return (
        of_product.join(listed, "product_id")
        .groupBy("date", dimension)
        .agg(
            F.count("*").alias("product_count"),
            F.sum("n").alias("review_count"),
            F.sum("n").alias("rating_sample_size"),
            V.half_up(F.sum("s") / F.sum("n")).alias("avg_rating"),
            V.half_up(F.sum("s") / F.sum("n")).alias("weighted_avg_rating"),
            V.half_up(F.avg("catalog_price")).alias("avg_price"),
        )
    )


def brand_daily_stats(reviews: DataFrame, products: DataFrame) -> DataFrame:
    return dimension_daily_stats(reviews, products, "brand")


def category_daily_stats(reviews: DataFrame, products: DataFrame) -> DataFrame:
    return dimension_daily_stats(reviews, products, "category")


def with_lineage(mart: DataFrame, run_id: str, source_run_id: str | None = None, source_group: str = "unverified", currency: str | None = None) -> DataFrame:
    """Run, source and currency columns, and data_as_of: the last date with a known business clock (a scalar, not a window)."""
    known = F.when(F.col("time_available"), F.col("date")) if "time_available" in mart.columns else F.col("date")
    as_of = mart.agg(F.max(known).alias("data_as_of"))  # one row
    out = mart if "time_available" in mart.columns else mart.withColumn("time_available", F.lit(True))
    return out.crossJoin(F.broadcast(as_of)).withColumns(
        {"currency": F.lit(currency).cast("string"), "source_group": F.lit(source_group), "run_id": F.lit(run_id), "source_run_id": F.lit(source_run_id).cast("string")}
    )


def mart_faults(mart: DataFrame, grain: list[str]) -> DataFrame:
    """One row: rows with a null grain, repeated grains, non-finite or out-of-range values; all zero for a sound mart."""
    kinds = {f.name: f.dataType.typeName() for f in mart.schema}
    nulls = F.lit(False)
    for c in grain:
        nulls = nulls | F.col(c).isNull()
    doubles = [c for c, k in kinds.items() if k in ("double", "float")]
    endless = reduce(lambda x, y: x | y, [F.col(c).isNotNull() & ~V.finite(F.col(c)) for c in doubles], F.lit(False))
    out = F.lit(False)
    for c in kinds:
        if c.endswith("_ratio"):
            out = out | ~F.col(c).between(0, 1)
        elif c.endswith("avg_rating"):
            out = out | ~F.col(c).between(1, 5)
        elif c.endswith("_price"):
            out = out | (F.col(c) <= 0)
        elif c.endswith("_count") or c in ("rating_sample_size", "data_points"):
            out = out | (F.col(c) <= 0)
    per = mart.groupBy(*grain).agg(F.count("*").alias("n"), F.count_if(nulls).alias("nulls"), F.count_if(endless).alias("endless"), F.count_if(F.coalesce(out, F.lit(False))).alias("outside"))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return per.agg(zero("nulls").alias("null_grain"), zero(F.col("n") - 1).alias("repeated_grain"), zero("endless").alias("not_finite"), zero("outside").alias("out_of_range"))


def require_sound(mart: DataFrame, grain: list[str]) -> None:
    faults = mart_faults(mart, grain).first().asDict()
    if any(faults.values()):
        raise ValueError(f"mart is not sound: {faults}")


def source_group(*frames: DataFrame) -> str:
    """The one source group of the frames' rows: marketplace, simulation or unverified; mixed or contradictory ones are an error."""
    found: set[tuple] = set()
    for df in frames:
        pair = [F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in ("source_group", "acquisition_method")]
        found |= {tuple(r) for r in df.select(*pair).distinct().limit(17).collect()}
    groups = {g or "unverified" for g, _ in found}
    if len(groups) > 1:
        raise ValueError(f"mixed source groups: {sorted(groups)}")
    for group, method in found:
        if group in METHODS and method is not None and method not in METHODS[group]:
            raise ValueError(f"{group} rows can't be acquired by {method}")
    return groups.pop() if groups else "unverified"


def single_currency(*frames: tuple[DataFrame, str]) -> str | None:
    """The one currency of all rows with a value in the money column given; several, or known and unknown ones, are an error."""
    found: set[str | None] = set()
    for df, money in frames:
        unit = V.currency(F.col("currency")) if "currency" in df.columns else F.lit(None).cast("string")
        found |= {r[0] for r in df.where(F.col(money).isNotNull()).select(unit.alias("c")).distinct().limit(3).collect()}
    if len(found) > 1:
        raise ValueError(f"mixed currencies: {sorted(map(str, found))}")
    return found.pop() if found else None
