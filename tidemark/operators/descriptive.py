"""Summaries, comparisons, indicators, histograms, percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import values as V
from tidemark.operators import marts, ranks

# The classes of anomaly kinds.
KINDS = {"price": "PRICE", "rating": "RATING", "volume": "BURST|BOMBING"}


def _rated(reviews: DataFrame) -> DataFrame:
    r = F.col("rating").cast("double")
    return reviews.where(~V.blank(F.col("review_id")) & V.finite(r) & r.between(1, 5)).select("product_id", r.alias("rating"))


def dataset_summary(products: DataFrame, reviews: DataFrame) -> DataFrame:
    """One row: totals, distinct brands and categories, mean and median rating and price, least and largest price."""
    p = F.col("price").cast("double")
    price = F.when(V.finite(p) & (p > 0), p)
    of_products = products.agg(
        F.count("*").alias("total_products"), F.countDistinct("brand").alias("brands"), F.countDistinct("category").alias("categories"),
        V.half_up(F.min(price)).alias("min_price"), V.half_up(F.max(price)).alias("max_price"), V.half_up(F.avg(price)).alias("avg_price"),
    )
    of_reviews = _rated(reviews).agg(F.count("*").alias("total_reviews"), V.half_up(F.avg("rating")).alias("avg_rating"))
    prices = ranks.median(products, price, "median_price").select(V.half_up(F.col("median_price")).alias("median_price"))
    stars = ranks.median(_rated(reviews), F.col("rating"), "median_rating").select(V.half_up(F.col("median_rating")).alias("median_rating"))
    return of_products.crossJoin(of_reviews).crossJoin(prices).crossJoin(stars)  # one row each


def star_distribution(reviews: DataFrame) -> DataFrame:
    """Stars (rounded half to even), count, share."""
    by_star = _rated(reviews).groupBy(F.bround("rating", 0).cast("int").alias("stars")).agg(F.count("*").alias("n"))
    total = by_star.agg(F.sum("n").alias("total"))
    return by_star.crossJoin(F.broadcast(total)).select("stars", "n", V.half_up(F.col("n") / F.col("total"), 4).alias("ratio"))


def product_metrics(reviews: DataFrame, products: DataFrame) -> DataFrame:
    """Every catalog product with its review measures; null with a status where it has no sample."""
    n = F.count("*")
    rated = _rated(reviews).groupBy("product_id").agg(
        n.alias("review_count"), V.half_up(F.avg("rating")).alias("avg_rating"), V.half_up(F.stddev_samp("rating")).alias("rating_std"),
        V.half_up(F.count_if(F.col("rating") >= marts.POSITIVE) / n, 4).alias("positive_ratio"), V.half_up(F.count_if(F.col("rating") <= marts.NEGATIVE) / n, 4).alias("negative_ratio"),
    )
    return products.select("product_id", "product_name", "brand", "category").join(rated, "product_id", "left").withColumns(
        {"review_count": F.coalesce("review_count", F.lit(0)), "rating_availability_status": F.when(F.col("avg_rating").isNull(), "unavailable").otherwise("available")}
    )


def compare_by(products: DataFrame, reviews: DataFrame, dimension: str) -> DataFrame:
    """Brands or categories: products, catalog prices (whatever the reviews), review measures, most reviewed first.

    Reviews are combined by product before the join.
    """
    p = F.col("price").cast("double")
    price = F.when(V.finite(p) & (p > 0), p)
    of_product = _rated(reviews).groupBy("product_id").agg(F.sum("rating").alias("s"), F.count("*").alias("n"))
    x = products.select("product_id", dimension, price.alias("price")).join(of_product, "product_id", "left")
    return (
        x.groupBy(dimension)
        .agg(
            F.count("*").alias("product_count"), V.half_up(F.avg("price")).alias("avg_price"), V.half_up(F.min("price")).alias("min_price"), V.half_up(F.max("price")).alias("max_price"),
            F.coalesce(F.sum("n"), F.lit(0)).alias("review_count"), V.half_up(F.sum("s") / F.sum("n")).alias("avg_rating"),
        )
        .orderBy(F.desc("review_count"), dimension)
    )


def kpi_summary(product_mart: DataFrame, brand_mart: DataFrame, quality: DataFrame) -> DataFrame:
    """One row: marts' reviews, products, brands, rating weighted by sample (null without one), mean quality score."""
    w = F.coalesce("rating_sample_size", "review_count")
    fit = F.col("avg_rating").between(1, 5) & (w > 0)
    a = product_mart.agg(
        F.coalesce(F.sum("review_count"), F.lit(0)).alias("total_reviews"), F.countDistinct("product_id").alias("total_products"),
        V.half_up(F.try_divide(F.sum(F.when(fit, F.col("avg_rating") * w)), F.sum(F.when(fit, w)))).alias("avg_rating"),
    )
    b = brand_mart.agg(F.countDistinct("brand").alias("total_brands"))
    c = quality.agg(V.half_up(F.avg("dq_score")).alias("avg_dq_score"))
    return a.crossJoin(b).crossJoin(c)  # one row each


def latest_reports(reports: DataFrame, name: str = "dataset", at: str = "measured_at") -> DataFrame:
    """Each dataset's newest reports, all of a tie."""
    last = F.max(at).over(Window.partitionBy(name))
    return reports.withColumn("_last", last).where(F.col(at) == F.col("_last")).drop("_last")


def histogram(df: DataFrame, value: Column, name: str) -> DataFrame:
    return df.groupBy(value.alias(name)).agg(F.count("*").alias("n"))


def purchase_status(c: Column) -> Column:
    return F.when(c.isNull(), "unknown").when(c, "verified").otherwise("unverified")


def latest_total(mart: DataFrame, value: str = "product_count") -> DataFrame:
    """The sum over the last day's rows: combined by day, then the one with the largest date."""
    daily = mart.groupBy("date").agg(F.sum(value).alias("v"))
    return daily.agg(F.max("date").alias("date"), F.max_by("v", "date").alias(value))


def anomaly_counts(events: DataFrame) -> DataFrame:
    """One row: incidents of each class by kind name."""
    return events.agg(F.count("*").alias("total"), *[F.count_if(F.col("anomaly_type").rlike(p)).alias(k) for k, p in KINDS.items()])


def coverage(mart: DataFrame) -> DataFrame:
    """One row: rows with a known, an unavailable or no stated clock; rows priced by the catalog; samples; last date."""
    return mart.agg(
        F.count_if("time_available").alias("timed_rows"), F.count_if(~F.col("time_available")).alias("untimed_rows"), F.count_if(F.col("time_available").isNull()).alias("unknown_rows"),
        F.count_if(F.col("price_source") == "catalog_fallback").alias("fallback_rows"), F.coalesce(F.sum("rating_sample_size"), F.lit(0)).alias("samples"), F.max("date").alias("data_as_of"),
    )


def percentiles(df: DataFrame, value: str, shares: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """One row: exact percentiles by nearest rank."""
    return ranks.nearest(df, F.col(value), {f"p{round(100 * s)}": s for s in shares})


def run_status(runs: DataFrame) -> DataFrame:
    """Per pipeline and source: the last run's status and end, the last success, failures. runs: pipeline, source, status, ended_at."""
    return runs.groupBy("pipeline", "source").agg(
        F.max_by("status", "ended_at").alias("last_status"), F.max("ended_at").alias("last_run"),
        F.max(F.when(F.col("status") == "success", F.col("ended_at"))).alias("last_success"), F.count_if(F.col("status") == "failed").alias("failures"),
    )
