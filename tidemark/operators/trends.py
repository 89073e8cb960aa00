"""Daily trends over calendar windows, price trajectories and volatility."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import values as V
from tidemark.operators import marts

# Default window and least observations.
WINDOW_DAYS, MIN_DAYS, MIN_REVIEWS = 7, 2, 2


def _rolled(daily: DataFrame, days: int, by: list[str]) -> DataFrame:
    """daily: date, n, s and the by columns; adds sums over the days up to and with each date that fall in the window."""
    w = Window.partitionBy(*by).orderBy(F.unix_date("date")).rangeBetween(-(days - 1), 0)
    return daily.withColumns({"wn": F.sum("n").over(w), "ws": F.sum("s").over(w), "observed_days": F.count("*").over(w)})


def daily_review_trend(reviews: DataFrame, window_days: int = WINDOW_DAYS, min_days: int = MIN_DAYS, min_reviews: int = MIN_REVIEWS) -> DataFrame:
    """Per day: reviews, mean rating, ratios, and rolling values over the observed days of the window.

    The window runs over one row a day, whatever the number of reviews.
    """
    daily = marts.review_observations(reviews).groupBy("date").agg(
        F.count("*").alias("n"), F.sum("rating").alias("s"), F.count_if(F.col("rating") >= marts.POSITIVE).alias("good"), F.count_if(F.col("rating") <= marts.NEGATIVE).alias("bad")
    )
    x = _rolled(daily, window_days, [])
    enough = (F.col("observed_days") >= min_days) & (F.col("wn") >= min_reviews)
    return x.select(
        "date", F.col("n").alias("review_count"), V.half_up(F.col("s") / F.col("n")).alias("avg_rating"),
        V.half_up(F.col("good") / F.col("n"), 4).alias("positive_ratio"), V.half_up(F.col("bad") / F.col("n"), 4).alias("negative_ratio"),
        V.half_up(F.col("ws") / F.col("wn")).alias("rolling_avg_rating"), V.half_up(F.col("wn") / F.col("observed_days"), 1).alias("rolling_avg_count"),
        "observed_days", (F.lit(window_days) - F.col("observed_days")).alias("missing_days"), F.date_sub("date", window_days - 1).alias("baseline_start"),
        F.when(enough, "sufficient").otherwise("insufficient").alias("baseline_status"),
    )


def daily_volume_trend(mart: DataFrame, window_days: int = WINDOW_DAYS, min_days: int = MIN_DAYS) -> DataFrame:
    """Reviews a day from a daily mart (date, review_count), with the rolling mean of observed days."""
    daily = mart.groupBy("date").agg(F.sum("review_count").alias("n")).withColumn("s", F.lit(0))
    x = _rolled(daily, window_days, [])
    return x.select(
        "date", F.col("n").alias("review_count"), V.half_up(F.col("wn") / F.col("observed_days"), 1).alias("rolling_avg_count"), "observed_days",
        (F.lit(window_days) - F.col("observed_days")).alias("missing_days"), F.when(F.col("observed_days") >= min_days, "sufficient").otherwise("insufficient").alias("baseline_status"),
    )


def price_trajectory(prices: DataFrame, product_id: str) -> DataFrame:
    """One product's prices by day; the product's filter reaches the scan."""
    return marts.price_daily_stats(prices.where(F.col("product_id") == product_id)).drop("price_std")


def price_volatility(prices: DataFrame) -> DataFrame:
    """Deviation over mean by product; null with a status where there are fewer than two points."""
    p = F.col("price").cast("double")
    x = prices.where(V.finite(p) & (p > 0)).groupBy("product_id").agg(F.count("*").alias("data_points"), F.avg(p).alias("m"), F.stddev_samp(p).alias("d"))
    return x.select(
        "product_id", "data_points", V.half_up(F.col("m")).alias("avg_price"), V.half_up(F.col("d")).alias("price_std"),
        V.half_up(F.when(F.col("data_points") >= 2, F.col("d") / F.col("m")), 4).alias("volatility"),
        F.when(F.col("data_points") >= 2, "available").otherwise("insufficient_data").alias("volatility_status"),
    ).orderBy(F.desc_nulls_last("volatility"), "product_id")
