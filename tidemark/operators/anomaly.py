"""Price, rating and review-volume anomalies by window analytics, without leaving the JVM.

Leave-one-out baselines use closed forms over one aggregate a key instead of a loop a row.
Later rows never change earlier rating or volume incidents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import values as V
from tidemark.operators import marts
from tidemark.operators import ranks as ranks_

# The detectors' parameters.
Z_THRESHOLD, MIN_POINTS, FLAT_CHANGE, FLAT_SCALE = 3.0, 3, 0.10, 0.01
IQR_FACTOR = 1.5
DROP, DROP_WINDOW_DAYS, DROP_MIN_REVIEWS, DROP_MIN_DAYS = 0.5, 7, 3, 2
BURST_SIGMAS, BURST_MIN_REVIEWS, BURST_FLAT_FACTOR, BURST_BASELINE_HOURS, BURST_MIN_HISTORY, BOMBING_RATING = 3.0, 5, 2.0, 24, 2, 2.5


def event_id(kind: str, entity: Column, *parts: Column) -> Column:
    """A key that the same incident always gets."""
    text = F.concat_ws("|", F.lit("PRODUCT"), entity, F.lit(kind), *[p.cast("string") for p in parts])
    return F.concat(F.lit("anom_"), F.substring(F.sha2(text, 256), 1, 20))


def _points(prices: DataFrame) -> DataFrame:
    p = F.col("price").cast("double")
    return prices.where(V.finite(p) & (p > 0)).select("product_id", p.alias("price"), F.col("timestamp").cast("timestamp").alias("timestamp"))


def price_zscores(prices: DataFrame, threshold: float = Z_THRESHOLD, min_points: int = MIN_POINTS) -> DataFrame:
    """Prices that lie threshold deviations from the mean of the product's other prices.

    Where the others are all equal, a change of FLAT_CHANGE counts, scaled by FLAT_SCALE of the mean.
    A product's moments are one combined aggregate joined back, so a hot product isn't sorted.
    """
    rows = _points(prices)
    rank = F.col("price")
    base = rows.groupBy("product_id").agg(
        F.count("*").alias("n"), F.avg("price").alias("m"), F.var_pop("price").alias("v"), F.min(rank).alias("low"), F.max(rank).alias("high"),
        F.min("timestamp").alias("first_at"), F.max("timestamp").alias("last_at"),
    ).where(F.col("n") >= min_points)
    ends = rows.join(base.select("product_id", "low", "high"), "product_id").groupBy("product_id").agg(F.count_if(F.col("price") == F.col("low")).alias("n_low"), F.count_if(F.col("price") == F.col("high")).alias("n_high"))
    x = rows.join(base.join(ends, "product_id"), "product_id")
    others = F.col("n") - 1
    mean = (F.col("n") * F.col("m") - F.col("price")) / others
    spread = F.col("n") * F.col("v") - (F.col("price") - F.col("m")) * (F.col("price") - mean)
    # the others are flat if all rows are, or if this row is the only one at one end and the rest lie at the other
    flat = (F.col("low") == F.col("high")) | ((F.col("price") == F.col("low")) & (F.col("n_low") == 1) & (F.col("n_high") == others)) | ((F.col("price") == F.col("high")) & (F.col("n_high") == 1) & (F.col("n_low") == others))
    level = F.when(flat, F.when(F.col("price") == F.col("low"), F.col("high")).otherwise(F.col("low"))).otherwise(mean)
    sigma = F.sqrt(F.greatest(spread, F.lit(0.0)) / (others - 1))
    z = F.when(flat, F.when(F.abs(F.col("price") - level) / level >= FLAT_CHANGE, (F.col("price") - level) / F.greatest(FLAT_SCALE * level, F.lit(1e-9)))).otherwise(F.try_divide(F.col("price") - mean, sigma))
    scored = x.select("product_id", "timestamp", "price", z.alias("z"), level.alias("baseline_mean"), F.when(flat, 0.0).otherwise(sigma).alias("baseline_std"), others.alias("baseline_points"))
    return scored.where(F.abs("z") >= threshold).select(
        event_id("PRICE_ANOMALY", F.col("product_id"), F.col("timestamp"), F.col("price")).alias("event_id"),
        "product_id", "timestamp", "price", V.half_up(F.abs("z")).alias("score"), V.half_up(F.col("baseline_mean")).alias("baseline_mean"), V.half_up(F.col("baseline_std")).alias("baseline_std"), "baseline_points",
    )


def price_iqr_outliers(prices: DataFrame, factor: float = IQR_FACTOR, min_points: int = MIN_POINTS, big: int = ranks_.BIG, ranges: int = ranks_.RANGES) -> DataFrame:
    """Prices outside the quartiles of the product's other prices by factor times their distance; flat others give none.

    Linear interpolation as usual. A product's rows meet in one shuffle and are sorted once;
    a product of more than big rows is worked out from its distinct prices with their counts
    (combined map-side), which are sorted in ranges, by several tasks. Both ways give each
    row the order statistics that its quartiles are made of.
    """
    rows = _points(prices).where("product_id IS NOT NULL")
    large = rows.groupBy("product_id").agg(F.count("*").alias("n")).where(F.col("n") > big).select("product_id")
    usual = _usual_quartiles(rows.join(F.broadcast(large), "product_id", "left_anti"), min_points)  # one row for more than big rows at most
    hot = rows.join(F.broadcast(large), "product_id", "left_semi")
    scored = usual.unionByName(hot.join(_ranged_quartiles(hot, min_points, big, ranges), ["product_id", "price"]))
    gap = F.col("q3") - F.col("q1")
    out = scored.where(gap > 0).where((F.col("price") < F.col("q1") - factor * gap) | (F.col("price") > F.col("q3") + factor * gap))
    return out.select(
        event_id("PRICE_IQR", F.col("product_id"), F.col("timestamp"), F.col("price")).alias("event_id"),
        "product_id", "timestamp", "price", V.half_up(F.abs(F.col("price") - F.col("median")) / gap).alias("score"), V.half_up(F.col("q1")).alias("q1"), V.half_up(F.col("q3")).alias("q3"), "baseline_points",
    )


#: Names and shares of the quartiles.
_QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def _rank(q: float) -> tuple[Column, Column]:
    """The whole and the fractional part of the rank of q among the n - 1 others."""
    h = (F.col("n") - 2) * F.lit(q)
    return F.floor(h), h - F.floor(h)


def _left_out(q: float, at_rank: Callable[[str, int], Column], position: Column, name: str) -> Column:
    """Leaving out the price at sorted position p moves rank k to k (k < p) or k + 1, so three ranks a quartile are all there is.

    Equal prices are alike: leaving out any of them is leaving out the one at hand.
    """
    k, f = _rank(q)
    one = F.when(k < position, at_rank(name, 0)).otherwise(at_rank(name, 1))
    two = F.when(k + 1 < position, at_rank(name, 1)).otherwise(at_rank(name, 2))
    return F.when(f == 0, one).otherwise(one + f * (two - one))


def _usual_quartiles(rows: DataFrame, min_points: int) -> DataFrame:
    """rows with q1, median, q3 of the product's others and their number; each product is sorted by one task."""
    whole = Window.partitionBy("product_id")
    x = rows.withColumn("position", F.row_number().over(whole.orderBy("price")).cast("long") - 1).withColumn("n", F.count("*").over(whole)).where(F.col("n") >= min_points)
    wanted = {f"_{name}_{i}": F.max(F.when(F.col("position") == _rank(q)[0] + i, F.col("price"))).over(whole) for name, q in _QUARTILES.items() for i in range(3)}
    x = x.withColumns(wanted)
    quartiles = [_left_out(q, lambda name, i: F.col(f"_{name}_{i}"), F.col("position"), name).alias(name) for name, q in _QUARTILES.items()]
    return x.select("product_id", "price", "timestamp", *quartiles, (F.col("n") - 1).alias("baseline_points"))


def _ranged_quartiles(rows: DataFrame, min_points: int, big: int, ranges: int) -> DataFrame:
    """product_id, price with q1, median, q3 of the product's others and their number, by distinct price; no task sorts a product."""
    counted = rows.groupBy("product_id", "price").agg(F.count("*").alias("c"))
    placed = ranks_.placed(counted.withColumnRenamed("price", "value"), ["product_id"], big, ranges).withColumnRenamed("value", "price")
    total = placed.groupBy("product_id").agg(F.sum("c").alias("n")).where(F.col("n") >= min_points)
    asked = F.array(*[F.struct(F.lit(f"{name}_{i}").alias("name"), (_rank(q)[0] + i).alias("at")) for name, q in _QUARTILES.items() for i in range(3)])
    wanted = total.select("product_id", "n", F.explode(asked).alias("r")).select("product_id", "n", "r.name", "r.at")
    spans = placed.select("product_id", "price", (F.col("upto") - F.col("c")).alias("from"), "upto")
    stats = wanted.join(spans, "product_id").where("at >= from AND at < upto").groupBy("product_id", "n").agg(F.map_from_entries(F.collect_list(F.struct("name", "price"))).alias("at_rank"))  # nine entries a product
    quartiles = [_left_out(q, lambda name, i: F.element_at("at_rank", F.lit(f"{name}_{i}")), F.col("upto") - 1, name).alias(name) for name, q in _QUARTILES.items()]
    return spans.join(stats, "product_id").select("product_id", "price", *quartiles, (F.col("n") - 1).alias("baseline_points"))


def rating_drops(reviews: DataFrame, drop: float = DROP, window_days: int = DROP_WINDOW_DAYS, min_reviews: int = DROP_MIN_REVIEWS, min_days: int = DROP_MIN_DAYS) -> DataFrame:
    """Days on which a product's mean rating falls by drop below the review-weighted mean of the days before, within window_days."""
    daily = marts.review_observations(reviews).groupBy("product_id", "date").agg(F.sum("rating").alias("s"), F.count("*").alias("n"))
    before = Window.partitionBy("product_id").orderBy(F.unix_date("date")).rangeBetween(-window_days, -1)
    x = daily.select("product_id", "date", "s", "n", F.sum("s").over(before).alias("bs"), F.sum("n").over(before).alias("bn"), F.count("*").over(before).alias("days"))
    x = x.where((F.col("days") >= max(min_days, 2)) & (F.col("n") >= min_reviews)).select("product_id", "date", "n", (F.col("s") / F.col("n")).alias("mean"), (F.col("bs") / F.col("bn")).alias("baseline"), "bn", "days")
    return x.where(F.col("baseline") - F.col("mean") >= drop).select(
        event_id("RATING_DROP", F.col("product_id"), F.col("date")).alias("event_id"),
        "product_id", "date", V.half_up(F.col("baseline") - F.col("mean")).alias("score"), V.half_up(F.col("mean")).alias("avg_rating"), V.half_up(F.col("baseline")).alias("baseline_mean"),
        F.col("n").alias("current_sample_size"), F.col("bn").alias("baseline_sample_size"), F.col("days").alias("baseline_days"),
    )


def review_bursts(reviews: DataFrame, bucket_hours: int = 1, sigmas: float = BURST_SIGMAS, min_reviews: int = BURST_MIN_REVIEWS, flat_factor: float = BURST_FLAT_FACTOR, baseline_hours: int = BURST_BASELINE_HOURS, min_history: int = BURST_MIN_HISTORY, bombing_rating: float = BOMBING_RATING) -> DataFrame:
    """Buckets with far more reviews than the buckets before; empty buckets in between count as zeros without being made.

    reviews: product_id, review_id, review_date (timestamp), rating. The kind is REVIEW_BOMBING where the mean rating is low.
    """
    width = 3600 * bucket_hours
    at = F.unix_timestamp(F.col("review_date").cast("timestamp"))
    fit = ~V.blank(F.col("product_id")) & ~V.blank(F.col("review_id").cast("string")) & F.col("review_date").isNotNull()
    rated = F.when(V.finite(F.col("rating").cast("double")) & F.col("rating").between(1, 5), F.col("rating"))
    hourly = reviews.where(fit).groupBy("product_id", F.floor(at / width).alias("h")).agg(F.count("*").alias("c"), F.sum(rated).alias("s"), F.count(rated).alias("rn"))
    span = max(1, baseline_hours // bucket_hours)
    whole = Window.partitionBy("product_id").orderBy("h")
    near = whole.rangeBetween(-span, -1)
    x = hourly.select(
        "product_id", "h", "c", "s", "rn",
        F.count("*").over(whole.rowsBetween(Window.unboundedPreceding, -1)).alias("seen"),
        F.count("*").over(near).alias("observed"),
        F.min("h").over(whole.rowsBetween(Window.unboundedPreceding, 0)).alias("first"),
        F.sum("c").over(near).alias("s1"),
        F.sum(F.col("c") * F.col("c")).over(near).alias("s2"),
    )
    nb = F.col("h") - F.greatest(F.col("first"), F.col("h") - span)
    x = x.where((F.col("seen") >= min_history) & (F.col("observed") >= min_history)).withColumn("nb", nb)
    mean = F.col("s1") / F.col("nb")
    flat = F.col("s2") * F.col("nb") == F.col("s1") * F.col("s1")  # whole numbers
    sigma = F.sqrt((F.col("s2") * F.col("nb") - F.col("s1") * F.col("s1")) / (F.col("nb") * (F.col("nb") - 1)))
    limit = F.when(flat, flat_factor * mean).otherwise(mean + sigmas * sigma)
    x = x.withColumns({"mean": mean, "limit": limit, "rating": F.try_divide(F.col("s"), F.col("rn"))})
    kind = F.when(F.col("rating") <= bombing_rating, "REVIEW_BOMBING").otherwise("REVIEW_BURST")
    start = F.timestamp_seconds(F.col("h") * width)
    return x.where(F.col("c") >= F.greatest(F.col("limit"), F.lit(float(min_reviews)))).select(
        event_id("REVIEW_BURST", F.col("product_id"), start).alias("event_id"),
        "product_id", start.alias("bucket_start"), kind.alias("anomaly_type"), F.col("c").alias("review_count"), V.half_up(F.col("c") / F.greatest(F.col("mean"), F.lit(1.0))).alias("score"),
        V.half_up(F.col("mean"), 4).alias("baseline_mean"), F.col("nb").alias("baseline_buckets"), V.half_up(F.col("rating")).alias("avg_rating"),
    )
