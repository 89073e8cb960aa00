"""Exact order statistics without a task that holds a whole column.

Values are counted first, so equal ones are one row. Groups of very many different values
are cut into ranges of their values (bounds from a sketch, which only decides how even the
ranges are), counts before each range are added up, and only inside a range are values
sorted. A rank that is looked for is first traced to its range; other ranges aren't sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Groups of more different values than BIG are cut into this many ranges.
BIG, RANGES = 50_000, 64


def counted(df: DataFrame, value: Column, by: list[str]) -> DataFrame:
    """by, value, c: how often each value that isn't null stands in its group."""
    return df.select(*by, value.alias("value")).where("value IS NOT NULL").groupBy(*by, "value").agg(F.count("*").alias("c"))


def _ranged(counts: DataFrame, by: list[str], big: int, ranges: int) -> DataFrame:
    """counts with the range of each value: 0 in groups that aren't cut."""
    large = counts.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") > big).drop("_n")
    shares = F.array(*[F.lit((i + 1) / ranges) for i in range(ranges - 1)])
    bounds = counts.join(large, by, "left_semi").groupBy(*by).agg(F.array_distinct(F.percentile_approx("value", shares, 20 * ranges)).alias("_bounds"))
    place = F.size(F.filter("_bounds", lambda b: b < F.col("value")))
    return counts.join(bounds, by, "left").withColumn("_range", F.when(F.col("_bounds").isNull(), 0).otherwise(place)).drop("_bounds")


def _before(ranged: DataFrame, by: list[str]) -> DataFrame:
    """by, range, _before (rows of the group in lower ranges), _rows; as many rows a group as ranges."""
    sums = ranged.groupBy(*by, "_range").agg(F.sum("c").alias("_rows"))
    lower = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    return sums.withColumn("_before", F.coalesce(F.sum("_rows").over(lower), F.lit(0)))


def _upto(rows: DataFrame, by: list[str]) -> Column:
    return F.sum("c").over(Window.partitionBy(*by, "_range").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))


def placed(counts: DataFrame, by: list[str], big: int = BIG, ranges: int = RANGES) -> DataFrame:
    """counts (by, value, c) with upto: the group's rows up to and with this value. by holds no nulls."""
    ranged = _ranged(counts, by, big, ranges)
    inside = ranged.withColumn("upto", _upto(ranged, by))
    cut = _before(ranged, by).where("_before > 0").select(*by, "_range", "_before")  # groups that aren't cut have none
    return inside.join(cut, [*by, "_range"], "left").select(*by, "value", "c", (F.col("upto") + F.coalesce("_before", F.lit(0))).alias("upto"))


def at_ranks(counts: DataFrame, wanted: DataFrame, by: list[str], big: int = BIG, ranges: int = RANGES) -> DataFrame:
    """wanted (by, at: ranks from 0) with value: the value at that rank of the group's sorted rows. by holds no nulls."""
    ranged = _ranged(counts, by, big, ranges)
    held = _before(ranged, by).join(wanted, by).where((F.col("at") >= F.col("_before")) & (F.col("at") < F.col("_before") + F.col("_rows"))).select(*by, "_range", "_before", "at")
    near = ranged.join(held.select(*by, "_range").distinct(), [*by, "_range"], "left_semi")
    spans = near.withColumn("_upto", _upto(near, by))
    met = spans.join(held, [*by, "_range"])
    inside = (F.col("at") - F.col("_before") < F.col("_upto")) & (F.col("at") - F.col("_before") >= F.col("_upto") - F.col("c"))
    return met.where(inside).select(*by, "at", "value")


def quantiles(df: DataFrame, value: Column, shares: tuple[float, ...], big: int = BIG, ranges: int = RANGES) -> DataFrame:
    """share, low, high, n: the values at the two ranks around share * (n - 1) of a whole column; no row for a column of nulls."""
    counts = counted(df, value, []).withColumn("_all", F.lit(0))
    total = counts.groupBy("_all").agg(F.sum("c").alias("n"))
    asked = total.select("_all", "n", F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("share"))
    h = F.col("share") * (F.col("n") - 1)
    both = asked.select("_all", "n", "share", F.floor(h).alias("low_at"), F.ceil(h).alias("high_at"))
    found = at_ranks(counts, both.select("_all", F.explode(F.array("low_at", "high_at")).alias("at")).distinct(), ["_all"], big, ranges)
    low, high = (found.select("_all", F.col("at").alias(f"{x}_at"), F.col("value").alias(x)) for x in ("low", "high"))
    return both.join(low, ["_all", "low_at"]).join(high, ["_all", "high_at"]).select("share", "low", "high", "n")


def median(df: DataFrame, value: Column, name: str, big: int = BIG, ranges: int = RANGES) -> DataFrame:
    """One row: the mean of the middle values, null without any."""
    return quantiles(df, value, (0.5,), big, ranges).agg(F.max((F.col("low") + F.col("high")) / 2).alias(name))


def nearest(df: DataFrame, value: Column, shares: dict[str, float], big: int = BIG, ranges: int = RANGES) -> DataFrame:
    """One row: by name the value of nearest rank (the first that at least that share of the rows doesn't exceed), nulls without any."""
    counts = counted(df, value, []).withColumn("_all", F.lit(0))
    total = counts.groupBy("_all").agg(F.sum("c").alias("n"))
    asked = total.select("_all", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.greatest(F.ceil(F.col("n") * F.lit(float(s))) - 1, F.lit(0)).alias("at")) for k, s in shares.items()])).alias("x")).select("_all", "x.k", "x.at")
    found = at_ranks(counts, asked.select("_all", "at").distinct(), ["_all"], big, ranges).join(asked, ["_all", "at"])
    return found.agg(*[F.max(F.when(F.col("k") == k, F.col("value"))).alias(k) for k in shares])


def numbered(df: DataFrame, at: str, *order: str) -> DataFrame:
    """df with position, from 0 by order over the whole table: written to at in range partitions, whose sizes give each one's first number. order must tell rows apart."""
    spread = df.repartitionByRange(*order).sortWithinPartitions(*order)
    spread.withColumn("_at", F.monotonically_increasing_id()).write.parquet(at)
    rows = df.sparkSession.read.parquet(at)
    part = F.shiftright("_at", 33)
    sizes = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))  # a row a partition
    before = F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("_part", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"))
    return rows.join(sizes, part == F.col("_part")).withColumn("position", F.col("_at") + F.col("_shift")).select(*df.columns, "position")
