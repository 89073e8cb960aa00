"""Connected components of an edge list by rounds of Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import drop, saved


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """node, component (its component's smallest node) of every node of edges: a, b.

    Alternates the two contractions of the star algorithm: in the large step each node sends
    its larger neighbours to its smallest neighbour, in the small step its smaller ones and
    itself; the edges end as stars around the smallest nodes. A round has two grouped
    aggregations and joins, no group of neighbours is ever collected, and the number of
    rounds grows with the logarithm of the largest component. Self-links and repeats don't
    matter; no edges give no rows.
    """
    now = saved(_plain(edges))
    size = _sums(now)
    while True:
        large = _step(now, larger=True)
        before, now = now, saved(_step(large, larger=False))
        drop(before)
        sums = _sums(now)
        if sums == size:
            break
        size = sums
    leaves = now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return leaves.union(roots)


def _plain(edges: DataFrame) -> DataFrame:
    """Distinct edges from the larger to the smaller node."""
    return edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _sums(edges: DataFrame) -> tuple:
    """Equal for two rounds only if nothing has moved."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _step(edges: DataFrame, larger: bool) -> DataFrame:
    """edges: a > b. The large step works on all neighbours of a node, the small one on its smaller neighbours."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if larger else edges
    least = both.groupBy(F.col("a").alias("u")).agg(F.least(F.min("b"), F.col("u")).alias("m"))
    near = both.join(least, both["a"] == least["u"])
    if larger:
        moved = near.where(F.col("b") > F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = near.select("b", "m").union(least.select("u", "m")).toDF("a", "b")
    return _plain(moved)
