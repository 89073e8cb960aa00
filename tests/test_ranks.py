"""Exact order statistics against sorted lists, with groups cut into ranges."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.operators import anomaly, descriptive, quality, ranks


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    out = [("hot", float(rng.choice([rng.randint(0, 400), 77, 77]))) for _ in range(3000)]
    out += [(f"g{rng.randint(0, 8)}", rng.uniform(0, 10)) for _ in range(300)] + [("one", 5.0), ("same", 1.0), ("same", 1.0)]
    return out


@pytest.mark.parametrize("big, ranges", [(50_000, 64), (20, 7), (0, 64), (5, 2)])
def test_places_and_ranks(spark, rows, big, ranges):
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    counts = ranks.counted(df, F.col("v"), ["g"])
    groups: dict = {}
    for g, v in rows:
        groups.setdefault(g, []).append(v)
    got = {(r.g, r.value): r.upto for r in ranks.placed(counts, ["g"], big, ranges).collect()}
    assert got == {(g, v): sum(x <= v for x in vs) for g, vs in groups.items() for v in set(vs)}
    wanted = [(g, at) for g, vs in groups.items() for at in {0, len(vs) // 4, len(vs) // 2, len(vs) - 1}]
    found = ranks.at_ranks(counts, spark.createDataFrame([*wanted, ("hot", 10**9)], "g string, at long"), ["g"], big, ranges)
    assert {(r.g, r["at"]): r.value for r in found.collect()} == {(g, at): sorted(groups[g])[at] for g, at in wanted}


@pytest.mark.parametrize("big", [50_000, 10])
def test_whole_columns(spark, rows, big):
    values = sorted(v for _, v in rows)
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double").repartition(3)
    n = len(values)
    want = {"p50": values[-(-n // 2) - 1], "p99": values[-(-n * 99 // 100) - 1], "p0": values[0], "p100": values[-1]}
    assert ranks.nearest(df, F.col("v"), {"p50": 0.5, "p99": 0.99, "p0": 0.0, "p100": 1.0}, big).first().asDict() == want
    for part in (values, values[:-1], values[:1]):
        m = ranks.median(spark.createDataFrame([(v,) for v in part], "v double"), F.col("v"), "m", big).first().m
        assert m == (part[(len(part) - 1) // 2] + part[len(part) // 2]) / 2
    empty = df.where("v IS NULL")
    assert ranks.median(empty, F.col("v"), "m").first().m is None and descriptive.percentiles(empty, "v").first().p50 is None


def test_no_task_sorts_a_column(spark, rows):
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    plan = ranks.placed(ranks.counted(df, F.col("v"), ["g"]), ["g"], 20)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "hashpartitioning(g#" in plan and "_range" in plan


def test_outliers_don_t_depend_on_the_ranges(spark):
    rng = random.Random(4)
    prices = [(f"p{i % 3}", round(rng.gauss(100, 10), 1) if rng.random() < 0.97 else rng.choice([1.0, 900.0]), i) for i in range(900)]
    df = spark.createDataFrame(prices, "product_id string, price double, t int").withColumn("timestamp", F.timestamp_seconds("t")).drop("t")
    whole, cut = ({tuple(r) for r in anomaly.price_iqr_outliers(df, big=big, ranges=5).collect()} for big in (50_000, 10))
    assert whole == cut and whole


def test_outliers_read_and_sort_the_prices_once(spark, tmp_path):
    rows = [(f"p{i % (9 if i < 600 else 1)}", float(1 + i * 7919 % 97), i) for i in range(900)]  # p0 has 367 rows, the others 66 or 67
    df = spark.createDataFrame(rows, "product_id string, price double, t int").withColumn("timestamp", F.timestamp_seconds("t")).drop("t")
    df.union(df.limit(1).withColumns({"product_id": F.lit(None).cast("string"), "price": F.lit(1e6)})).write.parquet(str(tmp_path / "p"))
    whole, mixed, cut = (anomaly.price_iqr_outliers(spark.read.parquet(str(tmp_path / "p")), factor=0.4, big=big, ranges=5) for big in (50_000, 100, 10))
    found = {tuple(r) for r in whole.collect()}
    assert found and {r[1] for r in found} >= {"p0", "p1"} and {tuple(r) for r in mixed.collect()} == found == {tuple(r) for r in cut.collect()}
    plan = whole._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    # once to see that no product is hot, once for the result, where each product is sorted once
    assert plan.count("FileScan parquet") <= 2 and len(re.findall(r"\bSort \[", plan)) <= 1, plan


def test_duplicates_without_a_key_or_order(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", 2), (None, 1), (None, 1), ("b", 1)], "k string, v int")
    got = sorted(((r.k, r.v, r.is_duplicate) for r in quality.flag_duplicates(df, "k").collect()), key=repr)
    assert got == sorted([("a", 1, False), ("a", 2, True), ("a", 2, True), (None, 1, False), (None, 1, False), ("b", 1, False)], key=repr)
