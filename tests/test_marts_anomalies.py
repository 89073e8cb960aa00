from __future__ import annotations

import datetime as dt
import statistics

import pytest

from tidemark.operators import anomaly, descriptive, marts, trends

REVIEWS = "review_id string, product_id string, rating double, review_date timestamp"
PRICES = "product_id string, price double, timestamp timestamp"
DAY = dt.datetime(2026, 10, 1, 12, tzinfo=dt.UTC)


def reviews(spark, *rows):
    return spark.createDataFrame([(f"r{i}", p, float(x), DAY + dt.timedelta(hours=h)) for i, (p, x, h) in enumerate(rows)], REVIEWS)


def prices(spark, *rows):
    return spark.createDataFrame([(p, float(x), DAY + dt.timedelta(hours=h)) for p, x, h in rows], PRICES)


def test_product_mart(spark):
    r = reviews(spark, *[("p1", 5, 0)] * 9, ("p2", 1, 0), ("p3", 3, 0), ("p9", 2, 0))
    catalog = spark.createDataFrame([("p1", "A", "X", 10.0), ("p2", "A", "X", 100.0), ("p3", "B", "X", None)], "product_id string, brand string, category string, price double")
    p = prices(spark, ("p1", 20, 0), ("p1", 40, 0), ("p1", float("inf"), 0), ("p1", 0, 0))
    got = {x.product_id: x for x in marts.product_daily_stats(r, catalog, p).collect()}
    assert (got["p1"].avg_price, got["p1"].price_source, got["p1"].rating_std, got["p1"].positive_ratio) == (30.0, "observed", 0.0, 1.0)
    assert (got["p2"].avg_price, got["p2"].price_source, got["p2"].rating_std) == (100.0, "catalog_fallback", None)
    assert (got["p3"].avg_price, got["p3"].price_source) == (None, "unavailable")
    brand = {x.brand: x for x in marts.brand_daily_stats(r, catalog).collect()}
    assert (brand["A"].avg_rating, brand["A"].avg_price, brand["A"].product_count, brand["A"].review_count) == (4.6, 55.0, 2, 10)
    assert "p9" in got and set(brand) == {"A", "B"}


def test_empty_marts(spark):
    r, p = spark.createDataFrame([], REVIEWS), spark.createDataFrame([], PRICES)
    assert marts.product_daily_stats(r, None, p).isEmpty() and marts.price_daily_stats(p).isEmpty()
    assert marts.mart_faults(marts.price_daily_stats(p), ["date", "product_id"]).first().asDict() == {"null_grain": 0, "repeated_grain": 0, "not_finite": 0, "out_of_range": 0}
    assert anomaly.price_zscores(p).isEmpty() and anomaly.price_iqr_outliers(p).isEmpty() and anomaly.rating_drops(r).isEmpty() and anomaly.review_bursts(r).isEmpty()


def test_faulty_mart(spark):
    mart = spark.createDataFrame([("a", 1, 6.0), ("a", 1, float("nan")), (None, 0, 2.0)], "k string, review_count int, avg_rating double")
    assert marts.mart_faults(mart, ["k"]).first().asDict() == {"null_grain": 1, "repeated_grain": 1, "not_finite": 1, "out_of_range": 3}
    with pytest.raises(ValueError, match="not sound"):
        marts.require_sound(mart, ["k"])


def test_guards(spark):
    mixed = spark.createDataFrame([("USD", 1.0), ("VND", 2.0), ("x", None)], "currency string, price double")
    with pytest.raises(ValueError, match="currencies"):
        marts.single_currency((mixed, "price"))
    assert marts.single_currency((mixed.where("currency != 'VND'"), "price")) == "USD"
    groups = spark.createDataFrame([("marketplace", "live"), ("marketplace", None)], "source_group string, acquisition_method string")
    assert marts.source_group(groups) == "marketplace"
    with pytest.raises(ValueError, match="mixed"):
        marts.source_group(groups, spark.range(1))
    with pytest.raises(ValueError, match="acquired"):
        marts.source_group(spark.createDataFrame([("simulation", "live")], "source_group string, acquisition_method string"))


def test_zscore_against_a_loop(spark):
    import random

    rng = random.Random(3)
    rows = [(f"p{k}", rng.choice([10, 10, 10, 11, 12, 40]), i) for k in range(40) for i in range(rng.randint(1, 12))]
    got = sorted((x.product_id, x.price, x.score) for x in anomaly.price_zscores(prices(spark, *rows), threshold=2.0).collect())
    want = []
    for i, (p, x, _) in enumerate(rows):
        others = [float(y) for j, (q, y, _) in enumerate(rows) if q == p and j != i]
        if len(others) < 2:
            continue
        m, sd = statistics.mean(others), statistics.stdev(others)
        z = (x - m) / sd if min(others) != max(others) else (x - m) / max(0.01 * m, 1e-9) if abs(x - m) / m >= 0.1 else 0.0
        if abs(z) >= 2.0 - 1e-12:
            want.append((p, float(x), abs(z)))
    assert [(p, x) for p, x, _ in got] == [(p, x) for p, x, _ in sorted(want)]
    assert all(abs(a[2] - b[2]) < 0.006 for a, b in zip(got, sorted(want), strict=True))


def test_iqr_against_a_loop(spark):
    import random

    import numpy as np

    rng = random.Random(5)
    rows = [(f"p{k}", rng.choice([10, 10, 11, 12, 13, 14, 60]), i) for k in range(40) for i in range(rng.randint(1, 15))]
    got = sorted((x.product_id, x.price) for x in anomaly.price_iqr_outliers(prices(spark, *rows)).collect())
    want = []
    for i, (p, x, _) in enumerate(rows):
        others = [y for j, (q, y, _) in enumerate(rows) if q == p and j != i]
        if len(others) < 2:
            continue
        a, b = np.quantile(others, [0.25, 0.75])
        if b > a and (x < a - 1.5 * (b - a) or x > b + 1.5 * (b - a)):
            want.append((p, float(x)))
    assert got == sorted(want) and want


def test_later_reviews_change_no_incident(spark):
    early = [("p", 3, 0), ("p", 3, 1), *[("p", 3, 2)] * 10]
    base = reviews(spark, *early)
    got = anomaly.review_bursts(base).collect()
    assert len(got) == 1 and got[0].review_count == 10 and got[0].anomaly_type == "REVIEW_BURST"
    later = reviews(spark, *early, *[("p", 1, 30)] * 100)
    assert [x.event_id for x in anomaly.review_bursts(later).collect() if x.review_count == 10] == [got[0].event_id]


def test_rating_drop_weighs_its_baseline(spark):
    rows = [("p", 1, 0), *[("p", 5, 24)] * 9, *[("p", 4, 48)] * 3]
    got = anomaly.rating_drops(reviews(spark, *rows)).collect()
    assert len(got) == 1 and got[0].baseline_mean == 4.6 and got[0].score == 0.6
    far = [("p", 5, 0), ("p", 5, 24), *[("p", 1, 24 * 270)] * 3]
    assert anomaly.rating_drops(reviews(spark, *far)).isEmpty()


def test_trend_counts_calendar_days(spark):
    rows = [("p", 5, 0), ("p", 4, 0), ("p", 3, 24 * 3), ("p", 1, 24 * 20)]
    got = {str(x.date): x for x in trends.daily_review_trend(reviews(spark, *rows)).collect()}
    assert got["2026-10-04"].rolling_avg_rating == 4.0 and got["2026-10-04"].observed_days == 2 and got["2026-10-04"].baseline_status == "sufficient"
    assert got["2026-10-21"].missing_days == 6 and got["2026-10-21"].baseline_status == "insufficient"


def test_volatility_needs_two_points(spark):
    got = {x.product_id: x for x in trends.price_volatility(prices(spark, ("a", 5, 0), ("b", 5, 0), ("b", 5, 1), ("c", 5, 0), ("c", 7, 0))).collect()}
    assert got["a"].volatility is None and got["b"].volatility == 0.0 and got["c"].volatility == 0.2357


def test_kpi_without_a_sample_is_unknown(spark):
    mart = spark.createDataFrame([("p", 0, 0, None)], "product_id string, review_count int, rating_sample_size int, avg_rating double")
    got = descriptive.kpi_summary(mart, spark.createDataFrame([], "brand string"), spark.createDataFrame([], "dq_score double")).first()
    assert got.avg_rating is None and got.avg_dq_score is None and got.total_brands == 0
