from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidemark.operators import quality, silver

RAW = "review_id string, product_id string, rating string, review_text string, review_date string, ingested_at string, user_id string"


def raw(spark, *rows):
    return spark.createDataFrame(rows, RAW)


def test_invalid_values_keep_their_evidence(spark):
    r = silver.standardise(raw(spark, ("r1", "p1", " 6 ", "ok", "soon", "2026-01-01", "u")), "reviews").first()
    assert r.rating is None and r.rating_raw == " 6 " and r.review_date is None and r.review_date_raw == "soon"
    assert r.normalization_errors == ["INVALID_RATING", "INVALID_REVIEW_DATE"] and r.normalization_status == "invalid" and not r.time_available


def test_raw_evidence_survives_a_replay(spark):
    once = silver.standardise(raw(spark, ("r1", "p1", "9", "ok", "2026-01-01", "2026-01-01", "u")), "reviews")
    twice = silver.standardise(once.withColumn("rating", F.col("rating").cast("string")), "reviews").first()
    assert twice.rating_raw == "9" and twice.normalization_errors == ["INVALID_RATING"]


def test_first_reason_wins_and_partitions(spark):
    rows = raw(
        spark, ("r1", "p1", "bad", " ", "soon", None, "u"), ("r2", "p1", "9", "t", "2026-01-01", None, "u"), (None, "p1", "4", "t", "2026-01-01", None, "u"), ("r4", None, "4", "t", "2026-01-01", None, "u"),
        ("r5", "p1", "4", " ", "2026-01-01", None, "u"), ("r6", "p1", "4", "t", "soon", None, "u"), ("r7", "p1", "4", "t", "2026-01-01", None, "u"), ("r8", "p1", "4", "t", None, "nonsense", "u"),
    )
    good, bad = silver.split(silver.standardise(rows, "reviews"), "reviews")
    assert [r.review_id for r in good.collect()] == ["r7"]
    assert {r.review_id: r.quarantine_reason for r in bad.collect()} == {
        "r1": "INVALID_TYPE_RATING", "r2": "INVALID_RATING_OUT_OF_RANGE", None: "MISSING_REVIEW_ID", "r4": "MISSING_PRODUCT_ID", "r5": "MISSING_REVIEW_TEXT", "r6": "INVALID_TYPE_TIMESTAMP", "r8": "NORMALIZATION_ERROR",
    }


def test_personal_fields_go(spark):
    df = spark.createDataFrame([("p", "n", "5", "me@x.org", "u1")], "product_id string, product_name string, price string, email string, user_id string")
    assert not {"email", "user_id"} & set(silver.standardise(df, "products").columns)


def test_envelope(spark):
    df = spark.createDataFrame([("e1", "outer", ("inner", "r1"))], "event_id string, source string, payload struct<source:string,review_id:string>")
    assert silver.unpack_envelope(df).first().asDict() == {"event_id": "e1", "source": "inner", "review_id": "r1"}


def test_accounting_of_a_merge(spark):
    old = spark.createDataFrame([(f"k{i}", i) for i in range(5)], "id string, v int")
    new = spark.createDataFrame([("k0", 10), ("k1", 11), ("k8", 1), ("k8", 2), ("k9", 3)], "id string, v int")
    bad = spark.createDataFrame([(None, 1)], "id string, v int")
    got = silver.accounted(old, new, bad, "id").first().asDict()
    assert got == {"input_rows": 6, "quarantined": 1, "intra_batch_duplicates": 1, "cross_batch_duplicates": 2, "new_rows": 2, "previous_rows": 5, "written_rows": 7, "dq_score": 66.67}
    assert {r.id: r.v for r in silver.merged(old, new, ["id"], "v").collect()} == {"k0": 10, "k1": 11, "k2": 2, "k3": 3, "k4": 4, "k8": 2, "k9": 3}


def test_latest_is_deterministic(spark):
    rows = [("a", 1, "x"), ("a", 1, "y"), ("a", None, "z"), ("b", None, "q")]
    for order in (rows, rows[::-1]):
        got = silver.latest(spark.createDataFrame(order, "k string, t int, v string").repartition(3), ["k"], "t").collect()
        assert sorted((r.k, r.t, r.v) for r in got) == [("a", 1, "y"), ("b", None, "q")]


def test_empty_inputs(spark):
    none = raw(spark)
    good, bad = silver.split(silver.standardise(none, "reviews"), "reviews")
    assert good.isEmpty() and bad.isEmpty() and silver.latest(good, ["review_id"], "ingested_at").isEmpty()
    assert silver.accounted(good, good, bad, "review_id").first().dq_score is None
    measures = quality.evaluate(none, "reviews", "review_id", ["review_id"], {}, {}).first()
    assert measures.total == 0 and measures.dq_score is None


def report(**changes):
    good = {"dataset": "reviews", "run_id": "r", "total": 100, "valid": 95, "invalid": 5, "missing": 2, "duplicates": 3, "dq_score": 95.0, "missing_ratio": 0.02, "duplicate_ratio": 0.03}
    return good | changes


@pytest.mark.parametrize(
    "changes",
    [{"dq_score": float("nan")}, {"dq_score": float("inf")}, {"dq_score": 101.0}, {"missing": -1}, {"valid": None}, {"valid": 94}, {"dq_score": 99.0}, {"missing_ratio": 0.5}, {"duplicates": 6, "duplicate_ratio": 0.06}, {"run_id": "other"}, {"valid": 80, "invalid": 20, "dq_score": 80.0}, {"total": 0}],
)
def test_gate_fails_closed(changes):
    assert quality.gate([report(**changes)], ["reviews"], "r")


def test_gate_passes():
    assert quality.gate([report()], ["reviews"], "r") == []
    assert quality.gate([]) and quality.gate([report()], ["prices"])


def test_reasons_and_codes_are_worked_out_once(spark):
    """A filter on the reason, or one that an explode implies, isn't copied to the scan with all that it is made of."""
    from tidemark.streaming import reviews as streams

    rows = silver.standardise(spark.range(3).selectExpr("CAST(id AS STRING) AS review_id", "'p' AS product_id", "'x' AS rating", "'t' AS review_text", "CAST(id AS STRING) AS review_date"), "reviews")
    messages = spark.range(3).selectExpr("""'{"rating": "' || id || '"}' AS value""")
    good, bad = silver.split(rows, "reviews")
    fit, unfit = streams.split(streams.parsed(messages))
    for df in (good, bad, fit, unfit, silver.error_histogram(rows)):
        text = df._jdf.queryExecution().optimizedPlan().toString()
        assert max([len(line) for line in text.split("\n") if "Filter " in line], default=0) < 200
    assert (good.count(), bad.count(), fit.count(), unfit.count()) == (0, 3, 0, 3)
