from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import alerts, snapshots


def samples(spark, rows):
    return spark.createDataFrame(rows, "metric string, labels string, t int, value double").withColumn("at", F.timestamp_seconds("t")).drop("t")


def test_a_rule_fires_only_after_its_hold(spark):
    lag = lambda label, *xs: [("consumer_lag", label, t, v) for t, v in xs]
    rows = (
        lag("long", (0, 5000.0), (300, 2000.0), (600, 1500.0)) + lag("short", (0, 5000.0), (300, 10.0), (301, 5000.0), (600, 5000.0)) + lag("over", (0, 5000.0), (600, 5000.0), (700, 1.0))
        + lag(None, (0, 5000.0), (900, 5000.0)) + lag("gap", (0, 5000.0), (300, None), (600, 5000.0)) + [("disk_free_ratio", "d", 0, 0.1), ("disk_free_ratio", "d", 300, 0.14), ("checkpoint_errors", "c", 5, 1.0), ("other", "x", 1, 9e9)]
    )
    got = {(r.alert, r.labels, r.severity, r.value) for r in alerts.fired(samples(spark, rows)).collect()}
    assert got == {("consumer_backlog", "long", "warning", 1500.0), ("consumer_backlog", None, "warning", 5000.0), ("disk_low", "d", "warning", 0.14), ("checkpoint_failure", "c", "critical", 1.0)}


def test_pipelines(spark):
    rows = [("a", "failed", 0, 0, 5, 1), ("b", "success", 99_000, 0, 0, 1), ("c", "running", None, 0, None, None), ("d", "running", None, 99_000, None, None), ("e", "success", 1, 0, 5, 1)]
    df = spark.createDataFrame(rows, "pipeline string, last_status string, s int, e int, received int, expected_min int").select("pipeline", F.lit("x").alias("source"), "last_status", F.timestamp_seconds("s").alias("last_success"), F.timestamp_seconds("e").alias("expected_since"), "received", "expected_min")
    got = {(r.pipeline, r.alert) for r in alerts.pipeline_alerts(df, F.timestamp_seconds(F.lit(100_000))).collect()}
    assert got == {("a", "failed"), ("a", "stale"), ("b", "input_shortage"), ("c", "never_succeeded"), ("e", "stale")}


def test_comparison_reports(spark):
    one = spark.createDataFrame([(i, "a") for i in range(30)], "k int, v string")
    two = spark.createDataFrame([(i, "b" if i < 20 else "a") for i in range(5, 35)], "k int, v string")
    rows = {r.table: r for r in snapshots.comparison_report({"t": (one, two, ["k"]), "same": (one, one, ["k"]), "twice": (one, one.union(one.limit(1)), ["k"])}).collect()}
    t = rows["t"]
    assert (t.rows_before, t.rows_after, t.added_keys, t.removed_keys, t.changed_keys, t.status) == (30, 30, 5, 5, 15, "changed") and len(t.changed_examples) == 10 and t.removed_examples[0] == '{"k":0}'
    assert rows["same"].status == "equal" and rows["twice"].status == "changed"
