"""Alerts: threshold rules over samples of metrics, and rules over the status of pipelines."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Seconds after which a pipeline without success is stale.
STALE = 93_600


class Rule(NamedTuple):
    """fires while the SQL predicate over value holds for every sample of metric in the last `hold` seconds, and at the newest one."""

    name: str
    metric: str
    predicate: str
    severity: str = "warning"
    hold: int = 0


# The rules' metrics, thresholds, severities and holding times.
RULES = (
    Rule("consumer_backlog", "consumer_lag", "value > 1000", "warning", 600),
    Rule("under_replicated", "under_replicated_partitions", "value > 0", "critical", 120),
    Rule("backup_stale", "backup_age_seconds", f"value > {STALE}", "critical"),
    Rule("disk_low", "disk_free_ratio", "value < 0.15", "warning", 300),
    Rule("checkpoint_failure", "checkpoint_errors", "value > 0", "critical"),
    Rule("measurement_stale", "measurement_age_seconds", "value > 120", "warning", 120),
)


def fired(samples: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """alert, severity, labels, since, at, value of the rules that fire, by the labels of a metric's samples.

    samples: metric, labels (text), at (timestamp), value. A sample without a value breaks a
    rule's hold. since is the first sample of the unbroken run up to the newest; two
    combined aggregates, no sort.
    """
    kinds = F.array(*[F.struct(F.lit(r.name).alias("alert"), F.lit(r.severity).alias("severity"), F.lit(r.metric).alias("of"), F.lit(r.hold).alias("hold")) for r in rules])
    holds = F.lit(None).cast("boolean")
    for r in reversed(rules):
        holds = F.when(F.col("rule.alert") == r.name, F.expr(r.predicate)).otherwise(holds)
    rows = samples.select("metric", "labels", F.col("at").cast("timestamp").alias("at"), "value", F.explode(F.filter(kinds, lambda k: k["of"] == F.col("metric"))).alias("rule"))
    rows = rows.select("rule", "labels", "at", "value", F.coalesce(holds, F.lit(False)).alias("holds"))
    key = ["rule", "labels"]
    last = rows.groupBy(*key).agg(F.max("at").alias("newest"), F.max_by("value", "at").alias("now"), F.max(F.when(~F.col("holds"), F.col("at"))).alias("broken"))
    burning = last.where(F.col("broken").isNull() | (F.col("broken") < F.col("newest")))
    met = rows.join(burning.withColumnsRenamed({"labels": "_labels", "rule": "_rule"}), (F.col("labels").eqNullSafe(F.col("_labels"))) & (F.col("rule") == F.col("_rule")))
    run = met.where(F.col("broken").isNull() | (F.col("at") > F.col("broken"))).groupBy(*key, "newest", "now").agg(F.min("at").alias("since"))
    return run.where(F.unix_timestamp("newest") - F.unix_timestamp("since") >= F.col("rule.hold")).select("rule.alert", "rule.severity", "labels", "since", F.col("newest").alias("at"), F.col("now").alias("value"))


def pipeline_alerts(status: DataFrame, now: Column, stale: int = STALE) -> DataFrame:
    """pipeline, source, alert, severity by the last runs' status.

    status: pipeline, source, last_status, last_success, and where known expected_since
    (registered then), received and expected_min (of the last run).
    """
    known = {c: F.col(c) if c in status.columns else F.lit(None) for c in ("expected_since", "received", "expected_min")}
    age = lambda c: F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(c.cast("timestamp"))
    found = F.array_compact(
        F.array(
            F.when(F.col("last_status") == "failed", F.struct(F.lit("failed").alias("alert"), F.lit("critical").alias("severity"))),
            F.when(age(F.col("last_success")) > stale, F.struct(F.lit("stale").alias("alert"), F.lit("warning").alias("severity"))),
            F.when(F.col("last_success").isNull() & (age(known["expected_since"]) > stale), F.struct(F.lit("never_succeeded").alias("alert"), F.lit("warning").alias("severity"))),
            F.when((F.col("last_status") == "success") & (known["received"] < known["expected_min"]), F.struct(F.lit("input_shortage").alias("alert"), F.lit("warning").alias("severity"))),
        )
    )
    return status.select("pipeline", "source", F.explode(found).alias("a")).select("pipeline", "source", "a.alert", "a.severity")
