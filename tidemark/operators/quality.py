"""Data quality: batch measures, rule scorecards, gates and reports."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import values as V
from tidemark.functions.rules import Rule

# The gate's thresholds and tolerances.
GATE = {"min_score": 90.0, "max_duplicate_ratio": 0.05, "max_missing_ratio": 0.05}
SCORE_TOLERANCE, RATIO_TOLERANCE = 0.011, 0.00011


def flag_duplicates(df: DataFrame, key: str, *order: str) -> DataFrame:
    """is_duplicate: not the first row of its key by order; a null key is never a duplicate, and its rows aren't gathered.

    order must tell rows of a key apart, or which of them is first is arbitrary (their
    number isn't); without any, all columns do.
    """
    number = F.row_number().over(Window.partitionBy(key).orderBy(*(order or df.columns)))
    keyed = df.where(F.col(key).isNotNull()).withColumn("is_duplicate", number > 1)
    return keyed.unionByName(df.where(F.col(key).isNull()).withColumn("is_duplicate", F.lit(False)))


def evaluate(df: DataFrame, dataset: str, key: str, required: list[str], casts: dict[str, str], limits: dict[str, tuple[float | None, float | None]], status: str | None = None) -> DataFrame:
    """One row of measures: rows lacking values, with cast or range errors, duplicates, quarantined, invalid, score and ratios.

    casts: column to the type its text must have; limits: column to closed bounds (None: open above zero).
    Duplicates are counted by an aggregate, so a hot key is combined before the shuffle.
    """
    lacking = cast_error = range_error = F.lit(False)
    for c in required:
        lacking = lacking | V.blank(F.col(c))
    for c, kind in casts.items():
        text = F.trim(F.col(c).cast("string"))
        read = V.instant(text).isNotNull() if kind == "timestamp" else text.try_cast(kind).isNotNull()
        cast_error = cast_error | (~V.blank(F.col(c)) & ~read)
    for c, (low, high) in limits.items():
        number = F.trim(F.col(c).cast("string")).try_cast("double")
        inside = V.finite(number) & ((number > 0) if low is None else (number >= low)) & (F.lit(True) if high is None else (number <= high))
        range_error = range_error | (number.isNotNull() & ~F.coalesce(inside, F.lit(False)))
    bad_status = (F.col(status) == "invalid") if status else F.lit(False)
    flags = df.select(F.col(key).alias("k"), lacking.alias("lacking"), cast_error.alias("cast"), range_error.alias("range"), F.coalesce(bad_status, F.lit(False)).alias("status"))
    flags = flags.withColumn("quarantined", F.col("lacking") | F.col("cast") | F.col("range") | F.col("status"))
    of_key = flags.groupBy("k").agg(
        F.count("*").alias("n"),
        *[F.count_if(c).alias(c) for c in ("lacking", "cast", "range", "quarantined")],
    )
    once = F.when(F.col("k").isNull(), F.lit(0)).otherwise(F.col("n") - 1)
    # of a repeated key the rows kept as first are those that are fit, where there is one
    invalid = F.when(F.col("k").isNull(), F.col("quarantined")).otherwise(F.greatest(F.col("n") - 1, F.col("quarantined")))
    s = of_key.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(a) for a, c in (("total", F.col("n")), ("missing", F.col("lacking")), ("cast_errors", F.col("cast")), ("range_errors", F.col("range")), ("quarantined", F.col("quarantined")), ("duplicates", once), ("invalid", invalid))])
    ratio = lambda c: F.when(F.col("total") > 0, V.half_up(F.col(c) / F.col("total"), 4))
    return s.select(
        F.lit(dataset).alias("dataset"), "total", (F.col("total") - F.col("invalid")).alias("valid"), "invalid", "missing", "cast_errors", "range_errors", "quarantined", "duplicates",
        F.when(F.col("total") > 0, V.half_up(100 * (F.col("total") - F.col("invalid")) / F.col("total"))).alias("dq_score"),
        ratio("missing").alias("missing_ratio"), ratio("duplicates").alias("duplicate_ratio"),
    )


def scorecard(df: DataFrame, rules: list[Rule], key: str, *order: str) -> DataFrame:
    """rule, evaluated, passed, failed; duplicates of a key aren't held against the rules."""
    first = flag_duplicates(df, key, *order).where("NOT is_duplicate")
    counts = first.agg(F.count("*").alias("n"), *[F.count_if(r.passes).alias(f"p{i}") for i, r in enumerate(rules)])
    cells = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.col(f"p{i}").alias("passed")) for i, r in enumerate(rules)])
    return counts.select("n", F.explode(cells).alias("x")).select("x.rule", F.col("n").alias("evaluated"), "x.passed", (F.col("n") - F.col("x.passed")).alias("failed"))


def gate(reports: Iterable[dict], required: Iterable[str] = (), run_id: str | None = None, min_score: float = GATE["min_score"], max_duplicate_ratio: float = GATE["max_duplicate_ratio"], max_missing_ratio: float = GATE["max_missing_ratio"]) -> list[str]:
    """Why a batch may not pass, empty if it may; reports are rows of evaluate() as dicts, one a dataset. Fails closed."""
    reports, why = list(reports), []
    for name in set(required) - {r.get("dataset") for r in reports}:
        why.append(f"{name}: no report")
    if not reports:
        why.append("no report")
    for r in reports:
        name = r.get("dataset")
        counts = {k: r.get(k) for k in ("total", "valid", "invalid", "missing", "duplicates")}
        ratios = {k: r.get(k) for k in ("dq_score", "missing_ratio", "duplicate_ratio")}
        if counts["total"] == 0:
            if name in required:
                why.append(f"{name}: empty")
            continue
        number = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool) and math.isfinite(x) and x >= 0
        bad = [k for k, x in (counts | ratios).items() if not number(x)]
        bad += [k for k, x in counts.items() if k not in bad and x != int(x)]
        bad += [k for k, x in ratios.items() if k not in bad and x > (100 if k == "dq_score" else 1)]
        if bad:
            why.append(f"{name}: not measured or impossible: {', '.join(sorted(bad))}")
            continue
        if run_id is not None and r.get("run_id") != run_id:
            why.append(f"{name}: of another run")
        total = counts["total"]
        if counts["valid"] + counts["invalid"] != total:
            why.append(f"{name}: valid and invalid rows don't add up")
        if abs(ratios["dq_score"] - 100 * counts["valid"] / total) > SCORE_TOLERANCE:
            why.append(f"{name}: score doesn't follow from the counts")
        for ratio, count in (("missing_ratio", "missing"), ("duplicate_ratio", "duplicates")):
            if abs(ratios[ratio] - counts[count] / total) > RATIO_TOLERANCE:
                why.append(f"{name}: {ratio} doesn't follow from the counts")
            if counts[count] > counts["invalid"]:
                why.append(f"{name}: more {count} than invalid rows")
        if ratios["dq_score"] < min_score:
            why.append(f"{name}: score {ratios['dq_score']} below {min_score}")
        if ratios["duplicate_ratio"] > max_duplicate_ratio:
            why.append(f"{name}: duplicate ratio {ratios['duplicate_ratio']} above {max_duplicate_ratio}")
        if ratios["missing_ratio"] > max_missing_ratio:
            why.append(f"{name}: missing ratio {ratios['missing_ratio']} above {max_missing_ratio}")
    return why


def report(measures: DataFrame, batch_id: str, run_id: str) -> DataFrame:
    """A row for the quality history."""
    return measures.select(F.lit(batch_id).alias("batch_id"), F.lit(run_id).alias("run_id"), "*", F.current_timestamp().alias("measured_at"))


def save_reports(reports: DataFrame, path: str) -> int:
    """Adds reports to the quality history; of a batch and dataset the last measured one stays."""
    from tidemark.sources import keyed

    return keyed.merge(reports, path, ["batch_id", "dataset"], "measured_at")


def saved_reports(spark: SparkSession, path: str) -> DataFrame:
    from tidemark.sources import keyed

    return keyed.read(spark, path)
