"""From raw rows to the current state: standardise, judge, split, de-duplicate, merge, account.

Every function takes and returns DataFrames and runs nothing. Values that can't be read
become null, keep their raw text in <field>_raw and add a code to normalization_errors.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import values as V


class Dataset(NamedTuple):
    """key, value and clock columns; the clocks and texts that a row needs; its quarantine reasons, first match first."""

    key: str
    value: str
    clock: str
    order: str
    required: tuple[str, ...]
    reasons: tuple[str, ...]


# Datasets, their columns, clocks and reasons.
DATASETS = {
    "reviews": Dataset(
        "review_id", "rating", "review_date", "ingested_at", ("review_id", "product_id", "rating", "review_text"),
        ("INVALID_TYPE_RATING", "INVALID_TYPE_TIMESTAMP", "INVALID_RATING_OUT_OF_RANGE", "MISSING_REVIEW_TEXT", "MISSING_PRODUCT_ID", "MISSING_REVIEW_ID"),
    ),
    "products": Dataset(
        "product_id", "price", "created_at", "ingested_at", ("product_id", "product_name", "price"),
        ("INVALID_TYPE_PRICE", "INVALID_TYPE_TIMESTAMP", "MISSING_PRODUCT_ID", "MISSING_PRODUCT_NAME", "INVALID_PRICE_NON_POSITIVE"),
    ),
    "prices": Dataset(
        "price_id", "price", "timestamp", "timestamp", ("price_id", "product_id", "price"),
        ("INVALID_TYPE_PRICE", "INVALID_TYPE_TIMESTAMP", "MISSING_PRICE_ID", "MISSING_PRODUCT_ID", "INVALID_PRICE_NON_POSITIVE"),
    ),
}
CLOCKS = ("created_at", "updated_at", "timestamp", "review_date", "ingested_at")
ENVELOPE = ("event_id", "event_type", "source", "ingested_at")
PERSONAL = ("email", "phone", "address", "full_name", "user_name", "username", "customer_name", "customer_id", "ip_address", "avatar_url", "profile_url")


def with_columns(df: DataFrame, names: tuple[str, ...] | list[str]) -> DataFrame:
    """Lacking columns as null strings."""
    return df.withColumns({c: F.lit(None).cast("string") for c in names if c not in df.columns})


def unpack_envelope(df: DataFrame) -> DataFrame:
    """The payload's fields as columns; of the envelope's own fields the payload's value wins."""
    if "payload" not in df.columns:
        return df
    inner = df.schema["payload"].dataType.names
    shared = [F.coalesce(F.col(f"payload.{c}").cast("string"), F.col(c).cast("string")).alias(c) if c in inner else F.col(c) for c in ENVELOPE if c in df.columns]
    return df.select(*shared, *[F.col(f"payload.{c}").alias(c) for c in inner if c not in ENVELOPE or c not in df.columns])


def standardise(df: DataFrame, dataset: str, salt: str = "tidemark") -> DataFrame:
    """Typed columns, raw evidence, error codes, status; one projection over the input."""
    spec = DATASETS[dataset]
    df = with_columns(df, [*spec.required, spec.clock, spec.order])
    clocks = [c for c in CLOCKS if c in df.columns]
    evidence = [spec.value, *clocks, *[c for c in ("brand", "category", "currency") if c in df.columns]]
    raw = {f"{c}_raw": F.coalesce(*([F.col(f"{c}_raw")] if f"{c}_raw" in df.columns else []), F.col(c).cast("string")) for c in evidence}
    df = df.withColumns(raw)
    numeric = isinstance(df.schema[spec.value].dataType, T.NumericType)
    out: dict[str, Column] = {f.name: F.trim(f.name) for f in df.schema if isinstance(f.dataType, T.StringType) and not f.name.endswith("_raw")}
    out[spec.value] = V.price(F.col(spec.value), numeric) if spec.value == "price" else V.rating(F.col(spec.value))
    for c in clocks:
        out[c] = F.col(c).cast("timestamp") if isinstance(df.schema[c].dataType, T.DatetimeType) else V.instant(F.col(c))
    for name, how in (("brand", V.brand), ("category", V.category), ("currency", V.currency)):
        if name in df.columns:
            out[name] = how(F.col(name))
    if "verified_purchase" in df.columns:
        out["verified_purchase"] = F.trim(F.col("verified_purchase").cast("string")).try_cast("boolean")
    if dataset == "reviews" and ("user_id" in df.columns or "customer_id" in df.columns):
        known = [F.when(~V.blank(F.col(c)), F.col(c)) for c in ("user_id", "customer_id") if c in df.columns]
        out["user_id"] = V.pseudonymous_user(F.coalesce(*known), salt)
    typed = df.withColumns(out).drop(*PERSONAL, *([] if dataset == "reviews" else ["user_id"]))

    value, upper = F.col(f"{spec.value}_raw"), spec.value.upper()
    codes = [F.when(V.blank(value), F.lit(f"MISSING_{upper}")).when(F.col(spec.value).isNull(), F.lit(f"INVALID_{upper}"))]
    codes += [F.when(~V.blank(F.col(f"{c}_raw")) & F.col(c).isNull(), F.lit(f"INVALID_{c.upper()}")) for c in clocks]
    found = F.array_compact(F.array(*codes))
    if "normalization_errors" in df.columns:
        earlier = F.col("normalization_errors")
        if isinstance(df.schema["normalization_errors"].dataType, T.StringType):
            earlier = F.from_json(earlier, "array<string>")
        found = F.array_union(found, F.coalesce(earlier, F.array().cast("array<string>")))
    typed = typed.withColumn("normalization_errors", F.sort_array(F.array_distinct(found)))
    return typed.withColumns(
        {
            "normalization_status": F.when(F.size("normalization_errors") > 0, "invalid").otherwise("valid"),
            "time_available": F.col(spec.clock).isNotNull(),
            "ingestion_time_available": F.col(spec.order).isNotNull(),
        }
    )


def judged(df: DataFrame, dataset: str) -> DataFrame:
    """Standardised rows with quarantine_reason: the first reason that holds, or null."""
    spec = DATASETS[dataset]
    raw = F.trim(f"{spec.value}_raw")
    number = V.number(raw) if spec.value == "rating" else V.amount(raw)
    readable = V.finite(number)
    holds = {
        f"INVALID_TYPE_{spec.value.upper()}": ~V.blank(raw) & ~readable,
        "INVALID_TYPE_TIMESTAMP": ~V.blank(F.col(f"{spec.clock}_raw")) & F.col(spec.clock).isNull(),
        "INVALID_RATING_OUT_OF_RANGE": F.col(spec.value).isNull(),
        "INVALID_PRICE_NON_POSITIVE": F.col(spec.value).isNull(),
    } | {f"MISSING_{c.upper()}": V.blank(F.col(c)) for c in spec.required if c != spec.value}
    reason = F.when(F.coalesce(holds[spec.reasons[0]], F.lit(False)), F.lit(spec.reasons[0]))
    for name in spec.reasons[1:]:
        reason = reason.when(F.coalesce(holds[name], F.lit(False)), F.lit(name))
    return df.withColumn("quarantine_reason", V.once(reason.when(F.col("normalization_status") == "invalid", F.lit("NORMALIZATION_ERROR"))))


def split(df: DataFrame, dataset: str) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and quarantined ones with their reason and time."""
    rows = judged(df, dataset)
    return rows.where("quarantine_reason IS NULL").drop("quarantine_reason"), rows.where("quarantine_reason IS NOT NULL").withColumn("quarantined_at", F.current_timestamp())


def latest(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """One row a key: the largest by order (nulls least), then by the other columns, so that ties have one outcome.

    An aggregate with map-side combining: a hot key costs no more than its rows.
    """
    others = [f.name for f in df.schema if f.name not in (*keys, *order)]
    sortable = [c for c in others if not isinstance(df.schema[c].dataType, (T.MapType, T.VariantType))]
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order, *sortable)).alias("_row"))
    return best.select(*[F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in df.columns])


def merged(existing: DataFrame, incoming: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The union by name, where an incoming row beats an existing one of its key."""
    both = existing.withColumn("_incoming", F.lit(0)).unionByName(incoming.withColumn("_incoming", F.lit(1)), allowMissingColumns=True)
    return latest(both, keys, "_incoming", *order).drop("_incoming")


def accounted(existing: DataFrame, valid: DataFrame, quarantined: DataFrame, key: str) -> DataFrame:
    """One row: input = quarantined + duplicates within + duplicates across + new; written = previous + new; score."""
    seen = valid.groupBy(F.col(key).alias("k")).agg(F.count("*").alias("n"))
    old = existing.select(F.col(key).alias("k")).distinct()
    met = seen.join(old.withColumn("known", F.lit(1)), "k", "full_outer")
    totals = met.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("valid_input"),
        F.count("n").alias("distinct_keys"),
        F.count(F.when(F.col("n").isNotNull() & F.col("known").isNotNull(), 1)).alias("cross_batch_duplicates"),
        F.count("known").alias("previous_rows"),
    )
    bad = quarantined.agg(F.count("*").alias("quarantined"))
    new = F.col("distinct_keys") - F.col("cross_batch_duplicates")
    received = F.col("valid_input") + F.col("quarantined")
    return totals.crossJoin(bad).select(  # one row by one row
        received.alias("input_rows"),
        "quarantined",
        (F.col("valid_input") - F.col("distinct_keys")).alias("intra_batch_duplicates"),
        "cross_batch_duplicates",
        new.alias("new_rows"),
        "previous_rows",
        (F.col("previous_rows") + new).alias("written_rows"),
        F.when(received > 0, V.half_up(100 * F.col("distinct_keys") / received)).alias("dq_score"),
    )


def null_counts(df: DataFrame, required: list[str]) -> DataFrame:
    """One row per column with its blank values, and one (field null) with the rows that lack a required value; one pass."""
    def empty(f: T.StructField) -> Column:
        c = F.col(f.name)
        if isinstance(f.dataType, T.StringType):
            return V.blank(c)
        return c.isNull() | F.isnan(c) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else c.isNull()

    flags = {f.name: empty(f) for f in df.schema}
    lacking = F.lit(False)
    for c in required:
        lacking = lacking | flags[c]
    names = list(flags)
    counts = df.agg(F.count("*").alias("rows"), F.count_if(lacking).alias("missing"), *[F.count_if(flags[c]).alias(f"n{i}") for i, c in enumerate(names)])
    cells = [F.struct(F.lit(c).alias("field"), F.col(f"n{i}").alias("n_null")) for i, c in enumerate(names)] + [F.struct(F.lit(None).cast("string").alias("field"), F.col("missing").alias("n_null"))]
    return counts.select("rows", F.explode(F.array(*cells)).alias("x")).select("x.field", "x.n_null", F.col("rows").alias("n_rows"))


def error_histogram(df: DataFrame) -> DataFrame:
    codes = df.select(F.explode_outer("normalization_errors").alias("code")).where("code IS NOT NULL")  # plain explode would work out the codes once more, to filter rows without any
    return codes.groupBy("code").agg(F.count("*").alias("n"))


def reason_histogram(quarantined: DataFrame) -> DataFrame:
    return quarantined.groupBy("quarantine_reason").agg(F.count("*").alias("n"))
