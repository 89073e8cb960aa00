"""Comparing, fingerprinting and thinning snapshots; order-dependent de-duplication."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import values as V

# Snapshots kept.
KEEP_DAYS, KEEP_WEEKS = 7, 4


def compared(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """The keys that were added, removed or changed; columns of both count, and null equals null."""
    rest = sorted(set(before.columns) & set(after.columns) - set(key))
    one = before.select(*key, F.lit(True).alias("_in_before"), F.struct(*rest).alias("_before"))
    two = after.select(*key, F.lit(True).alias("_in_after"), F.struct(*rest).alias("_after"))
    both = one.join(two, key, "full_outer")
    change = F.when(F.col("_in_before").isNull(), "added").when(F.col("_in_after").isNull(), "removed").when(~F.col("_before").eqNullSafe(F.col("_after")), "changed")
    return both.select(*key, change.alias("change")).where("change IS NOT NULL")


def comparison_report(tables: dict[str, tuple[DataFrame, DataFrame, list[str]]], examples: int = 10) -> DataFrame:
    """A row a table (before, after, key): rows before and after, keys added, removed and changed, the first examples of each, status equal or changed. Rows that repeat make it changed too."""
    out = None
    for name, (before, after, key) in sorted(tables.items()):
        kinds = ("added", "removed", "changed")
        # a bounded list of the least keys: the sort keeps as many a task as it gives
        shown = compared(before, after, key).select("change", F.to_json(F.struct(*key)).alias("k"))
        counts = shown.groupBy("change").agg(F.count("*").alias("n"))
        counts = counts.agg(*[F.coalesce(F.max(F.when(F.col("change") == k, F.col("n"))), F.lit(0)).alias(f"{k}_keys") for k in kinds])
        least = None
        for k in kinds:
            few = shown.where(F.col("change") == k).orderBy("k").limit(examples).agg(F.array_sort(F.collect_list("k")).alias(f"{k}_examples"))
            least = few if least is None else least.crossJoin(few)  # one row each
        sizes = fingerprint(before).select(F.col("row_count").alias("rows_before"), F.col("digest_sum").alias("_b")).crossJoin(fingerprint(after).select(F.col("row_count").alias("rows_after"), F.col("digest_sum").alias("_a")))
        row = sizes.crossJoin(counts).crossJoin(least).select(
            F.lit(name).alias("table"), "rows_before", "rows_after", *[f"{k}_keys" for k in kinds], *[f"{k}_examples" for k in kinds],
            F.when((F.col("_a") == F.col("_b")) & (F.col("rows_before") == F.col("rows_after")), "equal").otherwise("changed").alias("status"),
        )
        out = row if out is None else out.unionByName(row)
    return out


def row_digest(df: DataFrame) -> Column:
    """SHA-256 of a row's fields as text in name order; null differs from the empty text."""
    cells = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("~")) for c in sorted(df.columns)]
    return F.sha2(F.concat_ws("|", *cells), 256)


def fingerprint(df: DataFrame) -> DataFrame:
    """One row: number of rows and a digest of them as a multiset, whatever their order and partitions.

    The digests' first 60 bits are summed exactly, so nothing is collected or sorted.
    """
    d = row_digest(df)
    number = F.conv(F.substring(d, 1, 15), 16, 10).cast("decimal(38,0)")
    return df.select(number.alias("n")).agg(F.count("*").alias("row_count"), F.coalesce(F.sum("n"), F.lit(0)).cast("string").alias("digest_sum"))


def typed_fingerprint(df: DataFrame) -> DataFrame:
    """As fingerprint, from two 64-bit hashes of a row's typed fields in name order: several times cheaper, as no number or time is made into text.

    Meant to tell apart what differs by accident; it isn't a safeguard against rows that are
    made to collide. Null, the empty text and 0.0 and -0.0 differ, as do values of different types.
    """
    cells = []
    for c in sorted(df.columns):
        kind, cell = df.schema[c].dataType, F.col(c)
        if isinstance(kind, (T.ArrayType, T.StructType, T.MapType, T.VariantType)):  # the hash passes over nulls inside
            cell = cell.cast("string")
        elif isinstance(kind, (T.FloatType, T.DoubleType)):  # the hash takes both zeros as one
            cells.append(F.when(cell == 0, cell.cast("string")))
        cells += [cell, cell.isNull()]
    hashes = df.select(*[F.xxhash64(F.lit(seed), *cells).alias(f"h{seed}") for seed in (0, 1)])
    parts = [part for seed in (0, 1) for part in (F.shiftrightunsigned(f"h{seed}", 43), F.shiftright(f"h{seed}", 22).bitwiseAND(F.lit((1 << 21) - 1)), F.col(f"h{seed}").bitwiseAND(F.lit((1 << 22) - 1)))]
    sums = [F.coalesce(F.sum(part), F.lit(0)).cast("string") for part in parts]  # of 22 bits at most, so exact for 10 ** 12 rows
    return hashes.agg(F.count("*").alias("row_count"), F.concat_ws("-", *sums).alias("digest_sum"))


def multiset_difference(one: DataFrame, two: DataFrame) -> DataFrame:
    """digest, n_one, n_two of the rows that don't stand equally often in both."""
    count = lambda df, name: df.select(row_digest(df).alias("digest")).groupBy("digest").agg(F.count("*").alias(name))
    met = count(one, "n_one").join(count(two, "n_two"), "digest", "full_outer").na.fill(0, ["n_one", "n_two"])
    return met.where("n_one != n_two")


def identity_collisions(moves: DataFrame) -> DataFrame:
    """Old ids that lead to several new ones. moves: old_id, new_id."""
    return moves.groupBy("old_id").agg(F.countDistinct("new_id").alias("n_new")).where("n_new > 1")


def retained(snapshots: DataFrame, days: int = KEEP_DAYS, weeks: int = KEEP_WEEKS) -> DataFrame:
    """snapshots (snapshot_id, created_at) with keep: the newest of each of the last days that have one, of each of the last ISO weeks, and the newest of all."""
    at = F.col("created_at").cast("timestamp")
    day, week = F.to_date(at), F.to_date(F.date_trunc("week", at))
    rows = snapshots.withColumns({"_day": day, "_week": week})
    best = F.struct(at, F.col("snapshot_id"))
    of_day = rows.groupBy("_day").agg(F.max_by("snapshot_id", best).alias("snapshot_id")).orderBy(F.desc("_day")).limit(days)
    of_week = rows.groupBy("_week").agg(F.max_by("snapshot_id", best).alias("snapshot_id")).orderBy(F.desc("_week")).limit(weeks)
    kept = of_day.select("snapshot_id").union(of_week.select("snapshot_id")).distinct().withColumn("keep", F.lit(True))
    return snapshots.join(F.broadcast(kept), "snapshot_id", "left").withColumn("keep", F.coalesce("keep", F.lit(False)))  # days + weeks rows at most


def greedy_distinct(df: DataFrame, ident: str, digest: str, *order: Column) -> DataFrame:
    """Goes through rows by order and keeps one unless its id or its digest stands in a kept row; a blank id never does.

    order, then the other columns, tell rows apart; of rows alike in all of them one is kept.
    Each round decides the rows that come first both among the undecided rows of their id and
    of their digest, and drops those that share either with a kept row; rounds follow the
    longest chain of such conflicts, and each decides the first undecided row at least, so they
    come to an end. A round shuffles the undecided rows only, by id and by digest, and writes
    what it kept and what is still undecided to the checkpoint folder, once each.
    """
    spark = df.sparkSession
    at = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        raise ValueError("set a checkpoint folder that all executors share")
    at = f"{at.rstrip('/')}/greedy-{uuid.uuid4().hex}"
    columns = df.columns
    line = [*order, *[c for c in columns if not isinstance(df.schema[c].dataType, (T.MapType, T.VariantType))]]
    by_id, by_hash = Window.partitionBy("_id").orderBy(*line), Window.partitionBy(F.col(digest).cast("string")).orderBy(*line)
    blank = F.col("_id").startswith("~")  # spread by a digest that decides nothing
    key = F.when(V.blank(F.col(ident)), F.concat(F.lit("~"), F.xxhash64(*columns).cast("string"))).otherwise(F.concat(F.lit("="), F.col(ident).cast("string")))
    undecided = df.withColumn("_id", key)
    schema, n = undecided.withColumn("_kept", F.lit(0)).schema, 0
    while True:
        x = undecided.withColumn("_first", blank | (F.rank().over(by_id) == 1))
        x = x.withColumn("_kept", ((F.row_number().over(by_hash) == 1) & F.col("_first")).cast("int")).drop("_first")
        x = x.withColumn("_taken", F.first("_kept").over(by_hash))  # a digest's kept row is its first
        x.where("_kept = 1 OR _taken = 0").drop("_taken").write.partitionBy("_kept").parquet(f"{at}/_round={n}")
        made = spark.read.schema(schema).parquet(f"{at}/_round={n}")
        met = made.where("_kept = 1").where(~blank).select("_id")
        undecided = made.where("_kept = 0").drop("_kept").join(met, "_id", "left_anti").select(*columns, "_id")
        if undecided.isEmpty():
            return spark.read.schema(f"{schema.toDDL()}, _round int").parquet(at).where("_kept = 1").select(*columns)
        n += 1
