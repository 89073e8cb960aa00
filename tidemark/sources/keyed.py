"""Keyed tables: one row a key over any number of batches, rewritten only where a batch touches them.

Rows lie in buckets, by default a hash of their key; a commit (as of published tables) lists
each bucket's folders: runs, oldest first, in each of which a key stands once. A merge adds a
run of its own rows to the buckets that they fall into and commits the changed list; a small
bucket, or one of too many runs, is written anew as one run that holds each key's newest row.
So its work grows with the batch, not with the table, but for one merge in RUNS. Readers keep
each key's newest row of a bucket's runs, so they see the same rows either way. A batch number
that has been committed changes nothing when it comes again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.silver import latest
from tidemark.sources import published

#: Buckets by default; bytes up to which a bucket is written anew by each merge that touches it; runs that a bucket has at most.
BUCKETS, SMALL, RUNS = 64, 1 << 14, 8
_BUCKET = "_bucket"


def hashed(*keys: str, buckets: int = BUCKETS) -> Column:
    """A bucket by the keys' hash."""
    return F.lpad(F.conv(F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("string"), 10, 16), 4, "0")


def prefix(digest: str, length: int = 2) -> Column:
    """A bucket by the first characters of a hexadecimal digest."""
    return F.coalesce(F.substring(digest, 1, length), F.lit("none"))


def merge(df: DataFrame, path: str, keys: list[str], *order: str, bucket: Column | None = None, batch_id: int | None = None) -> int:
    """Merges df's rows and returns the version: of a key the largest row by order stays, of equal ones the incoming one; without order always the incoming one.

    bucket must follow from the keys alone and hold letters, digits and hyphens. batch_id:
    numbers that rise from batch to batch, as foreachBatch gives them; one that isn't above
    the last committed number is skipped. An empty df changes nothing. The columns must stay
    the same. Two writers at once: the later one gets Conflict.
    """
    spark = df.sparkSession
    before = published.history(spark, path, 1)
    commit = before[-1] if before else {"version": -1, "buckets": {}, "batch_id": None, "schema": None}
    done = commit["batch_id"]
    if batch_id is not None and done is not None and batch_id <= done:
        return commit["version"]
    simple = [[f.name, f.dataType.simpleString()] for f in df.schema]
    if commit["schema"] not in (None, simple):
        raise ValueError(f"schema differs from the published one: {simple}")
    by = bucket if bucket is not None else hashed(*keys)
    rule = {"keys": keys, "order": list(order)}
    incoming, merged = (f"data/{uuid.uuid4().hex}" for _ in range(2))
    _written(latest(df, keys, *order).withColumn(_BUCKET, by), f"{path}/{incoming}")
    touched = _buckets(spark, f"{path}/{incoming}")
    now = {b: published.runs(r) for b, r in commit["buckets"].items()}
    size = {b: n for b, n in commit.get("bytes", {}).items() if b in now}
    anew = {b for b in touched if b in now and (size.get(b, 0) <= SMALL or len(now[b]) >= RUNS)}
    if commit.get("rule") != rule:  # runs are read by one rule
        anew |= {b for b in now if b in touched or len(now[b]) > 1}
    if anew:  # the batch's new buckets go with them
        anew |= touched.keys() - now.keys()
    version, spare = commit["version"], [incoming]
    try:
        if touched:
            if anew:
                old = lambda of: published.newest(spark, path, {b: now[b] for b in of if b in now}, commit.get("rule"), df.schema)
                met, rest = sorted(anew & touched.keys()), sorted(anew - touched.keys())
                kept = rest and old(rest)
                if met:
                    new = spark.read.schema(df.schema).parquet(*[f"{path}/{incoming}/{_BUCKET}={b}" for b in met]).withColumn("_incoming", F.lit(1))
                    both = old(met).withColumn("_incoming", F.lit(0)).unionByName(new) if now.keys() & met else new
                    both = latest(both, keys, *order, "_incoming").drop("_incoming").select(*df.columns)
                    kept = kept.unionByName(both) if rest else both
                spare.append(merged)
                _written(kept.withColumn(_BUCKET, by), f"{path}/{merged}")
                size |= _buckets(spark, f"{path}/{merged}")
            for b in anew:
                now[b] = [f"{merged}/{_BUCKET}={b}"]
            for b in touched.keys() - anew:
                now[b] = [*now.get(b, []), f"{incoming}/{_BUCKET}={b}"]
                size[b] = size.get(b, 0) + touched[b]
            listed = {b: r[0] if len(r) == 1 else r for b, r in now.items()}
            version = published.write_commit(spark, path, {"version": version + 1, "operation": "merge", "operation_id": None, "batch_id": batch_id if batch_id is not None else done, "buckets": listed, "bytes": size, "rule": rule, "touched": len(touched), "schema": simple})
            spare = [incoming] if anew >= touched.keys() else [f"{incoming}/{_BUCKET}={b}" for b in sorted(anew & touched.keys())]
    finally:
        for folder in spare:
            published.delete(spark, f"{path}/{folder}")
    return version


def _written(rows: DataFrame, at: str) -> None:
    """A bucket's rows together, but over several files where it is large."""
    rows.hint("rebalance", _BUCKET).write.partitionBy(_BUCKET).parquet(at)


def _buckets(spark: SparkSession, at: str) -> dict[str, int]:
    """The buckets written there, by their folders' names, and their bytes."""
    fs, path = published._fs(spark, at)
    found = ((s.getPath().getName(), s.getPath()) for s in fs.listStatus(path))
    return {name.split("=", 1)[1]: fs.getContentSummary(p).getLength() for name, p in found if name.startswith(f"{_BUCKET}=")}


def read(spark: SparkSession, path: str) -> DataFrame:
    """The newest version."""
    return published.read(spark, path)
