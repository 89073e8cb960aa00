"""Published tables: Parquet folders beside small commit files that list them.

A version appears at once, when its commit file is created; the create fails if another
writer was first. A commit lists the folders that make up its version: an append writes its
own rows only and lists the older folders with its own, an overwrite or upsert lists one new
folder. Readers of an older version are never disturbed, so a reader may also ask for one.
compact() rewrites a version of many folders as one, vacuum() deletes folders that only old
versions list. This is a convention on top of Spark's own writers, not a table format.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.operators.silver import latest, merged
from tidemark.operators.snapshots import fingerprint


#: What a partitioned load's folder begins with.
_LOAD = "load="


class Conflict(Exception):
    """Another writer has published since."""


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def commit_names(spark: SparkSession, path: str) -> list[str]:
    """The commit files' names, oldest first."""
    fs, at = _fs(spark, f"{path}/_commits")
    if not fs.exists(at):
        return []
    names = sorted(s.getPath().getName() for s in fs.listStatus(at))
    return [n for n in names if n.endswith(".json") and not n.startswith((".", "_"))]


def history(spark: SparkSession, path: str, last: int | None = None) -> list[dict]:
    """The commits, oldest first, or the last ones only: version, operation, operation_id, data (folders), schema, rows, digest."""
    found = commit_names(spark, path)
    found = found[-last:] if last else found
    if not found:
        return []
    lines = spark.read.text([f"{path}/_commits/{n}" for n in found]).collect()  # one line a version
    return sorted((json.loads(r[0]) for r in lines), key=lambda c: c["version"])


def write_commit(spark: SparkSession, path: str, commit: dict) -> int:
    """Makes a version visible; Conflict if there is one of its number."""
    fs, at = _fs(spark, f"{path}/_commits/{commit['version']:012d}.json")
    try:
        stream = fs.create(at, False)
    except Exception as e:  # the file is there: the other writer's version stands
        raise Conflict(f"version {commit['version']} of {path} was published meanwhile") from e
    stream.write(bytearray(json.dumps(commit).encode()))
    stream.close()
    return commit["version"]


def delete(spark: SparkSession, path: str) -> None:
    fs, at = _fs(spark, path)
    fs.delete(at, True)


def folders(commit: dict) -> list[str]:
    """A commit's data folders, below the table's path."""
    if "buckets" in commit:
        return sorted(f for r in commit["buckets"].values() for f in runs(r))
    return [commit["data"]] if isinstance(commit["data"], str) else commit["data"]


def runs(listed: str | list[str]) -> list[str]:
    """A bucket's folders, oldest first; a commit lists a single one by itself."""
    return [listed] if isinstance(listed, str) else listed


def newest(spark: SparkSession, path: str, buckets: dict[str, list[str]], rule: dict | None, schema: StructType | None = None) -> DataFrame:
    """The rows of a keyed table's buckets: of a key in several runs the largest by the rule's order, of equal ones the later run's."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    some = lambda of: reader.parquet(*[f"{path}/{f}" for f in of])
    single = [r[0] for r in buckets.values() if len(r) == 1]
    several = [r for r in buckets.values() if len(r) > 1]
    if not several:
        return some(single)
    both = None
    for n in range(max(map(len, several))):  # as many as a bucket has runs at most
        run = some([r[n] for r in several if len(r) > n]).withColumn("_run", F.lit(n))
        both = run if both is None else both.unionByName(run)
    out = latest(both, rule["keys"], *rule["order"], "_run").drop("_run")
    return out.unionByName(some(single)) if single else out


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The newest version, or the one asked for."""
    commits = history(spark, path, 1 if version is None else None)
    if version is None:
        if not commits:
            raise KeyError(f"nothing is published at {path}")
        commit = commits[-1]
    else:
        commit = next((c for c in commits if c["version"] == version), None)
        if commit is None:
            raise KeyError(f"{path} has no version {version}")
    of = folders(commit)
    if version is not None:
        fs, _ = _fs(spark, path)
        gone = [f for f in of if not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{f}"))]
        if gone:
            raise KeyError(f"version {version} of {path} was cleaned away")
    if "buckets" in commit:
        return newest(spark, path, {b: runs(r) for b, r in commit["buckets"].items()}, commit.get("rule"))
    if commit.get("partition_by"):  # each load is a partition of one tree, so that the others are found
        return spark.read.option("basePath", f"{path}/data").parquet(*[f"{path}/{f}" for f in of]).select(*[F.col(n).cast(t) for n, t in commit["schema"]])
    return spark.read.parquet(*[f"{path}/{f}" for f in of])


def publish(df: DataFrame, path: str, mode: str = "overwrite", keys: list[str] | None = None, operation_id: str | None = None, expected: int | None = None, partition_by: list[str] | None = None) -> int:
    """Publishes df and returns the version: mode append, overwrite or upsert (by keys, incoming rows win).

    df is worked out once, when it is written; all else is read from what was written. An
    empty df changes nothing. The schema must stay the same. A repeated operation_id with
    the same rows returns its version, with others it is an error. expected is the version
    that df was made from; if the table has moved on, or moves on meanwhile, Conflict is raised.
    """
    spark = df.sparkSession
    commits = history(spark, path)
    now = commits[-1]["version"] if commits else -1
    repeated = next((c for c in commits if operation_id is not None and c["operation_id"] == operation_id), None)
    if repeated is None and expected is not None and expected != now:
        raise Conflict(f"{path} is at version {now}, not {expected}")
    simple = [[f.name, f.dataType.simpleString()] for f in df.schema]
    if commits and mode == "append" and commits[-1].get("partition_by") != partition_by:
        raise ValueError(f"the published table is partitioned by {commits[-1].get('partition_by')}")
    if repeated is None and commits and commits[-1]["schema"] != simple and not df.isEmpty():
        raise ValueError(f"schema differs from the published one: {simple}")
    if mode == "upsert" and not keys:
        raise ValueError("upsert needs keys")
    folder = lambda: f"data/{_LOAD if partition_by else ''}{uuid.uuid4().hex}"
    incoming = folder()
    (df.write.partitionBy(*partition_by) if partition_by else df.write).parquet(f"{path}/{incoming}")
    written = spark.read.schema(df.schema).parquet(f"{path}/{incoming}")
    print_ = fingerprint(written).first()
    made = [incoming]
    try:
        if repeated is not None:
            if repeated["digest"] != print_["digest_sum"]:
                raise ValueError(f"operation {operation_id} was published with other rows")
            version = repeated["version"]
        elif print_["row_count"] == 0:
            version = now
        else:
            data = incoming
            if mode == "upsert":
                lacking = F.lit(False)
                for k in keys:
                    lacking = lacking | F.col(k).isNull()
                if not written.where(lacking).isEmpty():
                    raise ValueError("upsert needs keys that aren't null")
                out = merged(read(spark, path) if commits else written.limit(0), written, keys)
                data = folder()
                made.append(data)
                (out.write.partitionBy(*partition_by) if partition_by else out.write).parquet(f"{path}/{data}")
            before = folders(commits[-1]) if mode == "append" and commits else []
            version = write_commit(spark, path, {"version": now + 1, "operation": mode, "operation_id": operation_id, "data": [*before, data], "partition_by": partition_by, "schema": simple, "digest": print_["digest_sum"], "rows": print_["row_count"]})
            made.remove(data)
    finally:
        for spare in made:  # what no version lists
            delete(spark, f"{path}/{spare}")
    return version


def compact(spark: SparkSession, path: str) -> int:
    """A version of one folder with the newest version's rows; readers and older versions aren't disturbed."""
    commit = history(spark, path, 1)[-1]
    if len(folders(commit)) < 2:
        return commit["version"]
    partition_by = commit.get("partition_by")
    data = f"data/{_LOAD if partition_by else ''}{uuid.uuid4().hex}"
    rows = read(spark, path)
    (rows.write.partitionBy(*partition_by) if partition_by else rows.write).parquet(f"{path}/{data}")
    return write_commit(spark, path, commit | {"version": commit["version"] + 1, "operation": "compact", "operation_id": None, "data": [data]})


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Deletes the folders that none of the last versions lists, and returns how many; versions before them can't be read any more.

    Not to be run beside a writer, whose folder no version lists yet.
    """
    used = {f for c in history(spark, path, keep) for f in folders(c)}
    whole = {"/".join(f.split("/")[:2]) for f in used}
    fs, at = _fs(spark, f"{path}/data")
    old = []
    for s in fs.listStatus(at) if fs.exists(at) else []:
        name = f"data/{s.getPath().getName()}"
        if name not in whole:
            old.append(s.getPath())
        elif name not in used:  # a folder of buckets, some of which may have been replaced
            old += [b.getPath() for b in fs.listStatus(s.getPath()) if b.isDirectory() and f"{name}/{b.getPath().getName()}" not in used]
    for folder in old:
        fs.delete(folder, True)
    return len(old)


def publish_group(frames: dict[str, DataFrame], path: str, run_id: str) -> dict[str, int]:
    """Publishes marts that belong together: a manifest is written last, so that readers of read_group see all of a run or none."""
    spark = next(iter(frames.values())).sparkSession
    versions = {name: publish(df, f"{path}/{name}", operation_id=run_id) for name, df in frames.items()}
    spark.createDataFrame([(run_id, json.dumps(versions))], "run_id string, versions string").coalesce(1).write.mode("append").json(f"{path}/_runs")
    return versions


def read_group(spark: SparkSession, path: str, run_id: str) -> dict[str, DataFrame]:
    row = spark.read.schema("run_id string, versions string").json(f"{path}/_runs").where(F.col("run_id") == run_id).first()
    if row is None:
        raise KeyError(f"run {run_id} isn't complete")
    return {name: read(spark, f"{path}/{name}", v) for name, v in json.loads(row["versions"]).items()}


def quarantine(df: DataFrame, path: str) -> None:
    df.write.mode("append").partitionBy("quarantine_reason").parquet(path)


def write_bronze(df: DataFrame, path: str, clock: str) -> None:
    """JSON by year, month, day and hour of each row's own clock; rows without one are under hour=unknown."""
    at = F.col(clock).cast("timestamp")
    part = {n: F.coalesce(F.date_format(at, p), F.lit("unknown")) for n, p in (("year", "yyyy"), ("month", "MM"), ("day", "dd"), ("hour", "HH"))}
    df.withColumns(part).write.mode("append").partitionBy(*part).json(path)


def consumed_faults(consumed: dict[str, DataFrame], reports: list[dict], run_id: str, source_runs: dict[str, str] | None = None) -> list[str]:
    """Why quality reports don't describe the frames that marts were made of: each needs rows and one report of its run with just as many.

    source_runs: the run that made a frame, where it isn't run_id.
    """
    why = []
    for name, df in consumed.items():
        run = (source_runs or {}).get(name, run_id)
        mine = [r for r in reports if r.get("dataset") == name and r.get("source_run_id", r.get("run_id")) == run]
        rows = df.count()
        if not rows:
            why.append(f"{name}: consumed, but empty")
        elif len(mine) != 1:
            why.append(f"{name}: {len(mine)} reports of run {run}")
        elif mine[0].get("total") != rows and mine[0].get("valid") != rows:
            why.append(f"{name}: {rows} rows consumed, {mine[0].get('total')} measured")
    return why


def publish_marts(frames: dict[str, DataFrame], grains: dict[str, list[str]], path: str, run_id: str, reports: list[dict] | None = None, consumed: dict[str, DataFrame] | None = None, source_runs: dict[str, str] | None = None) -> dict[str, int]:
    """Publishes a run's marts after all of them are found sound and, with reports, the quality gate lets the run pass; nothing is written otherwise.

    consumed: the frames that the marts were made of, which the reports must describe.
    """
    from tidemark.operators.marts import require_sound
    from tidemark.operators.quality import gate

    if reports is not None and (why := gate(reports, run_id=run_id)):
        raise ValueError("; ".join(why))
    if consumed is not None and (why := consumed_faults(consumed, reports or [], run_id, source_runs)):
        raise ValueError("; ".join(why))
    for name, df in frames.items():
        require_sound(df, grains[name])
        if "run_id" in df.columns and not df.where(F.col("run_id") != run_id).isEmpty():
            raise ValueError(f"{name} holds rows of another run")
    return publish_group(frames, path, run_id)


def publish_articles(articles: DataFrame, path: str, run_id: str, min_score: float = 90.0) -> dict:
    """Publishes a run's articles (newest versions), daily statistics and quarantine as one group, and returns its manifest.

    A batch without a valid article, or of a lower score, changes nothing in use: its
    quarantine and quality stay under _attempts. A run is published once.
    """
    from tidemark.operators import articles as A

    spark = articles.sparkSession
    if not 0 <= min_score <= 100:
        raise ValueError("the score is between 0 and 100")
    if run_id in {m["run_id"] for m in article_runs(spark, path)}:
        raise ValueError(f"run {run_id} is published already")
    judged = A.judged(articles)
    current, counts = A.versions(articles)
    quality = counts.first().asDict()
    bad = judged.where("reason IS NOT NULL")
    if not quality["valid"] or quality["dq_score"] < min_score:
        at = f"{path}/_attempts/{run_id}-{uuid.uuid4().hex[:8]}"
        bad.write.json(f"{at}/quarantine")
        counts.write.json(f"{at}/quality")
        raise ValueError(f"quality {quality['dq_score']} is below {min_score}: what is in use stays")
    frames = {"articles": current, "article_daily_stats": A.daily_stats(current), "quarantine": bad}
    versions = {name: publish(df.withColumn("run_id", F.lit(run_id)), f"{path}/{name}", operation_id=run_id) for name, df in frames.items()}
    manifest = {"run_id": run_id, "tables": versions, "quality": quality, "required_score": min_score, "status": "complete"}
    write_commit(spark, f"{path}/_manifests", {"version": len(article_runs(spark, path)), "operation": "articles", "operation_id": run_id, **manifest})
    return manifest


def article_runs(spark: SparkSession, path: str) -> list[dict]:
    """The manifests of published runs, oldest first; the last one names the versions in use."""
    return history(spark, f"{path}/_manifests")


def read_articles(spark: SparkSession, path: str, name: str = "articles") -> DataFrame:
    runs = article_runs(spark, path)
    if not runs:
        raise KeyError(f"no articles are published at {path}")
    return read(spark, f"{path}/{name}", runs[-1]["tables"][name])
