from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import snapshots
from tidemark.sources import files, generations, published


def greedy(rows):
    ids, hashes, kept = set(), set(), []
    for o, i, h in sorted(rows):
        if (i and i in ids) or h in hashes:
            continue
        kept.append(o)
        hashes.add(h)
        if i:
            ids.add(i)
    return kept


@pytest.mark.parametrize("seed", [1, 2])
def test_greedy_distinct(spark, seed):
    rng = random.Random(seed)
    rows = [(o, rng.choice(["", *"abcdefghij"]) + str(rng.randint(0, 9)) if rng.random() < 0.9 else None, f"h{rng.randint(0, 60)}") for o in range(150)]
    got = snapshots.greedy_distinct(spark.createDataFrame(rows, "o int, i string, h string").repartition(3), "i", "h", F.col("o"))
    assert sorted(r.o for r in got.collect()) == greedy(rows)


def test_greedy_is_not_two_passes(spark):
    rows = spark.createDataFrame([(1, "1", "h1"), (2, "2", "h1"), (3, "2", "h2")], "o int, i string, h string")
    assert sorted(r.o for r in snapshots.greedy_distinct(rows, "i", "h", F.col("o")).collect()) == [1, 3]


def test_greedy_writes_undecided_rows_only(spark, tmp_path):
    """Rows alike in everything count once, null digests are alike, and a round carries on only what isn't decided."""
    rows = [(1, "a", "x"), (1, "a", "x"), (2, "b", None), (3, "c", None), (4, "a", "y"), (5, "d", "y"), (6, "e", "z")]
    before = spark.sparkContext.getCheckpointDir()
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    try:
        got = snapshots.greedy_distinct(spark.createDataFrame(rows, "o int, i string, h string").repartition(3), "i", "h", F.col("o"))
        assert sorted(r.o for r in got.collect()) == [1, 2, 5, 6]
    finally:
        spark.sparkContext._jsc.sc().setCheckpointDir(before.removeprefix("file:"))
    written = [spark.read.parquet(str(at)).count() for at in sorted(tmp_path.rglob("_round=*"))]
    assert written == [5, 1]  # four rows are kept at once, "d" waits for "a"


def test_compared_and_fingerprints(spark):
    a = spark.createDataFrame([(1, "x", None), (2, "y", 1), (3, "z", 1)], "k int, s string, n int")
    b = spark.createDataFrame([(1, "x", None), (2, "y", 2), (4, "w", 1)], "k int, s string, n int")
    assert {r.k: r.change for r in snapshots.compared(a, b, ["k"]).collect()} == {2: "changed", 3: "removed", 4: "added"}
    assert snapshots.fingerprint(a.repartition(3)).collect() == snapshots.fingerprint(a.orderBy(F.desc("k"))).collect() != snapshots.fingerprint(b).collect()
    assert snapshots.fingerprint(a.where("s IS NULL")).first().row_count == 0
    twice = a.union(a.where("k = 1"))
    assert [(r.n_one, r.n_two) for r in snapshots.multiset_difference(a, twice).collect()] == [(1, 2)]


def test_generations_are_told_apart_without_text(spark):
    df = lambda *xs: spark.createDataFrame(xs, "a string, b string, c double, d array<int>, e timestamp")
    digest = lambda x: snapshots.typed_fingerprint(x).first()[:]
    one, two = ("a", None, 0.0, [1, None], None), ("b", "x", 1.5, [], None)
    assert digest(df(one, two)) == digest(df(two, one).repartition(3)) and digest(df(one, two))[0] == 2
    others = [
        df(one, one), df(one), df(one, two, two), df((None, "a", *one[2:]), two), df(("a", "", *one[2:]), two), df((*one[:2], -0.0, *one[3:]), two),
        df((*one[:3], [None, 1], None), two), df(("ab", "x", *one[2:]), ("a", "bx", *one[2:])), df(("ab", "bx", *one[2:]), ("a", "x", *one[2:])), df(one, two).where("a = 'none'"), df(one, two).withColumnRenamed("a", "z"),
    ]
    found = [digest(x) for x in [df(one, two), *others]]
    assert len(set(found)) == len(found)
    rows = spark.range(3).selectExpr("CAST(id AS STRING) AS a", "id / 3 AS b", "timestamp_seconds(id) AS c")
    plan = snapshots.typed_fingerprint(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert "sha2" not in plan and "concat_ws(|" not in plan
    planned = generations.plan({"rows": rows}, {"x": 1})
    assert generations.varied(planned, {"x": 2}) == generations.plan({"rows": rows}, {"x": 2}) != planned
    assert planned["inputs"]["rows"] == dict(zip(("rows", "digest"), digest(rows), strict=True))


def test_retained(spark):
    rows = spark.createDataFrame([(i, f"2026-01-{1 + i // 2:02d} {10 + i % 2}:00:00") for i in range(60)], "snapshot_id int, created_at string")
    kept = {r.snapshot_id for r in snapshots.retained(rows).where("keep").collect()}
    assert {59, 57, 55, 53, 51, 49, 47} <= kept and len(kept) <= 11 and 58 not in kept


def test_publishing(spark, tmp_path):
    at = str(tmp_path / "t")
    one = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert published.publish(one.limit(0), at) == -1
    assert published.publish(one, at, operation_id="first") == 0
    assert published.publish(one, at, operation_id="first") == 0
    with pytest.raises(ValueError, match="other rows"):
        published.publish(one.limit(1), at, operation_id="first")
    with pytest.raises(ValueError, match="schema"):
        published.publish(one.withColumn("k", F.col("k").cast("long")), at)
    assert published.publish(spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"), at, "upsert", ["k"], expected=0) == 1
    with pytest.raises(published.Conflict):
        published.publish(one, at, expected=0)
    with pytest.raises(ValueError, match="null"):
        published.publish(spark.createDataFrame([(None, "d")], "k int, v string"), at, "upsert", ["k"])
    assert published.publish(spark.createDataFrame([(9, "z")], "k int, v string"), at, "append") == 2
    assert sorted(map(tuple, published.read(spark, at, 0).collect())) == [(1, "a"), (2, "b")]
    assert sorted(map(tuple, published.read(spark, at).collect())) == [(1, "a"), (2, "c"), (3, "d"), (9, "z")]
    assert [c["operation"] for c in published.history(spark, at)] == ["overwrite", "upsert", "append"]
    with pytest.raises(KeyError):
        published.read(spark, at, 7)


def test_groups_appear_whole(spark, tmp_path):
    frames = {"a": spark.range(3), "b": spark.range(5)}
    published.publish_group(frames, str(tmp_path / "g"), "run-1")
    assert {k: v.count() for k, v in published.read_group(spark, str(tmp_path / "g"), "run-1").items()} == {"a": 3, "b": 5}
    with pytest.raises(KeyError):
        published.read_group(spark, str(tmp_path / "g"), "run-2")


def test_json_documents_and_lines(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a.json").write_text(json.dumps([{"id": 1, "x": "a"}, {"id": 2}], indent=1))
    (tmp_path / "in" / "deep" / "b.jsonl").write_text('{"id": 3, "y": true}\n{"id": 4}\n')
    got = files.read_json(spark, str(tmp_path / "in"))
    assert sorted(r.id for r in got.collect()) == [1, 2, 3, 4] and set(got.columns) == {"id", "x", "y"}
    with pytest.raises(FileNotFoundError):
        (tmp_path / "none").mkdir()
        files.read_json(spark, str(tmp_path / "none"))


def test_load_formats(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿product_id,price\n007,5\n")
    (tmp_path / "a.tsv").write_text("product_id\tprice\n007\t5\n")
    (tmp_path / "a.jsonl").write_text('{"product_id": 7, "price": 5}\n')
    for name in ("a.csv", "a.tsv"):
        assert files.load(spark, str(tmp_path / name)).first().product_id == "007"
    assert files.load(spark, str(tmp_path / "a.jsonl")).first().product_id == "7"
    with pytest.raises(ValueError):
        files.load(spark, "x.docx")


def test_made_data_is_deterministic(spark):
    a, b = files.make_reviews(spark, 500, 20).repartition(7), files.make_reviews(spark, 500, 20)
    assert snapshots.fingerprint(a).collect() == snapshots.fingerprint(b).collect()
    assert files.make_products(spark, 10).select("product_id").distinct().count() == 10
    assert 0 < a.where("rating = '9'").count() < 100
    assert files.amplified(files.make_products(spark, 3), 7, "product_id", "x").select("product_id").distinct().count() == 9


def test_bronze_by_hour(spark, tmp_path):
    df = spark.createDataFrame([("a", "2026-01-02 03:04:05"), ("b", None)], "id string, t string")
    published.write_bronze(df, str(tmp_path / "b"), "t")
    assert (tmp_path / "b/year=2026/month=01/day=02/hour=03").is_dir() and spark.read.json(str(tmp_path / "b")).count() == 2
    assert files.layer_stats(spark, str(tmp_path / "b")).first().files >= 2 and files.recent(spark, str(tmp_path / "b"), 1).count() == 1


def test_marts_are_published_only_if_sound(spark, tmp_path):
    good = spark.createDataFrame([("a", 1, "r")], "k string, review_count int, run_id string")
    bad = good.union(good)
    with pytest.raises(ValueError, match="sound"):
        published.publish_marts({"good": good, "bad": bad}, {"good": ["k"], "bad": ["k"]}, str(tmp_path / "m"), "r")
    assert not (tmp_path / "m").exists()
    with pytest.raises(ValueError, match="another run"):
        published.publish_marts({"good": good}, {"good": ["k"]}, str(tmp_path / "m"), "s")
    with pytest.raises(ValueError, match="no report"):
        published.publish_marts({"good": good}, {"good": ["k"]}, str(tmp_path / "m"), "r", [])
    assert published.publish_marts({"good": good}, {"good": ["k"]}, str(tmp_path / "m"), "r") == {"good": 0}


def test_replay_moves_clocks_together(spark):
    df = spark.createDataFrame([("2026-01-01 00:00:00", "2026-01-01 00:00:10"), ("2026-01-02 00:00:00", None)], "a string, b string")
    got = files.restamped(df, ["a", "b"]).selectExpr("unix_timestamp(a) AS a", "unix_timestamp(b) AS b").orderBy("a").collect()
    assert got[1].a - got[0].a == 86400 and got[0].b - got[0].a == 10 and got[1].b is None


def test_parquet_if_present(spark, tmp_path):
    assert files.parquet_if_present(spark, str(tmp_path / "none")) is None
    (tmp_path / "broken.parquet").write_text("no parquet")
    with pytest.raises(Exception, match="(?i)parquet|corrupt|footer"):
        files.parquet_if_present(spark, str(tmp_path / "broken.parquet")).count()
