"""Database loads, replays beside what is in use, nested schemas, simulations, provenance."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidemark.functions import rules
from tidemark.operators import anomaly
from tidemark.sources import files, generations, published, warehouse


@pytest.fixture(scope="module")
def url(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("derby")
    spark._jvm.java.lang.System.setProperty("derby.stream.error.file", str(at / "derby.log"))
    return f"jdbc:derby:{at}/db;create=true"


MART = "date string, product_id string, avg_price double, currency string, source_group string"


def test_a_load_replaces_or_keeps_history(spark, url):
    load = lambda marts, events, **k: warehouse.load(spark, url, {"mart": warehouse.Load(spark.createDataFrame(marts, MART), ["date", "product_id"], "replace", "avg_price"), "event": warehouse.Load(spark.createDataFrame(events, "event_id string, score double"), ["event_id"], "history")}, text_type="VARCHAR(300)", **k)
    rows = lambda t: sorted(map(tuple, warehouse.read(spark, url, t).collect()))
    assert load([("d1", "a", 1.0, "USD", "simulation"), ("d1", "b", None, None, "simulation")], [("e1", 1.0), ("e2", 2.0)]) == {"mart": 2, "event": 2}
    assert load([("d2", "a", 3.0, "USD", "simulation")], [("e2", 9.0), ("e3", 3.0)]) == {"mart": 1, "event": 2}
    assert rows("mart") == [("d2", "a", 3.0, "USD", "simulation")] and rows("event") == [("e1", 1.0), ("e2", 9.0), ("e3", 3.0)]
    before = rows("mart"), rows("event")
    for bad, why in (
        ([("d3", "a", 1.0, "USD", "simulation")] * 2, "repeat"),
        ([("d3", None, 1.0, "USD", "simulation")], "null"),
        ([("d3", "a", 1.0, "USD", "simulation"), ("d3", "b", 1.0, "EUR", "simulation")], "currencies"),
        ([("d3", "a", 1.0, "USD", "simulation"), ("d3", "b", 1.0, "USD", "marketplace")], "source groups"),
    ):
        with pytest.raises(warehouse.Refused, match=why):
            load(bad, [("e9", 1.0)])
    # a table that isn't loaded holds other rows
    warehouse.load(spark, url, {"products": warehouse.Load(spark.createDataFrame([("a", 5.0, "EUR", "marketplace")], "product_id string, price double, currency string, source_group string"), ["product_id"], "history", "price")}, text_type="VARCHAR(300)")
    with pytest.raises(warehouse.Refused, match="another source group"):
        load([("d3", "a", 1.0, "EUR", "simulation")], [("e9", 1.0)], others={"products": "price"})
    with pytest.raises(warehouse.Refused, match="currencies"):
        load([("d3", "a", 1.0, "USD", "marketplace")], [("e9", 1.0)], others={"products": "price"})
    assert (rows("mart"), rows("event")) == before
    # an empty snapshot empties what is replaced and leaves history
    load([], [])
    assert rows("mart") == [] and rows("event") == before[1]


def test_a_failed_load_changes_nothing(spark, url):
    one = lambda rows, schema="k string, v int": {"t": warehouse.Load(spark.createDataFrame(rows, schema), ["k"])}
    warehouse.load(spark, url, one([("a", 1)]), text_type="VARCHAR(300)")
    both = one([("b", 2)]) | {"u": warehouse.Load(spark.createDataFrame([("x", 1)], "k string, w int"), ["k"])}
    warehouse.load(spark, url, {"u": both["u"]}, text_type="VARCHAR(300)")
    with pytest.raises(Exception):  # the second table has no such column: the first one's new rows go back
        warehouse.load(spark, url, both | {"u": warehouse.Load(spark.createDataFrame([("x", 1)], "k string, other int"), ["k"])}, text_type="VARCHAR(300)")
    assert [tuple(r) for r in warehouse.read(spark, url, "t").collect()] == [("a", 1)]
    left = warehouse.read(spark, url, "SYS.SYSTABLES").where("TABLETYPE = 'T'").select("TABLENAME").collect()
    assert not [r[0] for r in left if "_" in r[0]]


def test_replay_reconcile_promote_rollback(spark, tmp_path):
    root = str(tmp_path / "g")
    sales = spark.createDataFrame([("a", 1), ("a", 2), ("b", 5)], "k string, v int")
    build = lambda by: lambda x: {"sums": x["sales"].groupBy("k").agg((F.sum("v") * by).alias("s")), "rows": x["sales"]}
    plan = generations.plan({"sales": sales}, {"by": 1})
    keys = {"sums": ["k"], "rows": ["k", "v"]}
    for name in ("one", "two"):
        generations.replay(spark, root, name, plan, {"sales": sales.repartition(3)}, build(1))
    assert generations.reconcile(spark, root, "one", "two", keys) == {"rows": {}, "sums": {}}
    assert generations.current(spark, root) is None
    generations.promote(spark, root, "one", "two", expected=None)
    assert {tuple(r) for r in generations.read(spark, root, "sums").collect()} == {("a", 3), ("b", 5)}
    # other inputs than planned
    with pytest.raises(generations.Refused, match="planned"):
        generations.replay(spark, root, "x", plan, {"sales": sales.union(sales)}, build(1))
    # a replay that differs
    new = generations.plan({"sales": sales}, {"by": 2})
    generations.replay(spark, root, "three", new, {"sales": sales}, build(2))
    generations.replay(spark, root, "four", new, {"sales": sales}, build(3))
    with pytest.raises(generations.Refused, match="sums"):
        generations.promote(spark, root, "three", "four", expected="one")
    with pytest.raises(generations.Refused, match="same plan"):
        generations.promote(spark, root, "three", "one", expected="one")
    assert generations.reconcile(spark, root, "one", "three", keys) == {"rows": {}, "sums": {"changed": 2}} and generations.current(spark, root) == "one"
    generations.replay(spark, root, "five", new, {"sales": sales}, build(2))
    with pytest.raises(published.Conflict):
        generations.promote(spark, root, "five", "three", expected=None)
    generations.promote(spark, root, "five", "three", expected="one")
    assert generations.rollback(spark, root) == "one" and {tuple(r) for r in generations.read(spark, root, "sums").collect()} == {("a", 3), ("b", 5)}
    with pytest.raises(generations.Refused, match="before"):
        generations.rollback(spark, root)
    # a failed build isn't whole
    with pytest.raises(Exception):
        generations.replay(spark, root, "six", new, {"sales": sales}, lambda x: {"sums": x["sales"].select(F.raise_error(F.lit("no")).alias("x"))})
    with pytest.raises(KeyError):
        generations.promote(spark, root, "six", "three", expected="one")


def test_nested_schemas_name_the_place(spark):
    schema = {
        "required": ["id", "payload"],
        "properties": {
            "id": {"type": "string", "minLength": 2},
            "payload": {"type": "object", "required": ["price"], "properties": {"price": {"type": "number", "minimum": 0}, "unit": {"enum": ["USD", "EUR"]}}},
            "items": {"type": "array", "minItems": 1, "items": {"type": "object", "required": ["n"], "properties": {"n": {"type": "integer"}, "tags": {"type": "array", "items": {"type": "string", "minLength": 1}}}}},
            "gone": {"type": "string"},
        },
    }
    df = spark.createDataFrame(
        [
            (1, "ok", ("1.5", "USD"), [("1", ["a"]), ("2", None)]),
            (2, "x", ("-1", "GBP"), [("x", ["", "b", None]), (None, []), None]),
            (3, None, None, []),
            (4, "ok", (None, None), None),
        ],
        "k int, id string, payload struct<price:string,unit:string>, items array<struct<n:string,tags:array<string>>>",
    )
    whole = F.struct("id", "payload", "items")
    got = {r.k: r.faults for r in df.select("k", rules.schema_faults(schema, whole, df.select(whole.alias("x")).schema["x"].dataType).alias("faults")).collect()}
    assert got[1] == [] and got[4] == ["required(payload.price)"]
    assert got[2] == ["length(id)", "limits(payload.price)", "enum(payload.unit)", "type(items[0].n)", "length(items[0].tags[0])", "type(items[0].tags[2])", "required(items[1].n)", "type(items[2])"]
    assert got[3] == ["required(id)", "required(payload)", "length(items)"]


@pytest.mark.parametrize("n, share", [(1000, 0.01), (37, 0.1), (4, 1.0), (250, 0.0), (0, 0.5)])
def test_simulations_have_exact_shares(spark, tmp_path, n, share):
    base = spark.createDataFrame([(f"r{i}", "4", f"2026-01-0{i + 1}") for i in range(7)], "review_id string, rating string, review_date string")
    out = files.simulated(base, n, "review_id", "big", ["review_id"], str(tmp_path / "s"), share)
    assert out.count() == n + (2 if n >= 5 else 0) and out.select("review_id").distinct().count() == n
    assert out.distinct().where("rating = '99.0'").count() == int(n * share)
    if n > 100 and share:
        bad = sorted(int(r.review_id[-7:]) for r in out.distinct().where("rating = '99.0'").collect())
        assert {b - a for a, b in zip(bad, bad[1:])} == {int(1 / share)}


def test_detectors_find_what_was_planted(spark):
    prices = files.make_prices(spark, 40)
    planted = {r.product_id for r in prices.where("glitch").collect()}
    found = {r.product_id for r in anomaly.price_zscores(prices.drop("glitch")).collect()}
    assert found == planted and len(planted) == 6
    reviews = files.make_bursts(spark, 20)
    at = F.date_trunc("hour", F.col("review_date").cast("timestamp"))
    want = {(r.product_id, r.at) for r in reviews.where("burst").select("product_id", at.alias("at")).distinct().collect()}
    got = anomaly.review_bursts(reviews.withColumn("rating", F.col("rating").cast("double")).withColumn("review_date", F.col("review_date").cast("timestamp")))
    assert {(r.product_id, r.bucket_start) for r in got.collect()} == want and {r.anomaly_type for r in got.collect()} == {"REVIEW_BOMBING"} and len(want) == 4
    assert files.stream_events(reviews.drop("burst")).where("get_json_object(value, '$.payload.review_id') IS NULL").isEmpty()


def test_marts_of_other_rows_than_the_report_s_are_refused(spark, tmp_path):
    mart = spark.createDataFrame([("a", 1, "r")], "k string, review_count int, run_id string")
    report = {"dataset": "reviews", "run_id": "r", "total": 3, "valid": 3, "invalid": 0, "missing": 0, "duplicates": 0, "dq_score": 100.0, "missing_ratio": 0.0, "duplicate_ratio": 0.0}
    publish = lambda rows, reports=(report,), **k: published.publish_marts({"m": mart}, {"m": ["k"]}, str(tmp_path / "m"), "r", list(reports), {"reviews": spark.range(rows)}, **k)
    for call, why in ((lambda: publish(4), "4 rows consumed, 3 measured"), (lambda: publish(0), "empty"), (lambda: publish(3, source_runs={"reviews": "older"}), "0 reports of run older")):
        with pytest.raises(ValueError, match=why):
            call()
    assert not (tmp_path / "m").exists()
    assert publish(3) == {"m": 0}


def test_articles_pass_a_gate_and_leave_a_manifest(spark, tmp_path):
    import hashlib

    at = str(tmp_path / "a")
    schema = "article_id string, source_name string, source_url string, title string, body string, content_sha256 string, collected_at string, published_at string"
    row = lambda i, ok=True: (f"a{i}", "x.org", f"https://x.org/{i}", "t", f"b{i}", hashlib.sha256(f"b{i}".encode()).hexdigest() if ok else "no", "2026-01-01T00:00:00Z", "2025-12-01T00:00:00Z")
    df = lambda rows: spark.createDataFrame(rows, schema)
    manifest = published.publish_articles(df([row(i) for i in range(10)] + [row(10, False)]), at, "run-1")
    assert manifest["status"] == "complete" and manifest["quality"]["valid"] == 10 and published.read_articles(spark, at).count() == 10
    for rows in ([row(1), row(2, False)], [row(3, False)]):
        with pytest.raises(ValueError, match="in use stays"):
            published.publish_articles(df(rows), at, "run-2")
    assert published.read_articles(spark, at).count() == 10 and len(list((tmp_path / "a" / "_attempts").iterdir())) == 2
    with pytest.raises(ValueError, match="already"):
        published.publish_articles(df([row(1)]), at, "run-1")
    published.publish_articles(df([row(1), row(2)]), at, "run-3")
    assert published.read_articles(spark, at).count() == 2 and published.read_articles(spark, at, "article_daily_stats").first().article_count == 2
    assert [m["run_id"] for m in published.article_runs(spark, at)] == ["run-1", "run-3"]
