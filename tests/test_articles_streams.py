from __future__ import annotations

import hashlib
import json

from pyspark.sql import functions as F

from tidemark.operators import articles, serving
from tidemark.streaming import reviews as streams

PAGE = """<html><head><script type="application/ld+json">{"@graph": [{"@type": "Thing"}, {"@type": "Product", "name": "Lamp", "sku": "L1", "brand": {"name": "Acme"}, "offers": {"price": "12.50", "priceCurrency": "USD"}, "aggregateRating": {"ratingValue": "4.5", "reviewCount": "7"}}]}</script>
<script type="application/ld+json">{"@type": "Product", "review": [{"reviewRating": {"ratingValue": 5}, "reviewBody": "good", "author": {"name": "x"}, "datePublished": "2026-01-01"}, {"reviewBody": "none"}]}</script></head>
<body><nav>menu</nav><h1>A  title &amp; more</h1><article><p>One.</p><script>no()</script><p>Two <b>three</b></p></article><a href="https://x.org/a#b">l</a></body></html>"""


def test_pages(spark):
    df = spark.createDataFrame([(1, "HTTPS://Www.X.org/p/?q=1#f", PAGE), (2, "https://y.org", "<p>nothing</p>"), (3, "https://z.org", None)], "page_id int, url string, html string")
    got = {r.page_id: r for r in articles.parse_pages(df).collect()}
    assert got[1].title == "A title & more" and got[1].body == "One. Two three" and got[1].content_sha256 == hashlib.sha256(b"One. Two three").hexdigest()
    assert got[2].title is None and got[2].body is None and got[3].body is None
    assert [r.link for r in articles.links(df).collect()] == ["https://x.org/a"]
    p = articles.product_page(df).where("url LIKE 'HTTPS%'").first()
    assert (p.product_id, p.product_name, p.brand, p.price, p.currency, p.rating, p.review_count) == ("L1", "Lamp", "Acme", 12.5, "USD", 4.5, 7)
    r = articles.page_reviews(df).orderBy("review_text").collect()
    assert [(x.review_text, x.rating, x.author) for x in r] == [("good", 5.0, "x"), ("none", None, None)] and len({x.review_id for x in r}) == 2


def test_open_graph_fallback(spark):
    html = '<meta property="og:title" content="Chair"><meta property="product:price:amount" content="9,5"><meta property="product:price:currency" content="eur">'
    p = articles.product_page(spark.createDataFrame([("u", html)], "url string, html string")).first()
    assert (p.product_name, p.price, p.currency, p.rating) == ("Chair", 9.5, "EUR", None)


def test_article_clocks(spark):
    df = spark.createDataFrame([("2026-01-01T00:00:00+07:00",), ("2026-01-01",), ("2026-01-01 10:00:00",), ("soon",), (None,)], "t string")
    at, precision = articles.clock(F.col("t"))
    assert [r.p for r in df.select(precision.alias("p")).collect()] == ["instant", "date", "timezone_unknown", "unknown", "unknown"]
    assert df.where(at.isNotNull()).count() == 1


EVENT = {"review_id": "r1", "product_id": "p1", "rating": "4", "review_text": "t", "review_date": "2026-01-01T00:00:10Z", "source_group": "simulation", "acquisition_method": "generated"}


def raw(spark, *events):
    return spark.createDataFrame([(json.dumps(e),) for e in events], "value string")


def test_stream_reasons(spark):
    bad = [EVENT | x for x in ({"rating": "bad"}, {"review_date": "soon"}, {"review_id": ""}, {"product_id": None}, {"review_text": " "}, {"rating": "9"}, {"review_date": None}, {"acquisition_method": "live"})]
    good, quarantined = streams.split(streams.parsed(raw(spark, EVENT, *bad, {"source_group": "marketplace", "payload": EVENT | {"user_id": "me", "email": "x"}})))
    assert good.count() == 1
    assert sorted(r.reason for r in quarantined.collect()) == sorted([*streams.REASONS, "INVALID_SOURCE_METADATA"])
    nested = quarantined.where("payload IS NOT NULL").first()
    assert "email" not in nested.payload and "user_id" not in nested.payload and json.loads(streams.replayable(quarantined).first().value)["acquisition_method"] == "snapshot_replay"


def test_no_personal_field_reaches_the_quarantine(spark):
    deep = {"tags": [{"Email": "secret-a"}, [{"profile_url": "secret-b", "kept": 1}]], "customer": {"contact": {"ip_address": "secret-c", "username": "secret-d"}, "tier": "gold"}, "address": {"street": "secret-e"}}
    rows = raw(spark, {"avatar_url": "secret-f", "trace": deep, "payload": EVENT | deep | {"rating": "9", "user_id": "secret-g"}}, EVENT | deep | {"rating": "9"})
    more = spark.createDataFrame([("[1]",), ("no json",), ("[" * 5000,), ("",), (None,)], "value string")
    got = streams.split(streams.parsed(rows.union(more)))[1].collect()
    assert len(got) == 7 and not any("secret" in (r.envelope or "") + (r.payload or "") for r in got)
    nested = next(r for r in got if r.payload)
    inner = json.loads(nested.payload)
    assert inner["customer"] == {"contact": {}, "tier": "gold"} and inner["tags"] == [{}, [{"kept": 1}]] and json.loads(nested.envelope)["trace"]["customer"] == inner["customer"]
    assert sum(r.envelope is None for r in got) == 5


def test_stream_windows_equal_the_batch_and_restart(spark, tmp_path):
    (tmp_path / "in").mkdir()
    events = [EVENT | {"review_id": f"r{i}", "rating": str(1 + i % 5), "review_date": f"2026-01-01T00:0{i % 4}:0{i % 7}Z"} for i in range(40)]
    write = lambda name, xs: (tmp_path / "in" / name).write_text("\n".join(map(json.dumps, xs)) + "\n")
    write("a.jsonl", events[:25] + events[:5] + [EVENT | {"rating": "bad"}])
    for _ in range(2):
        queries = streams.start(streams.from_files(spark, str(tmp_path / "in"), 1), str(tmp_path / "out"), str(tmp_path / "check"), available_now=True)
        for q in queries:
            q.awaitTermination()
        write("b.jsonl", events[25:])
    got = streams.read_windows(spark, str(tmp_path / "out/windows"))
    want = streams.windowed_reviews(streams.split(streams.parsed(raw(spark, *events)))[0])
    key = lambda df: sorted((str(r.window_start), r.product_id, r.review_count, r.avg_rating, r.negative_count) for r in df.collect())
    assert key(got) == key(want)
    assert streams.read_quarantine(spark, str(tmp_path / "out/quarantine")).count() == 1


def test_lateness(spark):
    rows = [("k", i, kind, t) for i, (kind, t) in enumerate([("EVENT", 1000), ("EVENT", 2000), (None, 1500), ("OTHER", 9000), ("EVENT", 1300), ("EVENT", 2000)])]
    df = spark.createDataFrame(rows, "stream_key string, position int, event_type string, t long").withColumn("event_time", F.timestamp_seconds("t"))
    assert streams.lateness(df).first().asDict() == {"events": 6, "ignored": 1, "late_accepted": 1, "late_dropped": 1}


def test_value_windows_ignore_bad_clocks_and_values(spark):
    df = spark.createDataFrame([("1700000000", 5.0), ("1700000000000", float("nan")), ("1700000001", None), ("soon", 5.0), ("0", 1.0)], "t string, v double")
    from tidemark.functions.values import instant

    got = sorted((r.event_count, r.sample_size, r.mean_value) for r in streams.value_windows(df, 60, instant(F.col("t")), F.col("v")).collect())
    assert got == [(1, 1, 1.0), (3, 1, 5.0)]


def test_serving(spark):
    df = spark.createDataFrame([("a", "Điện Thoại", "marketplace", 4.0, 5.0), ("b", "=SUM(1)", None, None, 0.0)], "product_id string, product_name string, source_group string, rating double, price double")
    assert [r.product_id for r in serving.search(df, "dien", ["product_name"]).collect()] == ["a"]
    assert serving.search(df, " ", ["product_name"]).count() == 2
    assert [r.product_id for r in serving.in_scope(df, "unverified").collect()] == ["b"]
    assert [r.product_id for r in serving.find(df, "DIEN", min_rating=3, filters={"source_group": "MARKETPLACE"}).collect()] == ["a"]
    assert serving.csv_safe(df).where("product_id = 'b'").first().product_name == "'=SUM(1)"
    assert serving.page(df, 0, 1, F.col("product_id")).first().product_id == "a" and serving.page(df, 2, 1, F.col("product_id")).first().product_id == "b"
    assert serving.comparable(df).count() == 1
    lines = [r.line for r in serving.exposition(df.select("product_id", "price")).collect()]
    assert lines == ['tidemark_price{product_id="a"} 5.0', 'tidemark_price{product_id="b"} 0.0']
