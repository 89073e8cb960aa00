"""Keyed tables, appends, and the fates of a stream's events, against loops."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import quality
from tidemark.sources import keyed, published
from tidemark.streaming import arrival
from tidemark.streaming import reviews as streams


def loop(events: list[tuple], delay: int, remember: int) -> list[tuple]:
    """(stream_key, position, fate) by going through the events in their order of arrival."""
    newest: dict = {}
    last: dict = {}
    seen: dict = {}
    out = []
    for key, position, ident, t, kind in events:
        top = newest.get(key)
        if position <= last.get(key, -1):
            out.append((key, position, "repeated"))
            continue
        last[key] = position
        if kind is not None and kind.upper() not in streams.KINDS:
            out.append((key, position, "ignored"))
            continue
        if ident is not None and (key, ident) in seen:
            t0 = seen[key, ident]
            if t0 is None or top is None or t0 >= top - delay - remember:
                out.append((key, position, "duplicate"))
                continue
        fate = "accepted"
        if t is not None and top is not None and t < top:
            if t < top - delay:
                out.append((key, position, "late_dropped"))
                continue
            fate = "late_accepted"
        if ident is not None:
            seen[key, ident] = t
        if t is not None:
            newest[key] = t if top is None else max(top, t)
        out.append((key, position, fate))
    return out


SCHEMA = "stream_key string, position long, event_key string, t long, event_type string"


def made(n: int) -> list[tuple]:
    rng = random.Random(2)
    out = []
    for i in range(n):
        key = rng.choice(["a", "a", "b", None])
        t = None if rng.random() < 0.05 else 1000 + i * 10 + rng.randint(-400, 50)
        out.append((key, i, rng.choice([None, f"e{(i - rng.randint(0, 12)) // 2}"]), t, rng.choice(["EVENT", None, "new_review", "CLICK"])))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("event_time", F.timestamp_seconds("t")).drop("t")


def fates(spark, path):
    return sorted(((r.stream_key, r.position, r.fate) for r in arrival.read(spark, path).collect()), key=repr)


def test_fates_after_restarts_repeated_events_and_a_repeated_batch(spark, tmp_path):
    events = made(240)
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    # the second and third parts begin with events that were sent before
    parts = [events[:90], events[70:160], events[150:]]
    for part in parts:
        frame(spark, part).coalesce(2).write.mode("append").parquet(source)
        q = arrival.start(spark.readStream.schema(frame(spark, []).schema).parquet(source), out, check, delay=200, remember=100)
        q.awaitTermination()
        assert q.exception() is None
    want = sorted(loop([e for part in parts for e in part], 200, 100), key=repr)
    assert fates(spark, out) == want
    assert {f for _, _, f in want} == set(arrival.FATES)
    # the last batch was written but not committed: it comes again and changes nothing
    last = max(int(n) for n in os.listdir(f"{check}/commits") if n.isdigit())
    for name in (str(last), f".{last}.crc"):
        if os.path.exists(f"{check}/commits/{name}"):
            os.remove(f"{check}/commits/{name}")
    arrival.start(spark.readStream.schema(frame(spark, []).schema).parquet(source), out, check, delay=200, remember=100).awaitTermination()
    assert fates(spark, out) == want
    by_key = {r.stream_key: r for r in arrival.counts(arrival.read(spark, out)).collect()}
    for key in ("a", "b", None):
        assert [by_key[key][f] for f in arrival.FATES] == [sum(w[0] == key and w[2] == f for w in want) for f in arrival.FATES]


def test_a_stream_of_another_configuration_is_an_error(spark, tmp_path):
    frame(spark, made(10)).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame(spark, []).schema).parquet(str(tmp_path / "in"))
    arrival.start(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    (tmp_path / "check" / "metadata").write_text("{broken")
    with pytest.raises(Exception):
        arrival.start(stream, str(tmp_path / "out2"), str(tmp_path / "check")).awaitTermination()
    assert (tmp_path / "check" / "metadata").read_text() == "{broken"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_a_key_stays_once_over_batches(spark, tmp_path):
    at = str(tmp_path / "t")
    df = lambda xs: spark.createDataFrame(xs, "k string, at int, v string")
    rng = random.Random(3)
    want: dict = {}
    for n in range(6):
        batch = [(f"k{rng.randint(0, 40)}", rng.randint(0, 9), f"v{n}") for _ in range(30)] + [(None, n, "null")]
        for k, t, v in sorted(batch, key=lambda r: (r[1], r[2])):
            if k not in want or (t, ) >= (want[k][0],):
                want[k] = (t, v)
        version = keyed.merge(df(batch), at, ["k"], "at", batch_id=n)
        assert version == n
        assert keyed.merge(df([("k1", 99, "again")]), at, ["k"], "at", batch_id=n) == n  # its number was there
    got = rows(keyed.read(spark, at))
    assert [(k, t) for k, t, _ in got] == sorted(((k, t) for k, (t, _) in want.items()), key=repr)
    assert keyed.merge(df([]), at, ["k"], "at", batch_id=9) == 5
    with pytest.raises(ValueError, match="schema"):
        keyed.merge(spark.range(2), at, ["id"])


def test_only_touched_buckets_are_written(spark, tmp_path):
    at = str(tmp_path / "t")
    keyed.merge(spark.range(500).withColumn("v", F.lit(1)), at, ["id"])
    before = published.history(spark, at)[-1]["buckets"]
    keyed.merge(spark.range(1).withColumn("v", F.lit(2)), at, ["id"])
    after = published.history(spark, at)[-1]["buckets"]
    assert len(before) == keyed.BUCKETS and sum(before[b] != after[b] for b in before) == 1
    assert keyed.read(spark, at).agg(F.sum("v"), F.count("*")).first()[:] == (501, 500)
    assert published.read(spark, at, 0).agg(F.sum("v")).first()[0] == 500
    published.vacuum(spark, at, keep=1)
    assert keyed.read(spark, at).count() == 500
    with pytest.raises(KeyError, match="cleaned"):
        published.read(spark, at, 0)


def test_a_merge_writes_its_own_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keyed, "SMALL", 0)
    monkeypatch.setattr(keyed, "RUNS", 4)
    at, bucket = str(tmp_path / "t"), F.concat(F.lit("b"), F.col("k") % 2)
    df = lambda n: spark.range(10).select((F.col("id") + 5 * n).alias("k"), ((F.col("id") * 7 + n) % 4).alias("at"), F.lit(n).alias("v"))
    want: dict = {}
    for n in range(6):
        for k, t, v in df(n).collect():
            if k not in want or t >= want[k][0]:
                want[k] = (t, v)
        keyed.merge(df(n), at, ["k"], "at", bucket=bucket, batch_id=n)
        assert rows(keyed.read(spark, at)) == sorted(((k, *x) for k, x in want.items()), key=repr)
        commit = published.history(spark, at, 1)[0]
        if n < 4:  # a run each, and nothing of the older ones again
            assert len(published.folders(commit)) == 2 * (n + 1) and spark.read.option("recursiveFileLookup", "true").parquet(f"{at}/data").count() == 10 * (n + 1)
        elif n == 4:
            assert len(published.folders(commit)) == 2
    assert published.read(spark, at, 1).count() == 15
    keyed.merge(df(0).where("k = 0").withColumns({"at": F.lit(-1).cast("long"), "v": F.lit(9)}), at, ["k"], bucket=bucket)  # by another rule: the incoming row always
    assert rows(keyed.read(spark, at)) == sorted(((k, *x) for k, x in (want | {0: (-1, 9)}).items()), key=repr)
    assert published.vacuum(spark, at, keep=1) > 0 and keyed.read(spark, at).count() == len(want)


def test_two_writers(spark, tmp_path, monkeypatch):
    at = str(tmp_path / "t")
    keyed.merge(spark.range(3), at, ["id"])
    old = published.history(spark, at, 1)
    keyed.merge(spark.range(5), at, ["id"])
    monkeypatch.setattr(published, "history", lambda *a, **k: old)
    with pytest.raises(published.Conflict):
        keyed.merge(spark.range(9), at, ["id"])
    monkeypatch.undo()
    assert keyed.read(spark, at).count() == 5
    assert len(os.listdir(f"{at}/data")) == 2  # nothing of the failed merge stays


def test_quarantine_keeps_versions_of_an_event_but_no_copies(spark, tmp_path):
    at = str(tmp_path / "q")
    sink = streams.quarantine_sink(at)
    df = lambda xs: spark.createDataFrame(xs, "payload_sha256 string, reason string, quarantined_at timestamp").withColumn("quarantined_at", F.col("quarantined_at"))
    import datetime as d

    day = lambda n: d.datetime(2026, 1, n)
    sink(df([("aa1", "X", day(1)), ("aa2", "X", day(1))]), 0)
    sink(df([("aa1", "X", day(3)), ("bb1", "Y", day(2)), ("bb1", "Y", day(1))]), 1)
    sink(df([("aa1", "X", day(9))]), 1)
    got = [(r.payload_sha256, r.quarantined_at.day) for r in streams.read_quarantine(spark, at).orderBy("payload_sha256").collect()]
    assert got == [("aa1", 3), ("aa2", 1), ("bb1", 2)]


def test_windows_are_rewritten_by_bucket(spark, tmp_path):
    at = str(tmp_path / "w")
    sink = streams.window_sink(at)
    df = lambda xs: spark.createDataFrame(xs, "window_start string, product_id string, source_group string, review_count int").withColumn("window_start", F.col("window_start").cast("timestamp"))
    sink(df([("2026-01-01 00:00:00", f"p{i}", "s", 1) for i in range(60)] + [("2026-01-02 00:00:00", "p1", "s", 1)]), 0)
    first = published.history(spark, at)[-1]["buckets"]
    sink(df([("2026-01-01 00:00:00", "p1", "s", 5)]), 1)
    sink(df([("2026-01-01 00:00:00", "p1", "s", 7)]), 1)
    second = published.history(spark, at)[-1]["buckets"]
    assert sum(first[b] != second[b] for b in first) == 1 and any(b.startswith("2026-01-02-") for b in first)
    assert streams.read_windows(spark, at).agg(F.sum("review_count"), F.count("*")).first()[:] == (65, 61)
    with pytest.raises(ValueError, match="mixed"):
        sink(df([("2026-01-01 00:00:00", "p1", g, 1) for g in ("s", "t")]), 2)


def test_an_append_writes_its_rows_only(spark, tmp_path):
    at = str(tmp_path / "t")
    for n in range(4):
        assert published.publish(spark.range(n * 10, n * 10 + 10).withColumn("part", F.col("id") % 2), at, "append", operation_id=f"o{n}", partition_by=["part"]) == n
    commits = published.history(spark, at)
    assert [len(published.folders(c)) for c in commits] == [1, 2, 3, 4] and len(os.listdir(f"{at}/data")) == 4
    assert [published.read(spark, at, n).count() for n in range(4)] == [10, 20, 30, 40]
    assert published.publish(spark.range(10, 20).withColumn("part", F.col("id") % 2), at, "append", operation_id="o1", partition_by=["part"]) == 1
    assert len(os.listdir(f"{at}/data")) == 4
    assert published.compact(spark, at) == 4 and published.compact(spark, at) == 4
    assert len(published.folders(published.history(spark, at)[-1])) == 1 and published.read(spark, at).count() == 40
    assert published.read(spark, at, 2).count() == 30
    assert published.vacuum(spark, at, keep=1) == 4 and published.read(spark, at).count() == 40


def test_reports_by_batch(spark, tmp_path):
    at = str(tmp_path / "r")
    df = lambda xs: spark.createDataFrame(xs, "batch_id string, dataset string, dq_score double, measured_at int")
    quality.save_reports(df([("b1", "reviews", 90.0, 1), ("b1", "prices", 80.0, 1)]), at)
    quality.save_reports(df([("b1", "reviews", 95.0, 2), ("b2", "reviews", 70.0, 2)]), at)
    assert rows(quality.saved_reports(spark, at)) == [("b1", "prices", 80.0, 1), ("b1", "reviews", 95.0, 2), ("b2", "reviews", 70.0, 2)]
