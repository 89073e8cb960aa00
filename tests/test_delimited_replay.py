"""Delimited text of several encodings and separators, JSON streams, paced replays."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators import ranks
from tidemark.sources import delimited, files
from tidemark.streaming import replay
from tidemark.streaming import reviews as streams


def test_malformed_text_is_an_error_and_no_other_encoding_is_tried(spark, tmp_path):
    (tmp_path / "broken.csv").write_text("product_id,name\n1,one\n2,two,extra\n")
    with pytest.raises(delimited.Malformed, match="3 fields"):
        files.load(spark, str(tmp_path / "broken.csv"))
    (tmp_path / "quoted.csv").write_text('product_id,name\n1,"a\nb"\n2,"c,d",extra\n')
    with pytest.raises(Exception):
        files.load(spark, str(tmp_path / "quoted.csv"), sep=",").collect()
    (tmp_path / "short.csv").write_text("product_id,name\n1,one\n2\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        files.load(spark, str(tmp_path / "short.csv"), sep=",").collect()


def test_a_stated_encoding_is_never_replaced(spark, tmp_path):
    (tmp_path / "latin.csv").write_bytes("product_id,name\n001,café\n".encode("cp1252"))
    at = str(tmp_path / "latin.csv")
    with pytest.raises(delimited.Undecodable):
        files.load(spark, at, encoding="utf-8", sep=",")
    for encoding in ("cp1252", "latin1", None):
        assert [tuple(r) for r in files.load(spark, at, encoding=encoding).collect()] == [("001", "café")]
    (tmp_path / "odd.csv").write_bytes(b"product_id,name\n1,\x81\xe9\n")
    assert files.load(spark, str(tmp_path / "odd.csv")).first()["name"] == "\x81é"
    with pytest.raises(delimited.Undecodable):
        files.load(spark, str(tmp_path / "odd.csv"), encoding="cp1252")


def test_identities_and_missing_values(spark, tmp_path):
    (tmp_path / "s.csv").write_text("review_id,product_id,rating,review_title\n0001,0007,5,Good\n0002,0008,4,\n")
    assert [tuple(r) for r in files.load(spark, str(tmp_path / "s.csv"), sep=",").collect()] == [("0001", "0007", "5", "Good"), ("0002", "0008", "4", None)]


def test_a_mixed_folder(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    write = lambda name, text, code="utf-8": (tmp_path / "in" / name).write_bytes(text.encode(code))
    write("a.csv", "﻿product_id,name\n1,é\n2,\"x, \"\"y\"\"\nz\"\n")
    write("b.csv", "product_id;name\n3;€ 5,00\n4;à, b\n", "cp1252")
    write("deep/c.tsv", "product_id\tname\tbrand\n5\tone;two\tb\n")
    write("d.txt", "product_id|name\n6|x\n\n7|y\n")
    write("e.csv", "")
    write("f.csv", "product_id\n8\n")
    write("ignored.json", "{}")
    got = delimited.read(spark, str(tmp_path / "in"), source="file")
    assert sorted((r.product_id, r.name, r.brand) for r in got.collect()) == [("1", "é", None), ("2", 'x, "y"\nz', None), ("3", "€ 5,00", None), ("4", "à, b", None), ("5", "one;two", "b"), ("6", "x", None), ("7", "y", None), ("8", None, None)]
    assert {r.product_id: r.file.rsplit("/", 1)[1] for r in got.collect()}["5"] == "c.tsv"
    with pytest.raises(FileNotFoundError):
        (tmp_path / "none").mkdir()
        delimited.read(spark, str(tmp_path / "none"))


EVENT = {"review_id": "r1", "product_id": "p1", "rating": "4", "review_text": "t", "review_date": "2026-01-01T00:00:10Z", "source_group": "simulation", "acquisition_method": "generated"}


def test_json_documents_as_a_stream_equal_the_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    events = [EVENT | {"review_id": f"r{i}", "rating": None if i == 3 else str(1 + i % 5)} for i in range(12)]
    (tmp_path / "in" / "a.json").write_text(json.dumps(events[:5], indent=2))
    (tmp_path / "in" / "b.json").write_text(json.dumps({"event_type": "NEW_REVIEW", "payload": events[5]}, indent=2))
    (tmp_path / "in" / "c.json").write_text(json.dumps(events[6:], indent=2))
    good, bad = streams.split(streams.parsed(streams.from_json_files(spark, str(tmp_path / "in"), per_trigger=1)))
    for name, df in (("good", good.select("review_id", "rating", "event_time")), ("bad", bad.select("reason"))):
        df.writeStream.option("checkpointLocation", str(tmp_path / f"check-{name}")).trigger(availableNow=True).format("parquet").start(str(tmp_path / name)).awaitTermination()
    raw = spark.createDataFrame([(json.dumps(e),) for e in [*events[:5], {"event_type": "NEW_REVIEW", "payload": events[5]}, *events[6:]]], "value string")
    one, two = streams.split(streams.parsed(raw))
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(spark.read.parquet(str(tmp_path / "good"))) == rows(one.select("review_id", "rating", "event_time"))
    assert rows(spark.read.parquet(str(tmp_path / "bad"))) == rows(two.select("reason")) and two.count() == 1


def test_numbers_follow_the_order(spark, tmp_path):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1009).alias("k")).repartition(7)
    got = {r.k: r.position for r in ranks.numbered(df, str(tmp_path / "n"), "k").collect()}
    assert got == {k: i for i, k in enumerate(sorted(got))} and len(got) == 1000


def test_a_paced_replay(spark, tmp_path):
    df = spark.range(25).select(F.format_string("r%02d", "id").alias("review_id"), F.when(F.col("id") % 2 == 0, F.lit("2020-01-01T00:00:00Z")).alias("review_date"))
    at, out = str(tmp_path / "s"), str(tmp_path / "out")
    assert replay.store(df, at, "review_id") == 25
    sink = lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/batch={n}")
    sent = replay.replay(spark, at, sink, str(tmp_path / "check"), per_trigger=10, every="0 seconds", clocks=("review_date", "none"), limit=20)
    assert sent.emitted == 20
    rows = spark.read.parquet(out).orderBy("position").collect()
    assert [r.review_id for r in rows] == [f"r{i:02d}" for i in range(20)] and [r.batch for r in rows] == [i // 10 for i in range(20)]
    assert all((r.review_date is None) == (r.position % 2 == 1) for r in rows) and all(r.review_date is None or r.review_date > "2026" for r in rows)
    # started again it goes on behind the batches that were committed
    more = replay.replay(spark, at, sink, str(tmp_path / "check"), per_trigger=10, every="0 seconds")
    assert spark.read.parquet(out).select("review_id").distinct().count() == 25 and more.emitted in (5, 15)
