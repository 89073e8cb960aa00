from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions import rules as R
from tidemark.functions import values as V


def one(spark, values, expression, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[1] for r in sorted(rows.select("i", expression(F.col("v"))).collect())]


@pytest.mark.parametrize(
    ("text", "value"),
    [
        ("19.990.000 VND", 19990000.0), ("$1,299.99", 1299.99), ("1.299,50 €", 1299.5), ("2.5e7", 25000000.0), ("25.555", 25555.0), ("1000000.000", 1000000.0), ("12,5", 12.5), ("1,234", 1234.0),
        (" - $5 ", -5.0), ("€ -7,25", -7.25), ("1e", None), ("12-34", None), ("1,2,3", None), ("1.234,567", None), ("1.234.567,8", 1234567.8), ("1,234.567", 1234.567), ("1.2,3.4", None), ("-$-5", None), ("$5 USD", None), ("5,", None), (".", None), ("1e-3 USD", None), ("++10", None), ("", None), (None, None), ("abc", None), ("1234đ", 1234.0), ("0", 0.0),
    ],
)
def test_amount(spark, text, value):
    assert one(spark, [text], V.amount) == [value]


def test_price_is_finite_and_positive(spark):
    assert one(spark, ["-5", "0", "7", None], V.price) == [None, None, 7.0, None]
    assert one(spark, [float("nan"), float("inf"), -1.0, 25.555], lambda c: V.price(c, True), "double") == [None, None, None, 25.555]


def test_instant(spark):
    got = one(spark, ["1700000000", "1700000000000", "2026-10-01T00:30:00+07:00", "2026/10/01", "01/10/2026 05:06:07", "01/10/2026", "soon", "", None, "99/99/2026", "NaN", "12:30"], lambda c: F.date_format(V.instant(c), "yyyy-MM-dd HH:mm:ss"))
    assert got == ["2023-11-14 22:13:20", "2023-11-14 22:13:20", "2026-09-30 17:30:00", "2026-10-01 00:00:00", "2026-10-01 05:06:07", "2026-10-01 00:00:00", None, None, None, None, None, None]


def test_rating(spark):
    assert one(spark, [" 4 ", "6", "0.5", "NaN", "true", "5", None, ""], V.rating) == [4.0, None, None, None, None, 5.0, None, None]


def test_names_and_currencies(spark):
    assert one(spark, [" Apple Inc. ", "acme corp", "", None, "mi"], V.brand) == ["Apple", "Acme Corp", "Unknown", "Unknown", "Xiaomi"]
    assert one(spark, ["phones", "Smartphones", " "], V.category) == ["Phones", "Smartphone", "Other"]
    assert one(spark, ["đ", "US$", "chf", "dollars", "", None], V.currency) == ["VND", "USD", "CHF", None, None, None]


def test_observed_currency(spark):
    rows = spark.createDataFrame([("USD", "$5"), ("EUR", "$5"), (None, "5 VND"), (None, "5")], "c string, p string")
    assert [r[0] for r in rows.select(V.observed_currency(F.col("c"), F.col("p"))).collect()] == ["USD", None, "VND", None]


def test_pseudonymous_user(spark):
    a, b, c, d, e = one(spark, ["u1", " u1 ", "none", None, "anon_0123456789abcdef"], lambda x: V.pseudonymous_user(x, "s"))
    assert a == b and len(a) == 21 and c == d == "anon_redacted" and e == "anon_0123456789abcdef"


def test_half_up(spark):
    assert one(spark, [1.005, 4.125, 2.675, -1.005, None], V.half_up, "double") == [1.01, 4.13, 2.68, -1.01, None]


def test_folded_and_formula(spark):
    assert one(spark, ["ĐƯỜNG Ấm", "=1+1", " @x"], V.folded) == ["duong am", "=1+1", " @x"]
    assert one(spark, ["a=1", "=1+1", " @x", None], V.formula_safe) == ["a=1", "'=1+1", "' @x", None]


def test_record_digest_ignores_field_order(spark):
    at = dt.datetime(2026, 1, 1, tzinfo=dt.UTC)
    x = spark.createDataFrame([(1, "a", at)], "n int, s string, t timestamp")
    assert x.select(V.record_digest("n", "s", "t")).first()[0] == x.select(V.record_digest("t", "s", "n")).first()[0]


def test_rules(spark):
    df = spark.createDataFrame([("a", 5.0), (" ", 0.0), (None, float("nan")), ("b", None)], "s string, x double")
    got = df.select(R.failed([R.not_null("s"), R.positive("x"), R.in_range("x", 0, 5), R.custom("short", F.length("s") < 2)]).alias("f")).collect()
    assert [r.f for r in got] == [[], ["not_null(s)", "positive(x)"], ["not_null(s)", "positive(x)", "in_range(x)", "short"], ["positive(x)", "in_range(x)"]]


def test_schema_rules(spark):
    schema = {"required": ["id"], "properties": {"id": {"type": "string", "minLength": 1}, "price": {"type": "number", "minimum": 0}, "unit": {"enum": ["VND", "USD"]}, "kind": {"const": "x"}}}
    df = spark.createDataFrame([("1", "5", "USD", "x"), ("", "-1", "EUR", "y"), (None, "abc", None, None)], "id string, price string, unit string, kind string")
    got = [r.f for r in df.select(R.failed(R.schema_rules(schema)).alias("f")).collect()]
    assert got == [[], ["length(id)", "limits(price)", "enum(unit)", "enum(kind)"], ["required(id)", "type(price)", "limits(price)"]]


def test_number_reads_what_a_cast_reads(spark):
    """The shape that is asked for before the cast leaves out no text that a cast reads."""
    texts = ["1", " 2", "3\t", "\n4", "-5.", "+.5", "6e3", "7E-2", "8d", "9.5F", "0x1p3", "-0X1.8P1", "NaN", "nan", "-Infinity", "inf", "+INF", "", " ", "1-2", "1,5", "1e", "e1", "..", "1 2", "2026-10-01", "12:30", "x", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(F.col("t").try_cast("double").cast("string").alias("want"), V.number(F.col("t")).cast("string").alias("got"))
    assert [r.got for r in df.collect()] == [r.want for r in df.collect()]
    assert one(spark, ["31/02/2026", "01/10/2026\n", "2026/10/01T05:06:07Z"], lambda c: F.date_format(V.instant(c), "yyyy-MM-dd HH:mm:ss")) == [None, None, "2026-10-01 05:06:07"]
