from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import rules as R
from tidemark.operators import cleaning


def test_contract_tells_orphans_only_with_parents(spark):
    prices = spark.createDataFrame([("a", 5.0), ("z", -1.0), (None, 5.0)], "product_id string, price double")
    parents = spark.createDataFrame([("a",), ("a",), (" ",)], "product_id string")
    rules = [R.not_null("product_id"), R.positive("price")]
    show = lambda df: [r.faults for r in df.orderBy(F.col("product_id").asc_nulls_last()).collect()]
    assert show(cleaning.contract(prices, rules, parents)) == [[], ["positive(price)", "ORPHAN"], ["not_null(product_id)"]]
    assert show(cleaning.contract(prices, rules, parents.where("product_id = ' '"))) == [[], ["positive(price)"], ["not_null(product_id)"]]


def test_products_and_prices(spark):
    df = spark.createDataFrame([("p1", " Lamp ", "mi", "phone", "$5", "usd"), ("p2", " ", "x", "y", "5", "usd"), ("p3", "Bed", None, None, "free", "?")], "product_id string, product_name string, brand string, category string, price string, currency string")
    assert [tuple(r) for r in cleaning.clean_products(df).collect()] == [("p1", "Lamp", "Xiaomi", "Smartphone", 5.0, "USD"), ("p3", "Bed", "Unknown", "Other", None, None)]
    good, bad = cleaning.split_prices(df.select("product_id", "price"))
    assert [r.product_id for r in good.collect()] == ["p1", "p2"] and [(r.product_id, r.reason, r.price_raw) for r in bad.collect()] == [("p3", "INVALID_PRICE", "free")]


def test_topics():
    assert cleaning.schema_of_topic("raw.REVIEWS.v1") == "review" and cleaning.schema_of_topic("other") is None
