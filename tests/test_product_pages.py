"""Facts of shop pages: the choice among structured data, fallbacks, and nothing invented."""

from __future__ import annotations

import json

import pytest

from tidemark.operators import product_pages

URL = "https://shop.example/phone-p123.html"


def script(*data: object, head: str = 'type="application/ld+json"') -> str:
    return "".join(f"<script {head}>{json.dumps(d, ensure_ascii=False)}</script>" for d in data)


@pytest.fixture(scope="module")
def facts(spark):
    def run(*pages: str | None, url: str = URL) -> list[dict]:
        df = spark.createDataFrame([(f"{url}?n={i}", p, i) for i, p in enumerate(pages)], "url string, html string, price int")
        out = {r["url"]: r.asDict() for r in product_pages.facts(df).collect()}
        return [out[f"{url}?n={i}"] for i in range(len(pages))]

    return run


def test_nothing_is_invented(facts):
    bare, number, empty, none = facts("<h1>Observed phone</h1>", "<h1>Phone 123456</h1>", "", None)
    assert bare["product_name"] == "Observed phone" and bare["evidence"] == "page" and bare["product_id"] == "123"
    for row in (bare, number):
        assert [row[k] for k in ("brand", "category", "price", "price_raw", "currency", "rating", "review_count", "seller", "image_url")] == [None] * 9
    assert empty["product_name"] is None and none["product_name"] is None and none["content_sha256"] is None


def test_prices_and_units(facts):
    product = lambda price: script({"@type": "Product", "name": "x", "offers": {"price": price}})
    negative, suffix, bare, dotted, text = facts(product(-100) + "<p>x Warranty value 200000 VND</p>", product("10.50 USD"), product(100), product(25.555), product("Call 123 for model 456"))
    assert negative["price"] is None and negative["price_raw"] == "-100"
    assert (suffix["price"], suffix["price_raw"], suffix["currency"]) == (10.5, "10.50 USD", "USD")
    assert (bare["price"], bare["currency"]) == (100.0, None)
    assert dotted["price"] == 25.555 and text["price"] is None and text["price_raw"] == "Call 123 for model 456"
    seen, small = facts("<h1>Observed phone</h1><div>250000 VND</div>", "<h1>Observed phone</h1><div>9.000 VND</div>")
    assert (seen["price"], seen["price_raw"], seen["currency"]) == (250000.0, "250000 VND", "VND")
    assert small["price"] is None and small["price_raw"] is None


def test_a_product_beats_candidates_and_the_first_wins(facts):
    nested = {"props": {"page": [{"title": "Offer", "price": 1}, {"data": {"displayName": "Lamp", "sale_price": "12.50", "sku": "L1", "brand": "Acme", "review_count": 3}}, {"name": "Other", "price": 5, "brand": "B"}]}}
    chosen, product, graph, listed = facts(
        script(nested, head='id="__NEXT_DATA__"'),
        script(nested, head='type="application/json"') + script({"@type": "Product", "name": "Chair"}),
        script({"@graph": [{"@type": "Thing", "name": "t", "price": 1, "sku": "s", "brand": "b"}, {"@type": ["Offer", "PRODUCT"], "name": "First", "offers": [{"price": "5", "priceCurrency": "eur"}]}, {"@type": "Product", "name": "Second"}]}),
        script([[{"a": {"b": {"c": {"name": "Deep", "finalPrice": 7, "masterid": 1}}}}]]),
    )
    assert (chosen["product_name"], chosen["price"], chosen["brand"], chosen["review_count"], chosen["evidence"]) == ("Lamp", 12.5, "Acme", 3, "candidate")
    assert (product["product_name"], product["price"], product["evidence"]) == ("Chair", None, "product")
    assert (graph["product_name"], graph["price"], graph["currency"]) == ("First", 5.0, "EUR")
    assert (listed["product_name"], listed["price"]) == ("Deep", 7.0)


def test_values_in_objects_and_lists(facts):
    (row,) = facts(script({"@type": "Product", "NAME": " Lamp ", "brand": [{"name": ""}, {"name": "Acme"}], "category": {"label": "Lamps"}, "seller": {"title": "Shop"}, "image": ["", "a.png"], "price": {"value": "1.234,50 €"}, "aggregateRating": {"ratingValue": "4.5", "ratingCount": "1,234"}}))
    assert [row[k] for k in ("product_name", "brand", "category", "seller", "image_url", "price", "currency", "rating", "review_count")] == ["Lamp", "Acme", "Lamps", "Shop", "a.png", 1234.5, "EUR", 4.5, 1234]


def test_microdata_and_meta(facts):
    meta, micro, og = facts(
        "<h1>Lamp</h1><meta content='19.90' property='product:price:amount'><meta property=\"product:price:currency\" content=\"USD\">",
        '<h1>Lamp</h1><span itemprop="brand">Acme &amp; Co</span><span class="p" itemprop="price">12.000 VND</span>',
        '<meta property="og:title" content="Chair"><h1>Other</h1><meta itemprop="price" content="7">',
    )
    assert (meta["price"], meta["currency"]) == (19.9, "USD")
    assert (micro["price"], micro["currency"], micro["brand"]) == (12000.0, "VND", "Acme & Co")
    assert (og["product_name"], og["price"], og["currency"]) == ("Chair", 7.0, None)


def test_breadcrumbs_of_the_own_host(facts):
    crumbs = lambda *items: script({"@type": "BreadcrumbList", "itemListElement": list(items)})
    plain, objects, foreign, stated = facts(
        crumbs({"name": "Home", "item": "https://shop.example/"}, {"name": "Observed phones", "item": "https://shop.example/phone/c123"}, {"name": "Observed phone", "item": URL}),
        crumbs({"item": {"@id": "/phone/c1", "name": "Phones"}}, {"item": {"url": "https://SHOP.example/x/c22/?q=1", "name": "Smartphones"}}, "odd", {"name": None, "item": "/y/c3"}),
        crumbs({"name": "Elsewhere", "item": "https://other.example/phone/c123"}),
        script({"@type": "Product", "name": "x", "category": "Stated"}) + crumbs({"name": "Phones", "item": "/phone/c1"}),
    )
    assert [r["category"] for r in (plain, objects, foreign, stated)] == ["Observed phones", "Smartphones", None, "Stated"]


def test_visible_ratings_and_broken_scripts(facts):
    seen, broken, several = facts("<h1>Phone</h1><p>4,5 (1.234)</p>", "<script type='application/ld+json'>{broken</script><h1>Phone</h1>" + script({"@type": "Product", "name": "Fine"}), "<script type='text/javascript'>" + json.dumps({"@type": "Product", "name": "no"}) + "</script><h1>Yes</h1>")
    assert (seen["rating"], seen["review_count"]) == (4.5, 1234)
    assert broken["product_name"] == "Fine" and several["product_name"] == "Yes"


def test_equal_pages_and_others_columns(spark):
    df = spark.createDataFrame([("u", "<h1>a</h1>", 1.0, "x")] * 3, "url string, html string, price double, _e string")
    assert product_pages.facts(df).count() == 3
    assert product_pages.facts(df.limit(0)).count() == 0
