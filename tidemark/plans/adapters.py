"""The driver's tables in the engine's shapes, as expressions that Spark and DuckDB both read.

Dirt is put in by CASE expressions, so both engines see the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_ID = "CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING)"
_DOLLARS = "CAST(floor(l_extendedprice) AS BIGINT)"
_T = f"CAST(CAST(floor({_DOLLARS} / 1000) AS BIGINT) AS STRING)"
_R = f"lpad(CAST({_DOLLARS} % 1000 AS STRING), 3, '0')"
_C = "lpad(CAST(l_linenumber * 13 % 100 AS STRING), 2, '0')"
_Y, _M, _D = "CAST(year(l_shipdate) AS STRING)", "lpad(CAST(month(l_shipdate) AS STRING), 2, '0')", "lpad(CAST(day(l_shipdate) AS STRING), 2, '0')"
_RATING = "1 + CAST(floor(l_quantity) AS BIGINT) % 5"

_UNKNOWN = "CAST(l_partkey + 100000000 AS STRING)"
_WHOLE = "CAST(CAST(floor(p_retailprice) AS BIGINT) AS STRING)"
_LD = f"""'<script type="application/ld+json">{{"@graph": [{{"name": "decoy", "price": 1}}, {{"@type": ["Thing", "Product"], "name": "' || p_name || '", "brand": {{"name": "' || p_brand || '"}}, "offers": [{{"price": "' || {_WHOLE} || '.50", "priceCurrency": "eur"}}], "aggregateRating": {{"ratingValue": 4.5, "ratingCount": "1,2' || lpad(CAST(p_size AS STRING), 2, '0') || '"}}}}]}}</script>'"""
_NEXT = f"""'<script id="__NEXT_DATA__">{{"props": {{"list": [{{"title": "decoy", "price": 1}}, {{"data": {{"displayName": "' || p_name || '", "salePrice": ' || {_WHOLE} || ', "sku": "s", "brand_name": "' || p_brand || '", "category": {{"label": "' || p_type || '"}}}}}}]}}}}</script>'"""
_MICRO = f"""'<h1>' || p_name || '</h1><b itemprop="brand">' || p_brand || '</b><span class="p" itemprop="price">' || {_WHOLE} || '.000 VND</span>'"""
_META = f"""'<meta property="og:title" content="' || p_name || '"><h1>decoy</h1><meta content="' || {_WHOLE} || '" property="product:price:amount"><meta property="product:price:currency" content="usd">'"""
_SEEN = f"""'<h1>' || p_name || '</h1><script type="application/ld+json">{{"@type": "BreadcrumbList", "itemListElement": [{{"name": "Home", "item": "/"}}, {{"name": "' || p_type || '", "item": "https://shop.example/x/c12"}}, {{"name": "no", "item": "https://other.example/c13"}}]}}</script><p>only ' || {_WHOLE} || '000 VND</p><i>4,5 (' || CAST(p_size AS STRING) || ')</i>'"""

#: view: table, columns. {days} is the number of days since 1970 in the engine's own words.
VIEWS: dict[str, tuple[str, dict[str, str]]] = {
    "products": ("part", {
        "product_id": "CAST(p_partkey AS STRING)", "product_name": "p_name", "brand": "p_brand", "category": "p_type", "price": "p_retailprice", "currency": "'USD'",
        "source_group": "CASE WHEN p_size % 3 = 0 THEN 'marketplace' WHEN p_size % 3 = 1 THEN 'simulation' END",
    }),
    "prices": ("lineitem", {"price_id": _ID, "product_id": f"CASE WHEN l_suppkey % 20 = 3 THEN {_UNKNOWN} ELSE CAST(l_partkey AS STRING) END", "price": "l_extendedprice", "timestamp": "CAST(l_shipdate AS TIMESTAMP)", "currency": "'USD'"}),
    # some products are in no catalog, some catalog products have no review, some days with reviews have no price
    "reviews": ("lineitem", {
        "review_id": _ID, "product_id": f"CASE WHEN l_suppkey % 20 = 7 OR l_partkey % 50 = 11 THEN {_UNKNOWN} ELSE CAST(l_partkey AS STRING) END", "rating": f"CAST({_RATING} AS DOUBLE)",
        "review_date": "CAST(CASE WHEN l_suppkey % 20 = 5 THEN l_shipdate + INTERVAL 3 DAY ELSE l_shipdate END AS TIMESTAMP)", "review_text": "l_returnflag",
    }),
    "raw_reviews": ("lineitem", {
        "review_id": f"CASE WHEN l_suppkey % 97 = 3 THEN ' ' ELSE {_ID} END",
        "product_id": "CASE WHEN l_suppkey % 89 = 5 THEN NULL ELSE CAST(l_partkey AS STRING) END",
        "rating": f"CASE WHEN l_quantity > 45 THEN '9' WHEN l_quantity <= 1 THEN 'bad' WHEN l_quantity <= 2 THEN '' WHEN l_quantity <= 3 THEN ' 4 ' ELSE CAST({_RATING} AS STRING) END",
        "review_text": "CASE WHEN l_linenumber = 7 AND l_discount < 0.02 THEN '  ' ELSE l_returnflag END",
        "review_date": f"CASE l_linenumber % 5 WHEN 0 THEN {_Y} || '-' || {_M} || '-' || {_D} WHEN 1 THEN {_Y} || '/' || {_M} || '/' || {_D} WHEN 2 THEN {_D} || '/' || {_M} || '/' || {_Y} WHEN 3 THEN CAST(86400 * {{days}} AS STRING) ELSE CASE WHEN l_tax > 0.07 THEN 'soon' ELSE {_Y} || '-' || {_M} || '-' || {_D} || 'T08:30:00+07:00' END END",
        "user_id": "CASE WHEN l_suppkey % 50 = 1 THEN 'none' ELSE ' user' || CAST(l_suppkey AS STRING) END",
        "ingested_at": f"{_Y} || '-' || {_M} || '-' || {_D} || 'T00:00:00Z'",
        "verified_purchase": "CASE WHEN l_linestatus = 'O' THEN 'true' WHEN l_tax < 0.02 THEN 'maybe' ELSE 'false' END",
    }),
    "raw_prices": ("lineitem", {
        "price_id": _ID, "product_id": "CAST(l_partkey AS STRING)",
        "price": f"CASE l_linenumber % 7 WHEN 0 THEN {_DOLLARS} || '.' || {_C} WHEN 1 THEN '$' || {_T} || ',' || {_R} || '.' || {_C} WHEN 2 THEN {_T} || '.' || {_R} || ',' || {_C} || ' €' WHEN 3 THEN {_T} || '.' || {_R} || ' VND' WHEN 4 THEN '12-34' WHEN 5 THEN '2.5e' || CAST(l_suppkey % 5 AS STRING) ELSE '-' || {_C} END",
        "currency": "CASE l_suppkey % 9 WHEN 0 THEN 'usd' WHEN 1 THEN ' US$ ' WHEN 2 THEN '₫' WHEN 3 THEN 'euro' WHEN 4 THEN 'chf' WHEN 5 THEN '?' WHEN 6 THEN '' WHEN 7 THEN NULL ELSE 'dollars' END",
        "brand": "CASE l_suppkey % 6 WHEN 0 THEN ' APPLE Inc. ' WHEN 1 THEN 'mi' WHEN 2 THEN '' WHEN 3 THEN 'samsung electronics' WHEN 4 THEN 'acme' ELSE NULL END",
        "category": "CASE l_linenumber % 4 WHEN 0 THEN 'Phone' WHEN 1 THEN 'laptops' WHEN 2 THEN 'chair' ELSE ' ' END",
    }),
    "stream_reviews": ("events", {
        "review_id": "CAST(event_id AS STRING)", "product_id": "event_type", "rating": "CAST(1 + event_id % 5 AS DOUBLE)", "review_date": "CAST(ts AS TIMESTAMP)", "event_time": "CAST(ts AS TIMESTAMP)",
        "source_group": "'simulation'", "user_id": "CAST(user_id AS STRING)", "value": "value",
    }),
    "articles": ("documents", {
        "article_id": "'a' || CAST(doc_id % 400 AS STRING)", "source_name": "lang || '.example.org'",
        "source_url": "CASE WHEN doc_id % 31 = 7 THEN 'https://other.example.net/' ELSE 'https://www.' || lang || '.example.org/' END || CAST(doc_id AS STRING)",
        "title": "CASE WHEN doc_id % 41 = 3 THEN ' ' ELSE 'Title ' || CAST(doc_id AS STRING) END", "body": "text",
        "content_sha256": "CASE WHEN doc_id % 37 = 5 THEN 'wrong' ELSE {sha}(text{bits}) END",
        "collected_at": "CASE WHEN doc_id % 29 = 11 THEN '2026-02-01' ELSE '2026-01-' || lpad(CAST(1 + doc_id % 28 AS STRING), 2, '0') || 'T10:00:00Z' END",
        "published_at": "CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '2025-12-' || lpad(CAST(1 + doc_id % 28 AS STRING), 2, '0') || 'T23:30:00-05:00' WHEN 2 THEN '2025-12-01' WHEN 3 THEN CASE WHEN doc_id % 3 = 0 THEN 'yesterday' ELSE '2025-11-05 10:00:00' END ELSE '2025-12-05T01:00:00+07:00' END",
    }),
    "shop_pages": ("part", {
        "page_id": "p_partkey", "url": "'https://shop.example/item-p' || CAST(p_partkey AS STRING) || '.html'",
        "html": f"'<body><a href=\"https://shop.example/c' || CAST(p_partkey % 7 AS STRING) || '#top\">x</a><A class=\"y\" HREF=\"https://other.example/' || CAST(p_size AS STRING) || '?q=1\">y</A><a href=\"/near\">z</a><a href=\"https://shop.example/c' || CAST(p_partkey % 7 AS STRING) || '\">again</a>' || CASE p_partkey % 6 WHEN 0 THEN {_LD} WHEN 1 THEN {_NEXT} WHEN 2 THEN {_MICRO} WHEN 3 THEN {_META} WHEN 4 THEN {_SEEN} ELSE '<h1>' || p_name || ' 123456</h1>' END || '</body>'",
    }),
    "runs": ("orders", {
        "pipeline": "o_orderpriority", "source": "o_orderstatus", "status": "CASE WHEN o_custkey % 4 = 0 THEN 'failed' ELSE 'success' END",
        "ended_at": "CAST(o_orderdate AS TIMESTAMP)", "run": "o_orderkey",
    }),
}

_SPARK = {"days": "unix_date(CAST(l_shipdate AS DATE))", "sha": "sha2", "bits": ", 256"}
_DUCK = {"days": "date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE))", "sha": "sha256", "bits": ""}


def frame(spark: SparkSession, sf_dir: str, view: str) -> DataFrame:
    table, columns = VIEWS[view]
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(*[f"{_fill(e, _SPARK)} AS {c}" for c, e in columns.items()])


def with_views(*views: str) -> str:
    """The opening of an oracle's SQL."""
    made = [f"{v} AS (SELECT {', '.join(f'{_fill(e, _DUCK)} AS {c}' for c, e in VIEWS[v][1].items())} FROM {VIEWS[v][0]})" for v in views]
    return "WITH " + ", ".join(made)


def _fill(expression: str, words: dict[str, str]) -> str:
    for name, word in words.items():
        expression = expression.replace("{" + name + "}", word)
    return expression


def rounded(sql: str, digits: int = 2) -> str:
    """The engine's rounding (halves away from zero, blind to the last bits) for DuckDB."""
    return f"CAST(round(CAST({sql} AS DECIMAL(28, 10)), {digits}) AS DOUBLE)"
