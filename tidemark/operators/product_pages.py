"""Product facts out of shop pages: a scored choice among structured data, then microdata, meta tags and visible text.

JSON in script elements is walked as variants, level by level inside a row, so there is no
shuffle and no Python. A node of type Product wins, the first in reading order; else the node
that has a name and a price and the most other product fields. Each fact comes from the chosen
node, and only if it states none from the page's tags; a price that is stated but can't be
read is not mended by other digits on the page. Categories may come from breadcrumb links to
category pages of the page's own host. Nothing is assumed: what isn't observed is null.

Null or empty pages have null facts; text that isn't JSON is skipped. The fields of an object
are read in the order of their names. JSON deeper than DEPTH levels isn't searched; Spark's own
parser refuses text much deeper than that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import values as V
from tidemark.operators.articles import _text

DEPTH = 64

# Scripts that hold data, fields that tell a product and what they score, the names of each fact in order, limits of visible prices.
DATA_SCRIPTS = ("__next_data__", "__nuxt_data__", "__initial_state__")
LONGEST_SCRIPT = 8_000_000
NAME_KEYS = ("name", "product_name", "productname", "title", "displayname")
PRICE_KEYS = ("price", "current_price", "sale_price", "saleprice", "final_price", "finalprice")
SCORES = ((("product_id", "productid", "sku", "itemid", "master_id"), 2), (("brand", "brand_name"), 1), (("rating_average", "aggregaterating", "review_count", "reviewcount"), 1))
FACTS = {
    "name": ("name", "product_name", "productname", "title", "displayname"),
    "price": ("price", "current_price", "currentprice", "sale_price", "saleprice", "final_price", "finalprice"),
    "offers": ("offers", "offer"),
    "currency": ("pricecurrency", "price_currency", "currency"),
    "brand": ("brand", "brand_name", "brandname", "manufacturer"),
    "category": ("category", "category_name", "categoryname", "primary_category_name"),
    "seller": ("seller", "seller_name", "sellername", "merchant"),
    "image": ("image", "image_url", "imageurl", "thumbnail_url"),
    "aggregate": ("aggregaterating", "aggregate_rating", "rating_summary", "ratingsummary"),
    "rating": ("rating_average", "ratingaverage", "rating", "ratingvalue"),
    "reviews": ("review_count", "reviewcount", "ratingcount", "rating_count", "num_reviews"),
    "ident": ("sku", "productid", "product_id"),
}
OFFER_PRICE = ("price", "lowprice", "low_price", "amount")
PRICE_WITHIN = ("price", "amount", "value", "lowprice", "low_price")
AGGREGATE_RATING, AGGREGATE_COUNT = ("ratingvalue", "rating_value", "rating"), ("reviewcount", "ratingcount", "review_count")
TEXT_WITHIN = ("name", "value", "label", "title")
VISIBLE_PRICE = r"(?i)(?<![\d+-])([+-]?(?:\d{1,3}(?:[.,]\d{3})+|\d{5,}))\s*(?:₫|đ|VNĐ|VND)"
VISIBLE_LIMITS, VISIBLE_CHARS = (10_000, 10_000_000_000), 1800
SUMMARY = r"(?<!\d)([0-5](?:[.,]\d)?)\s*\(\s*(\d[\d.,]*)\s*\)"
CATEGORY_PATH, URL_ID = r"/c\d+/?$", r"-p(\d+)(?:\.html)?"

_NODES = "array<struct<path:array<int>,v:variant>>"
_WALK = f"struct<seen:{_NODES},now:{_NODES}>"

# Expressions are SQL text: the whole page is read in a few projections, whose analysis would take longer piece by piece.


def _words(names: tuple[str, ...]) -> str:
    return ", ".join(f"'{n}'" for n in names)


def _first(array: str) -> str:
    """The first item that isn't null."""
    return f"get(filter({array}, x -> x IS NOT NULL), 0)"


def _fields(v: str) -> str:
    """An object's fields, null for all else."""
    return f"try_variant_get({v}, '$', 'map<string,variant>')"


def _items(v: str) -> str:
    return f"try_variant_get({v}, '$', 'array<variant>')"


def _blobs(html: str) -> str:
    """The JSON documents in a page's scripts, each with its place as path."""
    scripts = rf"regexp_extract_all({html}, r'(?is)<script\b[^>]*>.*?</script\s*>', 0)"
    head = r"lower(regexp_extract(s, r'(?is)^<script\b([^>]*)>', 1))"
    attribute = lambda name: rf"regexp_extract({head}, r'\b{name}\s*=\s*[\x22\x27]?([^\x22\x27\s>]*)', 1)"
    fit = f"filter({scripts}, s -> (contains({attribute('type')}, 'json') OR {attribute('id')} IN ({_words(DATA_SCRIPTS)})) AND length(s) <= {LONGEST_SCRIPT + 1000})"
    parsed = rf"filter(transform({fit}, s -> try_parse_json(regexp_extract(s, r'(?is)^<script\b[^>]*>(.*)</script\s*>$', 1))), v -> v IS NOT NULL)"
    return f"transform({parsed}, (v, i) -> named_struct('path', array(i), 'v', v))"


def _walked(roots: str, depth: int) -> str:
    """All objects and arrays below the roots, level by level, each with its path."""
    inside = f"coalesce(map_values({_fields('n.v')}), {_items('n.v')}, CAST(array() AS array<variant>))"
    below = f"filter(transform({inside}, (c, i) -> named_struct('path', concat(n.path, array(i)), 'v', c)), c -> {_fields('c.v')} IS NOT NULL OR {_items('c.v')} IS NOT NULL)"
    step = f"CAST(named_struct('seen', concat(a.seen, a.now), 'now', flatten(transform(a.now, n -> {below}))) AS {_WALK})"
    start = f"CAST(named_struct('seen', array(), 'now', coalesce({roots}, array())) AS {_WALK})"
    # levels below the last one that holds anything copy nothing
    return f"aggregate(sequence(1, {depth + 1}), {start}, (a, k) -> CASE WHEN size(a.now) = 0 THEN a ELSE {step} END, a -> a.seen)"


def _types(v: str) -> str:
    """The names in @type, one or several, in lower case."""
    stated = f"try_variant_get({v}, '$[\"@type\"]', 'variant')"
    return f"transform(coalesce(try_variant_get({stated}, '$', 'array<string>'), array(try_variant_get({stated}, '$', 'string'))), t -> lower(t))"


def _best(nodes: str) -> str:
    """The node that is the product: rank (lower is better), path, and itself as JSON."""
    keys = f"transform(map_keys({_fields('n.v')}), k -> lower(k))"
    has = lambda names: f"arrays_overlap({keys}, array({_words(names)}))"
    score = " + ".join(["2", *(f"CASE WHEN {has(names)} THEN {more} ELSE 0 END" for names, more in SCORES)])
    rank = f"CASE WHEN array_contains({_types('n.v')}, 'product') THEN -100 WHEN {has(NAME_KEYS)} AND {has(PRICE_KEYS)} THEN -({score}) END"
    ranked = f"transform(filter({nodes}, n -> {_fields('n.v')} IS NOT NULL), n -> named_struct('rank', {rank}, 'path', n.path, 'json', to_json(n.v)))"
    return f"array_min(filter({ranked}, e -> e.rank IS NOT NULL))"


def _entries(json: str) -> str:
    """An object's fields that aren't empty: name in lower case, value as JSON; empty for all else."""
    pairs = f"transform(map_entries({_fields(f'try_parse_json({json})')}), p -> named_struct('k', lower(p.key), 'j', to_json(p.value)))"
    return f"filter(coalesce({pairs}, CAST(array() AS array<struct<k:string,j:string>>)), p -> NOT p.j IN ('null', '\"\"', '[]', '{{}}'))"


def _plain(json: str) -> str:
    """A text or number as text."""
    return rf"CASE WHEN NOT {json} RLIKE r'^[\[{{tf]' THEN nullif(trim(try_variant_get(try_parse_json({json}), '$', 'string')), '') END"


def _scalar(json: str, within: tuple[str, ...] = TEXT_WITHIN) -> str:
    """The text of a value, of an object's telling field, or of the first such item of a list."""

    def one(j: str) -> str:
        return f"coalesce({_plain(j)}, {_first(f'transform(array({_words(within)}), w -> {_plain(f"get(filter({_entries(j)}, q -> q.k = w), 0).j")})')})"

    return f"coalesce({one(json)}, {_first(f'transform({_items(f"try_parse_json({json})")}, v -> {one("to_json(v)")})')})"


def _pick(entries: str, names: tuple[str, ...], what: str) -> str:
    """The first of the names' values (what: t for text, j for JSON)."""
    return _first(f"transform(array({_words(names)}), n -> get(filter({entries}, e -> e.k = n), 0).{what})")


def _tag(tags: str, attribute: str, value: str) -> str:
    """What the first of such elements with attribute="value" holds: its content attribute, else its text up to the next element."""
    found = rf"get(filter(regexp_extract_all(html, r'(?is)<(?:{tags})\b[^>]*>[^<]*', 0), t -> t RLIKE r'(?i)^<[^>]*\b{attribute}\s*=\s*[\x22\x27]{value}[\x22\x27]'), 0)"
    content = rf"nullif(trim(regexp_extract({found}, r'(?is)^<[^>]*\bcontent\s*=\s*(?:\x22([^\x22]*)\x22|\x27[^\x27]*\x27)', 1)), '')"
    other = rf"nullif(trim(regexp_extract({found}, r'(?is)^<[^>]*\bcontent\s*=\s*\x27([^\x27]*)\x27', 1)), '')"
    return f"coalesce({content}, {other}, nullif(trim(regexp_replace({found}, r'^<[^>]*>', '')), ''))"


def _crumbs(nodes: str) -> str:
    """Breadcrumb entries in reading order: label and link."""
    lists = f"array_sort(transform(filter({nodes}, n -> coalesce(array_contains({_types('n.v')}, 'breadcrumblist'), false)), n -> named_struct('path', n.path, 'items', to_json(try_variant_get(n.v, '$.itemListElement', 'variant')))))"
    item = "try_variant_get(v, '$.item', 'variant')"
    text = lambda of, path: f"try_variant_get({of}, '{path}', 'string')"
    link = f"""coalesce({text(item, '$["@id"]')}, {text(item, '$.url')}, CASE WHEN {_fields(item)} IS NULL THEN {text(item, '$')} END)"""
    label = f"coalesce({_scalar("to_json(try_variant_get(v, '$.name', 'variant'))")}, {_scalar(f"to_json(try_variant_get({item}, '$.name', 'variant'))")})"
    return f"flatten(transform({lists}, o -> transform(coalesce({_items('try_parse_json(o.items)')}, CAST(array() AS array<variant>)), v -> named_struct('label', {label}, 'link', {link}))))"


def _category() -> str:
    """The label of the last entry that links to a category page of the page's own host."""
    own = r"NOT c.link RLIKE r'^[a-zA-Z][a-zA-Z0-9+.-]*:|^//' OR lower(try_parse_url(c.link, 'HOST')) = lower(try_parse_url(url, 'HOST'))"
    path = r"regexp_replace(regexp_replace(c.link, r'[?#].*$', ''), r'^https?://[^/]*', '')"
    return f"try_element_at(transform(filter(_crumbs, c -> coalesce(({own}) AND {path} RLIKE r'{CATEGORY_PATH}' AND c.label IS NOT NULL, false)), c -> c.label), -1)"


def facts(pages: DataFrame, url: str = "url", html: str = "html", depth: int = DEPTH) -> DataFrame:
    """A row a page: url, product_id, product_name, brand, category, price, price_raw, currency, rating, review_count, seller, image_url, evidence (product, candidate or page), content_sha256."""
    p = pages.select(F.col(url).alias("url"), F.col(html).alias("html"), _text(F.col(html)).alias("_visible"))
    p = p.selectExpr("*", f"{_walked(_blobs('html'), depth)} AS _nodes")
    p = p.selectExpr("url", "html", "_visible", f"{_best('_nodes')} AS _best", f"{_crumbs('_nodes')} AS _crumbs")
    p = p.selectExpr("*", f"{_entries('_best.json')} AS _e")
    of_name = lambda k: _pick("_s", FACTS[k], "t")
    offers = f"transform(array({_pick('_e', FACTS['offers'], 'j')}), o -> CASE WHEN o LIKE '[%' THEN to_json(get({_items('try_parse_json(o)')}, 0)) ELSE o END)[0]"
    p = p.selectExpr("*", f"transform(_e, e -> named_struct('k', e.k, 't', {_scalar('e.j')})) AS _s", f"{offers} AS _offer", f"{_pick('_e', FACTS['price'], 'j')} AS _own_price", f"{_entries(_pick('_e', FACTS['aggregate'], 'j'))} AS _of")
    p = p.selectExpr("*", f"{_entries('_offer')} AS _offered")
    heading = rf"nullif(trim(regexp_replace(regexp_extract(html, r'(?is)<h1\b[^>]*>(.*?)</h1\s*>', 1), r'<[^>]+>', ' ')), '')"
    tagged = f"coalesce({_tag('meta', 'property', 'product:price:amount')}, {_tag('meta', 'itemprop', 'price')}, {_tag(r'\w+', 'itemprop', 'price')})"
    p = p.selectExpr(
        "*", f"coalesce(_own_price, {_pick('_offered', OFFER_PRICE, 'j')}, CASE WHEN NOT _offer LIKE '{{%' THEN _offer END) AS _price",
        f"coalesce({of_name('name')}, {_tag('meta', 'property', 'og:title')}, {heading}) AS _name", f"{tagged} AS _tagged",
        f"coalesce({of_name('currency')}, {_plain(_pick('_offered', FACTS['currency'], 'j'))}) AS _unit", f"{_tag('meta', 'property', 'product:price:currency')} AS _tag_unit",
        *[f"{of_name(k)} AS _{k}" for k in ("brand", "category", "seller", "image", "rating", "reviews", "ident")],
        f"{_tag(r'\w+', 'itemprop', 'brand')} AS _tag_brand", f"{_plain(_pick('_of', AGGREGATE_RATING, 'j'))} AS _of_rating", f"{_plain(_pick('_of', AGGREGATE_COUNT, 'j'))} AS _of_count",
    )
    place = "greatest(coalesce(position(lower(_name), lower(_visible)), 1), 1)"
    p = p.selectExpr("*", f"substring(_visible, {place}, {VISIBLE_CHARS}) AS _region", f"coalesce({_scalar('_price', PRICE_WITHIN)}, CASE WHEN _price IS NULL THEN _tagged END) AS _stated", "coalesce(_price RLIKE '^-?[0-9]', false) AS _number")
    seen = lambda pattern, i: F.nullif(F.regexp_extract("_region", pattern, i), F.lit(""))
    p = p.withColumns({"_name": _text(F.col("_name")), "_tag_brand": _text(F.col("_tag_brand")), "_seen": V.price(seen(VISIBLE_PRICE, 1)), "_token": seen(VISIBLE_PRICE, 0), "_stars": F.replace(seen(SUMMARY, 1), F.lit(","), F.lit(".")), "_votes": seen(SUMMARY, 2)})
    fit = F.col("_price").isNull() & F.col("_stated").isNull() & F.col("_seen").between(*VISIBLE_LIMITS)
    amount = F.when(F.col("_number"), V.price(F.col("_stated").try_cast("double"), True)).otherwise(V.price(F.col("_stated")))
    count = V.amount(F.coalesce("_reviews", "_of_count", "_votes"))
    p = p.withColumns({"price": F.when(fit, F.col("_seen")).otherwise(amount), "price_raw": F.when(fit, F.col("_token")).otherwise(F.col("_stated")), "_count": count})
    return p.select(
        "url", F.coalesce(F.nullif(F.regexp_extract("url", URL_ID, 1), F.lit("")), "_ident").alias("product_id"), F.col("_name").alias("product_name"), F.coalesce("_brand", "_tag_brand").alias("brand"),
        F.coalesce("_category", F.expr(_category())).alias("category"), "price", "price_raw", V.observed_currency(F.coalesce("_unit", F.when(F.col("_price").isNull(), F.col("_tag_unit"))), F.col("price_raw")).alias("currency"),
        V.rating(F.coalesce("_rating", "_of_rating", "_stars")).alias("rating"), F.when(F.col("_count") == F.floor("_count"), F.col("_count").try_cast("int")).alias("review_count"), F.col("_seller").alias("seller"), F.col("_image").alias("image_url"),
        F.when(F.col("_best.rank") == -100, "product").when(F.col("_best").isNotNull(), "candidate").otherwise("page").alias("evidence"), F.sha2("html", 256).alias("content_sha256"),
    )
