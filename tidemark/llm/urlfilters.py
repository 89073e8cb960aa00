"""URL filters by a temporal list join; DataFrame operations only.

A list is a history of dated entries: on a date an entry (a domain, or a domain with the
first segment of a path) is listed under a category or delisted. Each entry's history
becomes validity intervals [from, to), and every capture is judged against the intervals
that hold its fetch time, for its host, every parent domain, and each of these with its
first path segment. Domains don't depend on case, path segments do.

Captures are first reduced to distinct (host, segment, fetch day), so that a host with a
third of all captures sends no more rows into the join than it has days and segments;
the verdicts are joined back by the same three values.

Null or unparseable URLs have no host and are blocked by nothing, as are captures without
a fetch time. Repeated captures get a row each. Several changes of one entry on one day:
the last in the order (delist, list) holds. Repeated list rows and listings of a listed
entry change nothing. Null entries, dates or actions are ignored. An empty list blocks
nothing. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def host_of(url: Column) -> Column:
    """Lower-cased host without user, port and final dot; null if there is none."""
    host = F.regexp_extract(F.lower(F.trim(url)), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1)
    return F.nullif(F.regexp_replace(host, r"\.+$", ""), F.lit(""))


def segment_of(url: Column) -> Column:
    """First segment of the path, as written; empty if there is none."""
    return F.coalesce(F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]*)", 1), F.lit(""))


def with_domains(captures: DataFrame) -> DataFrame:
    """A row per domain of each host: the host itself and every parent domain, down to its last label."""
    counted = captures.withColumn("labels", F.explode(F.sequence(F.lit(1), F.size(F.split("host", r"\.")))))
    return counted.withColumn("domain", F.expr("substring_index(host, '.', -labels)")).drop("labels")


def entry_of(entry: Column) -> Column:
    """The entry with its domain lower-cased; a path segment stays as written, as in segment_of()."""
    domain = F.substring_index(entry, "/", 1)
    return F.concat(F.lower(domain), F.substring(entry, F.length(domain) + 1, F.length(entry)))


def intervals(entries: DataFrame) -> DataFrame:
    """entry, category, valid_from, valid_to (null: still valid) of entries: entry, category, day, action ('list' or 'delist')."""
    known = entries.where("entry IS NOT NULL AND day IS NOT NULL AND action IN ('list', 'delist')")
    daily = known.groupBy(entry_of(F.col("entry")).alias("entry"), "category", "day").agg(F.max(F.col("action") == "list").alias("listed"))
    w = Window.partitionBy("entry", "category").orderBy("day")
    changed = daily.withColumn("before", F.coalesce(F.lag("listed").over(w), F.lit(False))).where("listed != before")
    return changed.withColumn("valid_to", F.lead("day").over(w)).where("listed").selectExpr("entry", "category", "day AS valid_from", "valid_to")


def judge(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """captures (capture_id, url, fetched date) with host, blocked, n_entries, categories (sorted, joined by commas) and first listing day among the active entries."""
    parsed = captures.select("capture_id", host_of(F.col("url")).alias("host"), segment_of(F.col("url")).alias("segment"), "fetched")
    kinds = parsed.where("host IS NOT NULL AND fetched IS NOT NULL").select("host", "segment", "fetched").distinct()
    keyed = with_domains(kinds).withColumn("key", F.explode(F.array_distinct(F.array("domain", F.concat_ws("/", "domain", "segment")))))
    active = keyed.join(intervals(entries), (F.col("key") == F.col("entry")) & (F.col("valid_from") <= F.col("fetched")) & (F.col("valid_to").isNull() | (F.col("fetched") < F.col("valid_to"))))
    verdicts = active.groupBy("host", "segment", "fetched").agg(
        F.countDistinct("entry", F.coalesce("category", F.lit(""))).alias("n_entries"), F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories"), F.min("valid_from").alias("listed_since")
    )
    out = parsed.join(verdicts, ["host", "segment", "fetched"], "left")
    return out.select("capture_id", "host", "fetched", F.col("n_entries").isNotNull().alias("blocked"), F.coalesce("n_entries", F.lit(0)).cast("long").alias("n_entries"), F.coalesce("categories", F.lit("")).alias("categories"), "listed_since")


FIRST_DAY = "2024-01-01"


def page_captures(pages: DataFrame) -> DataFrame:
    """Captures of the pages table, which has no fetch time: each page gets a day of 2024 by its number."""
    return pages.select(F.col("page_id").alias("capture_id"), "url", F.date_add(F.lit(FIRST_DAY).cast("date"), F.pmod(F.col("page_id") * 7, F.lit(366)).cast("int")).alias("fetched"))


def page_entries(pages: DataFrame) -> DataFrame:
    """A list history over the hosts that pages show: by a hash of the host, a listing, perhaps a delisting and a relisting, and a listing of one path segment."""
    hosts = pages.select(host_of(F.col("url")).alias("host")).where("host IS NOT NULL").distinct()
    h = hosts.withColumn("h", F.conv(F.substring(F.md5("host"), 1, 7), 16, 10).cast("long"))
    day = lambda n: F.date_add(F.lit(FIRST_DAY).cast("date"), n.cast("int"))
    category = F.element_at(F.array(*map(F.lit, ("adult", "gambling", "malware", "spam"))), (F.col("h") % 4 + 1).cast("int"))
    start = F.col("h") % 200
    change = lambda entry, at, action: F.struct(entry.alias("entry"), day(at).alias("day"), F.lit(action).alias("action"))
    changes = F.filter(
        F.array(
            F.when(F.col("h") % 3 < 2, change(F.col("host"), start, "list")),
            F.when(F.col("h") % 3 < 2, change(F.col("host"), start + 30 + F.col("h") % 17, "delist")),
            F.when(F.col("h") % 3 == 0, change(F.col("host"), start + 90, "list")),
            F.when(F.col("h") % 5 == 0, change(F.concat("host", F.lit("/en")), start + 10, "list")),
            F.when(F.col("h") % 7 == 0, change(F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1), F.lit(300) + F.col("h") % 40, "list")),
            F.when(F.col("h") % 7 == 0, change(F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1), F.lit(300) + F.col("h") % 40 + 3, "delist")),
        ),
        lambda c: c.isNotNull(),
    )
    return h.select(category.alias("category"), F.explode(changes).alias("c")).select("c.entry", "category", "c.day", "c.action")


ORACLE = rf"""
    WITH p AS (SELECT page_id AS capture_id, lower(trim(url)) AS u, trim(url) AS raw, CAST('{FIRST_DAY}' AS DATE) + CAST((page_id * 7) % 366 AS INTEGER) AS fetched FROM pages),
    c AS (SELECT capture_id, fetched, nullif(regexp_replace(regexp_extract(u, '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1), '\.+$', ''), '') AS host,
        coalesce(regexp_extract(raw, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]*)', 1), '') AS segment FROM p),
    h AS (SELECT host, CAST('0x' || substr(md5(host), 1, 7) AS BIGINT) AS h, regexp_extract(host, '([^.]+\.[^.]+)$', 1) AS parent FROM (SELECT DISTINCT host FROM c WHERE host IS NOT NULL)),
    e AS (
        SELECT host AS entry, h, h % 200 AS day, true AS listed FROM h WHERE h % 3 < 2
        UNION ALL SELECT host, h, h % 200 + 30 + h % 17, false FROM h WHERE h % 3 < 2
        UNION ALL SELECT host, h, h % 200 + 90, true FROM h WHERE h % 3 = 0
        UNION ALL SELECT host || '/en', h, h % 200 + 10, true FROM h WHERE h % 5 = 0
        UNION ALL SELECT parent, h, 300 + h % 40, true FROM h WHERE h % 7 = 0
        UNION ALL SELECT parent, h, 300 + h % 40 + 3, false FROM h WHERE h % 7 = 0),
    d AS (SELECT entry, ['adult', 'gambling', 'malware', 'spam'][h % 4 + 1] AS category, CAST('{FIRST_DAY}' AS DATE) + CAST(day AS INTEGER) AS day, bool_or(listed) AS listed FROM e GROUP BY ALL),
    s AS (SELECT c.capture_id, d.entry, d.category, max(d.day) AS day FROM c JOIN d ON d.day <= c.fetched
        AND (c.host = d.entry OR c.host LIKE '%.' || d.entry OR c.host || '/' || c.segment = d.entry OR c.host || '/' || c.segment LIKE '%.' || d.entry)
        GROUP BY c.capture_id, d.entry, d.category),
    a AS (SELECT s.capture_id, s.entry, s.category, (SELECT max(x.day) FROM d AS x WHERE x.entry = s.entry AND x.category = s.category AND x.listed AND x.day <= s.day
            AND NOT EXISTS (SELECT 1 FROM d AS y WHERE y.entry = x.entry AND y.category = x.category AND y.listed AND y.day < x.day
                AND NOT EXISTS (SELECT 1 FROM d AS z WHERE z.entry = x.entry AND z.category = x.category AND NOT z.listed AND z.day > y.day AND z.day < x.day))) AS since
        FROM s JOIN d ON s.entry = d.entry AND s.category = d.category AND s.day = d.day WHERE d.listed),
    v AS (SELECT capture_id, count(*) AS n, string_agg(DISTINCT category, ',' ORDER BY category) AS categories, min(since) AS since FROM a GROUP BY capture_id)
    SELECT c.capture_id, c.host, c.fetched, v.n IS NOT NULL AS blocked, CAST(coalesce(v.n, 0) AS BIGINT) AS n_entries, coalesce(v.categories, '') AS categories, v.since AS listed_since
    FROM c LEFT JOIN v ON c.capture_id = v.capture_id
"""
