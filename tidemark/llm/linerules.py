"""Quality rules on documents, among them cross-document line frequency; DataFrame operations only.

Base figures come from each text's words and lines. The method: lines are normalised
(lower case, white space runs to one space, ends cut) and hashed; for each host (the
source column) the distinct documents that show a line are counted, exact copies of a text
once; a line shown by more than max_documents is removed from every document of the host
but the first (by doc_id) that has it; a document with fewer than min_words words left is
depleted and rejected. judge() gives figures and verdicts, apply_rules() the kept documents
with their texts rebuilt from the lines that survive.

Null texts have no words and fail the base rules. A null host is a host of its own; a null
doc_id has no lines to remove. Rows that share a doc_id are documents of their own: each has
its own figures, lines and verdict, but none loses a line of which their doc_id is the first. Extra columns are ignored, whatever their
names (only apply_rules() returns them). Very long texts are worked on whole: a text's
3-word windows are compared within its row, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = r"[\\x20\\x09-\\x0D]+"

#: The limit is the same for hosts of every size: a line that three distinct texts show is boilerplate.
MAX_DOCUMENTS, MIN_WORDS = 2, 50

#: What tells a row: rows with all three alike have the same figures.
KEY = ("doc_id", "host", "text_hash")


def base_figures(docs: DataFrame) -> DataFrame:
    """doc_id, host, text_hash, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed.

    A text's 3-word windows are hashed; only if some are equal, they are sorted by hash with
    the position in the low bits, and equal neighbours (compared by their whole hashes) give
    the positions of repeated windows, each of which covers three words less what the next
    one covers again.
    """
    text = docs.select("doc_id", F.col("source").alias("host"), F.xxhash64("text").alias("text_hash"), F.coalesce("text", F.lit("")).alias("t"))
    words = text.selectExpr(*KEY, "t", f"filter(split(t, '{SPACES}'), x -> x != '') AS w", r"filter(split(t, '\\n'), x -> x RLIKE '[^\\x20\\x09-\\x0D]') AS lines")
    hashed = words.selectExpr(
        *KEY,
        "size(w) AS n",
        "CAST(aggregate(w, 0, (a, x) -> a + length(x)) AS BIGINT) AS word_chars",
        "CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols",
        "CAST(size(lines) - size(array_distinct(lines)) AS BIGINT) AS n_dup_lines",
        "transform(w, x -> xxhash64(x)) AS h",
    )
    windows = hashed.selectExpr("*", "CASE WHEN n < 4 THEN CAST(array() AS ARRAY<BIGINT>) ELSE transform(sequence(0, n - 3), i -> xxhash64(h[i], h[i + 1], h[i + 2])) END AS g").drop("h")
    sized = windows.selectExpr("*", "shiftleft(1L, length(bin(CAST(n AS BIGINT)))) - 1L AS mask", "size(array_distinct(g)) AS kinds")
    keyed = sized.selectExpr("*", "CASE WHEN kinds = size(g) THEN CAST(array() AS ARRAY<BIGINT>) ELSE sort_array(transform(g, (x, i) -> (x & ~mask) | CAST(i AS BIGINT))) END AS k")
    found = keyed.selectExpr(
        "*",
        """CASE WHEN size(k) = 0 THEN CAST(array() AS ARRAY<INT>) ELSE sort_array(transform(filter(sequence(0, size(k) - 1), i ->
            (i > 0 AND g[CAST(k[i] & mask AS INT)] = g[CAST(k[i - 1] & mask AS INT)])
            OR (i < size(k) - 1 AND g[CAST(k[i] & mask AS INT)] = g[CAST(k[i + 1] & mask AS INT)])),
            i -> CAST(k[i] & mask AS INT))) END AS p""",
    )
    covered = found.selectExpr(
        *KEY, "CAST(n AS BIGINT) AS n_words", "word_chars", "n_symbols", "n_dup_lines",
        "CAST(aggregate(p, named_struct('last', -3, 'n', 0), (a, x) -> named_struct('last', x, 'n', a.n + least(3, x - a.last)), a -> a.n) AS BIGINT) AS n_repeat_words",
    )
    return covered.withColumn("base_failed", F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words"))


def lines_of(docs: DataFrame) -> DataFrame:
    """A row per line with a word: doc_id, host, text_hash, position (from 0, between line feeds), line_hash, line_words."""
    text = docs.where("text IS NOT NULL AND doc_id IS NOT NULL").selectExpr("doc_id", "source AS host", "xxhash64(text) AS text_hash", rf"posexplode(split(regexp_replace(lower(text), '[\\x20\\x09\\x0B-\\x0D]+', ' '), ' ?\\n ?')) AS (position, line)")
    trimmed = text.withColumn("line", F.trim("line")).where("line != ''")
    return trimmed.selectExpr("doc_id", "host", "text_hash", "position", "xxhash64(line) AS line_hash", "CAST(size(split(line, ' ')) AS BIGINT) AS line_words")


def frequent_lines(lines: DataFrame, max_documents: int) -> DataFrame:
    """host, line_hash, documents and the first doc_id of lines over the limit. Counted in two steps, so that no task gets all of a line's rows."""
    return (
        lines.groupBy("host", "line_hash", "text_hash").agg(F.min("doc_id").alias("first_doc"))
        .groupBy("host", "line_hash").agg(F.count("*").alias("documents"), F.min("first_doc").alias("first_doc"))
        .where(F.col("documents") > max_documents)
    )


def removed_lines(docs: DataFrame, max_documents: int) -> DataFrame:
    """The rows of lines_of() that are over the limit, but for those of the line's first document."""
    lines = lines_of(docs)
    many = frequent_lines(lines, max_documents).withColumnsRenamed({"host": "h", "line_hash": "l"})
    joined = lines.join(many, lines["host"].eqNullSafe(many["h"]) & (lines["line_hash"] == many["l"]))
    return joined.where("doc_id != first_doc")


def removed_words(docs: DataFrame, max_documents: int) -> DataFrame:
    """key (doc_id, host, text_hash) and the words that the lines over the limit hold, where a text has any; rows that repeat count once."""
    lines = removed_lines(docs, max_documents).groupBy(F.struct(*KEY).alias("key")).agg(F.collect_set(F.struct("position", "line_words")).alias("lines"))
    return lines.select("key", F.aggregate("lines", F.lit(0).cast("long"), lambda n, x: n + x["line_words"]).alias("removed_words"))


def _judged(docs: DataFrame, max_documents: int, min_words: int) -> DataFrame:
    """Figures and verdict of every row, with its key's columns."""
    base, removed = base_figures(docs), removed_words(docs, max_documents)
    out = base.join(removed, F.struct(*[base[c] for c in KEY]).eqNullSafe(removed["key"]), "left").withColumn("left_words", F.expr("n_words - coalesce(removed_words, 0L)"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("left_words") >= min_words))


def judge(docs: DataFrame, max_documents: int = MAX_DOCUMENTS, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per document: base figures, words left after line removal and the verdict."""
    return _judged(docs, max_documents, min_words).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "left_words")


def _key(docs: DataFrame) -> Column:
    return F.struct(docs["doc_id"], docs["source"].alias("host"), F.xxhash64(docs["text"]).alias("text_hash"))


def without_frequent_lines(docs: DataFrame, max_documents: int = MAX_DOCUMENTS) -> DataFrame:
    """docs with each text rebuilt from its surviving lines; a text that loses none keeps every byte, all other columns are as they were."""
    return _rebuilt(docs, removed_lines(docs, max_documents))


def _rebuilt(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """docs without these rows of lines_of()."""
    gone = lines.groupBy(F.struct(*KEY).alias("key")).agg(F.collect_set("position").alias("positions"))
    # split once; positions are subtracted by hash, so the time grows with the lines, not with their square
    kept = lambda lines: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone["positions"]), lambda i: F.get(lines, i)), "\n")
    text = F.when(gone["positions"].isNull(), docs["text"]).otherwise(F.transform(F.array(F.split(docs["text"], "\n")), kept)[0])
    return docs.join(gone, _key(docs).eqNullSafe(gone["key"]), "left").select(*[text.alias(c) if c == "text" else docs[c] for c in docs.columns])


def apply_rules(docs: DataFrame, max_documents: int = MAX_DOCUMENTS, min_words: int = MIN_WORDS) -> DataFrame:
    """The kept rows of docs with all their columns, their texts without the frequent lines."""
    rejected = _judged(docs, max_documents, min_words).where("NOT kept").select(F.struct(*KEY).alias("rejected")).distinct()
    kept = docs.join(rejected, _key(docs).eqNullSafe(rejected["rejected"]), "left_anti")
    gone = removed_lines(docs, max_documents)  # counted over all documents, those that go included
    return _rebuilt(kept, gone)


def oracle(max_documents: int = MAX_DOCUMENTS, min_words: int = MIN_WORDS) -> str:
    """DuckDB SQL for judge() over the documents table."""
    space = r"[\x20\x09-\x0D]"
    return rf"""
    WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
    w AS (SELECT rid, doc_id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, t FROM d),
    g AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
    r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM g) WHERE c > 1),
    c AS (SELECT rid, count(DISTINCT i + j) AS n FROM r, (VALUES (0), (1), (2)) AS o(j) GROUP BY rid),
    l AS (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d),
    u AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
    m AS (SELECT rid, doc_id, source, t, trim(regexp_replace(lower(line), '{space}+', ' ', 'g')) AS line FROM (SELECT rid, doc_id, source, t, unnest(string_split(t, chr(10))) AS line FROM d)),
    f AS (SELECT source, line, min(doc_id) AS first_doc FROM m WHERE line != '' GROUP BY source, line HAVING count(DISTINCT t) > {max_documents}),
    x AS (SELECT m.rid, sum(len(string_split(m.line, ' '))) AS n FROM m JOIN f ON m.line = f.line AND m.source IS NOT DISTINCT FROM f.source WHERE m.doc_id != f.first_doc GROUP BY m.rid),
    b AS (SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '{space}', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(u.n, 0) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(x.n, 0) AS BIGINT) AS removed
        FROM w LEFT JOIN c ON w.rid = c.rid LEFT JOIN u ON w.rid = u.rid LEFT JOIN x ON w.rid = x.rid),
    v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND n_words - removed >= {min_words} AS kept, n_words - removed AS left_words FROM v
    """
