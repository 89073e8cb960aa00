"""Merkle manifest of a table of documents, with proofs looked up by coordinates.

A leaf is the digest of a row's fields. Each source's leaves, in the order of doc_id, make a
tree of runs of sixteen; the sources' roots, in the order of their names, make one more tree.
A leaf's siblings follow from its place and its tree's size alone: every node lists the
coordinates of the others of its run, a join with the written node table finds their digests,
and the parent's path, found the same way, is put behind. So a path is worked out once a
node and not once a leaf, no key is wanted by more than sixteen rows, and nothing larger than
a path is gathered. Places in a source come from a range partitioning and the counts of its
portions, so a source of any size is spread over all tasks.

Nulls: a field that is null is written `-`; rows without doc_id stand first in their source
and count as not tampered with; rows without source are a source of their own, the first.
Rows that share a doc_id are leaves of their own, ordered by their digests. An empty table
gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import saved

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
RUN = 16
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of the parts' UTF-8 text, one after another."""
    return F.sha2(F.concat(*parts), 256)


def _framed(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(**other: Column) -> Column:
    """A row's digest; other replaces fields by name."""
    return digest(*[_framed(other.get(f, F.col(f))) for f in FIELDS])


def lowered(text: Column) -> Column:
    return F.translate(text, _UPPER, _UPPER.lower())


class Tree(NamedTuple):
    """Levels of nodes from the leaves up: tree, idx (place in its level), n (the level's nodes in that tree), digest; the first has the leaves' own columns too."""

    levels: list[DataFrame]

    def roots(self) -> DataFrame:
        """tree, digest of every tree's last node."""
        tops = [level.where("n = 1").select("tree", "digest") for level in self.levels]
        out = tops[0]
        for more in tops[1:]:
            out = out.unionByName(more)
        return out


def ordered(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """rows written in that order over range partitions, with _at: the portion's number (upper bits) and the place in it."""
    spread = rows.repartitionByRange(*[F.col(c).asc_nulls_first() for c in by]).sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in by])
    return saved(spread.withColumn("_at", F.monotonically_increasing_id()))


def _portion() -> Column:
    return F.shiftright("_at", 33)


def spans(rows: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Of ordered rows one row a group and portion: _first (its lowest _at), _before (rows of the group in earlier portions), n (rows of the group)."""
    counts = rows.groupBy(_portion().alias("_portion"), *group).agg(F.count("*").alias("_rows"), F.min("_at").alias("_first"))
    all_of = Window.partitionBy(*(group or [F.lit(0)]))  # as many rows a group as portions
    before = F.sum("_rows").over(all_of.orderBy("_portion").rowsBetween(Window.unboundedPreceding, -1))
    return counts.select("_portion", *group, "_first", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_rows").over(all_of).alias("n"))


def grown(leaves: DataFrame, run: int = RUN) -> Tree:
    """The trees over leaves: tree, idx, n, digest and others."""
    levels = [leaves]
    most = leaves.agg(F.max("n")).first()[0] or 0
    while most > 1:
        below = levels[-1].where("n > 1").groupBy("tree", F.expr(f"idx div {run}").alias("idx"))
        joined = below.agg(F.expr(f"(max(n) + {run - 1}) div {run}").alias("n"), F.array_sort(F.collect_list(F.struct("idx", "digest"))).alias("_of"))
        levels.append(saved(joined.select("tree", "idx", "n", F.sha2(F.array_join("_of.digest", ""), 256).alias("digest"))))
        most = -(-most // run)
    return Tree(levels)


def paths(tree: Tree, tops: DataFrame, run: int = RUN) -> DataFrame:
    """The leaves' rows with path, an array of (left, right) from the leaf up, each the siblings' digests put together, and the columns of tops.

    tops: tree, path (what follows a tree's own path) and others that go down with it.
    """
    above = None
    for i, level in reversed(list(enumerate(tree.levels))):
        here = level.where("n = 1").join(tops, "tree")
        if above is not None:
            here = here.unionByName(_climbed(level.where("n > 1"), above, run))
        above = here if i == 0 else saved(here.drop("digest", "n"))
    return above


def _climbed(nodes: DataFrame, above: DataFrame, run: int) -> DataFrame:
    """nodes (of trees of several) with the path over their siblings and then their parents'."""
    at_run = F.expr(f"idx div {run}").alias("_run")
    first = F.expr(f"(idx div {run}) * {run}")
    others = F.filter(F.sequence(first, F.least(first + run - 1, F.col("n") - 1)), lambda x: x != F.col("idx"))
    wanted = nodes.select("tree", at_run, "idx", F.explode(others).alias("at"))
    found = wanted.join(nodes.select("tree", F.col("idx").alias("at"), "digest"), ["tree", "at"])
    own = [c for c in nodes.columns if c not in ("tree", "idx")]
    mine = nodes.select("tree", at_run, "idx", F.struct(*own).alias("own"))
    rows = found.select("tree", "_run", "idx", F.struct("at", "digest").alias("sibling")).unionByName(mine, allowMissingColumns=True).repartition("tree", "_run")
    of_node = rows.groupBy("tree", "_run", "idx").agg(F.array_sort(F.collect_list("sibling")).alias("_s"), F.first("own", ignorenulls=True).alias("own"))

    def side(keep) -> Column:
        return F.array_join(F.transform(F.filter("_s", keep), lambda s: s["digest"]), "")

    step = F.struct(side(lambda s: s["at"] < F.col("idx")).alias("left"), side(lambda s: s["at"] > F.col("idx")).alias("right"))
    parents = above.withColumnRenamed("idx", "_run")
    down = [c for c in above.columns if c not in ("tree", "idx", "path")]
    return of_node.join(parents, ["tree", "_run"]).select("tree", "idx", *[F.col(f"own.{c}").alias(c) for c in own], F.concat(F.array(step), F.col("path")).alias("path"), *down)


_PATH = "array<struct<left:string,right:string>>"


def proven(leaves: DataFrame, run: int = RUN) -> DataFrame:
    """leaves (source, doc_id, leaf, claimed: the leaf as it is presented) with subroot, root and path."""
    rows = ordered(leaves, ["source", "doc_id", "leaf", "claimed"])
    portions = spans(rows, ["source"])
    names = ordered(portions.groupBy("source").agg(F.max("n").alias("_size")), ["source"])
    # a source's number is its place among the sources; one lookup a portion, then one a row by portion and source
    place = names.join(spans(names).withColumnRenamed("n", "_sources"), _portion() == F.col("_portion"))
    numbered = saved(place.select("source", (F.col("_at") - F.col("_first") + F.col("_before")).alias("tree"), "_sources"))
    known = portions.join(numbered.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).select("_portion", "_source", "_first", "_before", "n", "tree")
    found = rows.join(known, (_portion() == F.col("_portion")) & F.col("source").eqNullSafe(F.col("_source")))
    nodes = saved(found.select("tree", (F.col("_at") - F.col("_first") + F.col("_before")).alias("idx"), "n", F.col("leaf").alias("digest"), "doc_id", "claimed"))
    by_source = grown(nodes, run)
    subroots = saved(numbered.join(by_source.roots(), "tree").select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"), F.col("_sources").alias("n"), "digest"))
    whole = grown(subroots, run)
    root = whole.roots().select("tree", F.array().cast(_PATH).alias("path"), F.col("digest").alias("root"))
    tops = paths(whole, root, run).select(F.col("idx").alias("tree"), "path", F.col("digest").alias("subroot"), "root")
    return paths(by_source, saved(tops), run).withColumnRenamed("digest", "leaf")


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, start, lambda so_far, step: digest(step["left"], so_far, step["right"]))


def manifest(docs: DataFrame, tampered: Column | None = None, run: int = RUN) -> DataFrame:
    """Every row's leaf, roots, proof_sha256 (digest of its siblings from the leaf up) and whether the row as presented leads to the root.

    Rows where tampered holds are presented with their text's A-Z lower-cased.
    """
    wrong = F.coalesce(tampered, F.lit(False)) if tampered is not None else F.lit(False)
    leaves = docs.select("doc_id", "source", leaf().alias("leaf"), F.when(wrong, leaf(text=lowered(F.col("text")))).alias("other"))
    leaves = saved(leaves.select("doc_id", "source", "leaf", F.coalesce("other", "leaf").alias("claimed")))
    steps = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    out = proven(leaves, run).select("doc_id", "leaf", "subroot", "root", F.sha2(steps, 256).alias("proof_sha256"), folded(F.col("claimed"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def fifth(doc_id: str = "doc_id") -> Column:
    """Whether 5 divides the crc32 of the decimal id."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(5)) == 0


def _unrolled(name: str, levels: int) -> str:
    """Levels above {name}0 (tree, idx, n, digest), and each level's siblings."""
    up = [f"{name}{k + 1} AS MATERIALIZED (SELECT tree, idx // {RUN} AS idx, max((n + {RUN - 1}) // {RUN}) AS n, sha256(string_agg(digest, '' ORDER BY idx)) AS digest FROM {name}{k} WHERE n > 1 GROUP BY tree, idx // {RUN})" for k in range(levels)]
    near = [
        f"{name}s{k} AS MATERIALIZED (SELECT a.tree, a.idx, coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS l, coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS r "
        f"FROM {name}{k} a JOIN {name}{k} b ON a.tree = b.tree AND a.idx // {RUN} = b.idx // {RUN} WHERE a.n > 1 GROUP BY a.tree, a.idx)"
        for k in range(levels)
    ]
    return ",\n".join(up + near)


def oracle(levels: int = 8, source_levels: int = 4) -> str:
    """The manifest of documents for DuckDB; levels are unrolled, enough for 16 to that power of leaves."""
    def framed(c: str) -> str:
        return f"coalesce(CAST(octet_length(encode(CAST({c} AS VARCHAR))) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"

    def leaf_of(text: str) -> str:
        return "sha256(" + " || ".join(framed(text if f == "text" else f) for f in FIELDS) + ")"

    bit = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    byte = f"list_reduce([xor(crc, b)] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda c, i: {bit})"
    crc = f"xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda crc, b: {byte}), 4294967295)"
    low = f"translate(text, '{_UPPER}', '{_UPPER.lower()}')"
    fold, joins, parts = "claimed", [], []
    for name, k, idx in [("d", k, f"x.idx // {RUN**k}") for k in range(levels)] + [("t", k, f"x.tree // {RUN**k}") for k in range(source_levels)]:
        a = f"{name}s{k}"
        joins.append(f"LEFT JOIN {a} ON {a}.idx = {idx}" + (f" AND {a}.tree = x.tree" if name == "d" else ""))
        parts.append(f"coalesce({a}.l || {a}.r, '')")
        fold += f"|{a}"
    tops = " UNION ALL ".join(f"SELECT tree, digest FROM d{k} WHERE n = 1" for k in range(levels + 1))
    roots = " UNION ALL ".join(f"SELECT digest FROM t{k} WHERE n = 1" for k in range(source_levels + 1))
    # one column a step, so that each digest is worked out once
    first, *rest = fold.split("|")
    steps = [f"f0 AS (SELECT x.doc_id, x.tree, x.digest AS leaf, {first} AS so_far, sha256({' || '.join(parts)}) AS proof_sha256, {', '.join(f'{a}.l AS {a}l, {a}.r AS {a}r' for a in rest)} FROM d0 x {' '.join(joins)})"]
    steps += [f"f{i + 1} AS (SELECT * EXCLUDE (so_far, {a}l, {a}r), CASE WHEN {a}l IS NULL THEN so_far ELSE sha256({a}l || so_far || {a}r) END AS so_far FROM f{i})" for i, a in enumerate(rest)]
    return f"""WITH b AS (SELECT doc_id, source, {leaf_of('text')} AS leaf, CASE WHEN {crc} % 5 = 0 THEN {leaf_of(low)} END AS other FROM documents),
d0 AS MATERIALIZED (SELECT doc_id, leaf AS digest, coalesce(other, leaf) AS claimed, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
  row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, coalesce(other, leaf)) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n FROM b),
{_unrolled('d', levels)},
t0 AS MATERIALIZED (SELECT 0 AS tree, tree AS idx, (SELECT count(DISTINCT tree) FROM d0) AS n, digest FROM ({tops})),
{_unrolled('t', source_levels)},
{', '.join(steps)}
SELECT f.doc_id, f.leaf, t0.digest AS subroot, r.digest AS root, f.proof_sha256, f.so_far AS folded_root, f.so_far = r.digest AS verified
FROM f{len(rest)} f JOIN t0 ON t0.idx = f.tree CROSS JOIN ({roots}) r"""
