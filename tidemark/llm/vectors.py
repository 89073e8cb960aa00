"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

A rotation for balanced binary codes is learned on a bounded sample (principal axes, then
alternately codes and the best orthogonal rotation). Every vector is coded; each code is
cut into parts, and each part is the key of a table: vectors of one label that share a
part meet in that table's bucket, where the original vectors' cosines decide. Several
independently started rotations give more tables for the same code length.

Exact copies count as one vector with a multiplicity until the end, so a group of copies
never fills a bucket. A bucket over BLOCK vectors is cut into blocks; its pairs of blocks
are separate tasks, each vector goes to as many tasks as there are blocks, and no pair of
vectors leaves a task: a task gives each vector's links that no earlier table has shown,
and a spanning set of linked vectors. Components come from rounds of smallest-neighbour
propagation with pointer jumping over those.

A vector that is null, empty or zero, or holds null or non-finite components, links with
nothing, as does one without a label. Vectors of different lengths link with nothing of
another length. Rows that share a vec_id keep a row each, with the same figures. Extra
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import saved
from tidemark.llm.graph import components

#: Vectors of a bucket that one task compares with each other, at most twice as many.
BLOCK = 2048
#: Bits of a code; least bits of a part; vectors a part's bucket may hold on average; share of links at the threshold that no table may show.
BITS, LEAST_PART, CROWD, MISSED = 64, 10, 512, 1e-3


#: Vector lengths that get learned rotations, each in a job of its own; the others share one job, with random rotations.
LEARNED = 64


class Codes(NamedTuple):
    center: np.ndarray
    rotations: np.ndarray  # (codes, width, bits)
    parts: int  # tables per code

    @property
    def tables(self) -> int:
        return len(self.rotations) * self.parts


def layout(n: int, angle: float) -> tuple[int, int]:
    """Codes, and parts of each, for n vectors: parts are long enough to spread them, tables enough to show a pair at this angle between the coded vectors.

    A bit tells vectors apart with their angle's share of a half turn.
    """
    length = max(LEAST_PART, math.ceil(math.log2(max(n, 1) / CROWD)))
    parts = max(1, BITS // length)
    unseen = 1 - (1 - min(max(angle, 1e-3), 3.0) / math.pi) ** length
    return max(1, math.ceil(math.log(MISSED) / math.log(unseen) / parts)), parts


def raw_angle(least: float) -> float:
    return math.acos(min(max(least, -1.0), 0.999999))


def coded_angle(sample: np.ndarray, center: np.ndarray, least: float, share: float) -> float:
    """The angle, as the codes of these vectors less the center see it, that this share of links at the threshold doesn't exceed.

    From pairs of sampled vectors that are linked, and from sampled vectors with partners
    made at the threshold.
    """
    rng = np.random.default_rng(12)
    some = sample[rng.permutation(len(sample))[:2000]]
    near = some @ some.T
    one, two = np.nonzero(np.triu((near >= least) & (near < 1 - 1e-9), 1))
    if len(one) > 4000:
        kept = np.argsort(near[one, two], kind="stable")[:4000]  # those next to the threshold
        one, two = one[kept], two[kept]
    aside = rng.normal(size=some.shape)
    aside -= (aside * some).sum(1, keepdims=True) * some
    aside /= np.maximum(np.sqrt((aside**2).sum(1, keepdims=True)), 1e-12)
    made = least * some + math.sqrt(max(0.0, 1 - least**2)) * aside
    axes = _axes(sample - center)
    x = (np.concatenate([some, some[one]]) - center) @ axes
    y = (np.concatenate([made, some[two]]) - center) @ axes
    cosine = (x * y).sum(1) / np.maximum(np.sqrt((x**2).sum(1) * (y**2).sum(1)), 1e-12)
    return float(np.quantile(np.arccos(np.clip(cosine, -1, 1)), share))


def planned(sample: np.ndarray, n: int, least: float) -> tuple[np.ndarray, tuple[int, int]]:
    """The center of the codes, and their layout. The mean is the center unless this makes the angle of some link twice as wide, as in a tight group near the mean."""
    mean, origin = sample.mean(0), np.zeros(sample.shape[1])
    center = mean if coded_angle(sample, mean, least, 1.0) <= 2 * raw_angle(least) else origin
    return center, layout(n, max(raw_angle(least), coded_angle(sample, center, least, 0.99)))


def _axes(x: np.ndarray) -> np.ndarray:
    _, axes = np.linalg.eigh(x.T @ x + 1e-9 * np.eye(x.shape[1]))
    return axes[:, ::-1][:, :BITS]


def learn(sample: np.ndarray, center: np.ndarray, codes: int, parts: int, rounds: int = 30, seed: int = 11) -> Codes:
    """Iterative quantisation of unit vectors, once per code from another random start."""
    x = sample - center
    axes = _axes(x)
    bits = axes.shape[1]
    projected = x @ axes
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(codes):
        rotation, _ = np.linalg.qr(rng.normal(size=(bits, bits)))
        for _ in range(rounds):
            binary = np.where(projected @ rotation >= 0, 1.0, -1.0)
            u, _, v = np.linalg.svd(projected.T @ binary)
            rotation = u @ v
        out.append(axes @ rotation)
    return Codes(center, np.array(out), parts)


def drawn(width: int, codes: int, parts: int) -> Codes:
    """Codes of random directions, the same for each length wherever they are made."""
    rng = np.random.default_rng([13, width])
    return Codes(np.zeros(width), rng.normal(size=(codes, width, BITS)), parts)


def keys(model: Codes, unit: np.ndarray) -> np.ndarray:
    """A row of table keys per vector; each part of a code as an integer."""
    out = []
    for rotation in model.rotations:
        binary = (unit - model.center) @ rotation >= 0
        for part in np.array_split(np.arange(binary.shape[1]), model.parts):
            out.append((binary[:, part].astype(np.int64) << np.arange(len(part))).sum(1))
    return np.stack(out, axis=1)


def unit_vectors(rows: pa.Array) -> np.ndarray:
    x = np.array(rows.to_pylist(), float)
    return x / np.sqrt((x**2).sum(1, keepdims=True))


def _classes(vectors: DataFrame) -> DataFrame:
    """One row per distinct usable vector of a label: class_id (smallest vec_id), label, v, copies."""
    usable = vectors.where("vec_id IS NOT NULL AND label IS NOT NULL AND size(embedding) > 0").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    good = usable.where(F.expr("forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('inf')) AND exists(v, x -> x != 0)"))
    plain = good.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))  # one zero
    return plain.distinct().groupBy("label", "v").agg(F.min("vec_id").alias("class_id"), F.count("*").alias("copies"))


def near_duplicates(vectors: DataFrame, least: float = 0.98, sample_rows: int = 10_000, tables: tuple[int, int] | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors: vec_id, embedding, label.

    sample_rows bounds the sample that the rotations are fitted on; every vector is indexed.
    tables gives the number of codes and of parts of each; without it layout() does.
    """
    spark = vectors.sparkSession
    classes = saved(_classes(vectors))
    widths = [r[0] for r in classes.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(LEARNED + 1).collect()]
    found = [_links(classes.where(F.size("v") == n), least, sample_rows, tables) for n in widths[:LEARNED]]
    if len(widths) > LEARNED:
        found.append(_links(classes.where(~F.size("v").isin(widths[:LEARNED])), least, None, tables))
    if not found:
        return vectors.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    links = found[0]
    for more in found[1:]:
        links = links.union(more)
    links = saved(links)
    counted = links.where("kind = 0").groupBy(F.col("a").alias("class_id")).agg(F.sum("b").alias("others"))
    labels = components(spark, links.where("kind = 1").select("a", "b"))
    per_class = classes.join(counted, "class_id", "left").join(labels.withColumnsRenamed({"node": "class_id"}), "class_id", "left")
    figures = per_class.select("label", "v", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "class_id").alias("component_id"))
    keyed = vectors.select("vec_id", F.col("label").cast("long").alias("of"), F.transform(F.col("embedding").cast("array<double>"), lambda x: x + F.lit(0.0)).alias("w"))
    out = keyed.join(figures, (keyed["of"] == figures["label"]) & (keyed["w"] == figures["v"]), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def _links(classes: DataFrame, least: float, sample_rows: int | None, tables: tuple[int, int] | None) -> DataFrame:
    """kind 0: class a has b linked vectors not shown by an earlier table; kind 1: classes a and b are linked.

    classes are of one length, on whose sample codes are learned, or without sample_rows of
    any, with codes drawn for each; only vectors of one length meet.
    """
    spread = 1_000_003
    n = classes.count()
    model = None
    if sample_rows is None:
        codes, parts = tables or layout(n, raw_angle(least))
    else:
        drawn_row = F.pmod(F.xxhash64("class_id"), F.lit(spread))
        sample = classes.where(drawn_row <= int(spread * min(1.0, sample_rows / max(n, 1)))).select("v").limit(2 * sample_rows).toArrow()
        if not sample.num_rows:
            sample = classes.select("v").limit(2 * sample_rows).toArrow()
        unit = unit_vectors(sample.column(0).combine_chunks())
        center, (codes, parts) = planned(unit, n, least)
        if tables:
            codes, parts = tables
        model = learn(unit, center, codes, parts)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = np.array([len(v) for v in batch.column(2)])
            for width in np.unique(widths):
                some = batch.take(pa.array(np.flatnonzero(widths == width)))
                k = keys(model or drawn(int(width), codes, parts), unit_vectors(some.column(2)))
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(list(k), pa.list_(pa.int64()))], names=["class_id", "label", "v", "copies", "codes"])

    coded = saved(classes.select("class_id", "label", "v", "copies").mapInArrow(index, "class_id long, label long, v array<double>, copies long, codes array<long>"))
    spots = coded.select("class_id", "label", F.size("v").alias("width"), F.posexplode("codes").alias("t", "key"))
    sizes = spots.groupBy("label", "width", "t", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared = spots.join(sizes, ["label", "width", "t", "key"])
    # a bucket of up to BLOCK is one task group; a larger one has a group per pair of its blocks
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("class_id"), blocks).cast("int")
    grouped = shared.withColumn("blocks", blocks).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = grouped.select("class_id", "label", "width", "t", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own")
    carried = placed.join(coded.select("class_id", "v", "copies", "codes"), "class_id")

    def compare(group: pa.Table) -> pa.Table:
        t, i, j = (group.column(c)[0].as_py() for c in ("t", "i", "j"))
        ids = group.column("class_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        x = unit_vectors(group.column("v").combine_chunks())[order]
        copies = group.column("copies").to_numpy()[order]
        code = np.array(group.column("codes").to_pylist())[order]
        block = group.column("own").to_numpy()[order]
        counts, ends = np.zeros(len(ids), np.int64), np.arange(len(ids))
        for at in range(0, len(ids), 256):
            rows = slice(at, at + 256)
            linked = x[rows] @ x.T >= least
            linked &= np.arange(len(ids))[None, :] != np.arange(len(ids))[rows, None]
            if i != j:
                linked &= block[rows, None] != block[None, :]
            one, two = np.nonzero(linked)
            one += at
            fresh = ~(code[one, :t] == code[two, :t]).any(axis=1)  # an earlier table has shown the others
            one, two = one[fresh], two[fresh]
            counts += np.bincount(one, weights=copies[two], minlength=len(ids)).astype(np.int64)
            ends = joined_ends(ends, one, two)
        shown = np.flatnonzero(counts)
        joined = np.flatnonzero(ends != np.arange(len(ids)))
        kind = np.repeat([0, 1], [len(shown), len(joined)])
        return pa.table({"kind": pa.array(kind, pa.int32()), "a": pa.array(np.concatenate([ids[shown], ids[joined]]), pa.int64()), "b": pa.array(np.concatenate([counts[shown], ids[ends[joined]]]), pa.int64())})

    return carried.groupBy("label", "width", "t", "key", "i", "j").applyInArrow(compare, "kind int, a long, b long")


def joined_ends(ends: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Each member's smallest known fellow after links from one to two."""
    while len(one):
        low = np.minimum(ends[one], ends[two])
        if (ends[one] == low).all() and (ends[two] == low).all():
            break
        new = ends.copy()
        np.minimum.at(new, ends[one], low)
        np.minimum.at(new, ends[two], low)
        np.minimum.at(new, one, low)
        np.minimum.at(new, two, low)
        ends = new[new]
    while (ends[ends] != ends).any():
        ends = ends[ends]
    return ends


def exact_links(x: np.ndarray, labels: np.ndarray, least: float = 0.98) -> set[tuple[int, int]]:
    """Brute force over unit vectors, for tests."""
    s = (x @ x.T >= least) & (labels[:, None] == labels[None, :])
    return {(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(s, 1)), strict=True)}
