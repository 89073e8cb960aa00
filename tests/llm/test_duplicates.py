from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import jaccard, vectors
from tests_llm_brute import components  # noqa: I001


def brute(rows):
    sets = {}
    for d, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = frozenset(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))) if w else frozenset()
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 4 * min(len(x), len(y)) >= 3 * max(len(x), len(y)) and 100 * len(x & y) >= 75 * len(x | y):
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q)
    return {d: (len(sets[d]), root(d)) for d in sets}


def test_join_against_all_pairs(docs, rows):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs).collect()}
    want = brute(rows)
    assert got == want and len({c for _, c in want.values()}) < len(want)


def test_frequent_signatures_and_one_big_group(spark, monkeypatch):
    """Groups over the limits take the blocked way; nothing is lost."""
    import random

    monkeypatch.setattr(jaccard, "FREQUENT", 4)
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    monkeypatch.setattr(jaccard, "MEMBERS", 4)
    rng = random.Random(4)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(60):
        ws = list(base)
        for _ in range(rng.randint(0, 3)):
            ws[rng.randrange(60)] = f"v{rng.randrange(9)}"
        rows.append((i, " ".join(ws)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_bit_maps_rule_out_no_link():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 2**63, 3000).astype(np.uint64)
    for n in (1, 5, 40, 700):
        a = np.sort(rng.choice(pool, n, replace=False))
        b = np.sort(np.unique(np.concatenate([a[: n - n // 8], rng.choice(pool, n // 9 + 1)])))
        s = jaccard.Sets(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
        x, y = (np.frombuffer(m, np.uint8)[None] for m in jaccard.bit_maps(s))
        width = min(x.shape[1], y.shape[1])
        x, y = jaccard._folded(x, width), jaccard._folded(y, width)
        met = len(np.intersect1d(a, b))
        assert met <= len(a) - int(np.bitwise_count(x & ~y).sum()) and met <= len(b) - int(np.bitwise_count(y & ~x).sum())


def test_one_of_each_group_stays(docs, rows):
    want = {d for d, (_, c) in brute(rows).items() if d == c}
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == want


def test_null_and_repeated_ids(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(None, text), (None, "only here " * 20), (3, text), (3, text), (3, "another text " * 9), (5, text + " end")]
    got = sorted(((r.doc_id, r.component_id) for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(None, 3), (None, None), (3, 3), (3, 3), (3, 3), (5, 3)], key=str)


def test_empty(none, spark):
    assert jaccard.near_duplicates(none).isEmpty()
    assert vectors.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).isEmpty()


def made_vectors(n=400, width=24, seed=2):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(30, width))
    x = (centers[rng.integers(0, 30, n)] + rng.normal(size=(n, width)) * rng.choice([0.02, 0.1, 0.6], (n, 1))).astype(np.float32)
    x[10] = x[11]
    return x, rng.integers(0, 3, n)


def test_vectors_against_all_pairs(spark):
    x, labels = made_vectors()
    rows = [(i, v.tolist(), int(k), "clash") for i, (v, k) in enumerate(zip(x, labels, strict=True))]
    rows += [(1000, None, 1, ""), (1001, [0.0] * 24, 1, ""), (1002, [float("nan")] * 24, 1, ""), (1003, [None] * 24, 1, ""), (1004, x[10].tolist(), None, ""), (1005, [1.0] * 3, 1, ""), (1006, [float("inf")] * 24, 1, ""), (1007, [], 1, "")]
    got = {r.vec_id: r for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, class_id string")).collect()}
    unit = x.astype(float) / np.sqrt((x.astype(float) ** 2).sum(1, keepdims=True))
    want = vectors.exact_links(unit, labels)
    shown = sum(got[i].n_links for i in range(len(x))) / 2
    assert 0.9 * len(want) <= shown <= len(want) and want
    parent = list(range(len(x)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in sorted(want):
        p, q = root(a), root(b)
        parent[max(p, q)] = min(p, q)
    assert all(root(got[i].component_id) == root(i) for i in range(len(x)))  # no group joins what isn't linked
    assert sum(got[i].component_id == root(i) for i in range(len(x))) >= 0.95 * len(x)
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in range(1000, 1008))


def test_vector_buckets_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 16)
    rng = np.random.default_rng(9)
    x = (rng.normal(size=(1, 16)) + 0.01 * rng.normal(size=(90, 16))).astype(np.float32)
    got = vectors.near_duplicates(spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")).collect()
    assert all(r.component_id == 0 for r in got) and sum(r.n_links for r in got) >= 0.9 * 90 * 89


def links_shown(spark, x, labels):
    got = vectors.near_duplicates(spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, labels, strict=True))], "vec_id long, embedding array<float>, label int")).collect()
    unit = x.astype(float) / np.sqrt((x.astype(float) ** 2).sum(1, keepdims=True))
    want = len(vectors.exact_links(unit, labels))
    shown = sum(r.n_links for r in got) / 2
    print("links shown", shown, "of", want)
    return shown / want


@pytest.mark.parametrize("noise", [0.01, 0.15])
def test_recall_in_one_tight_group(spark, noise):
    """Also among vectors that are mostly one group, whose center is the mean."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(1, 48)) + noise * rng.normal(size=(600, 48))
    x[500:] = rng.normal(size=(100, 48))
    assert links_shown(spark, x.astype(np.float32), np.zeros(600, int)) >= 0.9


def test_recall_on_the_embeddings(spark):
    """The table holds no links of its own, so each vector gets a partner just within the threshold."""
    import os

    at = "/root/testdata/sf0.1/embeddings.parquet"
    if not os.path.exists(at):
        pytest.skip("no test tables")
    rows = spark.read.parquet(at).toPandas()
    x = np.array(rows["embedding"].tolist(), float)
    x /= np.sqrt((x**2).sum(1, keepdims=True))
    aside = np.random.default_rng(6).normal(size=x.shape)
    aside -= (aside * x).sum(1, keepdims=True) * x
    aside /= np.sqrt((aside**2).sum(1, keepdims=True))
    both = np.concatenate([x, 0.9801 * x + np.sqrt(1 - 0.9801**2) * aside]).astype(np.float32)
    assert links_shown(spark, both, np.tile(rows["label"].to_numpy(), 2)) >= 0.99


def test_vectors_of_every_length(spark, monkeypatch):
    """Lengths beyond the most frequent ones, and no link between lengths."""
    monkeypatch.setattr(vectors, "LEARNED", 1)
    rng = np.random.default_rng(4)
    rows = []
    for width in (3, 8, 9, 20, 20):
        rows += [(len(rows) + i, (rng.normal(size=width) * 0 + np.arange(1, width + 1) + 0.001 * rng.normal(size=width)).tolist(), 0) for i in range(6)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {i: (5, i // 6 * 6) if i < 18 else (11, 18) for i in range(30)}


@pytest.mark.parametrize("edges", [[(1, 2), (2, 3), (5, 4)], [(i, i + 1) for i in range(60)], [(1, 1)], []])
def test_components(spark, edges):
    from tidemark.llm.graph import components

    got = {r.node: r.component for r in components(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    assert set(got) == nodes
    if len(edges) == 60:
        assert set(got.values()) == {0}
    elif len(edges) == 3:
        assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4}


def test_extra_columns_are_ignored(docs):
    assert jaccard.near_duplicates(docs.select("doc_id", "text", F.lit(1).alias("component_id"))).columns == ["doc_id", "n_shingles", "component_id"]


@pytest.mark.parametrize("frequent", [3, 12])
def test_common_passages(spark, monkeypatch, frequent):
    """Documents that are mostly passages that many others hold too."""
    import random

    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    rng = random.Random(8)
    passages = [[f"p{k}x{i}" for i in range(rng.choice([40, 90, 150]))] for k in range(3)]
    rows = []
    for i in range(140):
        if rows and rng.random() < 0.3:
            ws = rng.choice(rows)[1].split(" ")
            for _ in range(rng.randint(0, 1 + len(ws) // 25)):
                ws[rng.randrange(len(ws))] = f"e{rng.randrange(10**6)}"
        else:
            ws = [f"u{rng.randrange(10**6)}" for _ in range(rng.randint(0, 120))]
            at = rng.randint(0, len(ws))
            ws[at:at] = rng.choice(passages)
            if rng.random() < 0.3:
                ws += rng.choice(passages)
        rows.append((i, " ".join(ws)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute(rows)
    assert got == want and len({c for _, c in want.values()}) < 140


def test_repeated_and_missing_ids_in_keep_one(spark):
    a, b = " ".join(f"w{i}" for i in range(60)), " ".join(f"u{i}" for i in range(60))
    near = a.replace("w59", "x")
    rows = [(1, a, "p"), (5, a, "q"), (5, b, "r"), (7, near, "s"), (None, near, "t"), (None, "z " * 30, "u"), (9, b, "v"), (9, b, "v"), (3, None, "w"), (3, "", "x"), (4, b, "y"), (4, b, "y")]
    kept = jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert sorted(((r.doc_id, r.source) for r in kept.collect()), key=str) == sorted([(1, "p"), (4, "y"), (None, "u"), (3, "w"), (3, "x")], key=str)


def test_a_text_without_id_links_others(spark):
    words = [f"w{i}" for i in range(200)]
    one, two, three = words[:160], words[12:172], words[24:184]  # neighbours are linked, the outer ones aren't
    rows = [(4, " ".join(one)), (None, " ".join(two)), (2, " ".join(three))]
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {4: 2, None: 2, 2: 2}


def test_a_passage_in_every_set_makes_few_pairs(spark):
    import random

    rng = random.Random(5)
    passage = [f"p{i}" for i in range(120)]
    texts = [" ".join(passage + [f"{k}x{rng.randrange(10**9)}" for _ in range(60 if k % 3 else 15)]) for k in range(400)]
    texts += [" ".join(t.split(" ")[:-3] + ["a", "b", "c"]) for t in texts[:40]]
    want = components(dict(enumerate(texts)))
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == want
