"""Held-out accuracy and edge cases of what is trained."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import brown, language, quality
from tidemark.llm.queries import fold

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_language_held_out(spark, real):
    model = language.fit(real.where(fold(3) != 1))
    got = language.identify(real, model).join(real.select("doc_id", "lang"), "doc_id").where((fold(3) == 1) & F.col("lang").isNotNull()).collect()
    known = [r for r in got if r.lang_pred != "und"]
    assert len(known) > 100 and sum(r.lang_pred == r.lang for r in known) / len(known) > 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_language_edges(docs, none):
    model = language.fit(docs)
    got = {r.doc_id: r for r in language.identify(docs, model).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert set(got) == set(texts)
    for d, t in texts.items():
        assert (got[d].lang_pred == "und") == (not any(c.isalpha() for c in t or "")) and (got[d].lang_pred != "und" or (got[d].score == 0 and got[d].rejected))
    assert language.keep_identified(docs, model).columns == docs.columns
    nothing = language.fit(none)
    assert {r.lang_pred for r in language.identify(docs, nothing).collect()} == {"und"} and language.identify(none, model).isEmpty()


def test_language_prediction_needs_only_the_text(docs):
    model = language.fit(docs)
    swapped = docs.withColumns({"lang": F.lit("xx"), "source": F.lit("yy"), "doc_id": F.col("doc_id") + 1000})
    key = lambda df: sorted((r.lang_pred, r.score) for r in language.identify(df, model).collect())
    assert key(docs) == key(swapped)


def test_quality_held_out(spark, real):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = quality.classify(real, labels, fold(5) == 0).join(labels.where("quality IS NOT NULL"), "doc_id").where("held_out").collect()
    ones, zeros = [r.score for r in got if r.quality == 1], [r.score for r in got if r.quality == 0]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in ones for b in zeros])
    assert len(got) > 30 and auc > 0.85
    assert all(r.predicted == (r.score >= 0.3) for r in got)


def test_quality_edges(spark, docs, none):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(3, None, 0), (4, 1, 1), (None, 1, 1), (999, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, labels, fold(5) == 0).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in quality.classify(docs, labels.where("quality = 1"), fold(5) == 0).collect()} == {1.0}
    assert {r.score for r in quality.classify(docs, labels.where("quality = 7"), fold(5) == 0).collect()} == {0.5}
    assert quality.classify(none, labels, fold(5) == 0).isEmpty()


def test_quality_statistics_against_a_loop(rows):
    """Every statistic, one text after another, word by word."""
    letters = set(range(65, 91)) | set(range(97, 123)) | set(range(128, 256))
    kinds = {"upper": set(range(65, 91)), "digit": set(b"0123456789"), "punctuation": set(b",;:'\"()-"), "symbol": set(b"#*$%&<>{}[]=+~^_\\/@"), "bar": set(b"|"), "exclaim": set(b"!?"), "stop": set(b"."), "other_bytes": set(range(128, 256))}
    extra = ["THE END. THE END.\n\nthe the THE", "a|b #x $1 (c); d! e?\nsame\nsame\nsame\n", "A", "été ÉTÉ 12 1a __ antidisestablishment"]
    texts = [r[1] for r in rows] + extra

    def loop(text):
        raw = (text or "").encode()
        words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
        n, sizes, low = len(words), [len(w) for w in words], [w.lower() for w in words]
        some, chars = max(n, 1), max(sum(sizes), 1)
        mean = chars / some
        lines = [x for x in raw.split(b"\n") if x]
        out = {k: sum(b in v for b in raw) / chars for k, v in kinds.items()}
        out |= {"words": math.log1p(n), "mean_length": math.log1p(mean) if n else 0.0, "length_spread": math.log1p(math.sqrt(max(sum(x * x for x in sizes) / some - mean**2, 0)))}
        out |= {"lines": math.log1p(len(lines)), "line_words": math.log1p(n / max(len(lines), 1)), "repeat_lines": 1 - len(set(lines)) / len(lines) if lines else 0.0}
        out |= {"distinct": len(set(low)) / some, "long_words": sum(x > 12 for x in sizes) / some, "short_words": sum(x <= 3 for x in sizes) / some}
        out |= {"upper_words": sum(len(w) > 1 and all(b in kinds["upper"] for b in w) for w in words) / some, "symbol_words": sum(any(b in kinds["symbol"] for b in w) for w in words) / some}
        out |= {"bare_words": sum(not any(b in letters for b in w) for w in words) / some, "repeat_next": sum(a == b for a, b in zip(low, low[1:], strict=False)) / some}
        for k in quality.SHARES:
            share = min(max(out[k], 0), 1)
            out[k] = math.log((share + 0.002) / (1.002 - share))
        return [min(max(out[k], -quality.CLIP), quality.CLIP) for k in quality.NAMES]

    got = quality.statistics(pa.array(texts))
    for text, row in zip(texts, got, strict=True):
        assert np.allclose(row, loop(text), atol=1e-5), (text or "")[:80]


def test_quality_scores_against_a_loop(spark, docs, rows):
    """Sums, shrinkage and densities written out; slope and offset are the model's own."""
    labels = {i: i % 2 for i in range(0, 160, 3)}
    held = lambda d: zlib.crc32(str(d).encode()) % 5 == 0
    x = {r[0]: v for r, v in zip(rows, quality.statistics(pa.array([r[1] for r in rows])), strict=True)}
    d = len(quality.NAMES)
    parts = [np.array([x[i] for i, y in labels.items() if y == k and not held(i)]) for k in (0, 1)]
    spread = [np.cov(p.T, bias=True) for p in parts]
    pooled = sum(len(p) * c for p, c in zip(parts, spread, strict=True)) / sum(map(len, parts))
    spread = [0.9 * c + 0.1 * pooled for c in spread]
    spread = [0.9 * c + 0.1 * np.diag(np.diag(c)) + 1e-3 * np.eye(d) for c in spread]
    density = lambda v, k: -0.5 * (v - parts[k].mean(0)) @ np.linalg.inv(spread[k]) @ (v - parts[k].mean(0)) - 0.5 * np.linalg.slogdet(spread[k])[1]
    table = spark.createDataFrame([(i, y, 0) for i, y in labels.items()], "doc_id long, quality int, toxic int")
    twice = docs.union(docs.where("doc_id % 2 = 0"))  # repeated rows don't change the fit
    got = quality.classify(twice, table, fold(5) == 0).collect()
    known = {i for i in labels if not held(i)}
    frame = spark.createDataFrame([(int(i), [float(a) for a in x[i]], labels[i]) for i in sorted(known)], "doc_id long, x array<double>, label int")
    model = quality.fit(frame)
    assert len(got) == len(rows) + sum(r[0] % 2 == 0 for r in rows)
    for r in got:
        z = model.slope * (density(x[r.doc_id], 1) - density(x[r.doc_id], 0)) + model.offset
        assert math.isclose(r.score, 1 / (1 + math.exp(-min(max(z, -30), 30))), rel_tol=1e-4, abs_tol=1e-9)


def test_quality_fit_repeats_where_ids_share_texts(spark, docs):
    """Other texts under an id that is there already: any order of rows gives the same scores."""
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(100)], "doc_id long, quality int, toxic int")
    other = docs.withColumn("text", F.reverse("text"))
    a, b = (quality.classify(d, labels, fold(5) == 0).groupBy("doc_id").agg(F.sort_array(F.collect_list("score")).alias("s")).collect() for d in (docs.union(other), other.repartition(5).union(docs)))
    assert {r.doc_id: [round(v, 9) for v in r.s] for r in a} == {r.doc_id: [round(v, 9) for v in r.s] for r in b}


def test_discriminant_on_known_densities():
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(4000, 3)), rng.normal(size=(4000, 3)) * [1, 2, 0.5] + 1
    sums = {k: (len(x), x.sum(0), x.T @ x) for k, x in enumerate((a, b))}
    model = quality.discriminant(sums, 0.0, 0.0)
    x = rng.normal(size=(50, 3))
    density = lambda m, c: -0.5 * np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m) - 0.5 * np.linalg.slogdet(c)[1]
    want = density(b.mean(0), np.cov(b.T, bias=True)) - density(a.mean(0), np.cov(a.T, bias=True))
    assert np.allclose(quality.difference(model, x), want, atol=0.1, rtol=0.03)


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), None]


def test_brown_base_against_a_loop(docs, rows):
    held = lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    counts = Counter(t for d, x, *_ in rows if not held(d) for t in tokens(x))
    n, v = sum(counts.values()), len(counts)
    got = {r.doc_id: r for r in brown.score(docs, fold(7) == 2).collect()}
    assert set(got) == {r[0] for r in rows}
    for d, x, *_ in rows:
        ts = tokens(x)
        assert got[d].held_out == held(d) and got[d].n_tokens == len(ts) and got[d].n_known == sum(counts[t] > 0 for t in ts) and got[d].train_tokens == n
        assert math.isclose(got[d].base_score, sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in ts), rel_tol=1e-9)
        assert got[d].score < 0 and math.isfinite(got[d].score)


def test_brown_rare_words_way_gives_the_same(docs, monkeypatch):
    """With a tiny head most words are counted by the join."""
    whole = {r.doc_id: r for r in brown.score(docs, fold(7) == 2).collect()}
    monkeypatch.setattr(brown, "HEAD", 64)
    monkeypatch.setattr(brown, "CORE", 16)
    for r in brown.score(docs, fold(7) == 2).collect():
        assert (r.n_known, r.n_tokens) == (whole[r.doc_id].n_known, whole[r.doc_id].n_tokens) and math.isclose(r.base_score, whole[r.doc_id].base_score, rel_tol=1e-9)


def test_brown_beats_the_base_on_held_out_text(real):
    got = brown.score(real, fold(7) == 2).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert got.s > got.b


def test_brown_probabilities_sum_to_one(spark):
    text = "a b a c b a b d a b c e a b"
    df = spark.createDataFrame([(i, text) for i in range(5)], "doc_id long, text string")
    vocabulary = brown.word_counts(df)
    m = brown.train(df, vocabulary)
    known = 10 ** (np.log10(m.counts) - np.log10(np.maximum(m.masses, 1))[m.classes]) * (1 - m.unknown[m.classes])
    in_class = np.bincount(m.classes, known, len(m.masses)) + m.unknown
    used = m.masses > 0
    assert np.allclose(in_class[used], 1) and np.allclose((10**m.transitions)[used][:, used].sum(1), 1, atol=1e-6)


def test_brown_empty(none, docs):
    assert brown.score(none, fold(7) == 2).isEmpty()
    got = brown.score(docs, F.lit(True)).collect()  # no training row
    assert all(r.train_tokens == 0 and r.n_known == 0 and math.isfinite(r.score) for r in got)


def test_exchange_raises_the_likelihood():
    rng = np.random.default_rng(1)
    n = 40
    group = rng.integers(0, 4, n)
    bigrams = rng.poisson(0.3 + 6 * (group[:, None] == (group[None, :] + 1) % 4)).astype(float)
    counts = bigrams.sum(0)

    def likelihood(of):
        one = np.eye(6)[of]
        grid, mass = one.T @ bigrams @ one, one.T @ counts
        return brown._f(grid).sum() - 2 * brown._f(mass).sum()

    start = np.concatenate([[0], 2 + np.arange(n - 2) % 4, [1]])
    assert likelihood(brown.exchange(bigrams, counts, 6, 8)) > likelihood(start)


def test_signs_that_are_no_letters_have_no_language(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["\u00b2", "\u00bd \u2153", "12 _ \u2460", "a\u00b2", "\u65e5"])], "doc_id long, text string")
    train = spark.createDataFrame([(i, f"{'the of and' if i % 2 else 'le de et'} {i}", "en" if i % 2 else "fr") for i in range(40)], "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in language.identify(docs, language.fit(train)).collect()}
    assert [got[i] == "und" for i in range(5)] == [True, True, True, False, False]


def test_rows_that_repeat_dont_change_the_fit(spark):
    train = spark.createDataFrame([(i, f"{'the of and' if i % 2 else 'le de et'} {i}", "en" if i % 2 else "fr") for i in range(40)], "doc_id long, text string, lang string")
    one, two = language.fit(train), language.fit(train.union(train.limit(7)).repartition(3))
    assert (one.logits == two.logits).all() and one.languages == two.languages


def test_brown_gains_against_moving_each_word(spark):
    """The gain of every move equals the likelihood of the bigrams counted anew after it, less that before."""
    rng = np.random.default_rng(4)
    words, classes = 30, 6
    bigrams = rng.poisson(rng.gamma(0.3, 6, (words, words))).astype(float)
    of = np.concatenate([[0], 2 + rng.integers(0, classes - 2, words - 1)])
    counts = bigrams.sum(0)

    def likelihood(of):
        one = np.eye(classes)[of]
        x = one.T @ bigrams @ one
        return sum(v * math.log(v) for v in x.ravel() if v) - 2 * sum(v * math.log(v) for v in one.T @ counts if v)

    one = np.eye(classes)[of]
    apart = bigrams - np.diag(np.diag(bigrams))
    some = np.arange(1, words)
    got = brown.gains((apart @ one)[some], (apart.T @ one)[some], np.diag(bigrams)[some], counts[some], of[some], one.T @ bigrams @ one, one.T @ counts)
    assert np.isneginf(got[:, :2]).all()
    for row, w in enumerate(some):
        for b in range(2, classes):
            moved = of.copy()
            moved[w] = b
            assert math.isclose(got[row, b] - got[row, of[w]], likelihood(moved) - likelihood(of), rel_tol=1e-8, abs_tol=1e-6)


def test_brown_words_beyond_the_core_go_where_their_neighbours_say(spark, monkeypatch):
    """Two kinds of words alternate; those beyond the core, whose endings say nothing, join their kind's classes."""
    monkeypatch.setattr(brown, "CORE", 40)
    rng = np.random.default_rng(6)
    names = rng.permutation([f"{a}{b}{c}" for a in "bcdfghklmn" for b in "aeiou" for c in "rstvwxzpqj"])
    kinds = names[:150], names[150:300]
    share = 1 / np.arange(1, 151)
    share /= share.sum()
    texts = [" ".join(rng.choice(kinds[i % 2], p=share) for i in range(60)) for _ in range(1200)]
    df = spark.createDataFrame(list(enumerate(map(str, texts))), "doc_id long, text string").repartition(4).cache()
    m = brown.train(df, brown.word_counts(df))
    at = {int(h): k for k, h in enumerate(m.hashes)}
    hashes = brown.tokens(pa.array([" ".join(kinds[0]) + " " + " ".join(kinds[1])])).hashes[:-1]
    rank, group = np.array([at[int(h)] for h in hashes]), np.repeat([0, 1], 150)
    assert (m.counts[rank] >= brown.MIN_COUNT).all()
    mass = np.zeros((2, len(m.masses)))
    np.add.at(mass, (group, m.classes[rank]), m.counts[rank])
    late = rank >= 40
    assert late.sum() > 200 and (mass.argmax(0)[m.classes[rank[late]]] == group[late]).mean() > 0.98
    df.unpersist()


def test_brown_score_against_a_loop(docs, rows):
    """Probabilities of every token, one after another, from the model's classes and counts of the training texts."""
    held = lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    train = [x for d, x, *_ in rows if not held(d)]
    m = brown.train(docs.where(fold(7) != 2), brown.word_counts(docs.where(fold(7) != 2)))
    counts = Counter(t for x in train for t in tokens(x))
    at = {int(h): k for k, h in enumerate(m.hashes)}

    def classes(x):
        t = brown.tokens(pa.array([x]))
        return [int(m.classes[at[int(h)]]) if int(h) in at else int(m.by_ending[e]) for h, e in zip(t.hashes, t.endings, strict=True)]

    pairs, mass, single = Counter(), Counter(), Counter()
    for x in train:
        cs = classes(x)
        pairs.update(zip([brown.END, *cs], cs))
        mass.update(cs)
    for x in {t for t, c in counts.items() if c == 1 and isinstance(t, str)}:
        single[int(m.by_ending[brown.tokens(pa.array([x])).endings[0]])] += 1
    total, after = sum(mass.values()), Counter()
    for (a, _), n in pairs.items():
        after[a] += n
    got = {r.doc_id: r.score for r in brown.score(docs, fold(7) == 2).collect()}
    for d, x, *_ in rows:
        want, a = 0.0, brown.END
        for t, c in zip(tokens(x), classes(x), strict=True):
            share = mass[c] / total
            unknown = min(max((single[c] + 0.5) / (mass[c] + 1), 1e-6), 0.5)
            want += math.log10(max((pairs[a, c] + brown.BACK_OFF * share) / (after[a] + brown.BACK_OFF), 1e-12))
            want += math.log10((1 - unknown) * counts[t] / max(mass[c], 1)) if counts[t] else math.log10(unknown)
            a = c
        assert math.isclose(got[d], want, rel_tol=1e-6), d


def test_brown_head_holds_whole_ranges_of_counts(spark, monkeypatch):
    rows = [(k, 0, c) for k, c in enumerate([50, 40, 30, 9, 9, 9, 4, 4, 4, 4, 1, 1, 1])] + [(int(brown.END_HASH.view(np.int64)), 0, 2)]
    df = spark.createDataFrame(rows, "h long, ending int, c long")
    for size, want in ((10, [2, 4, 4, 4, 4, 9, 9, 9, 30, 40, 50]), (9, [2, 9, 9, 9, 30, 40, 50]), (14, sorted(c for _, _, c in rows)), (0, [2])):
        monkeypatch.setattr(brown, "HEAD", size)
        assert sorted(r.c for r in brown.frequent(df).collect()) == want
