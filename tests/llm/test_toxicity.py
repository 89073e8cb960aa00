from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import toxicity as T

RULES = T.grammar()


def best(text: str, weights: dict[str, float] | None = None) -> float:
    found, _ = T.matches(text, T.Lexicon(weights or {}), RULES)
    return max((m.score for m in found), default=0.0)


def test_clauses_not_words():
    plain, aimed, told, denied = best("An idiot came."), best("You are an idiot."), best("She was told what he said about an idiot."), best("He is not an idiot.")
    assert aimed > plain > told > 0 and plain > denied > 0
    assert best("They will kill you.") > best("They kill time.") > 0
    assert best("You idiot") > best('He wrote "you idiot" there')
    assert best("Good morning. How are you?") == 0
    # a scope ends with its clause
    assert best("That is not so. An idiot came.") == plain
    assert best("Du bist ein Trottel") > best("Er ist kein Trottel") > 0


def loop(text: str, lexicon: T.Lexicon) -> float:
    """The grammar's meaning by a loop over a clause's words, without machines."""
    total, negated, told, quoted, person, insult, threat, last = 0.0, 0, False, False, 0, 0, 0, 0.0
    for w in T._TOKEN.findall(text.lower()):
        kind, weight = lexicon[w]
        last = weight or last
        if kind == T.NEGATION:
            negated, out = T.SCOPE, None
        else:
            out = "negated" if negated and kind in (T.INSULT, T.THREAT) else None
            negated = max(negated - 1, 0)
        if kind == T.REPORT:
            told = True
        if kind == T.QUOTE:
            quoted = not quoted
        if out is None and (told or quoted) and kind in (T.INSULT, T.THREAT):
            out = "reported"
        near_person, near_insult, near_threat = person, insult, threat
        person, insult, threat = max(person - 1, 0), max(insult - 1, 0), max(threat - 1, 0)
        if out is None and kind == T.TARGET:
            person, insult = T.NEAR, 0
            out = "aimed" if near_insult else "target"
            if near_threat:
                out, threat = "fulfilled", 0
        elif out is None and kind == T.INSULT:
            insult, out = T.NEAR, "targeted" if near_person else "insult"
        elif out is None and kind == T.THREAT:
            threat, out = T.NEAR, "threat"
        factor = {"negated": T.NEGATED, "reported": T.REPORTED, "aimed": T.AIMED, "fulfilled": T.FULFILLED, "targeted": T.TARGETED, "insult": T.INSULT, "threat": T.THREAT}.get(out)
        if factor is not None:
            total += T.FACTORS[factor] * (weight or last)
    return total


def test_composed_machine_against_a_loop():
    rng = random.Random(5)
    words = ["idiot", "scum", "kill", "you", "they", "not", "said", '"', "house", "tree", "runs"]
    lexicon = T.Lexicon({})
    for _ in range(3000):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(1, 14)))
        found, _ = T.matches(text, lexicon, RULES)
        if found:
            assert found[0].score == pytest.approx(loop(text, lexicon)), text
        else:
            assert not {"idiot", "scum", "kill"} & set(text.split())


def test_composition_is_one_after_the_other():
    rng = np.random.default_rng(1)
    parts = [T.negation(), T.reported_speech(), T.target(), T.threat()]
    for _ in range(300):
        symbols = rng.integers(0, 7, 20).tolist()
        want = symbols
        for p in parts:
            state, out = 0, []
            for x in want:
                out.append(int(p.output[state, x]))
                state = int(p.step[state, x])
            want = out
        state, got = 0, []
        for x in symbols:
            got.append(int(RULES.output[state, x]))
            state = int(RULES.step[state, x])
        assert got == want


@pytest.fixture(scope="module")
def learnt(spark):
    """Invented words: toxic documents have words that begin with zorg or grub, clean ones don't; a toxic document stands 300 times, nearly the same."""
    rng = random.Random(9)
    words = ["".join(rng.choice("aeilnrst") for _ in range(rng.randint(3, 9))) for _ in range(600)]
    rows, labels = [], []
    for i in range(1200):
        ws = [rng.choice(words) for _ in range(rng.randint(30, 90))]
        toxic = int(i % 6 == 0)
        if toxic:
            for _ in range(4):
                ws.insert(rng.randrange(len(ws)), rng.choice(["zorg", "grub"]) + rng.choice(words)[:4])
        rows.append((i, " ".join(ws)))
        labels.append((i, toxic))
    copy = " ".join(["plain"] + [w for w in words[:80]] + ["grubx"])
    for i in range(1200, 1500):
        rows.append((i, copy if i % 3 else copy.replace(words[5], "other")))
        labels.append((i, 1))
    docs = spark.createDataFrame([(*r, "x", 0.0) for r in rows], "doc_id long, text string, key string, score double").repartition(4)
    labels = spark.createDataFrame([*labels, (0, 0), (3, None), (4, 7), (None, 1)], "doc_id long, toxic int")
    return docs, labels


def held_out():
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1


def test_learns_from_labels(learnt):
    docs, labels = learnt
    out = T.classify(docs, labels, held_out()).where("doc_id < 1200").toPandas()
    assert len(out) == 1200
    mine = out[out.held_out]
    toxic = mine.doc_id % 6 == 0
    assert (mine.predicted[toxic] == 1).mean() > 0.97 and (mine.predicted[~toxic] == 0).mean() > 0.99
    # the copies' ordinary words are not learned, as they count once
    model = T.fit(docs, labels, held_out())
    assert {"zorg", "grub"} <= set(model.weights) and all(k.startswith(("zorg", "grub")) for k in model.weights)


def test_counts_against_a_loop(spark, learnt):
    docs, labels = learnt
    train = T.training(labels, held_out())
    ids = {r["doc_id"]: (r["label"], r["half"]) for r in train.collect()}
    assert 4 not in ids and ids[0][0] == 1
    want: dict = {}
    for r in docs.collect():
        if r["doc_id"] in ids:
            label, half = ids[r["doc_id"]]
            for key in {p for w in r["text"].split() for p in T.beginnings(w)} | {""}:
                want.setdefault(key, [0] * 4)[half * 2 + label] += 1
    got = {r["key"]: [r[f"n{k}"] for k in range(4)] for r in T.counts(docs, train).collect()}
    assert got == want


def test_any_rows(spark, docs, rows, none, learnt):
    _, labels = learnt
    out = T.classify(docs, labels.limit(0), held_out())
    assert out.count() == len(rows) and out.where("predicted = 1 OR score IS NULL OR score NOT BETWEEN 0 AND 1").isEmpty()
    assert T.classify(none, labels, held_out()).count() == 0
    odd = spark.createDataFrame([(None, "you idiot you scum, you worthless trash. you idiot"), (1, None), (2, ""), (2, ""), (3, "word " * 400_000), (4, '"' * 1000)], "doc_id long, text string")
    got = {(r["doc_id"], r["predicted"]) for r in T.classify(odd, labels.limit(0), held_out()).collect()}
    assert got == {(None, 1), (1, 0), (2, 0), (3, 0), (4, 0)}


def test_shares_of_the_real_table(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = T.classify(docs, labels, held_out()).join(labels, "doc_id").where("held_out AND toxic IS NOT NULL").toPandas()
    assert (out.predicted[out.toxic == 1] == 1).mean() > 0.7 and (out.predicted[out.toxic == 0] == 0).mean() > 0.97
