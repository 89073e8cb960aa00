"""Toxicity by a weighted finite-state pattern grammar over clauses.

Words become symbols by a lexical transducer: insults by a weighted automaton over their
letters, learned from labelled documents, and threats, targets, negations, reports and
quotation marks by short lists. Four transducers rewrite a clause's symbols: negation marks
what stands in its scope, reported speech what follows a reporting word or stands in
quotation marks, target what stands near a person, threat what a threatening word does to
one. They are composed into one machine; a clause's score is the sum over its path of an
insult's or threat's weight times the factor of the symbol that comes out. A document's
score is a logistic function of its clauses' scores.

An insult's weight is a lower bound (one standard error and a half) of the log odds of a
beginning of the word, or the whole word, between toxic and clean documents; a word has
the best weight of its beginnings. At most TRAIN_ROWS labelled documents (about; drawn by a
hash of their ids) are learned from, one of each group of copies, and at most LEXICON
entries are kept. The logistic function is fitted to documents whose words were weighed by
the other half, so that it isn't misled by words that only one document has.

Null and empty texts hold no clause and get the score of one without a match. Labels that
are null or neither 0 nor 1 count as none; of several labels of a document the highest
counts. Repeated rows get one result each. Without toxic or without clean training
documents the lists alone decide. An empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from itertools import product
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import saved, text_blocks, thrifty
from tidemark.llm.words import block_words, mix

TRAIN_ROWS = 100_000
LEXICON = 20_000
#: Toxic documents that an entry needs, and its weight at least.
LEAST_DOCS, LEAST_WEIGHT = 4, math.log(4)
SHORTEST, LONGEST = 4, 12
WHOLE_WORD = 24
SCOPE, NEAR = 3, 4
#: Entries of a task's memories, after which they start anew.
WORDS, COUNTS = 200_000, 500_000

INSULTS = frozenset("idiot moron stupid dumb loser scum trash pathetic worthless disgusting fool imbecile cretin vermin crétin débile ordure minable connard salaud dumm trottel abschaum versager widerlich arschloch estúpido imbécil basura asqueroso cabrón inútil".split())
THREATS = frozenset("kill hurt destroy burn hang shoot beat stab strangle tuer frapper brûler détruire pendre töten schlagen verbrennen vernichten erschießen matar golpear quemar destruir disparar".split())
TARGETS = frozenset("you your yours yourself he she him her they them their those these people tu toi te ton ta tes vous votre vos ils elles du dich dir dein deine ihr euch tú ti usted ustedes tu tus vosotros ellos ellas".split())
NEGATIONS = frozenset("not never no none nobody isn aren wasn don doesn didn without pas jamais aucun sans nicht nie kein keine keinen ohne nunca jamás ningún sin".split())
REPORTS = frozenset("said says say wrote writes called calls quoted claimed claims reported according dit disait écrit appelé selon cité sagte sagt schrieb nannte laut zitierte dijo dice escribió llamó según citó".split())
LISTED_WEIGHT = 3.0

_CLAUSE = re.compile(r"[^.!?;:\n]+")
_TOKEN = re.compile(r"[^\W\d_]+|[\"«»“”„]")
_QUOTES = frozenset("\"«»“”„")

# Symbols: other, insult, threat, target, negation, report, quote; then what the transducers write.
O, INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE, NEGATED, REPORTED, TARGETED, AIMED, FULFILLED = range(12)
#: A matched symbol's factor; AIMED is a target just after an insult and repeats part of its weight.
FACTORS = {INSULT: 1.0, THREAT: 0.6, NEGATED: 0.2, REPORTED: 0.4, TARGETED: 1.4, AIMED: 0.4, FULFILLED: 1.5}


class Transducer(NamedTuple):
    """A deterministic machine: step[state, symbol] and output[state, symbol]; it starts in state 0."""

    step: np.ndarray
    output: np.ndarray


def machine(states: Iterable, rule: Callable) -> Transducer:
    """From rule(state, symbol) -> (state, symbol) over all states, the first of which is the start."""
    states = list(states)
    at = {s: i for i, s in enumerate(states)}
    step, output = np.empty((len(states), len(range(12))), np.int16), np.empty((len(states), 12), np.int16)
    for s, x in product(states, range(12)):
        to, out = rule(s, x)
        step[at[s], x], output[at[s], x] = at[to], out
    return Transducer(step, output)


def composed(first: Transducer, second: Transducer) -> Transducer:
    """The machine that passes first's output on to second: a pair of states each, as far as they can be reached."""
    found = {(0, 0): 0}
    todo, step, output = [(0, 0)], [], []
    while todo:
        a, b = todo.pop(0)
        row, out = [], []
        for x in range(12):
            y = first.output[a, x]
            pair = (int(first.step[a, x]), int(second.step[b, y]))
            if pair not in found:
                found[pair] = len(found)
                todo.append(pair)
            row.append(found[pair])
            out.append(int(second.output[b, y]))
        step.append(row)
        output.append(out)
    return Transducer(np.array(step, np.int16), np.array(output, np.int16))


def negation() -> Transducer:
    """An insult or threat within SCOPE words after a negation is negated."""

    def rule(left: int, x: int) -> tuple[int, int]:
        if x == NEGATION:
            return SCOPE, O
        return max(left - 1, 0), NEGATED if left and x in (INSULT, THREAT) else x

    return machine(range(SCOPE + 1), rule)


def reported_speech() -> Transducer:
    """An insult or threat after a reporting word, or in quotation marks, is another's."""

    def rule(state: tuple[int, int], x: int) -> tuple[tuple[int, int], int]:
        told, quoted = state
        if x == REPORT:
            return (1, quoted), O
        if x == QUOTE:
            return (told, 1 - quoted), O
        return state, REPORTED if (told or quoted) and x in (INSULT, THREAT) else x

    return machine(product(range(2), range(2)), rule)


def target() -> Transducer:
    """An insult within NEAR words after a target is targeted; a target within NEAR words after an insult is aimed at."""

    def rule(state: tuple[int, int], x: int) -> tuple[tuple[int, int], int]:
        person, insult = (max(s - 1, 0) for s in state)
        if x == TARGET:
            return (NEAR, 0), AIMED if state[1] else TARGET
        if x == INSULT:
            return (person, NEAR), TARGETED if state[0] else INSULT
        return (person, insult), x

    return machine(product(range(NEAR + 1), range(NEAR + 1)), rule)


def threat() -> Transducer:
    """A target within NEAR words after a threat fulfils it."""

    def rule(left: int, x: int) -> tuple[int, int]:
        if x == THREAT:
            return NEAR, x
        if x in (TARGET, AIMED) and left:
            return 0, FULFILLED
        return max(left - 1, 0), x

    return machine(range(NEAR + 1), rule)


def grammar() -> Transducer:
    return composed(composed(composed(negation(), reported_speech()), target()), threat())


class Lexicon:
    """word -> (symbol, weight): the lists, and the automaton of learned beginnings (whole words end in `$`)."""

    def __init__(self, weights: dict[str, float]) -> None:
        self.weights = weights
        self.memory: dict[str, tuple[int, float]] = {}

    def __getitem__(self, word: str) -> tuple[int, float]:
        out = self.memory.get(word)
        if out is None:
            if len(self.memory) >= WORDS:
                self.memory.clear()
            out = self.memory[word] = self._symbol(word)
        return out

    def _symbol(self, word: str) -> tuple[int, float]:
        if word in _QUOTES:
            return QUOTE, 0.0
        weight = max((self.weights.get(p, 0.0) for p in beginnings(word)), default=0.0)
        if word in INSULTS:
            weight = max(weight, self.weights.get(f"{word}$", LISTED_WEIGHT))
        if weight >= LEAST_WEIGHT:
            return INSULT, weight
        for symbol, words in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)):
            if word in words:
                return symbol, LISTED_WEIGHT if symbol == THREAT else 0.0
        return O, 0.0


def beginnings(word: str) -> list[str]:
    """What the automaton may know of a word: its beginnings and, if it isn't too long, the whole."""
    out = [word[:n] for n in range(SHORTEST, min(len(word), LONGEST) + 1)]
    return [*out, f"{word}$"] if len(word) <= WHOLE_WORD else out


class Match(NamedTuple):
    """A clause that the grammar matched: its place in the text, score, and weight by written symbol."""

    start: int
    end: int
    score: float
    weights: dict[int, float]


def matches(text: str, lexicon: Lexicon, rules: Transducer) -> tuple[list[Match], int]:
    """The matched clauses of a text, and how many clauses with a word it has."""
    found, clauses = [], 0
    step, output = rules.step.tolist(), rules.output.tolist()
    for c in _CLAUSE.finditer(text):
        symbols = [lexicon[w] for w in _TOKEN.findall(c[0].lower())]
        clauses += bool(symbols)
        if not any(s in (INSULT, THREAT) for s, _ in symbols):
            continue
        state, last, weights = 0, 0.0, {}
        for symbol, weight in symbols:
            out = output[state][symbol]
            state = step[state][symbol]
            last = weight or last
            if out in FACTORS:
                weights[out] = weights.get(out, 0.0) + (weight or last)
        found.append(Match(c.start(), c.end(), sum(FACTORS[k] * v for k, v in weights.items()), weights))
    return found, clauses


NAMES = ("bias", "sum", "best", "clauses", "share", "targeted", "excused")
#: Coefficients before any training: a clause of a listed insult is near the threshold.
PRIOR = np.array([-3.0, 1.0, 1.0, 0.0, 0.0, 0.5, -1.0])


def statistics(text: str, lexicon: Lexicon, rules: Transducer) -> list[float]:
    """A document's figures for the logistic function."""
    found, clauses = matches(text, lexicon, rules)
    if not found:
        return [1.0] + [0.0] * (len(NAMES) - 1)
    of = [sum(m.weights.get(k, 0.0) for m in found) for k in (TARGETED, AIMED, FULFILLED, NEGATED, REPORTED)]
    return [1.0, math.log1p(sum(m.score for m in found)), math.log1p(max(m.score for m in found)), math.log1p(len(found)), len(found) / max(clauses, 1), math.log1p(sum(of[:3])), math.log1p(sum(of[3:]))]


def training(labels: DataFrame, held_out: Column, most: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, label, half of about so many labelled documents at most that aren't held out, by a hash of the id."""
    known = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").where(~held_out).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    known = saved(known)
    share = min(1.0, most / max(known.count(), 1))
    place = F.xxhash64(F.lit(11), "doc_id")
    drawn = known.where(F.pmod(place, F.lit(1 << 20)) < int(share * (1 << 20)))
    return drawn.withColumn("half", F.pmod(F.shiftright(place, 40), F.lit(2)).cast("int"))


def one_of_copies(docs: DataFrame, train: DataFrame) -> DataFrame:
    """Of train, the lowest id of each label's documents with one least hash of three-word runs: near copies mostly share it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches):
            w = block_words(block.column(block.schema.get_field_index("text")))
            runs = mix(w.hashes[:-2] * np.uint64(3) + w.hashes[1:-1] * np.uint64(5) + w.hashes[2:]) if len(w.hashes) > 2 else np.empty(0, np.uint64)
            least = [int(runs[a:b].min()) if (b := e - 2) > a else int(mix(w.hashes[a:e]).min(initial=np.uint64(0))) for a, e in zip(w.first[:-1], w.first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([block.column(0), block.column(1), block.column(2), pa.array(np.array(least, np.uint64).view(np.int64))], names=["doc_id", "label", "half", "least"])

    rows = docs.select("doc_id", "text").join(F.broadcast(train), "doc_id").select("doc_id", "label", "half", "text")  # train is bounded
    keys = rows.mapInArrow(thrifty(run), "doc_id long, label int, half int, least long")
    return saved(keys.groupBy("label", "least").agg(F.min_by(F.struct("doc_id", "half"), "doc_id").alias("d")).select("d.doc_id", "label", "d.half").distinct())


def counts(docs: DataFrame, train: DataFrame) -> DataFrame:
    """key, and how many clean and toxic documents of each half have a word that begins so: n0 .. n3, the number is half * 2 + label. The empty key counts the documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [Counter() for _ in range(4)]

        def sent() -> Iterator[pa.RecordBatch]:
            for k, c in enumerate(seen):
                if c:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c)), pa.array([k] * len(c), pa.int32()), pa.array(list(c.values()), pa.int64())], names=["key", "k", "n"])
                    c.clear()

        for block in text_blocks(batches):
            for label, half, text in zip(*(c.to_pylist() for c in block.columns), strict=True):
                words = set(_TOKEN.findall((text or "").lower()))
                seen[half * 2 + label].update({p for w in words for p in beginnings(w)} | {""})
                if sum(map(len, seen)) > COUNTS:
                    yield from sent()
        yield from sent()

    rows = docs.select("doc_id", "text").join(F.broadcast(train), "doc_id").select("label", "half", "text")
    parts = rows.mapInArrow(thrifty(run), "key string, k int, n long")
    return saved(parts.groupBy("key").agg(*[F.sum(F.when(F.col("k") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in range(4)]))


def learned(counted: DataFrame, halves: tuple[int, ...], most: int = LEXICON) -> dict[str, float]:
    """The weights of the entries of the most evidence, from the halves given."""
    clean, toxic = (sum((F.col(f"n{h * 2 + k}") for h in halves), F.lit(0)) for k in range(2))
    size = counted.where("key = ''").select(clean, toxic).first()
    if size is None or not size[0] or not size[1]:
        return {}
    odds = F.log((toxic + 0.5) / (size[1] + 1)) - F.log((clean + 0.5) / (size[0] + 1))
    weight = odds - 1.5 * F.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5))
    fit = counted.where("key != ''").where(toxic >= LEAST_DOCS).select("key", weight.alias("weight"), toxic.alias("docs")).where(F.col("weight") >= LEAST_WEIGHT)
    best = fit.orderBy(F.desc(F.col("weight") * F.sqrt("docs")), "key").limit(most)
    return {r["key"]: r["weight"] for r in best.collect()}  # bounded by most


def logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray = PRIOR, strength: float = 1.0) -> np.ndarray:
    """Coefficients by Newton's method, drawn towards prior."""
    b = prior.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        gradient = x.T @ (p - y) + strength * (b - prior)
        move = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + strength * np.eye(len(b)), gradient)
        b = b - move * min(1.0, 5 / max(float(np.abs(move).max()), 1e-12))
        if np.abs(move).max() < 1e-9:
            break
    return b


class Model(NamedTuple):
    weights: dict[str, float]
    coefficients: np.ndarray


def _features(rows: DataFrame, lexica: dict[int, dict[str, float]], kept: list[str]) -> DataFrame:
    """rows: text, lexicon (a number) and kept columns; adds x."""
    rules = grammar()
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*kept).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {k: Lexicon(w) for k, w in lexica.items()}
        for block in text_blocks(batches):
            texts, which = (block.column(block.schema.get_field_index(c)).to_pylist() for c in ("text", "lexicon"))
            x = [statistics(t or "", known[k], rules) for t, k in zip(texts, which, strict=True)]
            yield pa.RecordBatch.from_arrays([*(block.column(block.schema.get_field_index(c)) for c in kept), pa.array(x, pa.list_(pa.float64()))], names=[*kept, "x"])

    return rows.select(*kept, "text", "lexicon").mapInArrow(thrifty(run), f"{schema}, x array<double>")


def fit(docs: DataFrame, labels: DataFrame, held_out: Column, most: int = TRAIN_ROWS) -> Model:
    """labels: doc_id, toxic; held_out is a condition on doc_id."""
    train = one_of_copies(docs, training(labels, held_out, most))
    counted = counts(docs, train)
    lexica = {h: learned(counted, (1 - h,)) for h in range(2)}  # a document's words are weighed by the other half
    rows = docs.select("doc_id", "text").join(F.broadcast(train), "doc_id").withColumn("lexicon", F.col("half"))
    x = _features(rows, lexica, ["doc_id", "label"]).groupBy("doc_id", "label").agg(F.min("x").alias("x")).orderBy("doc_id").collect()  # bounded by most
    if len({r["label"] for r in x}) < 2:
        return Model({}, PRIOR)
    return Model(learned(counted, (0, 1)), logistic(np.array([r["x"] for r in x]), np.array([r["label"] for r in x], float)))


def classify(docs: DataFrame, labels: DataFrame, held_out: Column, threshold: float = 0.7, most: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted and clauses (matched ones) of every row."""
    model = fit(docs, labels, held_out, most)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rules = grammar()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(sent.value.weights)
        for block in text_blocks(batches, most=1 << 20):
            x = np.array([statistics(t or "", lexicon, rules) for t in block.column(2).to_pylist()]).reshape(-1, len(NAMES))
            s = 1 / (1 + np.exp(-np.clip(x @ sent.value.coefficients, -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [block.column(0), block.column(1), pa.array(s), pa.array((s >= threshold).astype("i4")), pa.array(np.rint(np.expm1(x[:, NAMES.index("clauses")])).astype(np.int64))],
                names=["doc_id", "held_out", "score", "predicted", "clauses"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(thrifty(run), "doc_id long, held_out boolean, score double, predicted int, clauses long")
