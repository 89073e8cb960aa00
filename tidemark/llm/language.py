"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text is lower-cased; its byte 2-, 3- and 4-grams are hashed to buckets, the buckets'
embeddings are averaged and a linear softmax over the known languages follows, all
trained by stochastic gradient descent in numpy on a bounded sample of labelled rows. As
average and layer are both linear, the trained model is kept as one row of logits per
bucket, and a text costs one gather per n-gram. A temperature and the rejection level
are calibrated on a part of the sample that training doesn't see.

Null texts and texts without a letter get "und", score 0 and are rejected. Texts are
read whole. Of equally likely languages the first by name is given. Rows are independent,
so repeats and extra columns don't matter. Without any labelled row every language is
"und".
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import text_blocks, texts_of, thrifty

BUCKETS, WIDTH, ORDERS = 1 << 16, 16, (2, 3, 4)
#: Text bytes that one numpy pass works on; rows and bytes of the sample in all, about.
BLOCK, SAMPLE_ROWS, SAMPLE_BYTES, BROADCAST_LANGUAGES = 1 << 18, 200_000, 256 << 20, 10_000
#: Letters and other signs of words, such as fractions: isalpha() tells them apart.
WORDLIKE = re.compile(r"[^\W\d_]")
GAP = "    "
_PRIMES = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917), np.uint32(668265263))

SCHEMA = "lang_pred string, score double, rejected boolean"


class Model(NamedTuple):
    languages: list[str]
    logits: np.ndarray  # a row per bucket
    bias: np.ndarray
    temperature: float
    least: float  # scores below it are rejected


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the texts, gaps between; where each text begins and ends."""
    raw = [(" " + t.lower() + GAP).encode("utf-8", "replace") for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint32)
    ends = np.cumsum([len(x) for x in raw])
    starts = ends - [len(x) for x in raw]
    return data, starts, ends - len(GAP) + 1


def hashed(data: np.ndarray, order: int) -> np.ndarray:
    """The bucket of the n-gram at each byte, for all bytes that begin one."""
    n = len(data) - order + 1
    h = np.full(n, order, np.uint32) * _PRIMES[3]
    for k in range(order):
        h = (h ^ data[k : k + n]) * _PRIMES[k % 3]
        h ^= h >> np.uint32(15)
    return h & np.uint32(BUCKETS - 1)


def bags(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per text its buckets and their shares."""
    out = []
    for t in texts:
        data, starts, ends = grams([t])
        found = np.concatenate([hashed(data, o)[: ends[0]] for o in ORDERS])
        buckets, counts = np.unique(found, return_counts=True)
        out.append((buckets, (counts / counts.sum()).astype(np.float32)))
    return out


def train(texts: list[str], labels: list[str], epochs: int = 6, batch: int = 32, rate: float = 60.0, seed: int = 7, held: int = 5) -> Model:
    """Stochastic gradient descent; every held-th row calibrates only."""
    languages = sorted(set(labels))
    y = np.array([languages.index(x) for x in labels])
    x = bags(texts)
    rng = np.random.default_rng(seed)
    embeddings = rng.normal(0, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
    layer, bias = np.zeros((WIDTH, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    layer += rng.normal(0, 0.3, layer.shape).astype(np.float32)
    learn = np.array([i for i in range(len(x)) if i % held or len(x) < 4 * held])
    check = np.array([i for i in range(len(x)) if not i % held] or [*range(len(x))])
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        order = rng.permutation(learn)
        for at in range(0, len(order), batch):
            some = order[at : at + batch]
            hidden = np.stack([w @ embeddings[b] for b, w in (x[i] for i in some)])
            z = hidden @ layer + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(some)), y[some]] -= 1
            back = p @ layer.T
            layer -= 0.02 * step / len(some) * hidden.T @ p
            bias -= 0.002 * step * p.mean(0)
            for row, i in enumerate(some):
                b, w = x[i]
                embeddings[b] -= step / len(some) * np.outer(w, back[row])
    logits = embeddings @ layer
    z = np.stack([w @ logits[b] + bias for b, w in (x[i] for i in check)])
    truth = y[check]

    def loss(t: float) -> float:
        s = z / t
        s -= s.max(1, keepdims=True)
        return float(-(s[np.arange(len(truth)), truth] - np.log(np.exp(s).sum(1))).mean())

    temperature = min(np.geomspace(0.05, 4, 60), key=loss)
    s = z / temperature
    p = np.exp(s - s.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    right = np.sort(p.max(1)[p.argmax(1) == truth])
    # at most one in a thousand of the rows that calibration gets right may fall below, and never a likely one
    least = min(float(right[len(right) // 1000]) if len(right) else 0.0, 0.5)
    return Model(languages, logits.astype(np.float32), bias, float(temperature), least)


def predict(model: Model, texts: list[str]) -> tuple[list[str], list[float], list[bool]]:
    lettered = np.array([any(m[0].isalpha() for m in WORDLIKE.finditer(t)) for t in texts], bool)
    if not model.languages or not len(texts):
        return ["und"] * len(texts), [0.0] * len(texts), [True] * len(texts)
    data, starts, ends = grams(texts)
    total = np.zeros((len(texts), len(model.languages)))
    count = np.zeros(len(texts))
    for order in ORDERS:
        h = hashed(data, order)
        upto = np.minimum(ends, len(h))
        for k in range(len(model.languages)):
            sums = np.concatenate([[0.0], np.cumsum(model.logits[:, k][h], dtype=np.float64)])
            total[:, k] += sums[upto] - sums[starts]
        count += upto - starts
    z = (total / np.maximum(count, 1)[:, None] + model.bias) / model.temperature
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    best = p.argmax(1)
    score = np.where(lettered, p[np.arange(len(texts)), best], 0.0)
    names = [model.languages[b] if ok else "und" for b, ok in zip(best, lettered, strict=True)]
    return names, score.tolist(), [not ok or s < model.least for ok, s in zip(lettered, score, strict=True)]


def fit(labelled: DataFrame, per_language: int = 500) -> Model:
    """Trains on about per_language whole texts of each language, by a hash of doc_id and text; fewer where all samples would pass SAMPLE_ROWS or SAMPLE_BYTES.

    labelled: doc_id, text, lang. Rows without text or language don't count. Every language
    is learned; time and the model's size grow with their number.
    """
    known = labelled.where("text IS NOT NULL AND lang IS NOT NULL").select("doc_id", "text", "lang")
    sizes = known.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    languages = sizes.count()
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0, np.float32), 1.0, 0.0)
    spread, per = 1_000_003, max(2, min(per_language, SAMPLE_ROWS // languages))
    share = F.least(F.lit(1.0), F.lit(per) / F.col("n"), F.lit(SAMPLE_BYTES / languages) / F.greatest(F.col("bytes"), F.lit(1)))
    shares = sizes.select(F.col("lang").alias("of"), (F.floor(share * spread) + 1).alias("upto"))
    if languages <= BROADCAST_LANGUAGES:  # else Spark chooses how to join
        shares = F.broadcast(shares)
    drawn = known.withColumn("drawn", F.pmod(F.xxhash64("doc_id", "text"), F.lit(spread))).join(shares, F.col("lang") == F.col("of"))
    rows = drawn.where("drawn < upto").select("drawn", "doc_id", "text", "lang").distinct().limit(2 * per * languages).collect()  # rows that repeat count once; the limit is for a draw beyond all odds
    rows.sort(key=lambda r: (r["drawn"], r["doc_id"] is not None, r["doc_id"] or 0, r["text"]))
    return train([r["text"] for r in rows], [r["lang"] for r in rows])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id with the predicted language, its calibrated probability and whether it is rejected."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS rows of logits, whatever the input

    @thrifty
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, most=BLOCK):
            names, scores, rejected = predict(sent.value, texts_of(block))
            yield pa.RecordBatch.from_arrays([block.column(0).cast(pa.int64()), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], names=["doc_id", "lang_pred", "score", "rejected"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, " + SCHEMA)


def keep_identified(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, all their columns, whose language is not rejected."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @thrifty
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, most=BLOCK):
            yield block.filter(pa.array([not x for x in predict(sent.value, texts_of(block))[2]], pa.bool_()))

    return docs.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema]))
