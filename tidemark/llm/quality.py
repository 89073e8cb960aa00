"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each document gives a fixed vector of statistics of its whole text, transformed to be
near normal (logarithms of counts, logits of shares) and clipped. Per class, the mean and
covariance come from sums over all labelled training rows, gathered as one bounded
partial sum per task. A class's covariance is shrunk towards the pooled one and towards
its own diagonal. The score is a logistic function of the difference of the two classes'
log densities, each a Mahalanobis distance by the class's cached Cholesky factor; slope
and offset are calibrated on a bounded sample of training rows.

Null and empty texts have the statistics of a text of no words and are scored like any
other. Labels that are null count as none; of several labels of a document the highest
counts. Repeated rows get one result each; of rows that share an id the fit takes the one
whose statistics are smallest, component by component in order. If a class has no training row, every score is
the share of label 1 among training rows (0.5 without any).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import saved, text_blocks
from tidemark.llm.words import block_words

NAMES = (
    "words", "mean_length", "length_spread", "upper", "digit", "punctuation", "symbol", "bar", "exclaim", "stop", "lines", "line_words",
    "distinct", "long_words", "short_words", "upper_words", "symbol_words", "other_bytes", "repeat_lines", "bare_words", "repeat_next",
)
#: Statistics that are shares, and so get a logit.
SHARES = frozenset({"upper", "digit", "punctuation", "symbol", "bar", "exclaim", "stop", "distinct", "long_words", "short_words", "upper_words", "symbol_words", "other_bytes", "repeat_lines", "bare_words", "repeat_next"})
CLIP = 8.0


def _set(chars: bytes | range) -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[list(chars)] = 1
    return out


_UPPER, _DIGIT, _LETTER = _set(range(65, 91)), _set(range(48, 58)), _set([*range(65, 91), *range(97, 123), *range(128, 256)])
_KINDS = {
    "upper": _UPPER, "digit": _DIGIT, "punctuation": _set(b",;:'\"()-"), "symbol": _set(b"#*$%&<>{}[]=+~^_\\/@"), "bar": _set(b"|"), "exclaim": _set(b"!?"), "stop": _set(b"."), "other_bytes": _set(range(128, 256)),
}


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of transformed statistics per text."""
    raw = [b"" if x is None else x for x in texts.cast(pa.large_binary()).to_pylist()]
    n = len(raw)
    out = np.zeros((n, len(NAMES)))
    if not n:
        return out
    w = block_words(texts)
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)  # as w.data, but with its case
    count = np.diff(w.first).astype(float)
    some = np.maximum(count, 1)

    def per_text(values: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
        return sums[w.first[1:]] - sums[w.first[:-1]]

    def over_bytes(kind: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(data) + 1, np.int32)
        np.cumsum(kind[data], out=sums[1:])
        return sums

    length = (w.ends - w.starts).astype(float)
    chars = np.maximum(per_text(length), 1)
    mean = chars / some
    col = {"words": np.log1p(count), "mean_length": np.log1p(mean * (count > 0)), "length_spread": np.log1p(np.sqrt(np.maximum(per_text(length**2) / some - mean**2, 0)))}
    for name, kind in _KINDS.items():
        sums = over_bytes(kind)
        col[name] = (sums[w.texts[1:]] - sums[w.texts[:-1]]) / chars
        if name == "upper":
            col["upper_words"] = per_text((sums[w.ends] - sums[w.starts]) >= np.maximum(length, 2)) / some
        if name == "symbol":
            col["symbol_words"] = per_text((sums[w.ends] - sums[w.starts]) > 0) / some
    letters = over_bytes(_LETTER)
    col["bare_words"] = per_text((letters[w.ends] - letters[w.starts]) == 0) / some
    col["long_words"], col["short_words"] = per_text(length > 12) / some, per_text(length <= 3) / some
    order = np.lexsort((w.hashes, np.repeat(np.arange(n), np.diff(w.first))))
    owner = np.repeat(np.arange(n), np.diff(w.first))
    fresh = np.ones(len(order), bool)
    if len(order) > 1:
        fresh[1:] = (w.hashes[order][1:] != w.hashes[order][:-1]) | (owner[1:] != owner[:-1])
    col["distinct"] = np.bincount(owner[fresh], minlength=n) / some
    after = np.zeros(len(w.hashes), bool)
    after[1:] = w.hashes[1:] == w.hashes[:-1]
    after[w.first[:-1][w.first[:-1] < len(after)]] = False
    col["repeat_next"] = per_text(after) / some
    lines = [[x for x in t.split(b"\n") if x] for t in raw]
    number = np.array([len(x) for x in lines], float)
    col["lines"] = np.log1p(number)
    col["line_words"] = np.log1p(count / np.maximum(number, 1))
    col["repeat_lines"] = np.array([1 - len(set(x)) / max(len(x), 1) if x else 0.0 for x in lines])
    for i, name in enumerate(NAMES):
        x = np.asarray(col[name], float)
        if name in SHARES:
            x = np.clip(x, 0, 1)
            x = np.log((x + 0.002) / (1.002 - x))
        out[:, i] = np.clip(x, -CLIP, CLIP)
    return out


class Model(NamedTuple):
    means: np.ndarray
    factors: np.ndarray  # Cholesky factors of the covariances
    log_dets: np.ndarray
    slope: float
    offset: float


def score(model: Model | float, x: np.ndarray) -> np.ndarray:
    if isinstance(model, float):
        return np.full(len(x), model)
    return 1 / (1 + np.exp(-np.clip(model.slope * difference(model, x) + model.offset, -30, 30)))


def difference(model: Model, x: np.ndarray) -> np.ndarray:
    """Of the log densities of class 1 and class 0."""
    density = []
    for k in range(2):
        z = (x - model.means[k]).T
        for i, row in enumerate(model.factors[k]):  # forward substitution, in place
            z[i] = (z[i] - row[:i] @ z[:i]) / row[i]
        density.append(-0.5 * (z**2).sum(0) - 0.5 * model.log_dets[k])
    return density[1] - density[0]


def discriminant(sums: dict[int, tuple[float, np.ndarray, np.ndarray]], to_pooled: float, to_diagonal: float) -> Model:
    """From each class's row count, sum and sum of outer products."""
    means, covariances, total = [], [], sum(s[0] for s in sums.values())
    for k in range(2):
        n, s, q = sums[k]
        means.append(s / n)
        covariances.append(q / n - np.outer(s / n, s / n))
    pooled = sum(sums[k][0] / total * covariances[k] for k in range(2))
    factors, dets = [], []
    for c in covariances:
        c = (1 - to_pooled) * c + to_pooled * pooled
        c = (1 - to_diagonal) * c + to_diagonal * np.diag(np.diag(c)) + 1e-3 * np.eye(len(c))
        f = np.linalg.cholesky(c)
        factors.append(f)
        dets.append(2 * np.log(np.diag(f)).sum())
    return Model(np.array(means), np.array(factors), np.array(dets), 1.0, 0.0)


def calibrated(model: Model, x: np.ndarray, y: np.ndarray) -> Model:
    """Slope and offset by Newton's method on the logistic loss."""
    d = np.clip(difference(model, x), -200, 200)
    scale = max(float(np.abs(d).mean()), 1e-9)
    a = np.stack([d / scale, np.ones(len(d))], axis=1)
    b = np.array([1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        gradient = a.T @ (p - y) + 1e-3 * b
        b = b - np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2), gradient)
    return model._replace(slope=max(float(b[0] / scale), 1e-6), offset=float(b[1]))


def features(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches):
            x = statistics(block.column(1))
            yield pa.RecordBatch.from_arrays([block.column(0).cast(pa.int64()), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "x"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, x array<double>")


def fit(rows: DataFrame, to_pooled: float = 0.1, to_diagonal: float = 0.1, calibration_rows: int = 20_000) -> Model | float:
    """rows: doc_id, x, label (0 or 1), all training rows. calibration_rows bounds the sample that slope and offset see."""
    d = len(NAMES)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            x = np.array(batch.column(0).to_pylist(), float).reshape(-1, d)
            y = np.array(batch.column(1).to_pylist(), int)
            for k in range(2):
                z = x[y == k]
                total[k] += np.concatenate([[len(z)], z.sum(0), (z.T @ z).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["label", "sums"])

    sums = rows.select("x", "label").mapInArrow(partial, "label int, sums array<double>")
    added = sums.select("label", F.posexplode("sums")).groupBy("label", "pos").agg(F.sum("col").alias("s")).collect()
    total = np.zeros((2, 1 + d + d * d))
    for r in added:
        total[r["label"], r["pos"]] = r["s"]
    n = total[:, 0]
    if min(n) < 1:
        return float(n[1] / n.sum()) if n.sum() else 0.5
    model = discriminant({k: (n[k], total[k, 1 : 1 + d], total[k, 1 + d :].reshape(d, d)) for k in range(2)}, to_pooled, to_diagonal)
    spread = 1_000_003
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(spread))
    sample = rows.where(drawn < int(spread * min(1.0, calibration_rows / n.sum())) + 1).select("x", "label").limit(2 * calibration_rows).toPandas()
    return calibrated(model, np.array(sample["x"].tolist(), float).reshape(-1, d), sample["label"].to_numpy(float))


def classify(docs: DataFrame, labels: DataFrame, held_out: Column, threshold: float = 0.3, **options: float) -> DataFrame:
    """Trains on labelled rows of docs that are not held_out (a condition on doc_id), scores all rows.

    labels: doc_id, quality.
    """
    known = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").cast("int").alias("label"))
    x = saved(features(docs))  # a few hundred bytes a document; spares reading the texts again
    train = x.where(~held_out).groupBy("doc_id").agg(F.min("x").alias("x")).join(known, "doc_id")
    sent = docs.sparkSession.sparkContext.broadcast(fit(saved(train), **options))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = score(sent.value, np.array(batch.column(2).to_pylist(), float).reshape(-1, len(NAMES)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s, pa.float64()), pa.array((s >= threshold).astype("i4"), pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    return x.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "x").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
