"""Embedding whitening by LOBPCG: the leading components of a covariance that is never formed.

Every pass over the vectors multiplies the covariance with a block of directions: a task
centres its rows and sends one small matrix. On the driver a Rayleigh-Ritz step over the
iterate, its residuals and the directions of the last step gives the next iterate, all of
them matrices of as many rows as a vector has entries, whatever the number of vectors. It
ends when each component's residual, taken from the pass itself, is certified to be within
TOLERANCE of the largest eigenvalue and no longer falls.

Entries are whole numbers, floor(1024 * c) + 100000, so sums and deviations are exact, and a
centred entry (n * x - S) / n is rounded once. Rows whose vector is null, empty or holds a
null or non-finite entry are left out, as are entries beyond 2**52 / 1024 in size, which have
no exact whole number. Vectors of another length than the most frequent one (of equally
frequent ones the longest) have no covariance with the rest and are left out too. Repeated
rows count and are given as often as they stand. A component without variance (eigenvalue
within 1e-13 of the trace, as with one vector or equal ones) has whitened null and no part
in identity_error; explained is null where the trace is 0. A deviation beyond a long is
null. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import saved

COMPONENTS = 8
#: Directions carried beside the components, so that a narrow gap behind the last one doesn't slow it down.
SPARE = 8
TOLERANCE = 1e-12
#: Passes without a certificate after which it is an error.
PASSES = 400
SCALE, SHIFT = 1024, 100_000
LARGEST = float(2**52) / SCALE
ROWS = 1 << 14


class Basis(NamedTuple):
    """n, each entry's sum, trace of the covariance, eigenvalues, components (a column each), residual norms over the largest eigenvalue, passes."""

    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    vectors: np.ndarray
    residuals: np.ndarray
    passes: int


def whole(vectors: DataFrame, column: str = "embedding", ident: str = "vec_id") -> DataFrame:
    """vec_id, x: the usable vectors of the most frequent length as whole numbers, written."""
    v = F.transform(column, lambda c: c.cast("double"))
    fit = F.coalesce(F.forall(v, lambda c: F.coalesce(F.abs(c) <= LARGEST, F.lit(False))), F.lit(False)) & (F.size(column) > 0)
    x = F.transform(v, lambda c: F.floor(c * SCALE).cast("long") + SHIFT)
    rows = saved(vectors.where(fit).select(F.col(ident).alias("vec_id"), x.alias("x")))
    size = F.size("x")
    length = rows.groupBy(size.alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(size == (length["d"] if length else 0))


def _blocks(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            yield part, part.column(part.schema.get_field_index("x")).flatten().to_numpy().reshape(-1, d)


def _fits(x: np.ndarray, n: int, sums: np.ndarray) -> bool:
    return max([n * int(np.abs(x).max(initial=0)), *map(abs, sums)]) < 2**61


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """(n * x - S) / n, exact before the division; in Python's numbers where 64 bits are too few."""
    if _fits(x, n, sums):
        return (x * n - sums.astype(np.int64)) / n
    return ((x.astype(object) * n - sums) / n).astype(np.float64)


def _summed(rows: DataFrame, work: Callable[[np.ndarray], np.ndarray], d: int, size: int) -> np.ndarray:
    """The sum of work over all rows' blocks, a vector of that size: one partial sum a task, added by entry."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_ = np.zeros(size), False
        for _, x in _blocks(batches, d):
            total += work(x)
            any_ = True
        if any_:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["part"])

    parts = rows.select("x").mapInArrow(task, "part array<double>").select(F.posexplode("part").alias("i", "v"))
    out = np.zeros(size)
    for i, v in parts.groupBy("i").agg(F.sum("v")).collect():  # one number an entry of a small matrix
        out[i] = v
    return out


def _product(x: np.ndarray, n: int, sums: np.ndarray, block: np.ndarray) -> np.ndarray:
    c = centred(x, n, sums)
    return (c.T @ (c @ block)).ravel()


def _orthonormal(columns: np.ndarray, beside: np.ndarray | None = None) -> np.ndarray:
    """An orthonormal base of what columns add to beside (itself orthonormal); directions that add nothing are left out."""
    size = np.linalg.norm(columns, axis=0)
    columns = columns[:, size > 0] / size[size > 0]
    for _ in range(2):  # twice is enough
        if beside is not None and columns.size:
            columns = columns - beside @ (beside.T @ columns)
        if columns.size:
            u, s, _ = np.linalg.svd(columns, full_matrices=False)
            columns = u[:, s > 1e-10 * max(1.0, s[0])]
    return columns


def fit(rows: DataFrame, components: int = COMPONENTS, tolerance: float = TOLERANCE) -> Basis | None:
    """The leading components of rows (x, all of one length); None without rows."""
    spread = rows.select(F.posexplode("x").alias("i", "x")).groupBy("i").agg(F.sum(F.col("x").cast("decimal(38,0)")), F.count("*"))
    stats = sorted(spread.collect())  # one row an entry of a vector
    if not stats:
        return None
    d, n = len(stats), stats[0][2]
    sums = [int(s) for _, s, _ in stats]
    s = np.array(sums, dtype=object)
    trace = float(_summed(rows, lambda x: np.array([np.square(centred(x, n, s)).sum()]), d, 1)[0]) / n
    width = min(d, components + SPARE)
    x = _orthonormal(np.random.default_rng(13).standard_normal((d, width)))
    wide = x
    best, stalled = np.inf, 0
    for passes in range(1, PASSES + 1):
        product = _summed(rows, partial(_product, n=n, sums=s, block=wide), d, d * wide.shape[1]).reshape(d, -1) / n
        small = wide.T @ product
        values, mix = np.linalg.eigh((small + small.T) / 2)
        mix = mix[:, ::-1][:, :width]
        values = np.maximum(values[::-1][:width], 0)
        before, x = x, wide @ mix
        residual = product @ mix - x * values
        top = values[0] if values[0] > 0 else 1.0
        norms = np.linalg.norm(residual, axis=0) / top
        worst = norms[:components].max()
        stalled = 0 if worst < best / 2 else stalled + 1
        best = min(best, worst)
        if worst <= tolerance and (stalled >= 2 or worst <= 1e-15 or wide.shape[1] == d):
            return Basis(n, sums, trace, values[:components], x[:, :components], norms[:components], passes)
        last = x - before @ (before.T @ x)  # how the iterate moved
        more = _orthonormal(np.concatenate([residual, last], axis=1), x)
        x = np.linalg.qr(x)[0]
        wide = np.linalg.qr(np.concatenate([x, more], axis=1))[0]
    raise RuntimeError(f"residuals are at {best:.1e} of the largest eigenvalue after {PASSES} passes")


def _projected(x: np.ndarray, basis: Basis, s: np.ndarray) -> np.ndarray:
    live = basis.values > 1e-13 * basis.trace
    scale = np.where(live, 1 / np.sqrt(np.where(live, basis.values, 1)), np.nan)
    return centred(x, basis.n, s) @ basis.vectors * scale


def identity_error(rows: DataFrame, basis: Basis) -> float | None:
    """The largest entry, in size, of the whitened vectors' covariance (centred on their mean) minus the identity; None without a live component."""
    d, s, k = len(basis.sums), np.array(basis.sums, dtype=object), len(basis.values)

    def mean(x: np.ndarray) -> np.ndarray:
        return _projected(x, basis, s).sum(axis=0)

    middle = _summed(rows, mean, d, k) / basis.n

    def spread(x: np.ndarray) -> np.ndarray:
        w = _projected(x, basis, s) - middle
        return (w.T @ w).ravel()

    off = np.abs(_summed(rows, spread, d, k * k).reshape(k, k) / basis.n - np.eye(k))
    live = np.isfinite(np.diag(off))
    return float(off[live][:, live].max()) if live.any() else None


def _deviations(x: np.ndarray, n: int, s: np.ndarray) -> list[int | None]:
    far = x * n - s.astype(np.int64) if _fits(x, n, s) else None
    if far is not None and float(np.square(far.astype(np.float64)).sum(axis=1).max(initial=0)) < 2**62:
        return np.square(far).sum(axis=1).tolist()
    exact = ((x.astype(object) * n - s) ** 2).sum(axis=1)
    return [int(e) if e < 2**63 else None for e in exact]


SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened(rows: DataFrame, basis: Basis, error: float | None) -> DataFrame:
    """A row each vector and component."""
    d, k, s = len(basis.sums), len(basis.values), np.array(basis.sums, dtype=object)
    explained = [float(v) / basis.trace if basis.trace > 0 else None for v in basis.values]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _blocks(batches, d):
            ids = part.column(part.schema.get_field_index("vec_id")).cast(pa.int64())
            each = np.repeat(np.arange(len(x)), k)
            out = _projected(x, basis, s).ravel()
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(each), basis.n)),
                 pa.array(_deviations(x, basis.n, s), pa.int64()).take(pa.array(each)), pa.array(out, mask=np.isnan(out)), pa.array(explained * len(x), pa.float64()), pa.array([error] * len(each), pa.float64())],
                names=[f.split()[0] for f in SCHEMA.split(", ")],
            )

    return rows.mapInArrow(task, SCHEMA)


def whiten(vectors: DataFrame, column: str = "embedding", ident: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """Every usable vector's whitened components."""
    rows = whole(vectors, column, ident)
    basis = fit(rows, components)
    if basis is None:
        return vectors.sparkSession.createDataFrame([], SCHEMA)
    return whitened(rows, basis, identity_error(rows, basis))
