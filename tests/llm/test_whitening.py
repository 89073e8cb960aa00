from __future__ import annotations

import math

import numpy as np
import pytest

from tidemark.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, n string"


def exact(vectors: list[list[float]]) -> tuple:
    x = np.floor(np.array(vectors, float) * 1024).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    c = (x * n - s) / n
    values, base = np.linalg.eigh(c.T @ c / n)
    return c, values[::-1], base[:, ::-1], [int(sum((n * int(v) - int(t)) ** 2 for v, t in zip(row, s, strict=True))) for row in x]


def held(out, vectors, components=8):
    """out's rows by component equal the exact ones but for a sign; returns them."""
    c, values, base, deviations = exact(vectors)
    t = out.toPandas()
    k = min(components, c.shape[1])
    assert len(t) == len(vectors) * k and set(t["n"]) == {len(vectors)}
    w = t.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    want = c @ base[:, :k] / np.sqrt(values[:k])
    want *= np.sign((want * w).sum(axis=0))
    assert np.abs(w - want).max() < 1e-8
    assert t.groupby("vec_id")["deviation"].first().tolist() == deviations
    shares = t.groupby("component")["explained"].first().to_numpy()
    assert np.allclose(shares, values[:k] / values.sum(), rtol=1e-10)
    assert t["identity_error"].nunique() == 1 and t["identity_error"][0] < 1e-9
    return w


def test_components(spark):
    rng = np.random.default_rng(3)
    v = (rng.standard_normal((700, 24)) * np.linspace(1, 0.2, 24) @ np.linalg.qr(rng.standard_normal((24, 24)))[0]).astype(np.float32)
    df = spark.createDataFrame([(i, x.tolist(), None, "x") for i, x in enumerate(v)], SCHEMA).repartition(5)
    held(whitening.whiten(df), v.tolist())


def test_long_vectors_take_several_steps(spark):
    rng = np.random.default_rng(4)
    v = rng.standard_normal((900, 96)).astype(np.float32)
    df = spark.createDataFrame([(i, x.tolist(), None, "x") for i, x in enumerate(v)], SCHEMA).repartition(3)
    rows = whitening.whole(df)
    basis = whitening.fit(rows)
    assert basis.passes > 2 and basis.residuals.max() <= whitening.TOLERANCE
    assert np.allclose(basis.vectors.T @ basis.vectors, np.eye(8), atol=1e-12)
    held(whitening.whitened(rows, basis, whitening.identity_error(rows, basis)), v.tolist())


def test_rows_that_go(spark):
    good = [[0.1, 0.2, 0.3], [0.4, -0.5, 0.6], [0.0, 0.9, -0.3], [0.2, 0.1, 0.7], [0.2, 0.1, 0.7]]
    bad = [None, [], [0.1, None, 0.2], [math.nan, 0.0, 0.0], [math.inf, 0.0, 1.0], [3e38, 0.0, 0.0], [1.0, 2.0]]
    df = spark.createDataFrame([(i, x, 1, "x") for i, x in enumerate(good + bad)], SCHEMA)
    float32 = [np.array(g, np.float32).tolist() for g in good]
    held(whitening.whiten(df), float32)


@pytest.mark.parametrize("rows", [0, 1, 5])
def test_no_variance(spark, rows):
    out = whitening.whiten(spark.createDataFrame([(i, [0.5, 0.25], 1, "x") for i in range(rows)], SCHEMA)).collect()
    assert len(out) == 2 * rows
    assert all(r["whitened"] is None and r["explained"] is None and r["identity_error"] is None and r["deviation"] == 0 for r in out)


def test_rank_below_components(spark):
    df = spark.createDataFrame([(i, [0.1 * i, 0.2 * i, 0.0], 1, "x") for i in range(10)], SCHEMA)
    out = whitening.whiten(df).toPandas()
    assert out[out.component == 1].whitened.notna().all() and out[out.component == 3].whitened.isna().all()
    assert out.identity_error[0] < 1e-6 and len(out) == 30  # the second eigenvalue is rounding of whole numbers


def test_deviations_beyond_64_bits():
    x = np.array([[2**40, 0], [0, 2**40]])
    assert whitening._deviations(x, 2, np.array([2**40, 2**40], object)) == [None, None]
    assert whitening._deviations(np.array([[3, 1], [1, 1]]), 2, np.array([4, 2], object)) == [4, 4]
