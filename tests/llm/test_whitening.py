"""Whitening against numpy's own eigenvectors, and on odd vectors."""

import math

import numpy as np
import pytest

from sourcelens.llm import whitening

COLUMNS = "vec_id long, embedding array<double>, label int, id string, v int, i int, n int, whitened string, deviation int"


def table(spark, vectors):
    return spark.createDataFrame([(i, v, 0, "x", 1, 1, 1, "y", 1) for i, v in vectors], COLUMNS).repartition(3)


def plain(vectors, most=32):
    """(x, e, components) by numpy."""
    x = np.floor(64 * np.array(vectors)).astype(np.int64) + 1_000_000
    y = x - x.sum(axis=0) / len(x)
    e, v = np.linalg.eigh(y.T @ y / len(x))
    return x, e[::-1], v[:, ::-1]


def test_jacobi_keeps_small_eigenvalues():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 17, 40):
        scale = np.logspace(0, -9, n)
        core = rng.standard_normal((n, n))
        core = core @ core.T + n * np.eye(n)
        a = scale[:, None] * core * scale
        e, v = whitening.jacobi(a)
        assert np.allclose(v.T @ v, np.eye(n), atol=1e-12) and (np.diff(e) <= 0).all()
        # The product of the eigenvalues is the determinant, which is known to relative accuracy here.
        assert math.isclose(np.log(e).sum(), 2 * np.log(scale).sum() + np.linalg.slogdet(core)[1], rel_tol=1e-10)


def test_jacobi_of_zero_and_equal():
    e, v = whitening.jacobi(np.zeros((3, 3)))
    assert (e == 0).all() and np.allclose(v, np.eye(3))
    e, v = whitening.jacobi(np.ones((4, 4)))
    assert np.allclose(e, [4, 0, 0, 0], atol=1e-12)
    assert len(whitening.jacobi(np.zeros((0, 0)))[0]) == 0


@pytest.mark.parametrize("dim,n", [(5, 60), (40, 300)])
def test_against_numpy(spark, dim, n):
    rng = np.random.default_rng(dim)
    vectors = (rng.standard_normal((n, dim)) * np.linspace(0.5, 2, dim)).tolist()
    vectors[7] = vectors[8]
    out = whitening.whitened_rows(table(spark, list(enumerate(vectors)))).toPandas()
    x, e, v = plain(vectors)
    k = min(32, dim)
    assert list(out.columns) == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert len(out) == n * k and (out.n == n).all() and out.identity_error.nunique() == 1 and out.identity_error[0] < 1e-9
    got = out.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    want = (x - x.sum(axis=0) / n) @ v[:, :k] / np.sqrt(e[:k])
    assert np.allclose(got * np.sign((got * want).sum(axis=0)), want, atol=1e-8)
    assert (got[7] == got[8]).all()
    s = x.sum(axis=0)
    for r in out[out.component == 1].itertuples():
        assert r.deviation == sum((n * int(a) - int(b)) ** 2 for a, b in zip(x[r.vec_id], s))
    for r in out[out.vec_id == 0].itertuples():
        assert math.isclose(r.explained, e[r.component - 1] / e.sum(), rel_tol=1e-9)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [0.5, 1.0, -2.0]), (2, [1.5, 0.25, 3.0]), (2, [1.5, 0.25, 3.0]), (None, [-1.0, 0.0, 0.125]), (4, [2.0, 2.0, 2.5]), (5, [0.0, 0.0, 0.0])]
    bad = [(6, None), (7, []), (8, [1.0, None, 2.0]), (9, [nan, 1.0, 2.0]), (10, [1.0, -inf, 0.0]), (11, [1.0]), (12, [1e300, 0.0, 0.0])]
    out = whitening.whitened_rows(table(spark, good + bad)).toPandas()
    assert len(out) == 18 and set(out.vec_id.dropna()) == {1, 2, 4, 5} and (out.n == 6).all()
    assert out.identity_error[0] < 1e-9


def test_large_entries_stay_exact(spark):
    vectors = [[2.0**40 * a, float(a * a), 1.0] for a in range(-4, 5)]
    out = whitening.whiten(table(spark, list(enumerate(vectors)))).select("id", F_str("deviation")).distinct().toPandas()
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors]
    s = [sum(c) for c in zip(*x)]
    for r in out.itertuples():
        assert int(r.deviation) == sum((9 * a - b) ** 2 for a, b in zip(x[r.id], s))


def F_str(name):
    from pyspark.sql import functions as F

    return F.col(name).cast("string").alias(name)


def test_without_variance(spark):
    assert whitening.whitened_rows(table(spark, [(1, [1.0, 2.0])])).count() == 0
    assert whitening.whitened_rows(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    assert whitening.whitened_rows(table(spark, [(1, [1.0, 2.0])]).where("vec_id < 0")).count() == 0
    # Two dimensions that move together have one component.
    out = whitening.whitened_rows(table(spark, [(k, [float(k), float(2 * k)]) for k in range(9)])).toPandas()
    assert set(out.component) == {1} and abs(out.explained[0] - 1) < 1e-12
