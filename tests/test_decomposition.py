"""The decomposition against the dense one."""

import numpy as np
import pytest

from glossa.operators import decomposition


def cells(spark, a, shift=0):
    i, j = np.nonzero(a)
    return spark.createDataFrame([(int(x) + shift, int(y) * 7, float(a[x, y])) for x, y in zip(i, j, strict=True)], "fid long, task_id long, w double")


def matrix(theta, n, k, shift=0):
    u = np.zeros((n, k))
    for r in theta.collect():
        u[r.fid - shift] = r.vec
    return u


@pytest.mark.parametrize(("n", "m", "k", "more", "rows"), [(60, 8, 3, 50, 7), (300, 30, 5, 4, 16), (400, 25, 6, 6, 5), (9, 20, 4, 3, 4)])
def test_svd_is_the_dense_one(spark, monkeypatch, n, m, k, more, rows):
    """Of few columns exactly, of many by iteration; over many blocks of rows, so the tree has several levels."""
    monkeypatch.setattr(decomposition, "ROWS", rows)
    monkeypatch.setattr(decomposition, "FAN", 3)
    r = np.random.default_rng(n)
    a = r.normal(size=(n, m)) * (r.random((n, m)) < 0.4) * np.linspace(4, 0.5, m)
    theta, (spectrum,) = decomposition.truncated_svd(spark, cells(spark, a).repartition(6), k, more=more)
    u, s, _ = np.linalg.svd(a, full_matrices=False)
    got = matrix(theta, n, k)
    assert np.allclose(spectrum, s[:k], rtol=1e-8) and np.allclose(got.T @ got, np.eye(k), atol=1e-9)
    assert np.linalg.norm(got @ got.T - u[:, :k] @ u[:, :k].T, 2) < 1e-6
    top = np.abs(got).argmax(0)
    assert (got[top, range(k)] > 0).all()


def test_svd_of_lower_rank_and_of_blocks(spark):
    r = np.random.default_rng(1)
    a = np.zeros((50, 12))
    a[:20] = np.outer(r.normal(size=20), r.normal(size=12))  # rank one
    a[30:] = r.normal(size=(20, 12))
    blocks = spark.createDataFrame([(0, 0, 19), (1, 20, 29), (2, 30, 49)], "block_id int, f_min long, f_max long")
    theta, spectra = decomposition.truncated_svd(spark, cells(spark, a), 3, blocks)
    got = matrix(theta, 50, 3)
    assert [len(s) for s in spectra] == [1, 0, 3] and np.allclose(got[:20, 1:], 0) and not got[20:30].any()
    for part in (slice(0, 20), slice(30, 50)):
        u, s, _ = np.linalg.svd(a[part])
        k = (s[:3] > 1e-9).sum()
        assert np.linalg.norm(got[part, :k] @ got[part, :k].T - u[:, :k] @ u[:, :k].T, 2) < 1e-8
    none, spectra = decomposition.truncated_svd(spark, cells(spark, np.zeros((3, 3))), 2)
    assert none.count() == 0 and spectra == [[]]


def test_svd_of_ill_conditioned_columns(spark):
    """Spread over ten orders of magnitude: the vectors stay orthonormal."""
    r = np.random.default_rng(3)
    a = np.linalg.qr(r.normal(size=(80, 10)))[0] * np.geomspace(1, 1e-10, 10) @ np.linalg.qr(r.normal(size=(10, 10)))[0]
    theta, (spectrum,) = decomposition.truncated_svd(spark, cells(spark, a), 10)
    got = matrix(theta, 80, 10)
    assert np.allclose(got[:, :5].T @ got[:, :5], np.eye(5), atol=1e-8) and np.allclose(spectrum[:6], np.geomspace(1, 1e-10, 10)[:6], rtol=1e-6)
