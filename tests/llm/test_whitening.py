"""Whitening against the singular vectors of all rows at once."""

import numpy as np
import pytest

from feedbackmill.llm import whitening
from feedbackmill.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def plain(vectors, components):
    """n, deviations, whitened rows and shares of the components with variance."""
    x = np.floor(np.array(vectors, float) * 64).astype(int) + 1_000_000
    n, sums = len(x), [sum(map(int, c)) for c in x.T]
    away = [[n * int(v) - s for v, s in zip(row, sums)] for row in x]
    centred = np.array([[a / n for a in row] for row in away])
    _, singular, axes = np.linalg.svd(centred, full_matrices=False)
    values, axes = singular**2 / n, axes.T
    real = int((values > values[0] * 1e-12).sum())
    keep = min(real, components)
    white = centred @ axes[:, :keep] / np.sqrt(values[:keep])
    return n, [sum(a * a for a in row) for row in away], white, values[:keep] / values.sum()


def check(got, ids, vectors, components=32, close=1e-7):
    n, deviations, white, shares = plain(vectors, components)
    assert len(got) == len(ids) * white.shape[1]
    assert {r["n"] for r in got} <= {n} and all(r["identity_error"] < 1e-9 for r in got)
    cells = {(r["vec_id"], r["component"]): r for r in got}
    for j in range(white.shape[1]):
        mine = np.array([cells[i, j + 1]["whitened"] for i in ids])
        sign = np.sign(mine @ white[:, j])
        assert np.allclose(mine * sign, white[:, j], atol=close)
        assert all(np.isclose(cells[i, j + 1]["explained"], shares[j], rtol=1e-9) for i in ids)
    for i, deviation in zip(ids, deviations):
        assert cells[i, 1]["deviation"] == (deviation if deviation < 1 << 63 else None)


def test_query(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    check(QUERIES["op12_whitening"](spark, SF).collect(), [r["vec_id"] for r in rows], [r["embedding"] for r in rows])


def test_badly_scaled_rows_in_parts(spark, monkeypatch):
    monkeypatch.setattr(whitening, "_ROWS", 7)
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(400, 6)) * [1e4, 1e3, 30, 10, 5, 0.5] @ np.linalg.qr(rng.normal(size=(6, 6)))[0]
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, x int")
    check(whitening.whiten(df.repartition(5)).collect(), range(400), vectors, close=1e-4)


def test_deficient_rank_and_large_entries(spark):
    rng = np.random.default_rng(4)
    vectors = np.round(rng.normal(size=(50, 3)), 3)
    vectors = np.c_[vectors, vectors[:, 0], np.full(50, 7.0), np.zeros(50)]  # a copy and constants
    vectors[:, 2] *= 2.0**19
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = whitening.whiten(df, components=2).collect()
    check(got, range(50), vectors, components=2, close=1e-5)
    assert {r["component"] for r in got} == {1, 2} and any(r["deviation"] is None for r in got)
    assert whitening.whiten(df.limit(1)).collect() == []  # nothing varies


def test_odd_rows(spark):
    good = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [3.0, -1.0]), (4, [0.0, 0.0])]
    bad = [(5, None), (6, [None, 1.0]), (7, [float("nan"), 1.0]), (8, [float("inf"), 1.0]), (9, [1.0]), (10, []), (11, [1e30, 0.0])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in good + bad], "vec_id long, embedding array<double>, n int, component int")
    got = whitening.whiten(df).collect()
    _, deviations, white, shares = plain([v for _, v in good], 32)
    assert sorted((str(r["vec_id"]), r["component"], r["deviation"]) for r in got) == sorted(
        (str(i), c, d) for (i, _), d in zip(good, deviations) for c in (1, 2)
    )
    assert whitening.whiten(df.limit(0)).collect() == []


@pytest.mark.parametrize("shifted", [True, False])
def test_factors(shifted):
    rng = np.random.default_rng(5)
    rows = rng.normal(size=(40, 5))
    r = whitening.cholesky_factor(rows.T @ rows, 40, shifted)
    assert np.allclose(r.T @ r, rows.T @ rows) and np.allclose(np.tril(r, -1), 0)
    assert np.allclose(whitening.solve_upper(rows, r) @ r, rows)
    singular = whitening.cholesky_factor(np.ones((4, 4)), 40, shifted)
    assert np.allclose(singular.T @ singular, np.ones((4, 4)), atol=1e-6)
