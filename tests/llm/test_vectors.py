"""Whitening against the dense eigenproblem, and the solver on its own."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import whitening
from barloom.llm.whitening import jacobi_davidson, minres, whiten

from ..conftest import SF_DIR

NAN, INF = float("nan"), float("inf")


def dense(vectors, components=32):
    """Rows of (n, deviation, e, explained, whitened up to sign) of plain vectors."""
    x = np.floor(64 * np.asarray(vectors, dtype=np.float64)).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    deviation = [sum(int(d) ** 2 for d in n * row - sums) for row in x]
    c = (n * x - sums) / n
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1][:components], u[:, ::-1][:, :components]
    return n, deviation, e, e / np.trace(c.T @ c / n), c @ u / np.sqrt(e)


def check(rows, ids, vectors):
    n, deviation, e, explained, want = dense(vectors)
    k = min(32, len(vectors[0]))
    assert len(rows) == len(vectors) * k
    table = {(r.vec_id, r.component): r for r in rows}
    for at, vec_id in enumerate(ids):
        mine = [table[vec_id, c] for c in range(1, k + 1)]
        assert {(r.n, r.deviation) for r in mine} == {(n, deviation[at])}
        assert np.allclose([r.explained for r in mine], explained, rtol=1e-10)
    got = np.array([[table[i, c].whitened for c in range(1, k + 1)] for i in ids])
    sign = np.sign(np.sum(got * want, axis=0))
    gap = np.min(np.abs(np.diff(e)), initial=e[0]) / e[0]
    assert np.abs(got * sign - want).max() < 1e-12 / gap + 1e-9
    assert len({r.identity_error for r in rows}) == 1 and rows[0].identity_error < 1e-9


def test_table_matches_the_dense_problem(spark):
    table = spark.read.parquet(f"{SF_DIR}/embeddings.parquet").withColumns({c: F.lit("x") for c in ("n", "x", "ids", "component", "v", "m")})
    good = [r for r in table.collect() if r.embedding is not None and all(c is not None and np.isfinite(c) for c in r.embedding)]
    check(whiten(table.repartition(5)).collect(), [r.vec_id for r in good], [r.embedding for r in good])


def test_unusable_rows_go(spark):
    rng = np.random.default_rng(3)
    plain = [(k, [float(v) for v in rng.standard_normal(6) * range(1, 7)]) for k in range(40)]
    odd = [(100, None), (101, []), (102, [1.0, None, 2.0, 3.0, 4.0, 5.0]), (103, [NAN] * 6), (104, [1.0, INF, 0.0, 0.0, 0.0, 0.0]), (105, [1.0] * 7)]
    df = spark.createDataFrame(plain + odd, "vec_id long, embedding array<float>")
    kept = [r for r in df.collect() if r.vec_id < 100]
    check(whiten(df).collect(), [r.vec_id for r in kept], [r.embedding for r in kept])


def test_repeated_rows_ties_and_missing_ids_count(spark):
    rows = [(None, [1.0, 0.0]), (1, [0.0, 1.0]), (1, [0.0, 1.0]), (2, [-1.0, 0.0]), (3, [0.0, -1.0]), (4, [0.0, -1.0])]
    out = whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(out) == 12 and {r.n for r in out} == {6} and max(r.identity_error for r in out) < 1e-12
    square = whiten(spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [-1.0, 0.0]), (3, [0.0, -1.0])], "vec_id long, embedding array<double>")).collect()
    assert len(square) == 8 and all(abs(r.explained - 0.5) < 1e-12 for r in square) and square[0].identity_error < 1e-12


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None), (2, [])]])
def test_without_variance_nothing_is_returned(spark, rows):
    assert whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect() == []


def test_entries_beyond_exact_integers_are_refused(spark):
    with pytest.raises(Exception, match="exact integers"):
        whiten(spark.createDataFrame([(1, [1e300]), (2, [0.0])], "vec_id long, embedding array<double>")).collect()


@pytest.mark.parametrize("kind", ["spread", "close", "ties", "low"])
def test_solver_reaches_double_precision(kind):
    rng = np.random.default_rng(5)
    d, wanted = 200, 32
    q = np.linalg.qr(rng.standard_normal((d, d)))[0]
    e = {"spread": np.linspace(1, 50, d) ** 2, "close": 1 + np.arange(d) * 1e-4, "ties": np.repeat([1.0, 2.0, 3.0, 9.0], d // 4), "low": np.where(np.arange(d) < 180, 0.0, 7.0 + np.arange(d))}[kind]
    a = (q * e) @ q.T
    a = (a + a.T) / 2
    values, vectors, residuals = jacobi_davidson(lambda w: a @ w, d, wanted)
    k = wanted if kind != "low" else 20
    assert np.allclose(values[:k], np.sort(e)[::-1][:k], rtol=1e-12)
    assert residuals.max() <= 1e-12 * e.max() and np.abs(vectors.T @ vectors - np.eye(wanted)).max() < 1e-12


def test_inner_solver_and_fan_in(spark, monkeypatch):
    rng = np.random.default_rng(1)
    a = rng.standard_normal((12, 12))
    a = a + a.T + 20 * np.eye(12)
    b = rng.standard_normal((12, 3))
    assert np.abs(a @ minres(lambda t: a @ t, b, 12) - b).max() < 1e-9
    assert (minres(lambda t: a @ t, np.zeros((12, 2)), 4) == 0).all()
    table = spark.read.parquet(f"{SF_DIR}/embeddings.parquet").repartition(6)
    monkeypatch.setattr(whitening, "FAN", 2)  # sums in two levels
    good = [r for r in table.collect()]
    check(whiten(table).collect(), [r.vec_id for r in good], [r.embedding for r in good])
