"""Path kernels against the index tables, and the matrix product against sums over rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.functions import performance as pf
from barloom.operators import paths
from barloom.operators import resample as rs

DAY = 86_400_000


def streams(spark, sizes, seed=1):
    rnd = random.Random(seed)
    return spark.createDataFrame([(s, d * DAY, rnd.gauss(0, 0.02)) for s, n in sizes.items() for d in range(n)], "symbol string, day bigint, ret double")


@pytest.mark.parametrize("scheme", ["stationary", "circular", "moving", "shuffled"])
def test_draws_equal_the_index_tables(spark, scheme):
    returns = streams(spark, {"a": 53, "b": 7, "c": 1})
    sizes = rs.lengths(returns, ["symbol"])
    make = {
        "stationary": (lambda: rs.stationary(sizes, ["symbol"], 6, 5), lambda n, r: paths.stationary_draws(n, r, 5)),
        "circular": (lambda: rs.circular(sizes, ["symbol"], 6, 5), lambda n, r: paths.circular_draws(n, r, 5)),
        "moving": (lambda: rs.moving(sizes, ["symbol"], 6, 5), lambda n, r: paths.moving_draws(n, r, 5)),
        "shuffled": (lambda: rs.shuffled(sizes, ["symbol"], 6), paths.shuffle_draws),
    }
    table, kernel = make[scheme]
    got = {(r.symbol, r.rep, r.pos): r.idx for r in table().collect()}
    for symbol, n in (("a", 53), ("b", 7), ("c", 1)):
        drawn = kernel(n, np.arange(6))
        assert drawn.shape == (6, n)
        assert all(got[symbol, k, p] == drawn[k, p] for k in range(6) for p in range(n))


def test_measures_equal_the_summary(spark, monkeypatch):
    returns = streams(spark, {"a": 90, "b": 2}).unionByName(spark.createDataFrame([("lost", d * DAY, -1.0 if d == 3 else 0.1) for d in range(8)], "symbol string, day bigint, ret double"))
    monkeypatch.setattr(paths, "CELLS", 200)  # several rows of work a stream
    got = {(r.symbol, r.rep): r for r in paths.replicate(returns, ["symbol"], 9, lambda n, r: paths.stationary_draws(n, r, 5)).collect()}
    index = rs.stationary(rs.lengths(returns, ["symbol"]), ["symbol"], 9, 5)
    want = rs.path_metrics(rs.resampled(index, returns, ["symbol"]), ["symbol"]).collect()
    assert len(got) == len(want) == 27
    for r in want:
        for name in paths.MEASURES:
            assert got[r.symbol, r.rep][name] == pytest.approx(r[name], rel=1e-9, abs=1e-12), (r.symbol, name)


def test_loss_shares_equal_the_horizon_windows(spark):
    returns = streams(spark, {"a": 40, "short": 4})
    got = {(r.symbol, r.rep): r.q for r in paths.replicate(returns, ["symbol"], 3, paths.shuffle_draws, paths.loss_shares(10), ["q"]).collect()}
    index = rs.resampled(rs.shuffled(rs.lengths(returns, ["symbol"]), ["symbol"], 3), returns, ["symbol"])
    h = index.select("symbol", "rep", pf.horizon_return(10, ["symbol", "rep"], "pos").alias("h")).where("h is not null")
    for r in h.groupBy("symbol", "rep").agg(F.avg((F.col("h") < 0).cast("double")).alias("q")).collect():
        assert got[r.symbol, r.rep] == pytest.approx(r.q)
    assert got["short", 0] is None


def test_matrix_product_equals_sums_over_drawn_rows(spark):
    rnd = random.Random(4)
    rows = [("k", s, i, rnd.gauss(0, 1), 45) for s in range(3) for i in range(45)] + [("z", 0, i, rnd.gauss(0, 1), 5) for i in range(5)]
    got = {(r.symbol, r.rep, r.series): (r.s1, r.s2) for r in paths.drawn_sums(spark.createDataFrame(rows, "symbol string, series int, idx long, x double, n long"), ["symbol"], "series", 7, 4, width=16).collect()}
    assert len(got) == 7 * 4
    value = {(k, s, i): x for k, s, i, x, _ in rows}
    for (k, rep, s), sums in got.items():
        drawn = paths.stationary_draws(45 if k == "k" else 5, np.array([rep]), 4)[0]
        xs = [value[k, s, i] for i in drawn]
        assert sums == pytest.approx((sum(xs), sum(x * x for x in xs)))
