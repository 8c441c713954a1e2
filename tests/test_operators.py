"""Known answers, brute-force comparisons and leakage checks on small fixtures."""

import itertools
import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.functions import accounting as ac
from barloom.functions import indicators as ind
from barloom.functions import ordered
from barloom.functions import performance as pf
from barloom.functions import weights as wt
from barloom.operators import clusters, folds, inference, pairs, portfolio
from barloom.plans import candidates as cand
from barloom.plans import walkforward as wf

DAY = 86_400_000


def returns(spark, streams):
    rows = [(k, i * DAY, float(x)) for k, xs in streams.items() for i, x in enumerate(xs)]
    return spark.createDataFrame(rows, "symbol string, day bigint, ret double")


def gauss(n, seed, mean=0.001, sd=0.01):
    rnd = random.Random(seed)
    return [rnd.gauss(mean, sd) for _ in range(n)]


def walk(n, seed, drift=0.0005):
    rnd, p, out = random.Random(seed), 100.0, []
    for i in range(n):
        p *= math.exp(rnd.gauss(drift, 0.02))
        out.append(p)
    return out


def bars(spark, closes):
    rows = [(s, i * DAY, c * 1.001, c, 1.0, c) for s, xs in closes.items() for i, c in enumerate(xs)]
    return spark.createDataFrame(rows, "symbol string, open_time bigint, open double, close double, volume double, quote_volume double")


def test_drawdown_and_sharpe_known_answers(spark):
    out = pf.summary(returns(spark, {"a": [1.0, -0.5, 0.5], "flat": [0.01, 0.01, 0.01]}), ["symbol"]).collect()
    by = {r["symbol"]: r for r in out}
    assert by["a"]["max_drawdown"] == pytest.approx(-0.5)
    assert by["a"]["final"] == pytest.approx(1.5)
    assert by["flat"]["sharpe"] == 0.0


def test_total_loss_stays_a_total_loss(spark):
    row = pf.summary(returns(spark, {"a": [0.1, -1.0, 0.5]}), ["symbol"]).first()
    assert row["final"] == 0.0 and row["cagr"] == -1.0


def test_var_uses_the_floor_index(spark):
    xs = [-0.05, -0.045, -0.042, -0.04] + [0.001 * i for i in range(60)]
    row = pf.tail(returns(spark, {"a": xs}), ["symbol"]).first()
    assert row["var95"] == pytest.approx(-0.04)
    assert row["es95"] == pytest.approx(sum(sorted(xs)[:3]) / 3)


@pytest.mark.parametrize("w0,w1,p0,x,p1,want", [(1, 1, 100, 105, 110, 0.10), (0, 1, 100, 102, 112.2, 0.10), (0, 0, 100, 90, 80, 0.0)])
def test_transition_known_answers(spark, w0, w1, p0, x, p1, want):
    lit = [F.lit(float(v)) for v in (w0, w1, p0, x, p1, 0.0, 0.0)]
    leg = ac.transition(*lit, basis="previous")
    row = spark.range(1).select(leg["ret"].alias("r"), (leg["overnight"] + leg["intraday"] + leg["cash"] - leg["cost"]).alias("s")).first()
    assert row["r"] == pytest.approx(want)
    assert row["s"] == pytest.approx(want)


def test_future_cannot_change_past_weights(spark):
    pool = cand.candidate_pool(True)
    base = walk(420, 7)
    poisoned = base[:360] + [c * 3 for c in base[360:]]
    out = []
    for closes in (base, poisoned):
        rows = wf.with_macd(wf.featured(bars(spark, {"a": closes}), pool), pool, ["symbol"])
        out.append(rows.where("bar_idx <= 360").orderBy("bar_idx").select(wt.pool_weights(pool, F.col("bar_idx")).alias("w")).collect())
    assert out[0] == out[1]
    assert all(0.0 <= w <= 1.0 for r in out[0] for w in r["w"])


def test_restarted_slice_equals_own_history(spark):
    """Masking the full-history weights by the local warm-up equals computing on the cut slice."""
    pool = [s for s in cand.candidate_pool(True) if s.kind not in ("BuyHold",)]
    closes = walk(500, 11)
    full = wf.featured(bars(spark, {"a": closes}), pool).withColumn("slice_idx", F.col("bar_idx") - 100).where("slice_idx >= 0")
    cut = bars(spark, {"a": closes}).where(F.col("open_time") >= 100 * DAY)
    own = wf.featured(cut, pool)
    a = wf.with_macd(full, pool, ["symbol"]).orderBy("open_time").select(wt.pool_weights(pool, F.col("slice_idx")).alias("w")).collect()
    b = wf.with_macd(own, pool, ["symbol"]).orderBy("open_time").select(wt.pool_weights(pool, F.col("bar_idx")).alias("w")).collect()
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert x["w"] == pytest.approx(y["w"])


def test_training_prefix_moments_equal_direct_runs(spark):
    pool = [cand.buy_hold(), cand.sma_cross(10, 50), cand.ts_mom(63, 0.30)]
    panel = bars(spark, {"a": walk(400, 3), "b": walk(400, 5)})
    cuts = spark.createDataFrame([(s, f, c, c + 50, 400) for s in "ab" for f, c in ((0, 200), (1, 300))], "symbol string, fold_id int, train_end_idx bigint, test_end_idx bigint, n_bars bigint")
    feats, setup = wf.featured(panel, pool), wf.Setup(embargo=10)
    got = {(r["symbol"], r["fold_id"], r["pool_idx"]): r["sharpe"] for r in wf.train_scores(feats, pool, cuts, setup).collect()}
    streams = wf.training_streams(feats, pool, setup, cuts)
    for fold, cut in ((0, 190), (1, 290)):
        part = streams.where(F.col("bar_idx") < cut).groupBy("symbol", "pool_idx").agg(F.avg("ret").alias("m"), F.stddev_samp("ret").alias("s"))
        for r in part.collect():
            want = 0.0 if r["s"] < 1e-12 else (r["m"] - setup.rf / 365) / r["s"] * math.sqrt(365)
            assert got[(r["symbol"], fold, r["pool_idx"])] == pytest.approx(want, abs=1e-6)


def test_nested_selection_against_loops(spark):
    pool = [cand.buy_hold(), cand.sma_cross(5, 20), cand.ts_mom(21, 0.30)]
    closes = walk(330, 13)
    setup = wf.Setup(embargo=5)
    cuts = spark.createDataFrame([("a", 0, 300, 320, 330)], "symbol string, fold_id int, train_end_idx bigint, test_end_idx bigint, n_bars bigint")
    feats = wf.featured(bars(spark, {"a": closes}), pool)
    got = wf.select_nested(feats, pool, cuts, 60, 60, 20, setup).first()
    n, folds_, epoch = 295, [], 0
    while epoch + 60 < n and epoch + 80 < n:
        start = epoch + 80
        end = min(start + 60, n)
        if end - start < 30:
            break
        folds_.append((start, end))
        epoch += 60
    means = []
    for idx in range(len(pool)):
        scores = []
        for start, end in folds_:
            sub = wf.featured(bars(spark, {"a": closes[start : end + 1] if end < n else closes[start:n]}), pool)
            whole = spark.createDataFrame([("a", 0, 10_000)], "symbol string, fold_id int, train_end_idx bigint")
            rets = [r["ret"] for r in wf.training_streams(sub, pool, setup, whole).where(F.col("pool_idx") == idx).orderBy("bar_idx").collect()]
            m = sum(rets) / len(rets)
            sd = math.sqrt(sum((x - m) ** 2 for x in rets) / (len(rets) - 1))
            scores.append(0.0 if sd < 1e-12 else (m - setup.rf / 365) / sd * math.sqrt(365))
        means.append(sum(scores) / len(scores))
    assert got["pool_idx"] == max(range(len(pool)), key=lambda i: (round(means[i], 9), -i))
    assert got["sharpe"] == pytest.approx(max(means), abs=1e-6)


def test_waterfill_against_loop(spark):
    rnd = random.Random(5)
    days = {d: [rnd.expovariate(1.0) ** 2 + 1e-3 for _ in range(rnd.randint(1, 9))] for d in range(60)}
    rows = [(d, f"s{i}", x) for d, xs in days.items() for i, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "day int, symbol string, raw double").withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("day")))
    got = {(r["day"], r["symbol"]): r["weight"] for r in portfolio.waterfill(df, F.lit(2.0) / F.col("n")).collect()}
    for d, xs in days.items():
        cap, left, mass, want = 2.0 / len(xs), set(range(len(xs))), 1.0, {}
        while left:
            total = sum(xs[i] for i in left)
            over = {i for i in left if mass * xs[i] / total > cap + 1e-15}
            if not over:
                want.update({i: mass * xs[i] / total for i in left})
                break
            want.update({i: cap for i in over})
            mass, left = mass - cap * len(over), left - over
        total = sum(want.values())
        for i in want:
            assert got[(d, f"s{i}")] == pytest.approx(want[i] / total, abs=1e-12)


def test_average_correlation_against_pairs(spark):
    rnd = random.Random(9)
    streams = {f"s{i}": [rnd.gauss(0, 0.01) for _ in range(70)] for i in range(4)}
    got = {r["day"]: r["avg_corr"] for r in portfolio.average_correlation(returns(spark, streams)).collect()}
    for t in range(60, 70):
        vals = []
        for a, b in itertools.combinations(streams, 2):
            x, y = streams[a][t - 60 : t], streams[b][t - 60 : t]
            mx, my = sum(x) / 60, sum(y) / 60
            cov = sum((p - mx) * (q - my) for p, q in zip(x, y))
            vals.append(cov / math.sqrt(sum((p - mx) ** 2 for p in x) * sum((q - my) ** 2 for q in y)))
        assert got[t * DAY] == pytest.approx(sum(vals) / len(vals), abs=1e-9)


@pytest.mark.parametrize("tiles", [1, 3])
def test_pairwise_corr_tiles_cover_every_pair_once(spark, tiles):
    rnd = random.Random(2)
    streams = {f"s{i}": [rnd.gauss(0, 0.01) for _ in range(600)] for i in range(7)}
    df = returns(spark, streams).withColumnRenamed("symbol", "series_id")
    rows = pairs.pairwise_corr(df, tiles).collect()
    assert sorted((r["a"], r["b"]) for r in rows) == sorted(itertools.combinations(sorted(streams), 2))
    assert all(r["n"] == 600 for r in rows)


def test_chunked_helpers_match_plain_windows(spark):
    rnd = random.Random(4)
    df = spark.createDataFrame([(rnd.choice("abb"), i, float(rnd.randint(-9, 9))) for i in range(500)], "k string, seq bigint, x double")
    w = Window.partitionBy("k").orderBy("seq")
    want = df.select("k", "seq", F.lag("x").over(w).alias("p"), F.sum("x").over(w).alias("s")).collect()
    lagged = ordered.lag_split(df, ["k"], ["seq"], {"p": "x"}, ordered.seq_chunk("seq", 7))
    both = ordered.running_sum_split(lagged, ["k"], ["seq"], {"s": "x"}, ordered.seq_chunk("seq", 7)).select("k", "seq", "p", "s").collect()
    assert sorted(want, key=lambda r: r["seq"]) == sorted(both, key=lambda r: r["seq"])
    glob = ordered.lag_split(df, [], ["seq"], {"p": "x"}, ordered.seq_chunk("seq", 11)).orderBy("seq").collect()
    assert [r["p"] for r in glob] == [None] + [r["x"] for r in glob][:-1]


@pytest.mark.parametrize("strict", [True, False])
def test_asof_split_against_loop(spark, strict):
    rnd = random.Random(8)
    left = [("a", rnd.randint(0, 300)) for _ in range(60)] + [("b", 5)]
    right = {("a", rnd.randint(0, 300)): float(i) for i in range(40)}
    lf = spark.createDataFrame(sorted(set(left)), "k string, t bigint")
    rf = spark.createDataFrame([(k, t, v) for (k, t), v in right.items()], "k string, t bigint, v double")
    for r in ordered.asof_split(lf, rf, ["k"], "t", ["v"], 23, strict).collect():
        seen = [(t, v) for (k, t), v in right.items() if k == r["k"] and (t < r["t"] if strict else t <= r["t"])]
        assert r["v"] == (max(seen)[1] if seen else None)


def test_clusters_follow_long_chains(spark):
    names = [f"n{i:02d}" for i in range(20)]
    nodes = spark.createDataFrame([("g", n) for n in names], "g string, node string")
    edges = [("g", a, b, 0.95) for a, b in zip(names[:12], names[1:12])] + [("g", "n15", "n18", -0.97), ("g", "n13", "n14", 0.5)]
    found = spark.createDataFrame(edges, "g string, a string, b string, rho double")
    got = {r["node"]: r["cluster"] for r in clusters.single_linkage(nodes, found, ["g"]).collect()}
    assert all(got[n] == "n00" for n in names[:12]) and got["n18"] == "n15" and got["n14"] == "n14"


def test_folds_against_loop(spark):
    days = sorted(random.Random(6).sample(range(0, 2200), 1500))
    df = spark.createDataFrame([(d * DAY,) for d in days], "day bigint")
    got = [(r["train_end_ms"], r["test_end_ms"]) for r in folds.expanding_folds(df, 700, 300).orderBy("fold_id").collect()]
    want, epoch = [], days[0]
    while True:
        a = next((d for d in days if d >= epoch + 700), None)
        b = None if a is None else next((d for d in days if d >= a + 300), None)
        if b is None:
            break
        want.append((a * DAY, b * DAY))
        epoch += 300
    assert got == want


def test_selection_adjusted_reasons(spark):
    rets = returns(spark, {k: gauss(200, k) for k in ("none", "thin", "full", "fixed")})
    ledger = spark.createDataFrame([("thin", 1.0), ("full", 0.5), ("full", 1.5), ("full", 0.1)], "symbol string, sharpe double")
    pool = spark.createDataFrame([("none", 1, False), ("thin", 40, False), ("full", 2, False), ("fixed", 40, True)], "symbol string, pool_size int, prespecified boolean")
    got = {r["symbol"]: r for r in inference.selection_adjusted(rets, ledger, pool, ["symbol"]).collect()}
    assert got["none"]["reason"] == "no search history" and got["none"]["dsr"] is None
    assert got["thin"]["reason"] == "fewer than two trial Sharpes" and got["thin"]["dsr"] is None
    assert got["fixed"]["n_trials"] == 1 and got["fixed"]["dsr"] == got["fixed"]["psr"]
    assert got["full"]["n_trials"] == 3 and got["full"]["dsr"] < got["full"]["psr"]


def test_posterior_is_reproducible_and_centred(spark):
    rets = returns(spark, {"a": gauss(400, 1)})
    one = inference.bayesian_sharpe(rets, ["symbol"], 4000).first()
    two = inference.bayesian_sharpe(rets.repartition(3), ["symbol"], 4000).first()
    assert one["posterior_mean"] == pytest.approx(two["posterior_mean"], abs=1e-9)
    assert one["ci_low"] < one["median"] < one["ci_high"] and one["draws"] == 4000


def test_reality_check_noise_and_skill(spark):
    rnd = random.Random(3)
    rows = [("noise", i, d * DAY, rnd.gauss(0, 0.01)) for i in range(8) for d in range(250)]
    rows += [("skill", i, d * DAY, rnd.gauss(0.004 if i == 0 else 0.0, 0.01)) for i in range(8) for d in range(250)]
    df = spark.createDataFrame(rows, "g string, series int, day bigint, ret double")
    got = {r["g"]: r["p_value"] for r in inference.reality_check(df, ["g"], "series", 60, 10).collect()}
    assert got["skill"] <= 2 / 61 and got["noise"] > 0.05


def test_chunked_helpers_keep_null_keys(spark):
    rows = [(k, i, float(i)) for k in (None, "a") for i in range(6)]
    df = spark.createDataFrame(rows, "k string, i bigint, v double")
    lagged = ordered.lag_split(df, ["k"], ["i"], {"p": "v"}, ordered.seq_chunk("i", 2)).collect()
    assert {(r["k"], r["i"], r["p"]) for r in lagged} == {(k, i, float(i - 1) if i else None) for k in (None, "a") for i in range(6)}
    summed = ordered.running_sum_split(df, ["k"], ["i"], {"s": "v"}, ordered.seq_chunk("i", 2)).collect()
    assert {(r["k"], r["i"], r["s"]) for r in summed} == {(k, i, float(sum(range(i + 1)))) for k in (None, "a") for i in range(6)}
    left = spark.createDataFrame([(None, 5), ("a", 3)], "k string, t bigint")
    right = spark.createDataFrame([(None, 1, "x"), (None, 4, "y"), ("a", 9, "z")], "k string, t bigint, w string")
    assert {(r["k"], r["t"], r["w"]) for r in ordered.asof_split(left, right, ["k"], "t", ["w"], 2).collect()} == {(None, 5, "y"), ("a", 3, None)}


def test_checkpoint_folder_needs_a_shared_one():
    from types import SimpleNamespace

    from barloom import session

    set_to = []
    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None, setCheckpointDir=set_to.append)
    bare = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: default), sparkContext=context)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(bare)
    named = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: "/shared/spark"), sparkContext=context)
    assert session.checkpoint_dir(named) == "/shared/spark" and set_to == ["/shared/spark"]
    context.getCheckpointDir = lambda: "file:/elsewhere/x"
    session.checkpoint_dir(named)
    assert set_to == ["/shared/spark"] * 2
    context.getCheckpointDir = lambda: "file:/shared/spark/abc"
    session.checkpoint_dir(named)
    assert len(set_to) == 2


def test_a_blanked_link_is_an_edit(spark):
    import hashlib
    import json

    from barloom.catalog.evidence import body
    from barloom.operators import audits

    rows, link = [], None
    for k in range(1, 5):
        entry = {"accepted": True, "category": "strategy", "cents": k, "id": k, "prev_hash": link, "timestamp": str(k)}
        digest = hashlib.sha256(json.dumps(entry, separators=(",", ":"), sort_keys=True).encode()).hexdigest()
        rows.append((k, str(k), "strategy", k, True, digest, None if k == 3 else link))
        link = digest
    df = spark.createDataFrame(rows, "id bigint, timestamp string, category string, cents bigint, accepted boolean, hash string, prev_hash string")
    out = {r["id"]: (r["gap"], r["regression"], r["edited"], r["broken_link"]) for r in audits.hash_chain(df, ordered.seq_chunk("id"), body()).collect()}
    assert out == {1: (False,) * 4, 2: (False,) * 4, 3: (False, False, True, False), 4: (False,) * 4}


def test_cost_line_does_not_depend_on_the_order_of_the_sum(spark):
    turns = [3.2849999999999997, 3.2850000000000006, 3.284999999999997, 0.0, 20.198232323232315]  # the first three: 3.285, summed in other orders
    df = spark.createDataFrame([(i, x) for i, x in enumerate(turns)], "i int, turns double")
    got = [r[0] for r in df.orderBy("i").select(portfolio.cost_line(F.col("turns"))).collect()]
    assert got == [-0.004928, -0.004928, -0.004928, 0.0, -0.030297]


def test_chunked_helpers_move_rows_once(spark):
    """Rows sorted for the windows inside the chunks are not dealt again for the join with what the chunks carry."""
    names = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {name: spark.conf.get(name, None) for name in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    try:
        df = spark.range(100).selectExpr("id % 3 k", "id i", "id * 1.0D v")
        chunk = ordered.seq_chunk("i", 10)
        for out in (ordered.lag_split(df, ["k"], ["i"], {"p": "v"}, chunk), ordered.running_sum_split(df, ["k"], ["i"], {"s": "v"}, chunk), ordered.max_before_split(df, ["k"], ["i"], {"m": "v"}, chunk)):
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange hashpartitioning") <= 4  # the rows; totals by chunk, across chunks and to the rows
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
