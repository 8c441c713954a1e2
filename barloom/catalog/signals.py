"""Indicators, target weights, accounting and costs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import accounting as ac
from ..functions import costs, performance as pf
from ..functions import indicators as ind
from ..functions import weights as wt
from ..functions.numeric import r as rd
from ..operators import orders as od
from ..plans import candidates as cand
from ..sources import panels
from ..sources.panels import Tables
from .ingest import close_returns, day_number
from .registry import cte, query, r, sql
from .sqlgen import d, features_cte, name, weight_sql, weights_cte


def prepared(t: Tables) -> DataFrame:
    return ind.series(panels.brand_bars(t))


def featured(t: Tables, features, macd=()) -> DataFrame:
    base = prepared(t)
    if macd:
        base = ind.add_macd(base, list(macd), ["symbol"])
    return ind.add_features(base, features)


def feature_query(op: str, *features: tuple) -> None:
    """Register a query that lists the given features of every bar."""
    label = features_cte(f"f_{op}", features)
    cols = ", ".join(r(name(f), name(f), 9 if f[0] == "sma" else 6) for f in features)  # averages of 6-digit closes are exact at 9

    @query(op, sql(f"SELECT symbol, open_time, {cols} FROM {label}", label))
    def _(t: Tables) -> DataFrame:
        df = featured(t, features)
        return df.select("symbol", "open_time", *[rd(name(f), 9 if f[0] == "sma" else 6).alias(name(f)) for f in features])


feature_query("ind_sma", ("sma", 20), ("sma", 50), ("sma", 200))
feature_query("ind_price_stdev", ("psd", 20), ("psd", 50))
feature_query("ind_rsi", ("rsi", 2), ("rsi", 14))
feature_query("ind_ann_vol", ("vol", 20), ("vol", 60))
feature_query("ind_roll_extreme", ("max", 50), ("min", 50), ("max", 100))
feature_query("ind_momentum", ("mom", 63), ("mom", 252))

EMA_SQL = """SELECT symbol{slice}, bar_idx, close, {seed} FROM {source} WHERE bar_idx = 0
  UNION ALL -- recursive
  SELECT symbol{slice}, bar_idx, close, {carry} FROM (
    SELECT s.symbol{sslice}, s.bar_idx, s.close, {step} FROM {label} e JOIN {source} s ON s.symbol = e.symbol {on} AND s.bar_idx = e.bar_idx + 1)"""


def ema_cte(label: str, source: str, slice_key: str = "") -> str:
    """MACD line and signal per slice as a recursive CTE; columns m_k, g_k (unshifted)."""
    seed, carry, step = [], [], []
    for k, (f, s, g) in enumerate(cand.MACD_SETS):
        kf, ks, kg = 2.0 / (f + 1.0), 2.0 / (s + 1.0), 2.0 / (g + 1.0)
        seed.append(f"close AS ef{k}, close AS es{k}, 0.0::DOUBLE AS g{k}")
        step.append(
            f"s.close * {d(kf)} + e.ef{k} * {d(1.0 - kf)} AS ef{k}, s.close * {d(ks)} + e.es{k} * {d(1.0 - ks)} AS es{k}, e.g{k} AS pg{k}"
        )
        carry.append(f"ef{k}, es{k}, (ef{k} - es{k}) * {d(kg)} + pg{k} * {d(1.0 - kg)} AS g{k}")
    text = EMA_SQL.format(
        slice=f", {slice_key}" if slice_key else "", sslice=f", s.{slice_key}" if slice_key else "",
        on=f"AND s.{slice_key} = e.{slice_key}" if slice_key else "",
        seed=", ".join(seed), carry=", ".join(carry), step=", ".join(step), source=source, label=label,
    )
    cte(label, text, source)
    return label


def shifted_macd(label: str, ema: str, part: str, keep: str) -> str:
    """Columns macd_f_s_g / macdsig_f_s_g as known before the bar."""
    cols = ", ".join(
        f"lag(ef{k} - es{k}) OVER ({part}) AS {name(('macd', *m))}, lag(g{k}) OVER ({part}) AS {name(('macdsig', *m))}"
        for k, m in enumerate(cand.MACD_SETS)
    )
    cte(label, f"SELECT {keep}, {cols} FROM {ema}", ema)
    return label


ema_cte("ema", "idx")
shifted_macd("macd", "ema", "PARTITION BY symbol ORDER BY bar_idx", "symbol, bar_idx")
MACD_NAMES = [n for m in cand.MACD_SETS for n in (name(("macd", *m)), name(("macdsig", *m)))]


@query(
    "ind_ema_macd",
    sql(f"SELECT symbol, open_time, {', '.join(r(n, n) for n in MACD_NAMES)} FROM idx JOIN macd USING (symbol, bar_idx)", "macd", "idx"),
)
def _(t: Tables) -> DataFrame:
    df = ind.add_macd(prepared(t), cand.MACD_SETS, ["symbol"])
    return df.select("symbol", "open_time", *[rd(n).alias(n) for n in MACD_NAMES])


cte(
    "realized",
    """SELECT *, CASE WHEN bar_idx >= 20 THEN stddev_samp(lr) OVER (PARTITION BY symbol ORDER BY open_time ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)
         * sqrt(252.0::DOUBLE) END AS rv FROM series""",
    "series",
)


@query("ind_realized_vol", sql(f"SELECT symbol, open_time, {r('rv', 'rv')} FROM realized", "realized"))
def _(t: Tables) -> DataFrame:
    return prepared(t).select("symbol", "open_time", rd(ind.realized_vol(20, 252)).alias("rv"))


CHAN = (("px", 1), ("max", 50), ("min", 50))
features_cte("f_chan", CHAN)


@query("ind_channel_pos", sql(f"SELECT symbol, open_time, {r('(px_1 - min_50) / nullif(max_50 - min_50, 0)', 'pos')} FROM f_chan", "f_chan"))
def _(t: Tables) -> DataFrame:
    pos = F.try_divide(F.col("px_1") - F.col("min_50"), F.col("max_50") - F.col("min_50"))
    return featured(t, CHAN).select("symbol", "open_time", rd(pos).alias("pos"))


ZED = (("px", 1), ("sma", 30), ("psd", 30))
features_cte("f_zed", ZED)


@query("ind_zscore", sql(f"SELECT symbol, open_time, {r('(px_1 - sma_30) / nullif(psd_30, 0)', 'z')} FROM f_zed", "f_zed"))
def _(t: Tables) -> DataFrame:
    z = F.try_divide(F.col("px_1") - F.col("sma_30"), F.col("psd_30"))
    return featured(t, ZED).select("symbol", "open_time", rd(z).alias("z"))


@query(
    "ind_adv",
    sql(
        f"""SELECT symbol, open_time, {r('avg(quote_volume) OVER w30', 'adv30', 6)},
              CASE WHEN bar_idx >= 20 THEN {r("stddev_samp(lr) OVER w20 * sqrt(365.0::DOUBLE)")} END AS rv20, volume AS day_volume FROM series
            WINDOW w30 AS (PARTITION BY symbol ORDER BY open_time ROWS BETWEEN 29 PRECEDING AND CURRENT ROW),
                   w20 AS (PARTITION BY symbol ORDER BY open_time ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""",
        "series",
    ),
)
def _(t: Tables) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy("open_time").rowsBetween(-29, 0)
    return prepared(t).select(
        "symbol", "open_time", rd(F.avg("quote_volume").over(w), 6).alias("adv30"), rd(ind.realized_vol(20, 365)).alias("rv20"),
        F.col("volume").alias("day_volume"),
    )


# ------------------------------------------------------------ return windows

W_SYM = "PARTITION BY symbol ORDER BY day"
cte("cumret", f"SELECT *, CASE WHEN count(ret) OVER w >= 90 THEN product(1 + ret) OVER w - 1 END AS mom FROM rets WINDOW w AS ({W_SYM} ROWS BETWEEN 90 PRECEDING AND 1 PRECEDING)", "rets")


@query("win_trailing_cumret", sql(f"SELECT symbol, day, {r('mom', 'mom')} FROM cumret", "cumret"))
def _(t: Tables) -> DataFrame:
    return close_returns(panels.brand_bars(t)).select("symbol", "day", rd(pf.trailing_cum_return(90)).alias("mom"))


def equity_sql(source: str, keys: str, order: str = "day") -> str:
    """SELECT text adding equity, peak and drawdown to a stream."""
    w = f"PARTITION BY {keys} ORDER BY {order} ROWS UNBOUNDED PRECEDING"
    return f"""SELECT *, least(0.0::DOUBLE, equity / peak - 1) AS drawdown FROM (SELECT *, greatest(1.0::DOUBLE, max(equity) OVER ({w})) AS peak
       FROM (SELECT *, product(1 + ret) OVER ({w}) AS equity FROM {source}))"""


cte("eq", equity_sql("rets", "symbol"), "rets")


@query("win_equity", sql(f"SELECT symbol, day, {r('equity', 'equity', 8)} FROM eq", "eq"))
def _(t: Tables) -> DataFrame:
    return pf.with_equity(close_returns(panels.brand_bars(t)), ["symbol"]).select("symbol", "day", rd("equity", 8).alias("equity"))


@query("win_drawdown", sql(f"SELECT symbol, day, {r('drawdown', 'drawdown', 9)} FROM eq", "eq"))
def _(t: Tables) -> DataFrame:
    return pf.with_equity(close_returns(panels.brand_bars(t)), ["symbol"]).select("symbol", "day", rd("drawdown", 9).alias("drawdown"))


cte(
    "tilt",
    """SELECT *, CASE WHEN mom IS NULL OR k < 2 THEN 1.0::DOUBLE ELSE raw / (sum(CASE WHEN mom IS NOT NULL THEN raw END) OVER (PARTITION BY day) / k) END AS multiplier
       FROM (SELECT *, 1.0 - 0.5::DOUBLE + 2 * 0.5::DOUBLE * ((rk - 1)::DOUBLE / nullif(k - 1, 0)) AS raw FROM (SELECT *, count(mom) OVER (PARTITION BY day) AS k,
             row_number() OVER (PARTITION BY day ORDER BY mom NULLS LAST, symbol) AS rk FROM cumret))""",
    "cumret",
)


@query("win_rank_tilt", sql(f"SELECT symbol, day, {r('multiplier', 'multiplier')} FROM tilt", "tilt"))
def _(t: Tables) -> DataFrame:
    from ..operators.portfolio import tilt_multiplier

    scored = close_returns(panels.brand_bars(t)).withColumn("mom", pf.trailing_cum_return(90))
    return tilt_multiplier(scored, ["day"]).select("symbol", "day", rd("multiplier").alias("multiplier"))


@query(
    "win_lag_change",
    sql(
        f"""SELECT symbol, day, {r('ret - lag(ret, 1, 0.0) OVER w', 'change')}, lag(day) OVER w IS NULL AS first_row FROM aligned WINDOW w AS ({W_SYM})""",
        "aligned",
    ),
)
def _(t: Tables) -> DataFrame:
    from ..operators.cleaning import align_to_timeline
    from .ingest import timeline_of

    bars = panels.brand_bars(t)
    w = Window.partitionBy("symbol").orderBy("day")
    dense = align_to_timeline(close_returns(bars), timeline_of(bars), ["symbol"])
    return dense.select(
        "symbol", "day", rd(F.col("ret") - F.lag("ret", 1, 0.0).over(w)).alias("change"), F.lag("day").over(w).isNull().alias("first_row")
    )


cte("horizon", f"SELECT *, CASE WHEN count(ret) OVER w >= 63 THEN product(1 + ret) OVER w - 1 END AS hret FROM rets WINDOW w AS ({W_SYM} ROWS BETWEEN CURRENT ROW AND 62 FOLLOWING)", "rets")


@query("win_rolling_horizon", sql(f"SELECT symbol, day, {r('hret', 'hret')} FROM horizon WHERE hret IS NOT NULL", "horizon"))
def _(t: Tables) -> DataFrame:
    df = close_returns(panels.brand_bars(t)).withColumn("hret", pf.horizon_return(63, ["symbol"]))
    return df.where("hret is not null").select("symbol", "day", rd("hret").alias("hret"))


# ------------------------------------------------------------ weights

FULL_POOL = cand.candidate_pool(True)
WEIGHT_STATS = f"symbol, name, count(*) AS n, count(*) FILTER (weight > 0) AS n_on, {r('avg(weight)', 'mean_w')}, {r('max_by(weight, open_time)', 'last_w')}, min(open_time) FILTER (weight > 0) AS first_on"


def exploded_weights(df: DataFrame, pool: list[cand.Spec], keep=("symbol", "open_time"), idx: str = "bar_idx") -> DataFrame:
    """(keep, pool_idx, name, weight) of a pool over a featured series."""
    names = F.array(*[F.lit(s.name) for s in pool])
    rows = df.select(*keep, F.posexplode(wt.pool_weights(pool, F.col(idx))).alias("pool_idx", "weight"))
    return rows.withColumn("name", F.element_at(names, F.col("pool_idx") + 1))


def weight_stats(rows: DataFrame) -> DataFrame:
    on = F.col("weight") > 0
    return rows.groupBy("symbol", "name").agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(on, 1)).alias("n_on"),
        rd(F.avg("weight")).alias("mean_w"),
        rd(F.max_by("weight", "open_time")).alias("last_w"),
        F.min(F.when(on, F.col("open_time"))).alias("first_on"),
    )


def macd_of(features) -> list[tuple]:
    return [f[1:] for f in features if f[0] == "macd"]


def weight_query(op: str, pool: list[cand.Spec]) -> None:
    feats = cand.pool_features(pool)
    plain = [f for f in feats if f[0] != "macd"]
    source = "series"
    if macd_of(feats):
        if plain:
            features_cte(f"fp_{op}", plain)
        cte(f"fm_{op}", f"SELECT * FROM {'fp_' + op if plain else 'series'} JOIN macd USING (symbol, bar_idx)", "fp_" + op if plain else "series", "macd")
        source = f"fm_{op}"
    elif plain:
        source = features_cte(f"fp_{op}", plain)
    weights_cte(f"w_{op}", pool, source, keep="symbol, open_time")

    @query(op, sql(f"SELECT {WEIGHT_STATS} FROM w_{op} GROUP BY symbol, name", f"w_{op}"))
    def _(t: Tables) -> DataFrame:
        return weight_stats(exploded_weights(featured(t, feats, macd_of(feats)), pool))


def of_kind(kind: str) -> list[cand.Spec]:
    return [s for s in FULL_POOL if s.kind == kind]


weight_query("wt_buyhold", of_kind("BuyHold"))
weight_query("wt_sma_cross", of_kind("SmaCross"))
weight_query("wt_trend_vol", of_kind("TrendVol"))
weight_query("wt_rsi_dip", of_kind("RsiDipBuy"))
weight_query("wt_macd", of_kind("MacdTrend"))
weight_query("wt_tsmom", of_kind("TSMom"))
weight_query("wt_dual_mom", of_kind("DualMom"))
weight_query("wt_channel", of_kind("ChanBreak"))
weight_query("wt_meanrev_z", of_kind("MeanRevZ"))
weight_query("wt_ensemble", of_kind("Ensemble"))
weight_query("wt_blend", [cand.blend([(cand.trend_vol(50, 0.30), 0.7), (cand.risk_ensemble(), 0.3)]), cand.blend([(cand.sma_cross(10, 50), 1.0), (cand.buy_hold(), 3.0)])])
weight_query("wt_risk_ensemble", [cand.risk_ensemble()])

features_cte("f_x", [("sma", 20), ("sma", 50)])
cte(
    "cross_sig",
    """SELECT symbol, open_time, close, bar_idx, CASE WHEN bar_idx < 50 THEN 'hold' WHEN fp <= sp AND fn > sn THEN 'buy' WHEN fp >= sp AND fn < sn THEN 'sell' ELSE 'hold' END AS signal
       FROM (SELECT *, avg(close) OVER (PARTITION BY symbol ORDER BY open_time ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS fn,
               avg(close) OVER (PARTITION BY symbol ORDER BY open_time ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS sn, sma_20 AS fp, sma_50 AS sp FROM f_x)""",
    "f_x",
)


def cross_signals(t: Tables, fast: int = 20, slow: int = 50) -> DataFrame:
    now = ind.add_features(prepared(t), [("sma", fast), ("sma", slow)], through=0).withColumnsRenamed({f"sma_{fast}": "fn", f"sma_{slow}": "sn"})
    both = ind.add_features(now, [("sma", fast), ("sma", slow)]).withColumnsRenamed({f"sma_{fast}": "fp", f"sma_{slow}": "sp"})
    signal = (
        F.when(F.col("bar_idx") < slow, "hold")
        .when((F.col("fp") <= F.col("sp")) & (F.col("fn") > F.col("sn")), "buy")
        .when((F.col("fp") >= F.col("sp")) & (F.col("fn") < F.col("sn")), "sell")
        .otherwise("hold")
    )
    return both.withColumn("signal", signal)


@query("sig_sma_cross", sql("SELECT symbol, open_time, signal FROM cross_sig WHERE signal <> 'hold'", "cross_sig"))
def _(t: Tables) -> DataFrame:
    return cross_signals(t).where("signal <> 'hold'").select("symbol", "open_time", "signal")


RULE = cand.trend_vol(50, 0.30)
features_cte("f_rule", cand.pool_features([RULE]))
cte("rule_w", f"SELECT *, {weight_sql(RULE)} AS weight FROM f_rule", "f_rule")


def rule_weights(t: Tables, spec: cand.Spec = RULE) -> DataFrame:
    return featured(t, spec.features).withColumn("weight", wt.weight(spec, F.col("bar_idx")))


cte(
    "lagged",
    """SELECT symbol, open_time, l AS latency, CASE WHEN bar_idx - l < 1 THEN 0.0::DOUBLE ELSE w END AS weight FROM (
         SELECT symbol, open_time, bar_idx, 0 AS l, weight AS w FROM rule_w UNION ALL
         SELECT symbol, open_time, bar_idx, 1, lag(weight, 1) OVER (PARTITION BY symbol ORDER BY open_time) FROM rule_w UNION ALL
         SELECT symbol, open_time, bar_idx, 2, lag(weight, 2) OVER (PARTITION BY symbol ORDER BY open_time) FROM rule_w)""",
    "rule_w",
)


@query("wt_latency", sql(f"SELECT symbol, latency, {r('avg(weight)', 'mean_w')}, {r('sum(weight * weight)', 'sq')}, min(open_time) FILTER (weight > 0) AS first_on FROM lagged GROUP BY 1, 2", "lagged"))
def _(t: Tables) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy("open_time")
    delayed = [F.struct(F.lit(k).alias("latency"), (F.lag("weight", k).over(w) if k else F.col("weight")).alias("weight")) for k in (0, 1, 2)]
    rows = rule_weights(t).select("symbol", "open_time", "bar_idx", F.array(*delayed).alias("z")).select(
        "symbol", "open_time", "bar_idx", F.explode("z").alias("z")
    )
    held = F.when(F.col("bar_idx") - F.col("z.latency") < 1, F.lit(0.0)).otherwise(F.col("z.weight"))
    return rows.select("symbol", "open_time", F.col("z.latency").alias("latency"), held.alias("weight")).groupBy("symbol", "latency").agg(
        rd(F.avg("weight")).alias("mean_w"), rd(F.sum(F.col("weight") * F.col("weight"))).alias("sq"), F.min(F.when(F.col("weight") > 0, F.col("open_time"))).alias("first_on")
    )


# ------------------------------------------------------------ orders

cte(
    "cycles",
    """SELECT open_time AS cycle, symbol, CASE WHEN k % 3 = 0 THEN 0.0 ELSE (k % 5)::DOUBLE END AS qty,
              CASE WHEN k % 29 = 4 THEN NULL ELSE close END AS price, CASE WHEN dayno % 101 = 0 THEN -1e9::DOUBLE ELSE 5000.0::DOUBLE END AS cash,
              CASE WHEN k % 31 = 5 THEN 1.5::DOUBLE WHEN k % 4 = 0 THEN 0.0 ELSE round(weight / 3, 4) END AS target, k % 13 = 7 AS stale, k % 13 = 7 AS blocked
       FROM (SELECT *, open_time // 86400000 AS dayno, (open_time // 86400000) + ascii(right(symbol, 1)) * 7 AS k FROM rule_w)""",
    "rule_w",
)


def cycles(t: Tables) -> DataFrame:
    """Trading cycles from the panel: every day is a cycle with held quantities, marks and targets."""
    k = day_number() + F.ascii(F.substring("symbol", -1, 1)) * 7
    return rule_weights(t).withColumn("k", k).select(
        F.col("open_time").alias("cycle"),
        "symbol",
        F.when(F.col("k") % 3 == 0, 0.0).otherwise((F.col("k") % 5).cast("double")).alias("qty"),
        F.when(F.col("k") % 29 != 4, F.col("close")).alias("price"),
        F.when(day_number() % 101 == 0, -1e9).otherwise(5000.0).alias("cash"),
        F.when(F.col("k") % 31 == 5, 1.5).when(F.col("k") % 4 == 0, 0.0).otherwise(F.round(F.col("weight") / 3, 4)).alias("target"),
        (F.col("k") % 13 == 7).alias("stale"),
        (F.col("k") % 13 == 7).alias("blocked"),
    )


cte(
    "cycle_eq",
    """SELECT cycle, max(cash) + sum(qty * coalesce(price, 0)) AS equity, bool_or(abs(qty) > 1e-12 AND price IS NULL) AS unmarked,
              sum(CASE WHEN blocked THEN qty * coalesce(price, 0) ELSE 0 END) AS locked, sum(CASE WHEN NOT blocked AND target BETWEEN 0 AND 1 THEN target ELSE 0 END) AS gross
       FROM cycles GROUP BY 1""",
    "cycles",
)


@query(
    "wt_gross_cap",
    sql(
        f"""SELECT cycle, symbol, {r('lw', 'locked_weight')}, {r('scale', 'scale')},
              {r('CASE WHEN NOT blocked AND target BETWEEN 0 AND 1 THEN target * scale ELSE target END', 'scaled_target')}
            FROM (SELECT *, CASE WHEN gross > room + 1e-12::DOUBLE THEN room / gross ELSE 1.0::DOUBLE END AS scale
                  FROM (SELECT *, greatest(0.0::DOUBLE, 0.9::DOUBLE - lw) AS room FROM (SELECT *, CASE WHEN NOT unmarked AND equity > 0 THEN locked / equity ELSE 0.0::DOUBLE END AS lw
                        FROM cycles JOIN cycle_eq USING (cycle))))""",
        "cycles",
        "cycle_eq",
    ),
)
def _(t: Tables) -> DataFrame:
    out = od.gross_cap(cycles(t), 0.9)
    return out.select("cycle", "symbol", rd("locked_weight").alias("locked_weight"), rd("scale").alias("scale"), rd("scaled_target").alias("scaled_target"))


cte(
    "decisions",
    """SELECT *, CASE WHEN NOT starts_with(action, 'blocked') THEN CASE WHEN abs(qty) <= 1e-12 AND target = 0 THEN 0.0::DOUBLE ELSE qty * price / equity END END AS current_weight,
              CASE WHEN NOT starts_with(action, 'blocked') THEN cycle::VARCHAR || '|' || symbol || '|REBAL|' || format('{:.4f}', target) END AS idem_key
       FROM (SELECT *, CASE WHEN stale THEN 'blocked_stale' WHEN unmarked THEN 'blocked_missing_mark' WHEN target NOT BETWEEN 0 AND 1 THEN 'blocked_invalid_target'
               WHEN abs(qty) <= 1e-12 AND target = 0 THEN 'hold' WHEN price IS NULL THEN 'blocked_invalid_price' WHEN equity <= 0 THEN 'blocked_invalid_equity'
               WHEN abs(target - qty * price / equity) <= 1e-4::DOUBLE THEN 'hold' WHEN target > qty * price / equity THEN 'BUY' ELSE 'SELL' END AS action
             FROM cycles JOIN cycle_eq USING (cycle))""",
    "cycles",
    "cycle_eq",
)


@query("wt_decision", sql(f"SELECT cycle, symbol, action, {r('current_weight', 'current_weight')}, idem_key FROM decisions", "decisions"))
def _(t: Tables) -> DataFrame:
    return od.decide(cycles(t)).select("cycle", "symbol", "action", rd("current_weight").alias("current_weight"), "idem_key")


@query(
    "wt_buy_scale",
    sql(
        f"""SELECT cycle, {r('pc', 'projected_cash', 4)}, {r('bn', 'buy_notional', 4)}, {r('CASE WHEN bn * 1.001::DOUBLE > 1e-12 THEN least(1.0::DOUBLE, pc / (bn * 1.001::DOUBLE)) ELSE 1.0 END', 'scale')}
            FROM (SELECT cycle, max(cash) + sum(CASE WHEN dv < 0 THEN -dv * 0.999::DOUBLE ELSE 0 END) AS pc, sum(CASE WHEN dv > 0 THEN dv ELSE 0 END) AS bn
                  FROM (SELECT *, target * equity - qty * price AS dv FROM decisions WHERE action IN ('BUY', 'SELL')) GROUP BY 1)""",
        "decisions",
    ),
)
def _(t: Tables) -> DataFrame:
    out = od.buy_scale(od.decide(cycles(t)))
    return out.select("cycle", rd("projected_cash", 4).alias("projected_cash"), rd("buy_notional", 4).alias("buy_notional"), rd("scale").alias("scale"))


@query(
    "pf_audit_positions",
    sql(
        f"""SELECT cycle, symbol, qty, price, {r('qty * price', 'value', 6)}, {r('CASE WHEN NOT unmarked THEN least(1000000.0::DOUBLE, qty * price / greatest(equity, 1e-9::DOUBLE)) END', 'weight')},
              {r('CASE WHEN NOT unmarked THEN equity END', 'equity', 6)} FROM cycles JOIN cycle_eq USING (cycle) WHERE abs(qty) > 1e-12""",
        "cycles",
        "cycle_eq",
    ),
)
def _(t: Tables) -> DataFrame:
    out = od.audit_positions(cycles(t))
    return out.select("cycle", "symbol", "qty", "price", rd("value").alias("value"), rd(F.when(F.col("weight").isNotNull(), F.least(F.lit(1e6), "weight"))).alias("weight"), rd("equity").alias("equity"))


# ------------------------------------------------------------ accounting

COST = costs.flat_rate(0.001, 5.0, 5.0)
RF = 0.03


def transition_sql(w0: str, w1: str, p0: str, x: str, p1: str, cost: str, rf: str, basis: str, source: str) -> str:
    """SELECT text appending every leg of the self-financing session."""
    ro, rc = (rf, "0.0::DOUBLE") if basis == "previous" else ("0.0::DOUBLE", rf)
    return f"""SELECT *, ac + cc - 1 AS ret, ao - ({w0}) AS overnight, (ac - ap) + (cc - cp) AS intraday, (co - (1 - ({w0}))) + {'(cc - cp)' if basis == 'target' else '0.0'} AS cash,
        paid AS cost, turn * wo AS traded
      FROM (SELECT *, ap * (({p1}) / ({x})) AS ac, cp * (1 + {rc}) AS cc FROM (SELECT *, ({w1}) * wa AS ap, (1 - ({w1})) * wa AS cp FROM (SELECT *, wo - paid AS wa FROM (
        SELECT *, ({cost}) * turn * wo AS paid FROM (SELECT *, abs(({w1}) - ao / wo) AS turn FROM (SELECT *, ao + co AS wo FROM (
        SELECT *, ({w0}) * (({x}) / ({p0})) AS ao, (1 - ({w0})) * (1 + {ro}) AS co FROM {source})))))))"""


PREV_W = "SELECT *, lag(w, 1, 0.0) OVER (PARTITION BY {keys} ORDER BY open_time) AS w_prev FROM (SELECT *, CASE WHEN bar_idx >= 1 THEN weight ELSE 0.0::DOUBLE END AS w FROM {src})"
cte("rule_pw", f"SELECT * FROM ({PREV_W.format(keys='symbol', src='rule_w')}) WHERE bar_idx >= 1", "rule_w")
cte("tr_in", "SELECT symbol, open_time, CASE WHEN (open_time // 86400000) % 23 = 0 THEN 1.2::DOUBLE ELSE w END AS w1, w_prev AS w0, prev_close AS p0, CASE WHEN (open_time // 86400000) % 19 = 3 THEN -1.0::DOUBLE ELSE open END AS x, close AS p1 FROM rule_pw", "rule_pw")
cte("tr_out", transition_sql("w0", "w1", "p0", "x", "p1", d(COST), d(RF / 365), "previous", "tr_in"), "tr_in")
LEGS = ["ret", "overnight", "intraday", "cash", "turnover", "cost"]


@query(
    "acct_transition",
    sql(
        "SELECT symbol, open_time, reason, "
        + ", ".join(f"CASE WHEN reason IS NULL THEN {r('turn' if c == 'turnover' else c, None, 9)} END AS {c}" for c in LEGS)
        + " FROM (SELECT *, CASE WHEN w1 NOT BETWEEN 0 AND 1 THEN 'w1 outside [0,1]' WHEN x <= 0 THEN 'x not positive' END AS reason FROM tr_out)",
        "tr_out",
    ),
)
def _(t: Tables) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy("open_time")
    rows = rule_weights(t).withColumn("w", F.when(F.col("bar_idx") >= 1, F.col("weight")).otherwise(0.0))
    rows = rows.withColumn("w0", F.lag("w", 1, 0.0).over(w)).where("bar_idx >= 1").select(
        "symbol", "open_time", "w0", F.when(day_number() % 23 == 0, 1.2).otherwise(F.col("w")).alias("w1"),
        F.col("prev_close").alias("p0"), F.when(day_number() % 19 == 3, -1.0).otherwise(F.col("open")).alias("x"), F.col("close").alias("p1"),
        F.lit(COST).alias("cost_rate"), F.lit(RF / 365).alias("rf"),
    )
    reason = ac.transition_problem("w0", "w1", "p0", "x", "p1", "cost_rate", "rf")
    legs = ac.transition(*[F.col(c) for c in ("w0", "w1", "p0", "x", "p1", "cost_rate", "rf")], basis="previous")
    return rows.select("symbol", "open_time", reason.alias("reason"), *[F.when(reason.isNull(), rd(legs[c], 9)).alias(c) for c in LEGS])


@query(
    "acct_open_fallback",
    sql(
        """SELECT symbol, open_time, coalesce(CASE WHEN isfinite(o) AND o > 0 THEN o END, prev_close) AS exec_price
           FROM (SELECT *, CASE (open_time // 86400000) % 9 WHEN 0 THEN NULL WHEN 1 THEN 0.0 WHEN 2 THEN 'nan'::DOUBLE ELSE open END AS o FROM series WHERE bar_idx >= 1)""",
        "series",
    ),
)
def _(t: Tables) -> DataFrame:
    k = day_number() % 9
    op = F.when(k == 0, F.lit(None)).when(k == 1, 0.0).when(k == 2, F.lit(float("nan"))).otherwise(F.col("open"))
    return prepared(t).where("bar_idx >= 1").select("symbol", "open_time", ac.open_or_fallback(op, F.col("prev_close")).alias("exec_price"))


cte(
    "banded",
    """SELECT symbol, band, bar_idx, weight, CASE WHEN abs(weight) > band THEN weight ELSE 0.0::DOUBLE END AS held FROM band_in WHERE bar_idx = 0
       UNION ALL -- recursive
       SELECT s.symbol, s.band, s.bar_idx, s.weight, CASE WHEN abs(s.weight - e.held) > s.band THEN s.weight ELSE e.held END
       FROM banded e JOIN band_in s ON s.symbol = e.symbol AND s.band = e.band AND s.bar_idx = e.bar_idx + 1""",
    "band_in",
)
cte("band_in", "SELECT symbol, band, bar_idx, weight FROM rule_w, (VALUES (0.0::DOUBLE), (0.05::DOUBLE), (0.2::DOUBLE)) b(band)", "rule_w")


@query("acct_band_hold", sql(f"SELECT symbol, band, bar_idx, {r('held', 'held')} FROM banded", "banded"))
def _(t: Tables) -> DataFrame:
    bands = F.explode(F.array(*[F.lit(b) for b in (0.0, 0.05, 0.2)]))
    rows = rule_weights(t).select("symbol", "open_time", "bar_idx", "weight", bands.alias("band"))
    return ac.hold_with_band(rows, ["symbol", "band"]).select("symbol", "band", "bar_idx", rd("held").alias("held"))


cte("acc_close", transition_sql("w_prev", "w", "prev_close", "prev_close", "close", d(COST), d(RF / 365), "target", "rule_pw"), "rule_pw")
cte("acc_open", transition_sql("w_prev", "w", "prev_close", "open", "close", d(COST), d(RF / 365), "previous", "rule_pw"), "rule_pw")
STREAM_COLS = f"symbol, open_time, {r('ret', 'ret', 9)}, {r('cost', 'cost', 9)}, {r('traded', 'traded', 9)}"


@query("acct_close_mode", sql(f"SELECT {STREAM_COLS} FROM acc_close", "acc_close"))
def _(t: Tables) -> DataFrame:
    out = ac.account(rule_weights(t), ["symbol"], COST, RF, 365, "close")
    return out.select("symbol", "open_time", *[rd(c, 9).alias(c) for c in ("ret", "cost", "traded")])


@query("acct_next_open", sql(f"SELECT {STREAM_COLS} FROM acc_open", "acc_open"))
def _(t: Tables) -> DataFrame:
    out = ac.account(rule_weights(t), ["symbol"], COST, RF, 365, "next_open")
    return out.select("symbol", "open_time", *[rd(c, 9).alias(c) for c in ("ret", "cost", "traded")])


def summary_sql(source: str, keys: str, ppy: int = 365, rf: float = 0.0, days: str = "count(ret)", order: str = "day", extra: str = "") -> str:
    """SELECT text of the one-row-per-stream summary (unrounded)."""
    return f"""SELECT *, CASE WHEN max_drawdown >= 0 THEN 0.0::DOUBLE ELSE cagr / abs(max_drawdown) END AS calmar FROM (SELECT *,
        CASE WHEN days_ <= 0 THEN 0.0::DOUBLE WHEN final = 0 THEN -1.0::DOUBLE ELSE pow(final, 365.0::DOUBLE / days_) - 1 END AS cagr,
        CASE WHEN n < 2 THEN 0.0::DOUBLE ELSE sd_ * sqrt({ppy}::DOUBLE) END AS vol,
        CASE WHEN n < 2 OR sd_ = 0 THEN 0.0::DOUBLE ELSE (mean_ - {d(rf / ppy)}) / sd_ * sqrt({ppy}::DOUBLE) END AS sharpe,
        CASE WHEN n < 2 OR down_ = 0 THEN 0.0::DOUBLE ELSE (mean_ - {d(rf / ppy)}) * {ppy} / down_ END AS sortino
      FROM (SELECT {keys}, count(ret) AS n, max_by(equity, {order}) AS final, avg(ret) AS mean_, stddev_samp(ret) AS sd_, min(drawdown) AS max_drawdown,
              sqrt(avg(pow(least(ret - {d(rf / ppy)}, 0.0::DOUBLE), 2))) * sqrt({ppy}::DOUBLE) AS down_, ({days})::DOUBLE AS days_ {extra}
            FROM ({equity_sql(source, keys, order)}) GROUP BY {keys}))"""


METRICS = ["final", "cagr", "vol", "sharpe", "sortino", "calmar", "max_drawdown"]
METRIC_COLS = ", ".join(r(m, m) for m in METRICS)

STREAM_POOL = cand.candidate_pool()
features_cte("f_sp", [f for f in cand.pool_features(STREAM_POOL) if f[0] != "macd"])
cte("fm_sp", "SELECT * FROM f_sp JOIN macd USING (symbol, bar_idx)", "f_sp", "macd")
weights_cte("w_sp", STREAM_POOL, "fm_sp", keep="symbol, open_time, bar_idx, open, close, prev_close, prev_time")
cte("sp_pw", f"SELECT * FROM ({PREV_W.format(keys='symbol, name', src='w_sp')}) WHERE bar_idx >= 1", "w_sp")
cte("sp_acc", transition_sql("w_prev", "w", "prev_close", "open", "close", d(COST), d(RF / 365), "previous", "sp_pw"), "sp_pw")
@query(
    "acct_stream",
    sql(
        f"SELECT symbol, name, n, {METRIC_COLS}, {r('exposure', 'exposure')}, {r('turnover', 'turnover')} FROM ("
        + summary_sql("sp_acc", "symbol, name", 365, RF, "(max(open_time) - min(prev_time)) / 86400000.0", "open_time", ", avg(w) AS exposure, sum(traded) AS turnover")
        + ")",
        "sp_acc",
    ),
)
def _(t: Tables) -> DataFrame:
    feats = cand.pool_features(STREAM_POOL)
    base = featured(t, feats, macd_of(feats))
    rows = exploded_weights(base, STREAM_POOL, ("symbol", "open_time", "bar_idx", "open", "close", "prev_close", "prev_time"))
    streams = ac.account(rows, ["symbol", "name"], COST, RF, 365, "next_open")
    days = (F.max("open_time") - F.min("prev_time")) / F.lit(86_400_000.0)
    out = pf.summary(streams, ["symbol", "name"], 365, RF, days, "open_time", {"exposure": F.avg("w"), "turnover": F.sum("traded")})
    return out.select("symbol", "name", "n", *[rd(m).alias(m) for m in [*METRICS, "exposure", "turnover"]])


@query(
    "acct_signal_cash",
    sql(
        f"""SELECT symbol, {r('10000 * product(growth)', 'final_value', 4)}, count(*) FILTER (pos <> pp) AS trades, {r('max_by(close, open_time) / min_by(close, open_time) - 1', 'buy_hold')}
            FROM (SELECT *, CASE WHEN pp = 1 THEN close / p0 ELSE 1.0::DOUBLE END * CASE WHEN pos <> pp THEN 0.999::DOUBLE ELSE 1.0::DOUBLE END AS growth
              FROM (SELECT *, lag(pos, 1, 0) OVER w AS pp, lag(close) OVER w AS p0 FROM (
                SELECT *, coalesce(last_value(CASE signal WHEN 'buy' THEN 1 WHEN 'sell' THEN 0 END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY open_time ROWS UNBOUNDED PRECEDING), 0) AS pos FROM cross_sig)
                WINDOW w AS (PARTITION BY symbol ORDER BY open_time))) GROUP BY 1""",
        "cross_sig",
    ),
)
def _(t: Tables) -> DataFrame:
    out = ac.signal_cash(cross_signals(t), 0.001)
    return out.select("symbol", rd(F.col("growth") * 10000, 4).alias("final_value"), "trades", rd("buy_hold").alias("buy_hold"))


# ------------------------------------------------------------ costs


@query(
    "cost_flat",
    sql(f"SELECT symbol, {r(f'sum(traded) * {d(COST)}', 'charged', 8)}, {r('sum(traded)', 'traded', 8)}, {r('sum(cost)', 'recorded', 8)} FROM acc_close GROUP BY 1", "acc_close"),
)
def _(t: Tables) -> DataFrame:
    out = ac.account(rule_weights(t), ["symbol"], COST, RF, 365, "close")
    return out.groupBy("symbol").agg(
        rd(F.sum("traded") * COST, 8).alias("charged"), rd(F.sum("traded"), 8).alias("traded"), rd(F.sum("cost"), 8).alias("recorded")
    )


MULT = "CASE WHEN rv > 0 THEN greatest(0.5::DOUBLE, least(3.0::DOUBLE, sqrt(rv / 0.6::DOUBLE))) ELSE 1.0::DOUBLE END"


@query("cost_vol_mult", sql(f"SELECT symbol, open_time, {r(MULT, 'multiplier')} FROM realized", "realized"))
def _(t: Tables) -> DataFrame:
    rows = prepared(t).withColumn("rv", ind.realized_vol(20, 252))
    return rows.select("symbol", "open_time", rd(costs.vol_multiplier(F.col("rv"))).alias("multiplier"))


@query(
    "cost_sqrt_impact",
    sql(
        f"""SELECT symbol, open_time, {r('CASE WHEN adv > 0 AND dw > 0 AND rv > 0 THEN 0.5::DOUBLE * rv / sqrt(252.0::DOUBLE) * sqrt(dw / (adv / 1000000.0::DOUBLE)) ELSE 0.0 END', 'impact', 8)}
            FROM (SELECT p.symbol, p.open_time, abs(w - w_prev) AS dw, q.rv, q.adv FROM rule_pw p JOIN (SELECT symbol, open_time, rv, avg(quote_volume) OVER (PARTITION BY symbol ORDER BY open_time
                 ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS adv FROM realized) q USING (symbol, open_time))""",
        "rule_pw",
        "realized",
    ),
)
def _(t: Tables) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy("open_time")
    rows = rule_weights(t).withColumns({"rv": ind.realized_vol(20, 252), "adv": F.avg("quote_volume").over(w.rowsBetween(-29, 0)), "w": F.when(F.col("bar_idx") >= 1, F.col("weight")).otherwise(0.0)})
    rows = rows.withColumn("dw", F.abs(F.col("w") - F.lag("w", 1, 0.0).over(w))).where("bar_idx >= 1")
    impact = costs.sqrt_impact(F.col("dw"), F.col("rv") / (252.0**0.5), F.col("adv") / 1_000_000.0, 0.5)
    return rows.select("symbol", "open_time", rd(impact, 8).alias("impact"))


# Fixed values of the example schedule: (30-day volume floor, fee).
TIERS = [(0.0, 0.0010), (1_000_000.0, 0.0008), (2_500_000.0, 0.0006), (10_000_000.0, 0.0004)]


@query(
    "cost_tier_fee",
    sql(
        """SELECT symbol, fee, count(*) AS n FROM (SELECT symbol, CASE WHEN v >= 10000000 THEN 0.0004::DOUBLE WHEN v >= 2500000 THEN 0.0006::DOUBLE WHEN v >= 1000000 THEN 0.0008::DOUBLE ELSE 0.001::DOUBLE END AS fee
             FROM (SELECT symbol, sum(quote_volume) OVER (PARTITION BY symbol ORDER BY open_time ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS v FROM bars)) GROUP BY 1, 2""",
        "bars",
    ),
)
def _(t: Tables) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy("open_time").rowsBetween(-29, 0)
    v = panels.brand_bars(t).select("symbol", F.sum("quote_volume").over(w).alias("v"))
    return v.groupBy("symbol", costs.tier_fee(F.col("v"), TIERS).alias("fee")).agg(F.count(F.lit(1)).alias("n"))


cte(
    "obs_in",
    """SELECT symbol, open_time, CASE WHEN w > w_prev THEN 'BUY' WHEN w < w_prev THEN 'SELL' ELSE 'FLAT' END AS side, w AS target_weight, w_prev AS previous_weight,
              prev_close AS decision_close, open AS exec_price, close AS mark_price, CASE WHEN (open_time // 86400000) % 5 <> 0 THEN open * 0.9995::DOUBLE END AS bid, open * 1.0007::DOUBLE AS ask
       FROM rule_pw""",
    "rule_pw",
)


def observations(t: Tables) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy("open_time")
    rows = rule_weights(t).withColumn("w", F.when(F.col("bar_idx") >= 1, F.col("weight")).otherwise(0.0))
    rows = rows.withColumn("w_prev", F.lag("w", 1, 0.0).over(w)).where("bar_idx >= 1")
    side = F.when(F.col("w") > F.col("w_prev"), "BUY").when(F.col("w") < F.col("w_prev"), "SELL").otherwise("FLAT")
    return costs.cost_observation(
        rows.select(
            "symbol", "open_time", side.alias("side"), F.col("w").alias("target_weight"), F.col("w_prev").alias("previous_weight"),
            F.col("prev_close").alias("decision_close"), F.col("open").alias("exec_price"), F.col("close").alias("mark_price"),
            F.when(day_number() % 5 != 0, F.col("open") * 0.9995).alias("bid"), (F.col("open") * 1.0007).alias("ask"),
        )
    )


cte(
    "obs",
    f"""SELECT *, {r('abs(target_weight - previous_weight)', 'turnover')}, {r('(ask - bid) / ((bid + ask) / 2) * 10000', 'quoted_spread_bps', 4)},
          {r('(exec_price / ((bid + ask) / 2) - 1) * 10000', 'fill_vs_mid_bps', 4)}, {r('(exec_price / decision_close - 1) * 10000', 'drift', 4)},
          {r("CASE side WHEN 'BUY' THEN 1 WHEN 'SELL' THEN -1 END * (exec_price / decision_close - 1) * 10000", 'proxy', 4)} FROM obs_in""",
    "obs_in",
)


@query(
    "cost_observation",
    # drift values are exact multiples of ten basis points, so they are compared at 3 decimals away from rounding ties
    sql(
        f"""SELECT symbol, open_time, side, turnover, {r('quoted_spread_bps', 'quoted_spread_bps', 3)}, {r('fill_vs_mid_bps', 'fill_vs_mid_bps', 3)},
              {r('drift', 'decision_to_exec_drift_bps', 3)}, {r('proxy', 'observed_cost_proxy_bps', 3)} FROM obs""",
        "obs",
    ),
)
def _(t: Tables) -> DataFrame:
    cols = ["quoted_spread_bps", "fill_vs_mid_bps", "decision_to_exec_drift_bps", "observed_cost_proxy_bps"]
    return observations(t).select("symbol", "open_time", "side", rd("turnover").alias("turnover"), *[rd(c, 3).alias(c) for c in cols])


# ------------------------------------------------------------ overlays

OVERLAY = """SELECT *, e * ret - 0.0015::DOUBLE * abs(e - lag(e, 1, 1.0) OVER ({w})) AS oret FROM (SELECT *, CASE WHEN count(ret) OVER p >= 20 AND stddev_samp(ret) OVER p > 0
   THEN least(1.0::DOUBLE, 0.25::DOUBLE / (stddev_samp(ret) OVER p * sqrt(365.0::DOUBLE))) ELSE 1.0::DOUBLE END AS e FROM {src} WINDOW p AS ({w} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))"""
cte("overlaid", OVERLAY.format(w=W_SYM, src="rets"), "rets")


@query("vol_overlay", sql(f"SELECT symbol, day, {r('e', 'exposure')}, {r('oret', 'ret', 8)} FROM overlaid", "overlaid"))
def _(t: Tables) -> DataFrame:
    out = costs.vol_overlay(close_returns(panels.brand_bars(t)), ["symbol"])
    return out.select("symbol", "day", rd("exposure").alias("exposure"), rd("ret", 8).alias("ret"))
