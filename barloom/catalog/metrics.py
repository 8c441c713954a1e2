"""Performance aggregates, regimes, diagnostics of return streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import performance as pf
from ..functions.indicators import series
from ..functions.numeric import r as rd
from ..operators import regimes as rg
from ..plans import walkforward as wf
from ..sources import panels
from ..sources.panels import DAY_MS, Tables
from .ingest import close_returns
from .registry import cte, query, r, sql
from .signals import RF, cross_signals, rule_weights, summary_sql
from .walk import POOL, SETUP, Walk


def brand_returns(t: Tables) -> DataFrame:
    return close_returns(panels.brand_bars(t))


def seg_returns(t: Tables) -> DataFrame:
    return close_returns(panels.segment_bars(t))


cte("ret_sum", summary_sql("rets", "symbol", 365, RF, "(max(day) - min(day)) / 86400000.0 + 1"), "rets")


def return_summary(t: Tables) -> DataFrame:
    days = (F.max("day") - F.min("day")) / F.lit(float(DAY_MS)) + 1
    return pf.summary(brand_returns(t), ["symbol"], 365, RF, days)


def metric_query(op: str, *cols: str) -> None:
    @query(op, sql(f"SELECT symbol, n, {', '.join(r(c, c) for c in cols)} FROM ret_sum", "ret_sum"))
    def _(t: Tables) -> DataFrame:
        return return_summary(t).select("symbol", "n", *[rd(c).alias(c) for c in cols])


metric_query("agg_cagr", "final", "cagr")
metric_query("agg_vol", "vol")
metric_query("agg_sharpe", "sharpe")
metric_query("agg_max_drawdown", "max_drawdown")
metric_query("agg_sortino", "sortino")
metric_query("agg_calmar", "cagr", "max_drawdown", "calmar")


@query("agg_downside", sql(f"SELECT symbol, {r(f'sqrt(avg(pow(least(ret - {RF / 365!r}::DOUBLE, 0.0::DOUBLE), 2))) * sqrt(365.0::DOUBLE)', 'downside')} FROM rets GROUP BY 1", "rets"))
def _(t: Tables) -> DataFrame:
    return brand_returns(t).groupBy("symbol").agg(rd(pf.downside(365, RF)).alias("downside"))


# int((1 - 0.95) * n): the product is taken in double precision, as everywhere else
cte(
    "tails",
    """SELECT symbol, max(CASE WHEN rk = greatest(0, least(n - 1, floor((1 - 0.95::DOUBLE) * n))) + 1 THEN ret END) AS var95,
              avg(CASE WHEN rk <= greatest(1, floor((1 - 0.95::DOUBLE) * n)) THEN ret END) AS es95
       FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ret) AS rk, count(*) OVER (PARTITION BY symbol) AS n FROM rets) GROUP BY 1""",
    "rets",
)


@query("agg_var", sql(f"SELECT symbol, {r('var95', 'var95', 8)} FROM tails", "tails"))
def _(t: Tables) -> DataFrame:
    return pf.tail(brand_returns(t), ["symbol"]).select("symbol", rd("var95", 8).alias("var95"))


@query("agg_es", sql(f"SELECT symbol, {r('es95', 'es95', 8)} FROM tails", "tails"))
def _(t: Tables) -> DataFrame:
    return pf.tail(brand_returns(t), ["symbol"]).select("symbol", rd("es95", 8).alias("es95"))


cte("mom4", "SELECT symbol, count(*) AS n, var_pop(ret) AS v, avg(pow(ret - mu, 3)) AS m3, avg(pow(ret - mu, 4)) AS m4 FROM (SELECT *, avg(ret) OVER (PARTITION BY symbol) AS mu FROM rets) GROUP BY 1", "rets")


@query("agg_skew", sql(f"SELECT symbol, n, {r('m3 / pow(v, 1.5)', 'skew')} FROM mom4", "mom4"))
def _(t: Tables) -> DataFrame:
    return brand_returns(t).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), rd(pf.skew()).alias("skew"))


@query("agg_kurt", sql(f"SELECT symbol, n, {r('m4 / (v * v)', 'kurt')} FROM mom4", "mom4"))
def _(t: Tables) -> DataFrame:
    return brand_returns(t).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), rd(pf.raw_kurtosis()).alias("kurt"))


@query(
    "agg_trade_stats",
    sql(
        f"""SELECT symbol, count(*) AS n_trades, {r('count(*) FILTER (ret > 0) / count(*)::DOUBLE', 'hit_rate')}, {r('avg(ret) FILTER (ret > 0)', 'avg_win')}, {r('avg(ret) FILTER (ret < 0)', 'avg_loss')},
              {r('sum(ret) FILTER (ret > 0) / nullif(abs(sum(ret) FILTER (ret < 0)), 0)', 'profit_factor')} FROM acc_close WHERE abs(w - w_prev) > 1e-9 GROUP BY 1""",
        "acc_close",
    ),
)
def _(t: Tables) -> DataFrame:
    from ..functions import accounting as ac
    from .signals import COST

    out = ac.account(rule_weights(t), ["symbol"], COST, RF, 365, "close")
    return trade_stats(out)


def trade_stats(streams: DataFrame) -> DataFrame:
    """Per symbol over the bars where the held weight moved."""
    win, loss = F.when(F.col("ret") > 0, F.col("ret")), F.when(F.col("ret") < 0, F.col("ret"))
    return streams.where(F.abs(F.col("w") - F.col("w_prev")) > 1e-9).groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_trades"), rd(F.count(win) / F.count(F.lit(1))).alias("hit_rate"), rd(F.avg(win)).alias("avg_win"),
        rd(F.avg(loss)).alias("avg_loss"), rd(F.try_divide(F.sum(win), F.abs(F.sum(loss)))).alias("profit_factor"),
    )


cte("acc_sum", summary_sql("(SELECT *, open_time AS day FROM acc_sma)", "symbol", 365, RF, "(max(day) - min(prev_time)) / 86400000.0", "day"), "acc_sma")
FLAGSHIP_COLS = ["final", "cagr", "vol", "sharpe", "max_drawdown"]


def _register_flagship() -> None:
    from ..functions import accounting as ac
    from ..plans import candidates as cand
    from .signals import COST, PREV_W, d, features_cte, transition_sql, weight_sql

    rule = cand.sma_cross(5, 20)
    features_cte("f_flag", cand.pool_features([rule]))
    cte("flag_w", f"SELECT *, {weight_sql(rule)} AS weight FROM f_flag", "f_flag")
    cte("flag_pw", f"SELECT * FROM ({PREV_W.format(keys='symbol', src='flag_w')}) WHERE bar_idx >= 1", "flag_w")
    cte("acc_sma", transition_sql("w_prev", "w", "prev_close", "prev_close", "close", d(COST), d(RF / 365), "target", "flag_pw"), "flag_pw")

    @query("agg_summary", sql(f"SELECT symbol, n, {', '.join(r(c, c) for c in FLAGSHIP_COLS)} FROM acc_sum", "acc_sum"))
    def _(t: Tables) -> DataFrame:
        out = ac.account(rule_weights(t, rule), ["symbol"], COST, RF, 365, "close")
        days = (F.max("open_time") - F.min("prev_time")) / F.lit(float(DAY_MS))
        return pf.summary(out, ["symbol"], 365, RF, days, "open_time").select("symbol", "n", *[rd(c).alias(c) for c in FLAGSHIP_COLS])


_register_flagship()

cte("seg_start", "SELECT symbol, min(open_time) AS t0 FROM segbars GROUP BY 1", "segbars")
cte("index_sum", summary_sql("(SELECT * FROM segrets JOIN seg_start USING (symbol))", "symbol", 252, RF, "(max(day) - min(t0)) / 86400000.0"), "segrets", "seg_start")


@query("agg_index_metrics", sql(f"SELECT symbol, {', '.join(r(c, c) for c in ['final', 'cagr', 'vol', 'sharpe', 'sortino', 'calmar', 'max_drawdown'])} FROM index_sum", "index_sum"))
def _(t: Tables) -> DataFrame:
    bars = panels.segment_bars(t)
    w = Window.partitionBy("symbol").orderBy("open_time")
    rows = bars.select("symbol", F.col("open_time").alias("day"), (F.col("close") / F.lag("close").over(w) - 1).alias("ret"), F.lag("open_time").over(w).alias("t0")).where("ret is not null")
    days = (F.max("day") - F.min("t0")) / F.lit(float(DAY_MS))
    out = pf.summary(rows, ["symbol"], 252, RF, days).where("n >= 2")
    return out.select("symbol", *[rd(c).alias(c) for c in ["final", "cagr", "vol", "sharpe", "sortino", "calmar", "max_drawdown"]])


@query("agg_time_under_water", sql(f"SELECT symbol, {r('avg((equity < peak)::INT)', 'tuw')} FROM eq GROUP BY 1", "eq"))
def _(t: Tables) -> DataFrame:
    out = pf.with_equity(brand_returns(t), ["symbol"])
    return out.groupBy("symbol").agg(rd(F.avg((F.col("equity") < F.col("peak")).cast("double"))).alias("tuw"))


@query("agg_monthly", sql(f"SELECT symbol, strftime(make_timestamp(day * 1000), '%Y-%m') AS month, count(*) AS n, {r('product(1 + ret) - 1', 'ret', 8)} FROM rets GROUP BY 1, 2", "rets"))
def _(t: Tables) -> DataFrame:
    month = F.date_format(F.timestamp_millis("day"), "yyyy-MM")
    return brand_returns(t).groupBy("symbol", month.alias("month")).agg(F.count(F.lit(1)).alias("n"), rd(F.product(F.col("ret") + 1.0) - 1.0, 8).alias("ret"))


# ---------------------------------------------------------------- regimes

cte(
    "labels",
    """SELECT symbol, open_time AS day, CASE WHEN j <= 0 OR i - j < 10 THEN 'sideways' WHEN now_ / then_ - 1 >= 0.25 THEN 'bull' WHEN now_ / then_ - 1 <= -0.25 THEN 'bear' ELSE 'sideways' END AS label
       FROM (SELECT symbol, open_time, last_value(close) OVER p AS now_, last_value(close) OVER q AS then_, count(*) OVER p AS i, count(*) OVER q AS j FROM segbars
         WINDOW p AS (PARTITION BY symbol ORDER BY open_time RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                q AS (PARTITION BY symbol ORDER BY open_time RANGE BETWEEN UNBOUNDED PRECEDING AND 15552000001 PRECEDING))""",
    "segbars",
)
cte(
    "segments",
    """SELECT symbol, label, min(day) AS start, max(day) AS "end" FROM (SELECT *, sum(c) OVER (PARTITION BY symbol ORDER BY day) AS run FROM (
         SELECT *, (label IS DISTINCT FROM lag(label) OVER (PARTITION BY symbol ORDER BY day))::INT AS c FROM labels)) GROUP BY symbol, run, label HAVING (max(day) - min(day)) / 86400000.0 + 1 >= 30""",
    "labels",
)


def market_labels(t: Tables) -> DataFrame:
    return rg.labels(panels.segment_bars(t))


@query("rg_labels", sql("SELECT symbol, day, label FROM labels", "labels"))
def _(t: Tables) -> DataFrame:
    return market_labels(t)


@query("rg_segments", sql('SELECT symbol, label, start, "end" FROM segments', "segments"))
def _(t: Tables) -> DataFrame:
    return rg.segments(market_labels(t)).select("symbol", "label", "start", "end")


cte(
    "stress",
    """SELECT symbol, day, coalesce(tr <= -0.2, false) OR coalesce(vol >= cut, false) AS stressed FROM (SELECT symbol, open_time AS day, CASE WHEN ok THEN tr END AS tr, CASE WHEN ok THEN vol END AS vol FROM stress_in)
       JOIN (SELECT symbol, list_sort(list(vol) FILTER (ok))[floor(count(vol) FILTER (ok) * 0.9::DOUBLE)::BIGINT] AS cut FROM stress_in GROUP BY 1) USING (symbol)""",
    "stress_in",
)
cte(
    "stress_in",
    """SELECT symbol, open_time, i >= 31 AND near >= 30 AS ok, c1 / c31 - 1 AS tr, vol FROM (SELECT symbol, open_time, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY symbol ORDER BY open_time RANGE BETWEEN 2592000000 PRECEDING AND 1 PRECEDING) AS near,
         lag(close, 1) OVER w AS c1, lag(close, 31) OVER w AS c31, stddev_samp(lr) OVER (PARTITION BY symbol ORDER BY open_time ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) * sqrt(365.0::DOUBLE) AS vol
       FROM (SELECT *, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY open_time)) AS lr FROM segbars) WINDOW w AS (PARTITION BY symbol ORDER BY open_time))""",
    "segbars",
)


@query("rg_stress", sql("SELECT symbol, count(*) AS n_days, count(*) FILTER (stressed) AS n_stressed, min(day) FILTER (stressed) AS first_day, max(day) FILTER (stressed) AS last_day FROM stress GROUP BY 1", "stress"))
def _(t: Tables) -> DataFrame:
    out = rg.stress(series(panels.segment_bars(t)))
    return out.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_days"), F.count(F.when(F.col("stressed"), 1)).alias("n_stressed"),
        F.min(F.when(F.col("stressed"), F.col("day"))).alias("first_day"), F.max(F.when(F.col("stressed"), F.col("day"))).alias("last_day"),
    )


cte("proxy_labels", "SELECT day, label FROM labels WHERE symbol = 'BUILDING'", "labels")
cte("tagged", "SELECT r.*, coalesce(l.label, 'sideways') AS label, (r.ret > 0)::INT AS hit FROM rets r LEFT JOIN proxy_labels l ON r.day = l.day", "rets", "proxy_labels")
REGIME_COLS = ["cagr", "vol", "sharpe", "max_drawdown", "hit_rate", "share_of_window"]


@query(
    "agg_regime_perf",
    sql(
        f"SELECT symbol, label, n, {', '.join(r(c, c) for c in REGIME_COLS)} FROM (SELECT *, n / (SELECT count(*)::DOUBLE FROM proxy_labels) AS share_of_window FROM ({summary_sql('tagged', 'symbol, label', 365, RF, 'count(ret)', 'day', ', avg(hit) AS hit_rate')}))",
        "tagged",
    ),
)
def _(t: Tables) -> DataFrame:
    proxy = market_labels(t).where("symbol = 'BUILDING'").select("day", "label")
    out = rg.regime_performance(brand_returns(t), proxy, ["symbol"], 365, RF)
    return out.select("symbol", "label", "n", *[rd(c).alias(c) for c in REGIME_COLS])


cte("proxy_segs", "SELECT row_number() OVER (ORDER BY start) AS seg, label, start, \"end\" FROM segments WHERE symbol = 'BUILDING'", "segments")
cte("seg_tagged", 'SELECT r.*, s.seg, s.label FROM rets r JOIN proxy_segs s ON r.day BETWEEN s.start AND s."end"', "rets", "proxy_segs")


def proxy_segments(t: Tables) -> DataFrame:
    return rg.segments(market_labels(t).where("symbol = 'BUILDING'")).select("label", "start", "end")


@query(
    "agg_segment_metrics",
    sql(f"SELECT symbol, start, label, n, {r('final', 'final')}, {r('cagr', 'cagr', 4)}, {r('max_drawdown', 'max_drawdown')} FROM ({summary_sql('(SELECT r.*, s.start, s.label FROM rets r JOIN proxy_segs s ON r.day BETWEEN s.start AND s.\"end\")', 'symbol, start, label')})", "rets", "proxy_segs"),
)
def _(t: Tables) -> DataFrame:
    out = rg.segment_metrics(brand_returns(t), proxy_segments(t), ["symbol"], ["start", "label"])
    return out.select("symbol", "start", "label", "n", rd("final").alias("final"), rd("cagr", 4).alias("cagr"), rd("max_drawdown").alias("max_drawdown"))


cte("index_rets", "SELECT day, ret FROM segrets WHERE symbol = 'HOUSEHOLD'", "segrets")


@query(
    "at_regime_table",
    sql(
        f"""SELECT p.start, p.label, p.n AS days, {r('p.cagr', 'portfolio_cagr', 4)}, {r('i.cagr', 'index_cagr', 4)} FROM
            ({summary_sql('(SELECT r.day, r.ret, s.start, s.label FROM pf_equal r JOIN proxy_segs s ON r.day BETWEEN s.start AND s."end")', 'start, label')}) p LEFT JOIN
            ({summary_sql('(SELECT r.day, r.ret, s.start, s.label FROM index_rets r JOIN proxy_segs s ON r.day BETWEEN s.start AND s."end")', 'start, label')}) i USING (start, label)""",
        "pf_equal",
        "proxy_segs",
        "index_rets",
    ),
)
def _(t: Tables) -> DataFrame:
    from ..operators import portfolio as pt
    from .portfolio import masked_inputs

    masked, _timeline, denoms = masked_inputs(t)
    segs = proxy_segments(t)
    index = seg_returns(t).where("symbol = 'HOUSEHOLD'").select("day", "ret")
    p = rg.segment_metrics(pt.equal_weight(masked, denoms), segs, [], ["start", "label"])
    i = rg.segment_metrics(index, segs, [], ["start", "label"]).select("start", "label", F.col("cagr").alias("icagr"))
    return p.join(i, ["start", "label"], "left").select("start", "label", F.col("n").alias("days"), rd("cagr", 4).alias("portfolio_cagr"), rd("icagr", 4).alias("index_cagr"))


# ---------------------------------------------------------------- windows of a stream

cte("blocks", "SELECT *, (row_number() OVER (PARTITION BY symbol ORDER BY day) - 1) // 730 AS block FROM rets", "rets")


@query("agg_rolling_blocks", sql(f"SELECT symbol, block, n, {', '.join(r(c, c) for c in ['final', 'cagr', 'sharpe', 'max_drawdown'])} FROM ({summary_sql('blocks', 'symbol, block')})", "blocks"))
def _(t: Tables) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy("day")
    rows = brand_returns(t).withColumn("block", F.floor((F.row_number().over(w) - 1) / 730).cast("bigint"))
    return pf.summary(rows, ["symbol", "block"]).select("symbol", "block", "n", *[rd(c).alias(c) for c in ["final", "cagr", "sharpe", "max_drawdown"]])


cte(
    "trimmed",
    """SELECT * FROM (SELECT r.*, a.v AS trim_start, b.v AS trim_end, n - a.v - b.v AS left_ FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY day) AS i, count(*) OVER (PARTITION BY symbol) AS n FROM rets) r,
         (VALUES (0), (90), (180)) a(v), (VALUES (0), (90), (180)) b(v) WHERE i > a.v AND i <= n - b.v) WHERE left_ >= 60""",
    "rets",
)


@query("agg_trim_grid", sql(f"SELECT symbol, trim_start, trim_end, n, {r('cagr', 'cagr')}, {r('sharpe', 'sharpe')} FROM ({summary_sql('trimmed', 'symbol, trim_start, trim_end')})", "trimmed"))
def _(t: Tables) -> DataFrame:
    w = Window.partitionBy("symbol")
    trims = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 90, 180) for b in (0, 90, 180)])
    rows = brand_returns(t).withColumns({"i": F.row_number().over(w.orderBy("day")), "m": F.count(F.lit(1)).over(w)}).withColumn("trim", F.explode(trims))
    kept = rows.where((F.col("i") > F.col("trim.a")) & (F.col("i") <= F.col("m") - F.col("trim.b")) & (F.col("m") - F.col("trim.a") - F.col("trim.b") >= 60))
    kept = kept.select("symbol", "day", "ret", F.col("trim.a").alias("trim_start"), F.col("trim.b").alias("trim_end"))
    return pf.summary(kept, ["symbol", "trim_start", "trim_end"]).select("symbol", "trim_start", "trim_end", "n", rd("cagr").alias("cagr"), rd("sharpe").alias("sharpe"))


# ---------------------------------------------------------------- readings

cte(
    "reading",
    """SELECT symbol, open_time, close AS price, close >= avg(close) OVER (PARTITION BY symbol ORDER BY open_time ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS above, bar_idx,
              avg(close) OVER (PARTITION BY symbol ORDER BY open_time ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) > avg(close) OVER (PARTITION BY symbol ORDER BY open_time ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS fast_above
       FROM series""",
    "series",
)


@query(
    "agg_current_reading",
    sql(
        """SELECT symbol, max(open_time) AS day, max_by(price, open_time) AS price, max_by(above, open_time) AS above_sma50, max_by(CASE WHEN bar_idx + 1 < 50 THEN 0.0::DOUBLE WHEN fast_above THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END, open_time) AS target
           FROM reading GROUP BY 1""",
        "reading",
    ),
)
def _(t: Tables) -> DataFrame:
    rows = cross_signals(t)  # fn/sn include the last close: the weight for the next session
    target = F.when(F.col("bar_idx") + 1 < 50, F.lit(0.0)).when(F.col("fn") > F.col("sn"), F.lit(1.0)).otherwise(F.lit(0.0))
    last = F.max_by(F.struct("close", (F.col("close") >= F.col("sn")).alias("above"), target.alias("target")), "open_time").alias("b")
    out = rows.groupBy("symbol").agg(F.max("open_time").alias("day"), last)
    return out.select("symbol", "day", F.col("b.close").alias("price"), F.coalesce("b.above", F.lit(False)).alias("above_sma50"), F.col("b.target").alias("target"))


@query(
    "agg_downsample",
    sql(f"SELECT symbol, day, {r('equity', 'equity', 8)} FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY day) AS rn, count(*) OVER (PARTITION BY symbol) AS n FROM eq) WHERE (rn - 1) % greatest(1, n // 180) = 0 OR rn = n", "eq"),
)
def _(t: Tables) -> DataFrame:
    w = Window.partitionBy("symbol")
    rows = pf.with_equity(brand_returns(t), ["symbol"]).withColumns({"rn": F.row_number().over(w.orderBy("day")), "m": F.count(F.lit(1)).over(w)})
    step = F.greatest(F.lit(1), F.floor(F.col("m") / 180))
    return rows.where(((F.col("rn") - 1) % step == 0) | (F.col("rn") == F.col("m"))).select("symbol", "day", rd("equity", 8).alias("equity"))


@query(
    "agg_window_return",
    sql(
        f"""SELECT symbol, count(*) AS n, CASE WHEN count(*) >= 2 THEN {r('max_by(close, open_time) / min_by(close, open_time) - 1')} END AS ret FROM segbars
            WHERE open_time BETWEEN epoch_ms(TIMESTAMP '1999-01-01') AND epoch_ms(TIMESTAMP '1999-12-31') GROUP BY 1""",
        "segbars",
    ),
)
def _(t: Tables) -> DataFrame:
    rows = panels.segment_bars(t).where(F.col("open_time").between(915148800000, 946598400000))
    ret = F.when(F.count(F.lit(1)) >= 2, rd(F.max_by("close", "open_time") / F.min_by("close", "open_time") - 1.0))
    return rows.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), ret.alias("ret"))


# ---------------------------------------------------------------- walk-forward diagnostics

cte("fold_m", summary_sql("big_oos", "symbol, fold_id", 365, SETUP.rf), "big_oos")


def big_oos(t: Tables) -> DataFrame:
    w = Walk(t, POOL)
    picks = wf.select_argmax(w.features, POOL, w.bounds, SETUP).select("symbol", "fold_id", "pool_idx")
    return t.keep("oos-picks", lambda: w.streams(picks))


FOLD_CONSISTENCY = f"""SELECT symbol, count(*) AS n_folds, {r('median(fret)', 'median_return')}, {r('median(sharpe)', 'median_sharpe')}, min_by(fold_id, (round(fret, 9), round(sharpe, 9))) AS worst_fold,
   {r('avg((fret > 0)::INT)', 'pct_profitable')}, {r('stddev_pop(fret)', 'stdev')}, {r('min(fret)', 'min_return')}, {r('max(fret)', 'max_return')} FROM (SELECT *, final - 1 AS fret FROM fold_m) GROUP BY 1"""


def fold_consistency(folds: DataFrame) -> DataFrame:
    """Per symbol over its folds: medians, worst fold by (return, Sharpe), population dispersion."""
    f = folds.withColumn("fret", F.col("final") - 1.0)
    return f.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_folds"), rd(F.median("fret")).alias("median_return"), rd(F.median("sharpe")).alias("median_sharpe"),
        F.min_by(F.col("fold_id").cast("bigint"), F.struct(F.round("fret", 9), F.round("sharpe", 9))).alias("worst_fold"), rd(F.avg((F.col("fret") > 0).cast("double"))).alias("pct_profitable"),
        rd(F.stddev_pop("fret")).alias("stdev"), rd(F.min("fret")).alias("min_return"), rd(F.max("fret")).alias("max_return"),
    )


@query("agg_fold_consistency", sql(FOLD_CONSISTENCY, "fold_m"))
def _(t: Tables) -> DataFrame:
    return fold_consistency(pf.summary(big_oos(t), ["symbol", "fold_id"], 365, SETUP.rf))


cte("asset_m", summary_sql("big_oos", "symbol", 365, SETUP.rf), "big_oos")
DISPERSION = ["stdev_sharpe", "min_sharpe", "median_sharpe", "max_sharpe", "median_cagr"]


@query(
    "agg_asset_dispersion",
    sql(
        f"""SELECT count(*) AS assets, count(*) FILTER (sharpe > 0) AS positive, {r('count(*) FILTER (sharpe > 0) / count(*)::DOUBLE', 'pct_positive')}, {r('stddev_pop(sharpe)', 'stdev_sharpe')}, {r('min(sharpe)', 'min_sharpe')},
              {r('median(sharpe)', 'median_sharpe')}, {r('max(sharpe)', 'max_sharpe')}, {r('median(cagr)', 'median_cagr')} FROM asset_m""",
        "asset_m",
    ),
)
def _(t: Tables) -> DataFrame:
    m = pf.summary(big_oos(t), ["symbol"], 365, SETUP.rf)
    pos = F.count(F.when(F.col("sharpe") > 0, 1))
    return m.agg(
        F.count(F.lit(1)).alias("assets"), pos.alias("positive"), rd(pos / F.count(F.lit(1))).alias("pct_positive"), rd(F.stddev_pop("sharpe")).alias("stdev_sharpe"),
        rd(F.min("sharpe")).alias("min_sharpe"), rd(F.median("sharpe")).alias("median_sharpe"), rd(F.max("sharpe")).alias("max_sharpe"), rd(F.median("cagr")).alias("median_cagr"),
    )


CONC = """SELECT '{dim}' AS dimension, {key}::VARCHAR AS name, sum(ret) AS value FROM {src} GROUP BY {key}"""
cte("contrib", " UNION ALL ".join([CONC.format(dim="asset", key="symbol", src="big_oos"), CONC.format(dim="fold", key="fold_id", src="big_oos"), CONC.format(dim="regime", key="coalesce(l.label, 'sideways')", src="big_oos s LEFT JOIN proxy_labels l ON s.day = l.day")]), "big_oos", "proxy_labels")
cte(
    "conc",
    f"""SELECT dimension, CASE WHEN tot > 0 THEN max_by(name, (round(value, 9), -rk)) FILTER (value > 0) ELSE max_by(name, (round(value, 9), -rk)) END AS name, {r('max(value)', 'value')},
          CASE WHEN tot > 0 THEN {r('max(value) / tot')} ELSE 0.0 END AS share, CASE WHEN tot > 0 THEN {r('sum(CASE WHEN value > 0 THEN pow(value / tot, 2) ELSE 0 END)')} END AS herfindahl,
          CASE WHEN tot > 0 THEN max(value) / tot > 0.5 ELSE false END AS concentrated
        FROM (SELECT *, sum(CASE WHEN value > 0 THEN value ELSE 0 END) OVER (PARTITION BY dimension) AS tot, row_number() OVER (PARTITION BY dimension ORDER BY name) AS rk FROM contrib) GROUP BY dimension, tot""",
    "contrib",
)


def concentration(contrib: DataFrame) -> DataFrame:
    """Per dimension: largest contributor (name order breaks ties), its share of the positive sum, Herfindahl."""
    totals = contrib.groupBy("dimension").agg(F.sum(F.when(F.col("value") > 0, F.col("value")).otherwise(0.0)).alias("tot"))
    rank = F.row_number().over(Window.partitionBy("dimension").orderBy("name"))  # one row per contributor
    rows = contrib.withColumn("rk", rank).join(totals, "dimension")
    agg = rows.groupBy("dimension", "tot").agg(
        F.max_by("name", F.struct(F.round("value", 9), -F.col("rk"))).alias("name"), F.max("value").alias("value"),
        F.sum(F.when(F.col("value") > 0, F.pow(F.try_divide("value", "tot"), F.lit(2.0))).otherwise(0.0)).alias("h"),
    )
    ok = F.col("tot") > 0
    share = F.try_divide("value", "tot")
    return agg.select(
        "dimension", "name", rd("value").alias("value"), F.when(ok, rd(share)).otherwise(0.0).alias("share"), F.when(ok, rd("h")).alias("herfindahl"),
        F.when(ok, share > 0.5).otherwise(False).alias("concentrated"),
    )


def contributions(t: Tables) -> DataFrame:
    oos = big_oos(t)
    labels = market_labels(t).where("symbol = 'BUILDING'").select("day", "label")
    tagged = oos.join(F.broadcast(labels), "day", "left").withColumn("label", F.coalesce("label", F.lit("sideways")))
    dims = F.explode(
        F.array(
            F.struct(F.lit("asset").alias("dimension"), F.col("symbol").alias("name")),
            F.struct(F.lit("fold").alias("dimension"), F.col("fold_id").cast("string").alias("name")),
            F.struct(F.lit("regime").alias("dimension"), F.col("label").alias("name")),
        )
    )
    return tagged.select(dims.alias("d"), "ret").groupBy("d.dimension", "d.name").agg(F.sum("ret").alias("value"))


@query("agg_concentration", sql("SELECT * FROM conc", "conc"))
def _(t: Tables) -> DataFrame:
    return concentration(t.keep("contrib", lambda: contributions(t)))


@query(
    "agg_dominant_source",
    sql(
        """SELECT CASE WHEN n_assets = 0 OR n_folds = 0 THEN 'insufficient_data' WHEN fold THEN 'one_fold' WHEN asset THEN 'one_asset' WHEN regime THEN 'one_regime' ELSE 'spread_across_assets_and_folds' END AS dominant_source,
             asset AS one_asset, fold AS one_fold, regime AS one_regime, n_assets, n_folds FROM (
             SELECT bool_or(concentrated) FILTER (dimension = 'asset') AS asset, bool_or(concentrated) FILTER (dimension = 'fold') AS fold, bool_or(concentrated) FILTER (dimension = 'regime') AS regime FROM conc),
           (SELECT count(DISTINCT symbol) AS n_assets, count(DISTINCT fold_id) AS n_folds FROM big_oos)""",
        "conc",
        "big_oos",
    ),
)
def _(t: Tables) -> DataFrame:
    contrib = t.keep("contrib", lambda: contributions(t))
    conc = concentration(contrib)

    def hit(dim: str):
        return F.coalesce(F.bool_or(F.when(F.col("dimension") == dim, F.col("concentrated"))), F.lit(False))

    flags = conc.agg(hit("asset").alias("one_asset"), hit("fold").alias("one_fold"), hit("regime").alias("one_regime"))
    sizes = contrib.agg(F.count(F.when(F.col("dimension") == "asset", 1)).alias("n_assets"), F.count(F.when(F.col("dimension") == "fold", 1)).alias("n_folds"))
    source = (
        F.when((F.col("n_assets") == 0) | (F.col("n_folds") == 0), "insufficient_data").when(F.col("one_fold"), "one_fold").when(F.col("one_asset"), "one_asset")
        .when(F.col("one_regime"), "one_regime").otherwise("spread_across_assets_and_folds")
    )
    return flags.crossJoin(sizes).select(source.alias("dominant_source"), "one_asset", "one_fold", "one_regime", "n_assets", "n_folds")


@query(
    "agg_distinct_series",
    sql("SELECT count(*) AS n_picks, count(DISTINCT name) AS distinct_picks, count(DISTINCT split_part(name, '(', 1)) AS families, count(DISTINCT symbol) AS symbols FROM big_pick", "big_pick"),
)
def _(t: Tables) -> DataFrame:
    w = Walk(t, POOL)
    picks = wf.select_argmax(w.features, POOL, w.bounds, SETUP).withColumn("name", w.name())
    family = F.substring_index("name", "(", 1)
    return picks.agg(
        F.count(F.lit(1)).alias("n_picks"), F.countDistinct("name").alias("distinct_picks"), F.countDistinct(family).alias("families"), F.countDistinct("symbol").alias("symbols")
    )

