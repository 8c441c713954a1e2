"""Sweeps, ablations, attribution and the comparison report."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import accounting as ac
from ..functions import costs
from ..functions import performance as pf
from ..functions import weights as wt
from ..functions.numeric import r as rd
from ..operators import portfolio as pt
from ..operators.cleaning import align_to_timeline
from ..plans import candidates as cand
from ..plans import sweeps as sw
from ..plans import walkforward as wf
from ..sources import panels
from ..sources.panels import Tables
from .ingest import timeline_of
from .portfolio import COMBINE, masked_inputs
from .registry import clone, cte, query, r, sql
from .signals import OVERLAY, PREV_W, d, features_cte, summary_sql, transition_sql, weight_sql, weights_cte
from .universe import eligibility
from .walk import POOL, RATE, RFD, SETUP, Walk, walk_ctes

COLS = ["final", "cagr", "sharpe", "max_drawdown"]
OUT = ", ".join(r(c, c) for c in COLS)


def rows(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, *[rd(c).alias(c) for c in COLS])


# ---------------------------------------------------------------- parameter grid

GRID = sw.grid_pool()
GRID_DIM = ", ".join(f"({i}, {s.args[0]}, {s.args[1]}::DOUBLE)" for i, s in enumerate(GRID))
features_cte("grid_f", cand.pool_features(GRID))
cte("grid_sl", "SELECT f.*, b.fold_id, f.bar_idx - b.train_end_idx AS slice_idx FROM grid_f f JOIN bounds b USING (symbol) WHERE f.bar_idx BETWEEN b.train_end_idx AND b.test_end_idx", "grid_f", "bounds")
weights_cte("grid_w", GRID, "grid_sl", idx="slice_idx", keep="symbol, fold_id, slice_idx, open_time, open, close, prev_close")
cte("grid_acc", "SELECT symbol, pool_idx, open_time AS day, ret FROM (" + transition_sql("w_prev", "w", "prev_close", "open", "close", RATE, RFD, "previous",
    "(SELECT * FROM (SELECT *, lag(w, 1, 0.0) OVER (PARTITION BY symbol, fold_id, pool_idx ORDER BY open_time) AS w_prev FROM (SELECT *, CASE WHEN slice_idx >= 1 THEN weight ELSE 0.0::DOUBLE END AS w FROM grid_w)) WHERE slice_idx >= 1)") + ")", "grid_w")
cte("grid_m", f"SELECT * FROM ({summary_sql('grid_acc', 'symbol, pool_idx')}) JOIN (VALUES {GRID_DIM}) g(pool_idx, lookback, target) USING (pool_idx)", "grid_acc")


def grid_of(t: Tables) -> DataFrame:
    w = Walk(t, GRID)
    streams = wf.fixed_streams(w.features, GRID, w.bounds, SETUP)
    dim = t.spark.createDataFrame([(i, s.args[0], s.args[1]) for i, s in enumerate(GRID)], "pool_idx int, lookback int, target double")
    return sw.grid_metrics(streams, ["symbol", "pool_idx"]).join(F.broadcast(dim), "pool_idx")


@query("sw_param_grid", sql(f"SELECT symbol, lookback, target, {OUT} FROM grid_m", "grid_m"))
def _(t: Tables) -> DataFrame:
    return rows(grid_of(t), "symbol", "lookback", "target")


@query(
    "agg_grid_stability",
    sql(
        f"""SELECT symbol, {r('min(sharpe)', 'min')}, {r('list_sort(list(sharpe))[count(*) // 2 + 1]', 'median')}, {r('max(sharpe)', 'max')}, {r('avg((sharpe >= 0.5 * mx)::INT)', 'share_above_half_max')},
              {r('(coalesce(sum(d1), 0) + coalesce(sum(d2), 0)) / (count(d1) + count(d2))', 'mean_neighbor_delta')} FROM (SELECT *, max(sharpe) OVER (PARTITION BY symbol) AS mx, abs(lead(sharpe) OVER (PARTITION BY symbol, target ORDER BY lookback) - sharpe) AS d1,
              abs(lead(sharpe) OVER (PARTITION BY symbol, lookback ORDER BY target) - sharpe) AS d2 FROM grid_m) GROUP BY 1""",
        "grid_m",
    ),
)
def _(t: Tables) -> DataFrame:
    out = sw.grid_stability(grid_of(t), ["symbol"])
    return out.select("symbol", *[rd(c).alias(c) for c in ("min", "median", "max", "share_above_half_max", "mean_neighbor_delta")])


# ---------------------------------------------------------------- cost, latency, execution

for _bps in sw.COST_BPS:
    walk_ctes(f"c{_bps}", POOL, rate=d(_bps / 10_000.0), base="big")
for _lag in (1, 2):
    walk_ctes(f"lag{_lag}", POOL, latency=_lag, base="big")
walk_ctes("mclose", POOL, execution="close", base="big")


def union_summary(parts: dict[str, str], key: str) -> str:
    return " UNION ALL ".join(f"SELECT {label} AS {key}, symbol, {OUT} FROM ({summary_sql(src, 'symbol')})" for label, src in parts.items())


COST_SQL = union_summary({f"{b / 10_000.0!r}::DOUBLE": f"c{b}_oos" for b in sw.COST_BPS}, "level")
LAT_SQL = union_summary({"'0'": "big_oos", "'1'": "lag1_oos", "'2'": "lag2_oos"}, "latency")
EXEC_SQL = union_summary({"'close'": "mclose_oos", "'next_open'": "big_oos"}, "execution")


def cost_sweep(t: Tables) -> DataFrame:
    w = Walk(t, POOL)
    out = sw.cost_levels(w.features, POOL, w.bounds, SETUP, [b / 10_000.0 for b in sw.COST_BPS])
    return rows(sw.grid_metrics(out, ["level", "symbol"]), "level", "symbol")


def setup_sweep(t: Tables, setups: dict[str, wf.Setup], key: str) -> DataFrame:
    w = Walk(t, POOL)
    return rows(sw.grid_metrics(sw.variants(w.features, POOL, w.bounds, setups, key), [key, "symbol"]), key, "symbol")


def latency_sweep(t: Tables) -> DataFrame:
    return setup_sweep(t, {str(k): SETUP.with_(latency=k) for k in sw.LATENCIES}, "latency")


def execution_sweep(t: Tables) -> DataFrame:
    return setup_sweep(t, {m: SETUP.with_(execution=m) for m in sw.MODES}, "execution")


@query("sw_cost", sql(COST_SQL, *[f"c{b}_oos" for b in sw.COST_BPS]))
def _(t: Tables) -> DataFrame:
    return cost_sweep(t)


@query("sw_latency", sql(LAT_SQL, "big_oos", "lag1_oos", "lag2_oos"))
def _(t: Tables) -> DataFrame:
    return latency_sweep(t)


@query("sw_execution", sql(EXEC_SQL, "mclose_oos", "big_oos"))
def _(t: Tables) -> DataFrame:
    return execution_sweep(t)


cte("oos_blocks", "SELECT *, (row_number() OVER (PARTITION BY symbol ORDER BY day) - 1) // 730 AS block FROM big_oos", "big_oos")


@query(
    "sw_full",
    sql(
        f"""SELECT 'parameters' AS sweep, lookback::VARCHAR || '/' || format('{{:.2f}}', target) AS level, symbol, {OUT} FROM grid_m UNION ALL SELECT 'rolling', block::VARCHAR, symbol, {OUT} FROM ({summary_sql('oos_blocks', 'symbol, block')})
            UNION ALL SELECT 'costs', format('{{:.4f}}', level), symbol, final, cagr, sharpe, max_drawdown FROM ({COST_SQL}) UNION ALL SELECT 'latency', latency, symbol, final, cagr, sharpe, max_drawdown FROM ({LAT_SQL})
            UNION ALL SELECT 'execution', execution, symbol, final, cagr, sharpe, max_drawdown FROM ({EXEC_SQL})""",
        "grid_m", "oos_blocks", *[f"c{b}_oos" for b in sw.COST_BPS], "big_oos", "lag1_oos", "lag2_oos", "mclose_oos",
    ),
)
def _(t: Tables) -> DataFrame:
    w = Walk(t, POOL)
    picks = wf.select_argmax(w.features, POOL, w.bounds, SETUP).select("symbol", "fold_id", "pool_idx")
    win = Window.partitionBy("symbol").orderBy("day")
    blocks = w.streams(picks).withColumn("block", F.floor((F.row_number().over(win) - 1) / 730).cast("bigint"))
    label = F.concat(F.col("lookback").cast("string"), F.lit("/"), F.format_string("%.2f", "target"))
    parts = [
        ("parameters", rows(grid_of(t), "symbol", "lookback", "target").withColumn("level", label)),
        ("rolling", rows(sw.grid_metrics(blocks, ["symbol", "block"]), "symbol", "block").withColumn("level", F.col("block").cast("string"))),
        ("costs", cost_sweep(t).withColumn("level", F.format_string("%.4f", "level"))),
        ("latency", latency_sweep(t).withColumn("level", F.col("latency"))),
        ("execution", execution_sweep(t).withColumn("level", F.col("execution"))),
    ]
    out = None
    for sweep, part in parts:
        part = part.select(F.lit(sweep).alias("sweep"), "level", "symbol", *COLS)
        out = part if out is None else out.unionByName(part)
    return out


# ---------------------------------------------------------------- ablations

FAMILIES = sorted({s.family for s in POOL})
FAM_DIM = ", ".join(f"({i}, '{s.family}')" for i, s in enumerate(POOL))
cte("abl_pick", f"SELECT * FROM (SELECT o.omitted, s.symbol, s.fold_id, s.pool_idx, row_number() OVER (PARTITION BY o.omitted, s.symbol, s.fold_id ORDER BY s.sharpe DESC, s.pool_idx) AS rk FROM big_score s JOIN (VALUES {FAM_DIM}) f(pool_idx, family) USING (pool_idx), (VALUES ('none'), {', '.join(f'($${f}$$)' for f in FAMILIES)}) o(omitted) WHERE f.family <> o.omitted) WHERE rk = 1", "big_score")
cte("abl_oos", "SELECT p.omitted, t.symbol, t.open_time AS day, t.ret FROM big_test t JOIN abl_pick p ON t.symbol = p.symbol AND t.fold_id = p.fold_id AND t.pool_idx = p.pool_idx", "big_test", "abl_pick")
cte("abl_m", summary_sql("abl_oos", "omitted, symbol", 365, SETUP.rf), "abl_oos")


@query("ab_family", sql(f"SELECT a.omitted, a.symbol, {r('a.sharpe', 'sharpe')}, {r('a.sharpe - b.sharpe', 'delta_sharpe')}, {r('a.cagr - b.cagr', 'delta_cagr')} FROM abl_m a JOIN abl_m b ON a.symbol = b.symbol AND b.omitted = 'none'", "abl_m"))
def _(t: Tables) -> DataFrame:
    w = Walk(t, POOL)
    m = pf.summary(sw.family_ablation(w.features, POOL, w.bounds, SETUP), ["omitted", "symbol"], 365, SETUP.rf).select("omitted", "symbol", "sharpe", "cagr")
    base = m.where("omitted = 'none'").select("symbol", F.col("sharpe").alias("s0"), F.col("cagr").alias("c0"))
    return m.join(base, "symbol").select("omitted", "symbol", rd("sharpe").alias("sharpe"), rd(F.col("sharpe") - F.col("s0")).alias("delta_sharpe"), rd(F.col("cagr") - F.col("c0")).alias("delta_cagr"))


cte("pf_tilted", COMBINE.format(w="tilt_w"), "denoms", "tilt_w")
VARIANTS = {"equal_weight": "pf_equal", "inv_vol": "pf_iv", "inv_vol+tilt": "pf_tilted", "inv_vol+tilt+crisis": "pf_rule"}
cte("variants", " UNION ALL ".join(f"SELECT '{k}' AS variant, day, ret FROM {v}" for k, v in VARIANTS.items()), *VARIANTS.values())
W_VAR = "PARTITION BY variant ORDER BY day"
cte("variants_all", f"SELECT variant, day, ret FROM variants UNION ALL SELECT variant || '|vol_targeted', day, oret FROM ({OVERLAY.format(w=W_VAR, src='variants')})", "variants")


def combiner_streams(masked: DataFrame, denoms: DataFrame) -> DataFrame:
    """(variant, day, ret) of the four fixed combiners on the same masked streams."""
    def named(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.lit(name).alias("variant"), "day", "ret")

    return (
        named(pt.equal_weight(masked, denoms), "equal_weight")
        .unionByName(named(pt.inverse_vol(masked, denoms), "inv_vol"))
        .unionByName(named(pt.rule(masked, denoms, use_crisis=False), "inv_vol+tilt"))
        .unionByName(named(pt.rule(masked, denoms), "inv_vol+tilt+crisis"))
    )


@query("ab_overlay", sql(f"SELECT variant, {OUT} FROM ({summary_sql('variants_all', 'variant', 365, SETUP.rf)})", "variants_all"))
def _(t: Tables) -> DataFrame:
    masked, _timeline, denoms = masked_inputs(t)
    base = combiner_streams(masked, denoms)
    targeted = costs.vol_overlay(base, ["variant"]).select(F.concat("variant", F.lit("|vol_targeted")).alias("variant"), "day", "ret")
    return rows(pf.summary(base.unionByName(targeted), ["variant"], 365, SETUP.rf), "variant")


# ---------------------------------------------------------------- baselines and the comparison report

BASE = {"momentum SMA10/50": cand.sma_cross(10, 50), "mean-reversion RSI-2": cand.rsi_dip(2, 60, 150), "buy&hold": cand.buy_hold()}
cte("base_bars", "SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY open_time) - 1 AS bar_idx FROM segbars WHERE symbol = 'BUILDING'", "segbars")
cte("base_series", "SELECT *, greatest(close - prev_close, 0.0::DOUBLE) AS up, greatest(prev_close - close, 0.0::DOUBLE) AS dn, ln(close / prev_close) AS lr FROM (SELECT *, lag(close) OVER (ORDER BY open_time) AS prev_close FROM base_bars)", "base_bars")
features_cte("base_f", cand.pool_features(BASE.values()), source="base_series")
cte("base_w", " UNION ALL ".join(f"SELECT '{n}' AS baseline, open_time, bar_idx, open, close, prev_close, {weight_sql(s)} AS weight FROM base_f" for n, s in BASE.items()), "base_f")
cte("base_pw", f"SELECT * FROM ({PREV_W.format(keys='baseline', src='base_w')}) WHERE bar_idx >= 1", "base_w")
cte("oos_span", "SELECT min(train_end_ms) AS f, max(test_end_ms) AS l FROM folds", "folds")
cte(
    "baselines",
    "SELECT b.baseline, b.open_time AS day, b.ret FROM (" + transition_sql("w_prev", "w", "prev_close", "open", "close", RATE, RFD, "previous", "base_pw") + f") b, oos_span s WHERE b.open_time >= s.f AND b.open_time < s.l UNION ALL SELECT 'cash (risk-free)', open_time, {RFD} FROM base_bars, oos_span s WHERE open_time >= s.f AND open_time < s.l",
    "base_pw", "base_bars", "oos_span",
)


def baseline_streams(t: Tables, folds: DataFrame) -> DataFrame:
    """(baseline, day, ret) on the proxy: accounted on the full history, then cut to the out-of-sample window."""
    from ..functions import indicators as ind

    bars = panels.segment_bars(t).where("symbol = 'BUILDING'")
    pool = list(BASE.values())
    feats = ind.add_features(ind.series(bars), cand.pool_features(pool))
    names = F.array(*[F.lit(n) for n in BASE])
    long = feats.select("symbol", "open_time", "bar_idx", "open", "close", "prev_close", F.posexplode(wt.pool_weights(pool, F.col("bar_idx"))).alias("i", "weight"))
    long = long.withColumn("baseline", F.element_at(names, F.col("i") + 1))
    acc = ac.account(long, ["baseline"], SETUP.cost_rate, SETUP.rf, 365, "next_open").select("baseline", F.col("open_time").alias("day"), "ret")
    cash = bars.select(F.lit("cash (risk-free)").alias("baseline"), F.col("open_time").alias("day"), F.lit(SETUP.rf / 365).alias("ret"))
    span = folds.agg(F.min("train_end_ms").alias("f"), F.max("test_end_ms").alias("l"))
    return acc.unionByName(cash).join(F.broadcast(span), (F.col("day") >= F.col("f")) & (F.col("day") < F.col("l"))).drop("f", "l")


@query("at_baselines", sql(f"SELECT baseline, {OUT} FROM ({summary_sql('baselines', 'baseline')})", "baselines"))
def _(t: Tables) -> DataFrame:
    from .universe import calendar_folds

    return rows(pf.summary(baseline_streams(t, calendar_folds(t)), ["baseline"]), "baseline")


# sleeves = walk-forward streams aligned to the out-of-sample calendar and masked, in three versions: as selected, selected and
# traded under a rebalance band, and the one fixed rule under that band
BAND = 0.05
BANDED, FIXED = SETUP.with_(band=BAND), [cand.risk_ensemble()]


def banded_ctes(tag: str, base: str, source: str, keys: str, idx: str) -> None:
    """Held weights of a pool: recursion over bars, one list of all candidates per key."""
    cols = keys.split(", ")
    cte(f"{tag}_in", f"SELECT {keys}, {idx} AS i, list(CASE WHEN {idx} >= 1 THEN weight ELSE 0.0::DOUBLE END ORDER BY pool_idx) AS ws FROM {source} GROUP BY ALL", source)
    cte(
        f"{tag}_held",
        f"""SELECT {keys}, i, list_transform(ws, lambda x: 0.0::DOUBLE) AS held FROM {tag}_in WHERE i = 0
            UNION ALL -- recursive
            SELECT {", ".join(f"s.{k}" for k in cols)}, s.i, list_transform(list_zip(s.ws, e.held), lambda x: CASE WHEN abs(x[1] - x[2]) > {d(BAND)} THEN x[1] ELSE x[2] END)
            FROM {tag}_held e JOIN {tag}_in s ON {" AND ".join(f"s.{k} = e.{k}" for k in cols)} AND s.i = e.i + 1""",
        f"{tag}_in",
    )
    rows = f"SELECT {keys}, i, unnest(held) AS h, unnest(range(len(held))) AS k FROM {tag}_held"
    cte(base, f"SELECT w.* REPLACE (h AS weight) FROM {source} w JOIN ({rows}) r ON {" AND ".join(f"w.{k} = r.{k}" for k in cols)} AND w.{idx} = r.i AND w.pool_idx = r.k", source, f"{tag}_held")


banded_ctes("bnd_tr", "bnd_w", "big_w", "symbol", "bar_idx")
banded_ctes("bnd_te", "bnd_tw", "big_tw", "symbol, fold_id", "slice_idx")
walk_ctes("bnd", POOL, base="bnd")
only_fixed = f"pool_idx = {POOL.index(FIXED[0])}"
cte("fix_w", f"SELECT * FROM bnd_w WHERE {only_fixed}", "bnd_w")
cte("fix_tw", f"SELECT * FROM bnd_tw WHERE {only_fixed}", "bnd_tw")
walk_ctes("fix", FIXED, base="fix")

cte("oos_days", "SELECT t.day FROM timeline t, oos_span s WHERE t.day > s.f AND t.day <= s.l", "timeline", "oos_span")
cte("sleeve_denoms", "SELECT t.day, greatest(1, count(e.symbol)) AS denom FROM oos_days t LEFT JOIN eligible e ON t.day = e.day GROUP BY 1", "oos_days", "eligible")
COMBINED = ["pf_equal", "iv_raw", "iv_fill", "iv_w", "pf_iv", "tilt_w", "corr_z", "avg_corr", "pf_rule"]
for kind, oos in (("pl_", "big_oos"), ("bd_", "bnd_oos"), ("fx_", "fix_oos")):
    cte(f"{kind}sleeves", f"SELECT symbol, day, coalesce(ret, 0.0) AS ret FROM (SELECT s.symbol, t.day FROM oos_days t JOIN (SELECT symbol, min(day) AS f, max(day) AS l FROM {oos} GROUP BY 1) s ON t.day BETWEEN s.f AND s.l) LEFT JOIN {oos} USING (symbol, day)", "oos_days", oos)
    cte(f"{kind}masked", f"SELECT * FROM {kind}sleeves SEMI JOIN eligible USING (day, symbol)", f"{kind}sleeves", "eligible")
    clone(COMBINED, kind, {"masked": f"{kind}masked", "denoms": "sleeve_denoms"})
cte("pl_pf_tilt", COMBINE.format(w="pl_tilt_w").replace("denoms", "sleeve_denoms"), "sleeve_denoms", "pl_tilt_w")
cte("cmp_thr_in", "SELECT variant, day, ret, row_number() OVER (PARTITION BY variant ORDER BY day) AS i FROM (SELECT 'full' AS variant, day, ret FROM pl_pf_rule UNION ALL SELECT 'fixed', day, ret FROM fx_pf_rule)", "pl_pf_rule", "fx_pf_rule")
clone(["throttled"], "cmp_", {"thr_in": "cmp_thr_in"})
cte("cmp_thr", "SELECT t.variant, i.day, t.ret FROM cmp_throttled t JOIN cmp_thr_in i USING (variant, i)", "cmp_throttled", "cmp_thr_in")


def overlay_of(source: str) -> str:
    return f"SELECT day, oret AS ret FROM ({OVERLAY.format(w='ORDER BY day', src=source)})"


TARGETED = {
    "equal_rm": "pl_pf_equal", "inv_vol_rm": "pl_pf_iv", "full_rm": "pl_pf_rule", "throttle_rm": "(SELECT day, ret FROM cmp_thr WHERE variant = 'full')",
    "banded_rm": "bd_pf_rule", "fixed_rm": "(SELECT day, ret FROM cmp_thr WHERE variant = 'fixed')",
}
cte(
    "cmp",
    "SELECT 'equal_raw' AS series, day, ret FROM pl_pf_equal UNION ALL " + " UNION ALL ".join(f"SELECT '{name}', day, ret FROM ({overlay_of(source)})" for name, source in TARGETED.items())
    + " UNION ALL SELECT baseline, day, ret FROM baselines UNION ALL SELECT symbol, day, ret FROM big_oos",
    "pl_pf_equal", "pl_pf_iv", "pl_pf_rule", "bd_pf_rule", "cmp_thr", "baselines", "big_oos",
)


class Report:
    """Masked sleeves of the three walk-forward versions on the out-of-sample calendar, each stored once."""

    def __init__(self, t: Tables):
        from .universe import calendar_folds

        self.walk = Walk(t, POOL)
        self.folds = calendar_folds(t)
        span = self.folds.agg(F.min("train_end_ms").alias("f"), F.max("test_end_ms").alias("l"))
        self.days = timeline_of(self.walk.bars).join(F.broadcast(span), (F.col("day") > F.col("f")) & (F.col("day") <= F.col("l"))).select("day")
        self.eligible = eligibility(t)
        self.denoms = pt.denominators(self.days, self.eligible)
        self.t = t

    def oos(self, kind: str) -> DataFrame:
        """(symbol, day, ret) of 'plain', 'banded' or 'fixed'."""
        pool, setup = (FIXED if kind == "fixed" else POOL), (SETUP if kind == "plain" else BANDED)

        def streams() -> DataFrame:
            w = self.walk
            picks = wf.select_argmax(w.features, pool, w.bounds, setup).select("symbol", "fold_id", "pool_idx")
            return wf.picked_streams(w.features, pool, w.bounds, picks, setup).select("symbol", "day", "ret")

        return self.t.keep(f"oos-{kind}", streams)

    def sleeves(self, kind: str) -> DataFrame:
        return self.t.keep(f"sleeves-{kind}", lambda: pt.mask(align_to_timeline(self.oos(kind), self.days, ["symbol"]), self.eligible))

    def rule(self, kind: str) -> DataFrame:
        return pt.rule(self.sleeves(kind), self.denoms)


def named(df: DataFrame, name: str, column: str = "variant") -> DataFrame:
    return df.select(F.lit(name).alias(column), "day", "ret")


@query("at_compare", sql(f"SELECT series, n, {OUT} FROM ({summary_sql('cmp', 'series', 365, SETUP.rf)})", "cmp"))
def _(t: Tables) -> DataFrame:
    """Seven portfolio series over the out-of-sample days, the baselines and every symbol on its own."""
    report = Report(t)
    plain = report.sleeves("plain")
    equal, full, fixed = pt.equal_weight(plain, report.denoms), t.keep("report-full", lambda: report.rule("plain")), report.rule("fixed")
    throttled = pt.drawdown_throttle(named(full, "throttle_rm").unionByName(named(fixed, "fixed_rm")))
    raw = (
        named(equal, "equal_rm")
        .unionByName(named(pt.inverse_vol(plain, report.denoms), "inv_vol_rm"))
        .unionByName(named(full, "full_rm"))
        .unionByName(throttled.select("variant", "day", "ret"))
        .unionByName(named(report.rule("banded"), "banded_rm"))
    )
    series = (
        named(equal, "equal_raw", "series")
        .unionByName(costs.vol_overlay(raw, ["variant"]).select(F.col("variant").alias("series"), "day", "ret"))
        .unionByName(baseline_streams(t, report.folds).select(F.col("baseline").alias("series"), "day", "ret"))
        .unionByName(report.oos("plain").select(F.col("symbol").alias("series"), "day", "ret"))
    )
    return rows(pf.summary(series, ["series"], 365, SETUP.rf), "series").join(series.groupBy("series").agg(F.count(F.lit(1)).alias("n")), "series")


# ---------------------------------------------------------------- attribution ladder

RUNGS = ["equal", "inverse vol", "tilt", "crisis", "rebalance band", "vol overlay"]
LADDER = ["pl_pf_equal", "pl_pf_iv", "pl_pf_tilt", "pl_pf_rule", "bd_pf_rule", f"({overlay_of('bd_pf_rule')})"]
cte("ladder", " UNION ALL ".join(f"SELECT {k} AS rung, '{name}' AS component, day, ret FROM {source}" for k, (name, source) in enumerate(zip(RUNGS, LADDER, strict=True), start=1)), *LADDER[:5])
cte("base_turn", "SELECT sum(tv) AS turns FROM (SELECT day, sum(abs(w - pw)) / 2 AS tv FROM (SELECT g.day, g.symbol, coalesce(b.w, 0) AS w, lag(coalesce(b.w, 0), 1, 0) OVER (PARTITION BY g.symbol ORDER BY g.day) AS pw FROM (SELECT day, symbol FROM oos_days, (SELECT DISTINCT symbol FROM bars)) g LEFT JOIN (SELECT m.day, m.symbol, 1.0::DOUBLE / d.denom AS w FROM pl_masked m JOIN sleeve_denoms d USING (day)) b USING (day, symbol)) GROUP BY 1)", "oos_days", "bars", "pl_masked", "sleeve_denoms")


@query(
    "at_ladder",
    sql(
        f"""SELECT rung, component, {OUT}, {r('coalesce(cagr - lag(cagr) OVER (ORDER BY rung), 0)', 'delta_cagr')}, {r('coalesce(sharpe - lag(sharpe) OVER (ORDER BY rung), 0)', 'delta_sharpe')}, {r('-0.0015::DOUBLE * turns', 'cost_line')}
            FROM ({summary_sql('ladder', 'rung, component', 365, SETUP.rf)}), base_turn""",
        "ladder",
        "base_turn",
    ),
)
def _(t: Tables) -> DataFrame:
    """Six rungs over the walk-forward sleeves; the band acts inside the sleeves, so rungs 5 and 6 use banded ones."""
    report = Report(t)
    masked, denoms = report.sleeves("plain"), report.denoms
    banded = t.keep("report-banded", lambda: report.rule("banded")).withColumn("variant", F.lit("rebalance band"))
    base = combiner_streams(masked, denoms).replace({"equal_weight": "equal", "inv_vol": "inverse vol", "inv_vol+tilt": "tilt", "inv_vol+tilt+crisis": "crisis"}, subset="variant")
    overlay = costs.vol_overlay(banded, ["variant"]).select(F.lit("vol overlay").alias("variant"), "day", "ret")
    dim = t.spark.createDataFrame([(c, k, c) for k, c in enumerate(RUNGS, start=1)], "variant string, rung int, component string")
    m = pf.summary(base.unionByName(banded.select("variant", "day", "ret")).unionByName(overlay), ["variant"], 365, SETUP.rf).join(F.broadcast(dim), "variant")
    order = Window.partitionBy(F.lit(0)).orderBy("rung")  # six rungs
    weights = masked.join(denoms, "day").select("day", "symbol", (F.lit(1.0) / F.col("denom")).alias("weight"))
    turns = pt.weight_turnover(weights, report.days).agg(F.sum("turnover").alias("turns"))
    out = m.crossJoin(F.broadcast(turns))
    deltas = {f"delta_{c}": F.coalesce(F.col(c) - F.lag(c).over(order), F.lit(0.0)) for c in ("cagr", "sharpe")}
    return out.withColumns(deltas).select("rung", "component", *[rd(c).alias(c) for c in COLS], rd("delta_cagr").alias("delta_cagr"), rd("delta_sharpe").alias("delta_sharpe"), pt.cost_line(F.col("turns")).alias("cost_line"))


# ---------------------------------------------------------------- selection rules side by side

RULE_SOURCES = {"argmax": "big_oos", "one_se_worst": "oos_worst", "one_se_turnover": "oos_cheap", "robust_shrunk": "oos_robust"}
cte("ms", " UNION ALL ".join(f"SELECT '{k}' AS rule, symbol, day, ret FROM {v}" for k, v in RULE_SOURCES.items()), *RULE_SOURCES.values())
cte("ms_m", summary_sql("ms", "rule, symbol", 365, SETUP.rf), "ms")


@query(
    "ms_rules",
    sql(f"SELECT rule, count(*) AS n_assets, {r('avg(sharpe)', 'mean_sharpe')}, {r('median(sharpe)', 'median_sharpe')}, {r('avg(cagr)', 'mean_cagr')}, {r('avg(max_drawdown)', 'mean_max_drawdown')} FROM ms_m GROUP BY 1", "ms_m"),
)
def _(t: Tables) -> DataFrame:
    from .walk import PRIOR

    w = Walk(t, POOL)
    key = ["symbol", "fold_id", "pool_idx"]
    picks = {
        "argmax": wf.select_argmax(w.features, POOL, w.bounds, SETUP).select(*key),
        "one_se_worst": wf.select_one_se(w.features, POOL, w.bounds, SETUP).select(*key),
        "one_se_turnover": wf.select_one_se(w.features, POOL, w.bounds, SETUP, "lowest_turnover").select(*key),
        "robust_shrunk": wf.select_robust(w.features, POOL, w.bounds, SETUP, PRIOR).select(*key, "alpha", "prior_idx"),
    }
    out = None
    for rule, chosen in picks.items():
        part = w.streams(chosen).withColumn("rule", F.lit(rule))
        out = part if out is None else out.unionByName(part)
    m = pf.summary(out, ["rule", "symbol"], 365, SETUP.rf)
    return m.groupBy("rule").agg(
        F.count(F.lit(1)).alias("n_assets"), rd(F.avg("sharpe")).alias("mean_sharpe"), rd(F.median("sharpe")).alias("median_sharpe"), rd(F.avg("cagr")).alias("mean_cagr"), rd(F.avg("max_drawdown")).alias("mean_max_drawdown")
    )
