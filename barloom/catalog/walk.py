"""Walk-forward selection and selection statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import r as rd
from ..plans import candidates as cand
from ..plans import walkforward as wf
from ..sources import panels
from ..sources.panels import Tables
from .registry import cte, query, r, sql
from .signals import METRIC_COLS, METRICS, d, ema_cte, features_cte, shifted_macd, summary_sql, transition_sql, weights_cte
from .universe import calendar_folds

POOL = cand.candidate_pool()
PRIOR = next(k for k, spec in enumerate(POOL) if spec == cand.risk_ensemble())
SETUP = wf.Setup()
RATE, RFD = d(SETUP.cost_rate), d(SETUP.rf / SETUP.ppy)

# ---- shared SQL: slices, MACD per slice, weights, accounting, scores


def walk_ctes(tag: str, pool: list[cand.Spec], rate: str = RATE, execution: str = "next_open", latency: int = 0, base: str | None = None) -> None:
    """Register train_/test_ accounting CTEs for a pool: {tag}_train, {tag}_test, {tag}_score."""
    x, basis = ("open", "previous") if execution == "next_open" else ("prev_close", "target")
    if base is None:
        plain = [f for f in cand.pool_features(pool) if f[0] != "macd"]
        features_cte(f"{tag}_f", plain)
        cte(f"{tag}_fm", f"SELECT * FROM {tag}_f JOIN macd USING (symbol, bar_idx)", f"{tag}_f", "macd")
        keep = "symbol, open_time, bar_idx, open, close, prev_close, prev_time"
        weights_cte(f"{tag}_w", pool, f"{tag}_fm", keep=keep)
        cte(f"{tag}_sl", f"SELECT f.*, b.fold_id, f.bar_idx - b.train_end_idx AS slice_idx FROM {tag}_f f JOIN bounds b USING (symbol) WHERE f.bar_idx BETWEEN b.train_end_idx AND b.test_end_idx", f"{tag}_f", "bounds")
        cte(f"{tag}_slm", f"SELECT * FROM {tag}_sl JOIN slice_macd USING (symbol, fold_id, slice_idx)", f"{tag}_sl", "slice_macd")
        weights_cte(f"{tag}_tw", pool, f"{tag}_slm", idx="slice_idx", keep="symbol, fold_id, slice_idx, open_time, bar_idx, open, close, prev_close, prev_time")
        base = tag

    def held(source: str, part: str, idx: str) -> str:
        w = f"CASE WHEN {idx} - {latency} >= 1 THEN coalesce(lag(weight, {latency}) OVER (PARTITION BY {part} ORDER BY open_time), 0.0) ELSE 0.0::DOUBLE END"
        return f"SELECT *, lag(w, 1, 0.0) OVER (PARTITION BY {part} ORDER BY open_time) AS w_prev FROM (SELECT *, {w} AS w FROM {source})"

    cte(f"{tag}_train", transition_sql("w_prev", "w", "prev_close", x, "close", rate, RFD, basis, f"(SELECT * FROM ({held(f'{base}_w', 'symbol, pool_idx', 'bar_idx')}) WHERE bar_idx >= 1)"), f"{base}_w")
    cte(f"{tag}_test", transition_sql("w_prev", "w", "prev_close", x, "close", rate, RFD, basis, f"(SELECT * FROM ({held(f'{base}_tw', 'symbol, fold_id, pool_idx', 'slice_idx')}) WHERE slice_idx >= 1)"), f"{base}_tw")
    cte(
        f"{tag}_score",
        f"""SELECT *, CASE WHEN n < 8 THEN 'inf'::DOUBLE WHEN (1 - skew * sharpe / sqrt(365.0) + 0.25 * (kurt - 1) * sharpe * sharpe / 365.0) <= 0 THEN 0.0::DOUBLE
              ELSE sqrt((1 - skew * sharpe / sqrt(365.0::DOUBLE) + 0.25::DOUBLE * (kurt - 1) * sharpe * sharpe / 365.0::DOUBLE) / n) * sqrt(365.0::DOUBLE) END AS se
            FROM (SELECT symbol, fold_id, pool_idx, name, n, turnover, round(CASE WHEN n < 2 OR sd < 1e-12::DOUBLE THEN 0.0::DOUBLE ELSE (m - {RFD}) / sd * sqrt(365.0::DOUBLE) END, 9) AS sharpe,
              CASE WHEN sd < 1e-12::DOUBLE OR n < 3 THEN 0.0::DOUBLE ELSE m3 / pow(v, 1.5::DOUBLE) END AS skew, CASE WHEN sd < 1e-12::DOUBLE OR n < 4 THEN 3.0::DOUBLE ELSE m4 / (v * v) END AS kurt
            FROM (SELECT symbol, fold_id, pool_idx, any_value(name) AS name, count(*) AS n, sum(traded) AS turnover, avg(ret) AS m, stddev_samp(ret) AS sd, var_pop(ret) AS v,
                    avg(pow(ret - mu, 3)) AS m3, avg(pow(ret - mu, 4)) AS m4
                  FROM (SELECT t.*, b.fold_id, avg(ret) OVER (PARTITION BY t.symbol, b.fold_id, pool_idx) AS mu FROM {tag}_train t JOIN bounds b USING (symbol) WHERE bar_idx < greatest(2, train_end_idx - 30))
                  GROUP BY 1, 2, 3))""",
        f"{tag}_train",
        "bounds",
    )
    cte(f"{tag}_pick", f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol, fold_id ORDER BY sharpe DESC, pool_idx) AS rk FROM {tag}_score) WHERE rk = 1", f"{tag}_score")
    cte(
        f"{tag}_oos",
        f"SELECT t.symbol, t.fold_id, t.pool_idx, t.name, t.open_time AS day, t.ret, t.w, t.traded FROM {tag}_test t JOIN {tag}_pick p ON t.symbol = p.symbol AND t.fold_id = p.fold_id AND t.pool_idx = p.pool_idx",
        f"{tag}_test",
        f"{tag}_pick",
    )


cte("slice_src", "SELECT i.symbol, b.fold_id, i.bar_idx - b.train_end_idx AS bar_idx, i.close FROM idx i JOIN bounds b USING (symbol) WHERE i.bar_idx BETWEEN b.train_end_idx AND b.test_end_idx", "idx", "bounds")
ema_cte("slice_ema", "slice_src", "fold_id")
shifted_macd("slice_macd", "slice_ema", "PARTITION BY symbol, fold_id ORDER BY bar_idx", "symbol, fold_id, bar_idx AS slice_idx")
walk_ctes("big", POOL)


class Walk:
    """Shared inputs of the walk-forward queries."""

    def __init__(self, t: Tables, pool: list[cand.Spec], setup: wf.Setup = SETUP):
        self.bars = panels.stored_brand_bars(t)
        self.pool, self.setup = pool, setup
        self.bounds = t.keep("bounds", lambda: wf.fold_bounds(self.bars, calendar_folds(t)))
        self.features = wf.featured(self.bars, pool)
        self.names = F.array(*[F.lit(s.name) for s in pool])

    def name(self, column: str = "pool_idx"):
        return F.element_at(self.names, F.col(column) + 1)

    def streams(self, picks: DataFrame, setup: wf.Setup | None = None) -> DataFrame:
        return wf.picked_streams(self.features, self.pool, self.bounds, picks, setup or self.setup)


STITCH = METRIC_COLS + f", n, n_folds, {r('exposure', 'exposure')}, {r('turnover', 'turnover')}"


def stitch_sql(source: str, keys: str = "symbol", rf: float = SETUP.rf) -> str:
    return (
        f"(SELECT * FROM ({summary_sql(source, keys, 365, rf, '(max(day) - min(day)) / 86400000.0 + 1', 'day')}) JOIN "
        f"(SELECT {keys}, count(*) AS n_folds, sum(e * dd) / sum(dd) AS exposure, sum(tt * dd) / sum(dd) AS turnover FROM "
        f"(SELECT {keys}, fold_id, count(*) AS dd, avg(w) AS e, sum(traded) AS tt FROM {source} GROUP BY {keys}, fold_id) GROUP BY {keys}) USING ({keys}))"
    )


def stitched(out: DataFrame, *keys: str) -> DataFrame:
    return out.select(*keys, *[rd(m).alias(m) for m in METRICS], "n", "n_folds", rd("exposure").alias("exposure"), rd("turnover").alias("turnover"))


@query("wf_select_argmax", sql(f"SELECT symbol, {STITCH} FROM {stitch_sql('big_oos')}", "big_oos"))
def _(t: Tables) -> DataFrame:
    w = Walk(t, POOL)
    picks = wf.select_argmax(w.features, POOL, w.bounds, SETUP).select("symbol", "fold_id", "pool_idx")
    return stitched(wf.stitched_summary(w.streams(picks)), "symbol")


@query("wf_candidate_records", sql(f"SELECT symbol, fold_id, name, n, {r('sharpe', 'sharpe')}, {r('turnover', 'turnover')}, {r('skew', 'skew', 4)}, {r('kurt', 'kurt', 4)} FROM big_score", "big_score"))
def _(t: Tables) -> DataFrame:
    w = Walk(t, POOL)
    scores = wf.train_scores(w.features, POOL, w.bounds, SETUP)
    return scores.select(
        "symbol", F.col("fold_id").cast("bigint").alias("fold_id"), w.name().alias("name"), "n", rd("sharpe").alias("sharpe"), rd("turnover").alias("turnover"),
        rd("skew", 4).alias("skew"), rd("kurt", 4).alias("kurt"),
    )


@query("topk_argmax_stable", sql(f"SELECT symbol, fold_id, name, {r('sharpe', 'sharpe')} FROM big_pick", "big_pick"))
def _(t: Tables) -> DataFrame:
    w = Walk(t, POOL)
    picks = wf.select_argmax(w.features, POOL, w.bounds, SETUP)
    return picks.select("symbol", F.col("fold_id").cast("bigint").alias("fold_id"), w.name().alias("name"), rd("sharpe").alias("sharpe"))


@query("mt_sharpe_se", sql(f"SELECT symbol, fold_id, name, n, {r('sharpe', 'sharpe')}, {r('se', 'se')} FROM big_score", "big_score"))
def _(t: Tables) -> DataFrame:
    w = Walk(t, POOL)
    scores = wf.train_scores(w.features, POOL, w.bounds, SETUP)
    return scores.select("symbol", F.col("fold_id").cast("bigint").alias("fold_id"), w.name().alias("name"), "n", rd("sharpe").alias("sharpe"), rd("se").alias("se"))


STREAM_STATS = f"count(*) AS n, {r('sum(ret)', 'total')}, {r('avg(w)', 'mean_w')}, {r('sum(traded)', 'traded')}, {r('max_by(ret, day)', 'last_ret', 8)}"


def stream_stats(df: DataFrame, *keys) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), rd(F.sum("ret")).alias("total"), rd(F.avg("w")).alias("mean_w"), rd(F.sum("traded")).alias("traded"),
        rd(F.max_by("ret", "day"), 8).alias("last_ret"),
    )


@query("wf_fixed_streams", sql(f"SELECT symbol, fold_id, name, {STREAM_STATS} FROM (SELECT *, open_time AS day FROM big_test) GROUP BY 1, 2, 3", "big_test"))
def _(t: Tables) -> DataFrame:
    w = Walk(t, POOL)
    out = wf.fixed_streams(w.features, POOL, w.bounds, SETUP)
    return stream_stats(out, "symbol", F.col("fold_id").cast("bigint").alias("fold_id"), w.name().alias("name"))


# ---- selection rules

cte("kept", "SELECT s.*, p.sharpe AS best_sharpe, p.se AS best_se FROM big_score s JOIN big_pick p USING (symbol, fold_id) WHERE s.sharpe >= p.sharpe - p.se OR s.pool_idx = p.pool_idx", "big_score", "big_pick")
cte(
    "sub_blocks",
    f"""SELECT symbol, fold_id, pool_idx, name, block, CASE WHEN sd <= 1e-12::DOUBLE THEN CASE WHEN m > 0 THEN 10.0::DOUBLE WHEN m < 0 THEN -10.0::DOUBLE ELSE 0.0::DOUBLE END
          ELSE (m - {RFD}) / sd * sqrt(365.0::DOUBLE) END AS sharpe FROM (
          SELECT symbol, fold_id, pool_idx, name, least(i // (n // 3), 2) AS block, avg(ret) AS m, stddev_samp(ret) AS sd FROM (
            SELECT t.symbol, b.fold_id, t.pool_idx, t.name, t.ret, row_number() OVER (PARTITION BY t.symbol, b.fold_id, t.pool_idx ORDER BY open_time) - 1 AS i,
                   count(*) OVER (PARTITION BY t.symbol, b.fold_id, t.pool_idx) AS n
            FROM big_train t JOIN bounds b USING (symbol) WHERE bar_idx < greatest(2, train_end_idx - 30)) WHERE n // 3 >= 2 GROUP BY 1, 2, 3, 4, 5)""",
    "big_train",
    "bounds",
)
cte("worst", "SELECT symbol, fold_id, pool_idx, name, round(min(sharpe), 9) AS worst FROM sub_blocks GROUP BY ALL", "sub_blocks")


def pool_training(w: Walk) -> DataFrame:
    every = w.bounds.select("symbol", "fold_id").crossJoin(F.broadcast(w.bars.sparkSession.range(len(POOL)).select(F.col("id").cast("int").alias("pool_idx"))))
    return wf.training_rows_of(wf.training_streams(w.features, POOL, SETUP, w.bounds), w.bounds, every, SETUP.embargo)


KEYS = ["symbol", "fold_id", "pool_idx"]


@query("wf_subwindow_sharpe", sql(f"SELECT symbol, fold_id, name, block, {r('sharpe', 'sharpe')} FROM sub_blocks", "sub_blocks"))
def _(t: Tables) -> DataFrame:
    w = Walk(t, POOL)
    out = wf.subwindow_sharpes(pool_training(w), KEYS, "open_time", SETUP)
    return out.select("symbol", F.col("fold_id").cast("bigint").alias("fold_id"), w.name().alias("name"), F.col("block").cast("bigint").alias("block"), rd("sharpe").alias("sharpe"))


@query("wf_worst_subwindow", sql(f"SELECT symbol, fold_id, name, {r('worst', 'worst')} FROM worst", "worst"))
def _(t: Tables) -> DataFrame:
    w = Walk(t, POOL)
    out = wf.worst_subwindow(pool_training(w), KEYS, "open_time", SETUP)
    return out.select("symbol", F.col("fold_id").cast("bigint").alias("fold_id"), w.name().alias("name"), rd("worst").alias("worst"))


cte("se_worst", "SELECT * FROM (SELECT k.*, w.worst, row_number() OVER (PARTITION BY k.symbol, k.fold_id ORDER BY w.worst DESC, k.pool_idx) AS wr FROM kept k JOIN worst w USING (symbol, fold_id, pool_idx)) WHERE wr = 1", "kept", "worst")
cte("se_cheap", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol, fold_id ORDER BY round(turnover, 9), pool_idx) AS wr FROM kept) WHERE wr = 1", "kept")


@query("topk_minimax", sql(f"SELECT symbol, fold_id, name, {r('worst', 'worst')} FROM se_worst", "se_worst"))
def _(t: Tables) -> DataFrame:
    w = Walk(t, POOL)
    picks = wf.select_one_se(w.features, POOL, w.bounds, SETUP)
    return picks.select("symbol", F.col("fold_id").cast("bigint").alias("fold_id"), w.name().alias("name"), rd("worst").alias("worst"))


@query("topk_cheapest", sql(f"SELECT symbol, fold_id, name, {r('turnover', 'turnover')} FROM se_cheap", "se_cheap"))
def _(t: Tables) -> DataFrame:
    w = Walk(t, POOL)
    picks = wf.select_one_se(w.features, POOL, w.bounds, SETUP, "lowest_turnover")
    return picks.select("symbol", F.col("fold_id").cast("bigint").alias("fold_id"), w.name().alias("name"), rd("turnover").alias("turnover"))


def oos_of(pick: str, label: str) -> str:
    cte(label, f"SELECT t.symbol, t.fold_id, t.pool_idx, t.name, t.open_time AS day, t.ret, t.w, t.traded FROM big_test t JOIN {pick} p ON t.symbol = p.symbol AND t.fold_id = p.fold_id AND t.pool_idx = p.pool_idx", "big_test", pick)
    return label


oos_of("se_worst", "oos_worst")
oos_of("se_cheap", "oos_cheap")


@query("wf_select_one_se", sql(f"SELECT 'worst_subwindow' AS tie_break, symbol, {STITCH} FROM {stitch_sql('oos_worst')} UNION ALL SELECT 'lowest_turnover', symbol, {STITCH} FROM {stitch_sql('oos_cheap')}", "oos_worst", "oos_cheap"))
def _(t: Tables) -> DataFrame:
    w = Walk(t, POOL)
    parts = []
    for rule in ("worst_subwindow", "lowest_turnover"):
        picks = wf.select_one_se(w.features, POOL, w.bounds, SETUP, rule).select("symbol", "fold_id", "pool_idx")
        parts.append(w.streams(picks).withColumn("tie_break", F.lit(rule)))
    return stitched(wf.stitched_summary(parts[0].unionByName(parts[1]), ["tie_break", "symbol"]), "tie_break", "symbol")


cte(
    "robust",
    f"""SELECT w.symbol, w.fold_id, w.pool_idx, w.name, w.sharpe, w.best_se, s.sharpe AS prior_sharpe, CASE WHEN w.sharpe - s.sharpe <= 0 THEN 0.0::DOUBLE WHEN isinf(w.best_se) THEN 0.0::DOUBLE
          WHEN w.best_se <= 0 THEN 1.0::DOUBLE ELSE (w.sharpe - s.sharpe) / (w.sharpe - s.sharpe + w.best_se) END AS alpha
        FROM se_worst w JOIN big_score s ON w.symbol = s.symbol AND w.fold_id = s.fold_id AND s.pool_idx = {PRIOR}""",
    "se_worst",
    "big_score",
)


@query("wf_credibility", sql(f"SELECT symbol, fold_id, name, {r('sharpe - prior_sharpe', 'gap')}, {r('best_se', 'se')}, {r('alpha', 'alpha')} FROM robust", "robust"))
def _(t: Tables) -> DataFrame:
    w = Walk(t, POOL)
    out = wf.select_robust(w.features, POOL, w.bounds, SETUP, PRIOR)
    return out.select(
        "symbol", F.col("fold_id").cast("bigint").alias("fold_id"), w.name().alias("name"), rd(F.col("sharpe") - F.col("prior_sharpe")).alias("gap"),
        rd("best_se").alias("se"), rd("alpha").alias("alpha"),
    )


cte(
    "robust_w",
    f"""SELECT a.symbol, a.fold_id, a.slice_idx, a.open_time, a.open, a.close, a.prev_close, CASE WHEN r.alpha < 1 THEN least(1.0::DOUBLE, greatest(0.0::DOUBLE, r.alpha * a.weight + (1 - r.alpha) * p.weight)) ELSE a.weight END AS weight
        FROM big_tw a JOIN robust r ON a.symbol = r.symbol AND a.fold_id = r.fold_id AND a.pool_idx = r.pool_idx
        JOIN big_tw p ON p.symbol = a.symbol AND p.fold_id = a.fold_id AND p.slice_idx = a.slice_idx AND p.pool_idx = {PRIOR}""",
    "big_tw",
    "robust",
)
cte(
    "oos_robust",
    "SELECT symbol, fold_id, open_time AS day, ret, w, traded FROM ("
    + transition_sql("w_prev", "w", "prev_close", "open", "close", RATE, RFD, "previous", "(SELECT * FROM (SELECT *, lag(w, 1, 0.0) OVER (PARTITION BY symbol, fold_id ORDER BY open_time) AS w_prev FROM (SELECT *, CASE WHEN slice_idx >= 1 THEN weight ELSE 0.0::DOUBLE END AS w FROM robust_w)) WHERE slice_idx >= 1)")
    + ")",
    "robust_w",
)


@query("wf_select_robust", sql(f"SELECT symbol, {STITCH} FROM {stitch_sql('oos_robust')}", "oos_robust"))
def _(t: Tables) -> DataFrame:
    w = Walk(t, POOL)
    picks = wf.select_robust(w.features, POOL, w.bounds, SETUP, PRIOR).select("symbol", "fold_id", "pool_idx", "alpha", "prior_idx")
    return stitched(wf.stitched_summary(w.streams(picks)), "symbol")


@query("agg_fold_stitch", sql(f"SELECT symbol, {STITCH} FROM {stitch_sql('big_oos')}", "big_oos"))
def _(t: Tables) -> DataFrame:
    w = Walk(t, POOL)
    picks = wf.select_argmax(w.features, POOL, w.bounds, SETUP).select("symbol", "fold_id", "pool_idx")
    return stitched(wf.stitched_summary(w.streams(picks)), "symbol")


@query("agg_picks_count", sql("SELECT name, count(*) AS n FROM big_pick GROUP BY 1 ORDER BY n DESC, name LIMIT 5", "big_pick"))
def _(t: Tables) -> DataFrame:
    w = Walk(t, POOL)
    picks = wf.select_argmax(w.features, POOL, w.bounds, SETUP)
    return picks.groupBy(w.name().alias("name")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "name").limit(5)


@query(
    "wf_last_pick",
    sql(
        f"""SELECT p.symbol, max_by(p.name, p.fold_id) AS name, max(p.fold_id) AS fold_id, any_value({r('s.sharpe')}) AS oos_sharpe FROM big_pick p
            JOIN (SELECT * FROM {stitch_sql('big_oos')}) s USING (symbol) GROUP BY 1""",
        "big_pick",
        "big_oos",
    ),
)
def _(t: Tables) -> DataFrame:
    w = Walk(t, POOL)
    picks = wf.select_argmax(w.features, POOL, w.bounds, SETUP)
    last = picks.groupBy("symbol").agg(F.max_by("pool_idx", "fold_id").alias("pool_idx"), F.max("fold_id").cast("bigint").alias("fold_id"))
    sharpe = wf.stitched_summary(w.streams(picks.select("symbol", "fold_id", "pool_idx"))).select("symbol", rd("sharpe").alias("oos_sharpe"))
    return last.join(sharpe, "symbol").select("symbol", w.name().alias("name"), "fold_id", "oos_sharpe")


@query("wf_select_nested")
def _(t: Tables) -> DataFrame:
    w = Walk(t, POOL)
    picks = wf.select_nested(w.features, POOL, w.bounds, 365, 182, 220, SETUP).select("symbol", "fold_id", "pool_idx")
    return stitched(wf.stitched_summary(w.streams(picks)), "symbol")
