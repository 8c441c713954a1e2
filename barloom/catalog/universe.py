"""Universe filters, folds, candidates and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.indicators import series
from ..functions.numeric import r as rd
from ..functions.ordered import asof_split
from ..operators import folds as fo
from ..operators import pairs
from ..operators import universe as un
from ..plans import candidates as cand
from ..sources import panels, tapes
from ..sources.panels import DAY_MS, Tables
from .ingest import close_returns, day_number, snapshot_lines, timeline_of
from .registry import cte, query, r, sql

MIN_ADV = 60_000.0
TRAIN_DAYS, TEST_DAYS = 1095, 365

cte(
    "tickers",
    """SELECT CASE p_size % 12 WHEN 0 THEN 'USDC' WHEN 1 THEN 'B' || p_size::VARCHAR || 'UP' WHEN 2 THEN 'B' || p_size::VARCHAR || 'BEAR'
               ELSE 'C' || p_size::VARCHAR || left(p_type, 2) END || CASE WHEN p_type LIKE 'E%' THEN 'EUR' ELSE 'USDT' END AS symbol,
              round(sum(l_extendedprice), 2) AS quote_volume
       FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""",
)


def tickers(t: Tables) -> DataFrame:
    size = F.col("p_size").cast("string")
    base = (
        F.when(F.col("p_size") % 12 == 0, "USDC")
        .when(F.col("p_size") % 12 == 1, F.concat(F.lit("B"), size, F.lit("UP")))
        .when(F.col("p_size") % 12 == 2, F.concat(F.lit("B"), size, F.lit("BEAR")))
        .otherwise(F.concat(F.lit("C"), size, F.substring("p_type", 1, 2)))
    )
    quote = F.when(F.col("p_type").startswith("E"), "EUR").otherwise("USDT")
    named = t.part.select("p_partkey", F.concat(base, quote).alias("symbol"))
    rows = t.lineitem.select("l_partkey", "l_extendedprice").join(named, F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy("symbol").agg(F.round(F.sum("l_extendedprice"), 2).alias("quote_volume"))


VANILLA = """symbol LIKE '%USDT' AND left(symbol, length(symbol) - 4) NOT IN ('USDC','FDUSD','TUSD','DAI','BUSD','USDP','EUR','AEUR','USD1','PAXG','XUSD','USDE','BFUSD')
   AND NOT regexp_matches(left(symbol, length(symbol) - 4), '(UP|DOWN|BULL|BEAR)$')"""


@query("universe_topn", sql(f"SELECT symbol, quote_volume FROM tickers WHERE {VANILLA} ORDER BY quote_volume DESC, symbol DESC LIMIT 10", "tickers"))
def _(t: Tables) -> DataFrame:
    return un.top_symbols(tickers(t), "USDT", 10).select("symbol", "quote_volume")


@query("sort_topn_symbols", sql("SELECT symbol, quote_volume FROM tickers ORDER BY quote_volume DESC, symbol DESC LIMIT 5", "tickers"))
def _(t: Tables) -> DataFrame:
    return tickers(t).orderBy(F.desc("quote_volume"), F.desc("symbol")).limit(5)


@query("listing_dates", sql("SELECT symbol, min(open_time) AS first_bar, max(open_time) AS last_bar FROM bars GROUP BY 1", "bars"))
def _(t: Tables) -> DataFrame:
    return un.listing_dates(panels.brand_bars(t))


cte(
    "thin",
    """SELECT symbol, open_time, close, CASE WHEN (open_time // 86400000) % 7 = 0 THEN NULL ELSE quote_volume END AS quote_volume,
              CASE WHEN (open_time // 86400000) % 7 = 0 AND symbol LIKE '%3' THEN NULL ELSE volume END AS volume FROM bars""",
    "bars",
)
cte(
    "medians",
    """SELECT symbol, CASE WHEN NOT bool_or(v IS NULL) THEN median(v) END AS median_turnover FROM (
         SELECT symbol, coalesce(abs(quote_volume), abs(volume * close)) AS v, row_number() OVER (PARTITION BY symbol ORDER BY open_time DESC) AS rn FROM thin)
       WHERE rn <= 30 GROUP BY 1""",
    "thin",
)


def thin_bars(t: Tables) -> DataFrame:
    """Bars where some days lack the quote volume and, for symbols ending in 3, the base volume too."""
    hole = day_number() % 7 == 0
    return panels.stored_brand_bars(t).select(
        "symbol", "open_time", "close",
        F.when(~hole, F.col("quote_volume")).alias("quote_volume"),
        F.when(~(hole & F.col("symbol").endswith("3")), F.col("volume")).alias("volume"),
    )


@query("median_turnover", sql("SELECT symbol, round(median_turnover, 4) + 0.0 AS median_turnover FROM medians", "medians"))
def _(t: Tables) -> DataFrame:
    return un.median_turnover(thin_bars(t)).withColumn("median_turnover", rd("median_turnover", 4))


@query(
    "liquidity_filter",
    sql(
        """SELECT symbol, coalesce(median_turnover >= 60000, true) AS passes, CASE WHEN median_turnover IS NULL THEN 'no volume data'
             WHEN median_turnover < 60000 THEN 'below floor' ELSE 'ok' END AS reason FROM medians""",
        "medians",
    ),
)
def _(t: Tables) -> DataFrame:
    reason = un.liquidity_reason(F.col("median_turnover"), MIN_ADV)
    return un.median_turnover(thin_bars(t)).select("symbol", (reason != "below floor").alias("passes"), reason.alias("reason"))


cte(
    "span_days",
    """SELECT s.symbol, t.day FROM timeline t JOIN (SELECT symbol, min(open_time) + 90 * 86400000::BIGINT AS f, max(open_time) + 2 * 86400000::BIGINT AS l FROM thin GROUP BY 1) s
       ON t.day BETWEEN s.f AND s.l""",
    "timeline",
    "thin",
)
cte(
    "adv_at",
    """SELECT d.symbol, d.day, k.adv FROM span_days d ASOF LEFT JOIN (SELECT symbol, open_time, avg(quote_volume) OVER (PARTITION BY symbol ORDER BY open_time
              ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS adv FROM thin WHERE quote_volume IS NOT NULL) k ON d.symbol = k.symbol AND d.day > k.open_time""",
    "span_days",
    "thin",
)


@query("trailing_adv", sql("SELECT symbol, day, round(adv, 4) + 0.0 AS adv FROM adv_at", "adv_at"))
def _(t: Tables) -> DataFrame:
    thin = thin_bars(t)
    spans = un.listing_dates(thin)
    bound = F.col("day").between(F.col("first_bar") + 90 * DAY_MS, F.col("last_bar") + 2 * DAY_MS)
    days = spans.join(F.broadcast(timeline_of(thin)), bound).select("symbol", "day")
    return un.trailing_adv(thin, days).withColumn("adv", rd("adv", 4))


cte("eligible", f"SELECT day, symbol FROM adv_at WHERE adv IS NULL OR adv >= {MIN_ADV}", "adv_at")


def eligibility(t: Tables) -> DataFrame:
    thin = thin_bars(t)
    return t.keep("eligible", lambda: un.pit_eligibility(thin, timeline_of(thin), 90, MIN_ADV))


@query("pit_eligibility", sql("SELECT day, symbol FROM eligible", "eligible"))
def _(t: Tables) -> DataFrame:
    return eligibility(t)


cte("snap_members", "SELECT DISTINCT open_time AS day, symbol FROM bars WHERE (open_time // 86400000) % 4 <> 2", "bars")


def snapshot_table(t: Tables) -> DataFrame:
    """(day, symbol) observed in the snapshot log; every fourth day was never logged."""
    parsed = tapes.parse_tape(snapshot_lines(t), tapes.SNAPSHOT_SCHEMA, ["line_id"])
    rows = tapes.snapshot_members(parsed).select(F.to_date("date").alias("d"), F.explode("symbols").alias("symbol"))
    day = F.unix_date("d").cast("bigint") * F.lit(DAY_MS)
    return rows.select(day.alias("day"), "symbol").where(F.floor(F.col("day") / DAY_MS) % 4 != 2)


@query("pit_from_snapshots", sql("SELECT day, symbol FROM snap_members", "snap_members"))
def _(t: Tables) -> DataFrame:
    return un.pit_from_snapshots(snapshot_table(t), timeline_of(panels.brand_bars(t)))


@query(
    "snapshot_coverage",
    sql(
        """SELECT count(*) AS days_requested, count(s.day) AS days_covered, count(*) - count(s.day) AS days_missing,
             round(count(s.day) / count(*)::DOUBLE, 6) + 0.0 AS fraction_covered, min(CASE WHEN s.day IS NULL THEN t.day END) AS first_missing
           FROM timeline t LEFT JOIN (SELECT DISTINCT day FROM snap_members) s ON t.day = s.day""",
        "snap_members",
        "timeline",
    ),
)
def _(t: Tables) -> DataFrame:
    out = un.snapshot_coverage(snapshot_table(t), timeline_of(panels.brand_bars(t)))
    return out.withColumn("fraction_covered", rd("fraction_covered"))


@query("membership_violations", sql("SELECT day, symbol FROM rets ANTI JOIN eligible USING (day, symbol)", "rets", "eligible"))
def _(t: Tables) -> DataFrame:
    contributors = close_returns(panels.brand_bars(t)).select("day", "symbol")
    return un.membership_violations(contributors, eligibility(t))


@query(
    "history_screen",
    sql(
        """SELECT symbol, n_bars, last_bar, reason, reason = 'ok' AS admitted FROM (SELECT symbol, count(*) AS n_bars, max(open_time) AS last_bar,
             CASE WHEN count(*) < 1640 THEN 'short history' WHEN epoch_ms(TIMESTAMP '2001-11-05') - max(open_time) > 3 * 86400000::BIGINT THEN 'stale' ELSE 'ok' END AS reason
           FROM bars GROUP BY 1)""",
        "bars",
    ),
)
def _(t: Tables) -> DataFrame:
    return un.history_screen(panels.brand_bars(t), TRAIN_DAYS + TEST_DAYS + 180, 1004918400000, 3.0)


@query(
    "window_slice",
    sql("SELECT symbol, open_time, close FROM segbars WHERE open_time BETWEEN epoch_ms(TIMESTAMP '1997-01-01') AND epoch_ms(TIMESTAMP '1999-12-31')", "segbars"),
)
def _(t: Tables) -> DataFrame:
    return panels.segment_bars(t).where(F.col("open_time").between(852076800000, 946598400000)).select("symbol", "open_time", "close")


cte(
    "folds",
    """SELECT k AS fold_id, train_end_ms, (SELECT min(day) FROM timeline WHERE day >= train_end_ms + 365 * 86400000::BIGINT) AS test_end_ms FROM (
         SELECT k, (SELECT min(day) FROM timeline WHERE day >= (SELECT min(day) FROM timeline) + (k * 365 + 1095) * 86400000::BIGINT) AS train_end_ms
         FROM range(0, 40) AS g(k)) WHERE train_end_ms IS NOT NULL
         AND (SELECT min(day) FROM timeline WHERE day >= train_end_ms + 365 * 86400000::BIGINT) IS NOT NULL""",
    "timeline",
)


def calendar_folds(t: Tables) -> DataFrame:
    """Folds on the shared brand calendar (a handful of rows)."""
    days = timeline_of(panels.stored_brand_bars(t))
    return t.keep("folds", lambda: fo.expanding_folds(days, TRAIN_DAYS, TEST_DAYS))


@query("fold_generator", sql("SELECT fold_id, train_end_ms, test_end_ms FROM folds", "folds"))
def _(t: Tables) -> DataFrame:
    return calendar_folds(t).withColumn("fold_id", F.col("fold_id").cast("bigint"))


@query(
    "purged_fold_generator",
    sql(
        """SELECT symbol, fold_id, train_end_ms, test_start_ms, test_end_ms, n_test FROM (
             SELECT *, min((n_test >= 30)::INT) OVER (PARTITION BY symbol ORDER BY fold_id) AS ok FROM (
               SELECT *, (SELECT count(*) FROM bars b WHERE b.symbol = x.symbol AND b.open_time >= test_start_ms AND (test_end_ms IS NULL OR b.open_time < test_end_ms)) AS n_test FROM (
                 SELECT *, (SELECT min(open_time) FROM bars b WHERE b.symbol = y.symbol AND b.open_time >= test_start_ms + 182 * 86400000::BIGINT) AS test_end_ms FROM (
                   SELECT *, (SELECT min(open_time) FROM bars b WHERE b.symbol = z.symbol AND b.open_time >= train_end_ms + 220 * 86400000::BIGINT) AS test_start_ms FROM (
                     SELECT s.symbol, k AS fold_id, (SELECT min(open_time) FROM bars b WHERE b.symbol = s.symbol AND b.open_time >= s.t0 + (k * 182 + 365) * 86400000::BIGINT) AS train_end_ms
                     FROM (SELECT symbol, min(open_time) AS t0 FROM bars GROUP BY 1) s, range(0, 60) AS g(k)) z
                   WHERE train_end_ms IS NOT NULL) y WHERE test_start_ms IS NOT NULL) x)) WHERE ok = 1""",
        "bars",
    ),
)
def _(t: Tables) -> DataFrame:
    days = panels.brand_bars(t).select("symbol", F.col("open_time").alias("day"))
    return fo.purged_folds(days, 365, 182, 220, ["symbol"]).withColumn("fold_id", F.col("fold_id").cast("bigint"))


def _pool_sql(pool, columns=("name",)) -> str:
    rows = ", ".join(f"({i}, '{s.name}', '{s.family}', {s.warmup})" for i, s in enumerate(pool))
    return f"(VALUES {rows}) AS p(pool_idx, name, family, warmup)"


@query(
    "pool_version",
    sql(
        "SELECT family, count(*) AS n, substr(sha256(string_agg(name, chr(10) ORDER BY name)), 1, 16) AS version, n_symbols FROM "
        + _pool_sql(cand.candidate_pool(True))
        + ", (SELECT count(DISTINCT symbol) AS n_symbols FROM bars) GROUP BY family, n_symbols",
        "bars",
    ),
)
def _(t: Tables) -> DataFrame:
    pool = cand.candidates_table(t.spark, cand.candidate_pool(True))
    n = panels.brand_bars(t).agg(F.countDistinct("symbol").alias("n_symbols"))
    digest = F.substring(F.sha2(F.array_join(F.array_sort(F.collect_list("name")), "\n"), 256), 1, 16)
    return pool.groupBy("family").agg(F.count(F.lit(1)).alias("n"), digest.alias("version")).join(F.broadcast(n))


@query(
    "candidate_grid",
    sql(
        "SELECT symbol, pool_idx, name, family, warmup, greatest(0, n_bars - warmup) AS usable_bars FROM "
        + _pool_sql(cand.candidate_pool(True))
        + ", (SELECT symbol, count(*) AS n_bars FROM bars GROUP BY 1)",
        "bars",
    ),
)
def _(t: Tables) -> DataFrame:
    pool = cand.candidates_table(t.spark, cand.candidate_pool(True)).drop("members")
    bars = panels.brand_bars(t).groupBy("symbol").agg(F.count(F.lit(1)).alias("n_bars"))
    usable = F.greatest(F.lit(0), F.col("n_bars") - F.col("warmup")).alias("usable_bars")
    return bars.join(F.broadcast(pool)).select("symbol", "pool_idx", "name", "family", "warmup", usable)


# ---------------------------------------------------------------- joins

cte(
    "segrets",
    """SELECT symbol, open_time AS day, close / prev - 1 AS ret FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY open_time) AS prev FROM segbars)
       WHERE prev IS NOT NULL""",
    "segbars",
)


@query(
    "join_equi_days",
    sql(
        f"""SELECT b.symbol, count(*) AS n_days, {r('avg(b.ret - s.ret)', 'mean_gap', 8)}, {r('corr(b.ret, s.ret)', 'rho')}
            FROM rets b JOIN segrets s ON b.day = s.day AND s.symbol = 'BUILDING' GROUP BY 1""",
        "rets",
        "segrets",
    ),
)
def _(t: Tables) -> DataFrame:
    a = close_returns(panels.brand_bars(t))
    m = close_returns(panels.segment_bars(t)).where("symbol = 'BUILDING'").select("day", F.col("ret").alias("bench"))
    joined = a.join(m, "day")
    return joined.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_days"), rd(F.avg(F.col("ret") - F.col("bench")), 8).alias("mean_gap"), rd(F.corr("ret", "bench")).alias("rho")
    )


cte("regrets", "SELECT symbol AS series_id, open_time AS day, close / prev - 1 AS ret FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY open_time) AS prev FROM segbars) WHERE prev IS NOT NULL", "segbars")
cte("common", "SELECT * FROM regrets WHERE day IN (SELECT day FROM regrets GROUP BY 1 HAVING count(DISTINCT series_id) = (SELECT count(DISTINCT series_id) FROM regrets))", "regrets")


def segment_streams(t: Tables) -> DataFrame:
    return close_returns(panels.segment_bars(t)).withColumnRenamed("symbol", "series_id")


@query("join_common_days", sql(f"SELECT series_id, day, {r('ret', 'ret', 9)} FROM common", "common"))
def _(t: Tables) -> DataFrame:
    return pairs.common_days(segment_streams(t)).select("series_id", "day", rd("ret", 9).alias("ret"))


@query("join_semi_mask", sql(f"SELECT symbol, count(*) AS n, {r('sum(ret)', 'total')} FROM rets SEMI JOIN eligible USING (day, symbol) GROUP BY 1", "rets", "eligible"))
def _(t: Tables) -> DataFrame:
    masked = close_returns(panels.brand_bars(t)).join(eligibility(t), ["day", "symbol"], "left_semi")
    return masked.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), rd(F.sum("ret")).alias("total"))


@query("join_anti_missing", sql("SELECT day FROM timeline ANTI JOIN snap_members USING (day)", "timeline", "snap_members"))
def _(t: Tables) -> DataFrame:
    return timeline_of(panels.brand_bars(t)).join(snapshot_table(t), "day", "left_anti")


cte(
    "bounds",
    """SELECT * FROM (SELECT b.symbol, f.fold_id, f.train_end_ms, f.test_end_ms, count(*) FILTER (open_time < train_end_ms) AS train_end_idx,
              count(*) FILTER (open_time < test_end_ms) AS test_end_idx, count(*) AS n_bars FROM bars b, folds f GROUP BY ALL)
       WHERE train_end_idx >= 2 AND train_end_idx < n_bars AND test_end_idx > train_end_idx""",
    "bars",
    "folds",
)


@query(
    "join_fold_interval",
    sql(
        """SELECT i.symbol, i.fold_id, 'select' AS part, count(*) AS n, min(open_time) AS first_day, max(open_time) AS last_day
           FROM (SELECT i.*, b.fold_id, b.train_end_idx FROM idx i JOIN bounds b USING (symbol)) i WHERE bar_idx < greatest(2, train_end_idx - 30) GROUP BY 1, 2
           UNION ALL
           SELECT i.symbol, b.fold_id, 'test', count(*), min(open_time), max(open_time)
           FROM idx i JOIN bounds b USING (symbol) WHERE bar_idx BETWEEN train_end_idx AND test_end_idx GROUP BY 1, 2""",
        "idx",
        "bounds",
    ),
)
def _(t: Tables) -> DataFrame:
    s = series(panels.stored_brand_bars(t))
    bounds = fo.fold_train_rows(s, calendar_folds(t))
    tagged = fo.selection_rows(s, bounds, 30).select("symbol", "fold_id", F.lit("select").alias("part"), "open_time").unionByName(
        fo.test_slices(s, bounds).select("symbol", "fold_id", F.lit("test").alias("part"), "open_time")
    )
    return tagged.groupBy("symbol", F.col("fold_id").cast("bigint").alias("fold_id"), "part").agg(
        F.count(F.lit(1)).alias("n"), F.min("open_time").alias("first_day"), F.max("open_time").alias("last_day")
    )


@query(
    "join_asof_backward",
    sql(
        """SELECT d.symbol, d.day, a.close AS last_close, b.close AS close_180 FROM (SELECT s.symbol, t.day FROM timeline t, (SELECT DISTINCT symbol FROM segbars) s) d
           ASOF LEFT JOIN segbars a ON d.symbol = a.symbol AND d.day > a.open_time
           ASOF LEFT JOIN segbars b ON d.symbol = b.symbol AND d.day - 180 * 86400000::BIGINT > b.open_time""",
        "timeline",
        "segbars",
    ),
)
def _(t: Tables) -> DataFrame:
    seg = panels.segment_bars(t)
    prints = seg.select("symbol", F.col("open_time").alias("day"), F.col("close").alias("last_close"))
    grid = seg.select("symbol").distinct().join(F.broadcast(timeline_of(panels.brand_bars(t))))
    now = asof_split(grid, prints, ["symbol"], "day", ["last_close"], un.YEAR_MS)
    shifted = prints.select("symbol", (F.col("day") + 180 * DAY_MS).alias("day"), F.col("last_close").alias("close_180"))
    return asof_split(now, shifted, ["symbol"], "day", ["close_180"], un.YEAR_MS)


PAIR_SQL = f"""SELECT x.series_id AS a, y.series_id AS b, count(*) AS n, {r("coalesce(CASE WHEN isfinite(corr(x.ret, y.ret)) THEN corr(x.ret, y.ret) END, 0)", 'rho')}
   FROM common x JOIN common y ON x.day = y.day AND x.series_id < y.series_id GROUP BY 1, 2"""


@query("join_pairwise_self", sql(PAIR_SQL, "common"))
def _(t: Tables) -> DataFrame:
    return pairs.pairwise_corr(pairs.common_days(segment_streams(t)), tiles=2).withColumn("rho", rd("rho"))


@query(
    "join_cross_params",
    sql(
        f"""SELECT symbol, level_bps, latency, count(*) AS n, {r('sum(ret - level_bps / 10000.0::DOUBLE * (latency + 1))', 'net', 6)}
            FROM rets, (VALUES (5), (10), (20), (50), (100)) c(level_bps), (VALUES (0), (1), (2)) l(latency) GROUP BY 1, 2, 3""",
        "rets",
    ),
)
def _(t: Tables) -> DataFrame:
    levels = t.spark.createDataFrame([(b, lag) for b in (5, 10, 20, 50, 100) for lag in (0, 1, 2)], "level_bps int, latency int")
    grid = close_returns(panels.brand_bars(t)).join(F.broadcast(levels))  # 15 parameter rows
    net = F.col("ret") - F.col("level_bps") / F.lit(10000.0) * (F.col("latency") + 1)
    return grid.groupBy("symbol", "level_bps", "latency").agg(F.count(F.lit(1)).alias("n"), rd(F.sum(net)).alias("net"))
