"""Portfolio construction queries over the masked brand panel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import costs
from ..functions.numeric import r as rd
from ..operators import portfolio as pt
from ..operators.cleaning import align_to_timeline
from ..sources import panels
from ..sources.panels import Tables
from .ingest import close_returns, timeline_of
from .registry import cte, query, r, sql
from .signals import OVERLAY
from .universe import eligibility

cte("masked", "SELECT symbol, day, ret FROM aligned SEMI JOIN eligible USING (day, symbol)", "aligned", "eligible")
cte("denoms", "SELECT t.day, greatest(1, count(e.symbol)) AS denom FROM timeline t LEFT JOIN eligible e ON t.day = e.day GROUP BY 1", "timeline", "eligible")


def masked_inputs(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(masked streams, timeline, denominators) of the brand panel."""
    bars = panels.stored_brand_bars(t)
    timeline = timeline_of(bars)
    eligible = eligibility(t)
    streams = align_to_timeline(close_returns(bars), timeline, ["symbol"])
    masked = t.keep("masked", lambda: pt.mask(streams, eligible))
    return masked, timeline, pt.denominators(timeline, eligible)


def day_rows(df: DataFrame, digits: int = 8) -> DataFrame:
    return df.select("day", rd("ret", digits).alias("ret"))


cte("pf_equal", "SELECT d.day, coalesce(sum(m.ret), 0) / max(d.denom) AS ret FROM denoms d LEFT JOIN masked m ON d.day = m.day GROUP BY 1", "denoms", "masked")


@query("pf_equal", sql(f"SELECT day, {r('ret', 'ret', 8)} FROM pf_equal", "pf_equal"))
def _(t: Tables) -> DataFrame:
    masked, _timeline, denoms = masked_inputs(t)
    return day_rows(pt.equal_weight(masked, denoms))


@query(
    "pf_legacy_denominator",
    sql(f"SELECT t.day, {r('coalesce(sum(a.ret), 0) / (SELECT count(DISTINCT symbol) FROM bars)::DOUBLE', 'ret', 8)} FROM timeline t LEFT JOIN aligned a ON t.day = a.day GROUP BY 1", "timeline", "aligned", "bars"),
)
def _(t: Tables) -> DataFrame:
    bars = panels.stored_brand_bars(t)
    timeline = timeline_of(bars)
    streams = align_to_timeline(close_returns(bars), timeline, ["symbol"])
    return day_rows(pt.equal_weight(streams, pt.denominators(timeline, None, bars.select("symbol").distinct().count())))


cte(
    "iv_raw",
    """SELECT *, CASE WHEN hist_n < 2 THEN 1.0::DOUBLE ELSE 1.0::DOUBLE / greatest(sd * sqrt(365.0::DOUBLE), 1e-6::DOUBLE) END AS raw, max(hist_n) OVER (PARTITION BY day) >= 20 AS ready,
              count(*) OVER (PARTITION BY day) AS present
       FROM (SELECT *, count(ret) OVER w AS hist_n, stddev_samp(ret) OVER w AS sd FROM masked WINDOW w AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))""",
    "masked",
)
# Water-filling as repeated clip rounds (the cap of 2/present can bind for at most half the names; 14 rounds settle these panels).
cte(
    "iv_fill",
    """SELECT day, symbol, 0 AS round, raw, 2.0::DOUBLE / present AS cap, false AS capped FROM iv_raw WHERE ready
       UNION ALL -- recursive
       SELECT day, symbol, round + 1, raw, cap, capped OR mass * raw / free > cap + 1e-15::DOUBLE FROM (
         SELECT *, 1 - cap * count(*) FILTER (capped) OVER (PARTITION BY day) AS mass, sum(CASE WHEN capped THEN 0 ELSE raw END) OVER (PARTITION BY day) AS free FROM iv_fill WHERE round < 14)""",
    "iv_raw",
)
cte(
    "iv_w",
    """SELECT i.day, i.symbol, i.ret, i.present, CASE WHEN NOT i.ready THEN 1.0::DOUBLE / i.present ELSE f.w / sum(f.w) OVER (PARTITION BY i.day) END AS weight FROM iv_raw i LEFT JOIN (
         SELECT day, symbol, CASE WHEN capped THEN cap ELSE (1 - cap * count(*) FILTER (capped) OVER (PARTITION BY day)) * raw / sum(CASE WHEN capped THEN 0 ELSE raw END) OVER (PARTITION BY day) END AS w
         FROM iv_fill WHERE round = 14) f USING (day, symbol)""",
    "iv_raw",
    "iv_fill",
)


@query("pf_cap_waterfill", sql(f"SELECT day, symbol, {r('weight', 'weight')} FROM iv_w", "iv_w"))
def _(t: Tables) -> DataFrame:
    masked, _timeline, _denoms = masked_inputs(t)
    return pt.inverse_vol_weights(masked).select("day", "symbol", rd("weight").alias("weight"))


COMBINE = """SELECT d.day, coalesce(sum(w.weight * w.ret), 0) * count(w.symbol) / max(d.denom) AS ret FROM denoms d LEFT JOIN {w} w ON d.day = w.day GROUP BY 1"""
cte("pf_iv", COMBINE.format(w="iv_w"), "denoms", "iv_w")


@query("pf_invvol", sql(f"SELECT day, {r('ret', 'ret', 8)} FROM pf_iv", "pf_iv"))
def _(t: Tables) -> DataFrame:
    masked, _timeline, denoms = masked_inputs(t)
    return day_rows(pt.inverse_vol(masked, denoms))


cte(
    "tilt_w",
    """SELECT day, symbol, ret, CASE WHEN ranked = present AND present >= 2 THEN weight * mult / sum(weight * mult) OVER (PARTITION BY day) ELSE weight END AS weight
       FROM (SELECT *, (0.5::DOUBLE + (rk - 1)::DOUBLE / nullif(present - 1, 0)) AS mult FROM (SELECT *, count(mom) OVER (PARTITION BY day) AS ranked, row_number() OVER (PARTITION BY day ORDER BY mom NULLS LAST, symbol) AS rk
         FROM (SELECT *, CASE WHEN count(ret) OVER w >= 90 THEN round(product(1 + ret) OVER w - 1, 12) END AS mom FROM iv_w WINDOW w AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 90 PRECEDING AND 1 PRECEDING))))""",
    "iv_w",
)


@query("pf_tilt", sql(f"SELECT day, symbol, {r('weight', 'weight')} FROM tilt_w", "tilt_w"))
def _(t: Tables) -> DataFrame:
    masked, _timeline, _denoms = masked_inputs(t)
    return pt.tilt(pt.inverse_vol_weights(masked)).select("day", "symbol", rd("weight").alias("weight"))


cte(
    "corr_z",
    """SELECT day, symbol, unnest(h) AS x, unnest(range(0, 60)) AS pos FROM (SELECT day, symbol, list(ret) OVER w AS h, count(ret) OVER w AS n, var_pop(ret) OVER w AS v FROM masked
         WINDOW w AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)) WHERE n >= 60 AND v > 0""",
    "masked",
)
cte(
    "avg_corr",
    "SELECT day, avg(rho) AS avg_corr FROM (SELECT a.day, a.symbol, b.symbol AS other, corr(a.x, b.x) AS rho FROM corr_z a JOIN corr_z b ON a.day = b.day AND a.pos = b.pos AND a.symbol < b.symbol GROUP BY 1, 2, 3) GROUP BY 1",
    "corr_z",
)


@query("pf_avg_corr", sql(f"SELECT day, {r('avg_corr', 'avg_corr')} FROM avg_corr", "avg_corr"))
def _(t: Tables) -> DataFrame:
    masked, _timeline, _denoms = masked_inputs(t)
    return pt.average_correlation(masked).select("day", rd("avg_corr").alias("avg_corr"))


@query("pf_crisis", sql(f"SELECT t.day, {r('avg_corr', 'avg_corr')}, CASE WHEN avg_corr > 0.6::DOUBLE THEN 0.6::DOUBLE ELSE 1.0::DOUBLE END AS factor FROM timeline t LEFT JOIN avg_corr USING (day)", "timeline", "avg_corr"))
def _(t: Tables) -> DataFrame:
    masked, timeline, _denoms = masked_inputs(t)
    joined = timeline.join(pt.average_correlation(masked), "day", "left")
    return joined.select("day", rd("avg_corr").alias("avg_corr"), pt.crisis_exposure(F.col("avg_corr")).alias("factor"))


cte(
    "pf_rule",
    """SELECT d.day, coalesce(sum(w.weight * w.ret), 0) * count(w.symbol) / max(d.denom) * max(CASE WHEN c.avg_corr > 0.6::DOUBLE THEN 0.6::DOUBLE ELSE 1.0::DOUBLE END) AS ret
       FROM denoms d LEFT JOIN tilt_w w ON d.day = w.day LEFT JOIN avg_corr c ON d.day = c.day GROUP BY 1""",
    "denoms",
    "tilt_w",
    "avg_corr",
)


@query("pf_rule", sql(f"SELECT day, {r('ret', 'ret', 8)} FROM pf_rule", "pf_rule"))
def _(t: Tables) -> DataFrame:
    masked, _timeline, denoms = masked_inputs(t)
    return day_rows(pt.rule(masked, denoms))


cte("book", "SELECT day, symbol, weight FROM iv_w WHERE (day // 86400000 + ascii(right(symbol, 1))) % 6 <> 0", "iv_w")


@query(
    "pf_weight_turnover",
    sql(
        f"""SELECT day, {r('turnover', 'turnover')}, turnover > 0.01 AS event FROM (SELECT day, sum(abs(w - pw)) / 2 AS turnover FROM (
              SELECT g.day, g.symbol, coalesce(b.weight, 0) AS w, lag(coalesce(b.weight, 0), 1, 0) OVER (PARTITION BY g.symbol ORDER BY g.day) AS pw
              FROM (SELECT day, symbol FROM timeline, (SELECT DISTINCT symbol FROM bars)) g LEFT JOIN book b USING (day, symbol)) GROUP BY 1)""",
        "timeline",
        "book",
        "bars",
    ),
)
def _(t: Tables) -> DataFrame:
    masked, timeline, _denoms = masked_inputs(t)
    gone = (F.floor(F.col("day") / panels.DAY_MS) + F.ascii(F.substring("symbol", -1, 1))) % 6 == 0
    book = pt.inverse_vol_weights(masked).where(~gone).select("day", "symbol", "weight")
    return pt.weight_turnover(book, timeline).select("day", rd("turnover").alias("turnover"), (F.col("turnover") > 0.01).alias("event"))


cte(
    "throttled",
    """SELECT variant, i, ret * CASE WHEN false THEN 0.5 ELSE 1.0 END AS ret, false AS flag, 1 + ret AS equity, greatest(1.0::DOUBLE, 1 + ret) AS peak FROM thr_in WHERE i = 1
       UNION ALL -- recursive
       SELECT variant, i, o, flag, equity * (1 + o), greatest(peak, equity * (1 + o)) FROM (
         SELECT *, CASE WHEN flag THEN b * 0.5::DOUBLE ELSE b END AS o FROM (
           SELECT s.variant, s.i, s.ret AS b, e.equity, e.peak, CASE WHEN e.flag THEN e.equity / e.peak - 1 <= -0.05::DOUBLE ELSE e.equity / e.peak - 1 <= -0.10::DOUBLE END AS flag
           FROM throttled e JOIN thr_in s ON s.variant = e.variant AND s.i = e.i + 1))""",
    "thr_in",
)
cte(
    "thr_in",
    """SELECT variant, day, ret, row_number() OVER (PARTITION BY variant ORDER BY day) AS i FROM (SELECT 'equal' AS variant, day, ret FROM pf_equal UNION ALL SELECT 'invvol', day, ret FROM pf_iv
       UNION ALL SELECT symbol, day, ret FROM aligned)""",
    "pf_equal",
    "pf_iv",
    "aligned",
)


@query("dd_throttle", sql(f"SELECT variant, day, {r('t.ret', 'ret', 8)}, flag AS throttled FROM throttled t JOIN thr_in USING (variant, i)", "throttled", "thr_in"))
def _(t: Tables) -> DataFrame:
    masked, timeline, denoms = masked_inputs(t)
    streams = align_to_timeline(close_returns(panels.stored_brand_bars(t)), timeline, ["symbol"]).withColumnRenamed("symbol", "variant")
    both = pt.equal_weight(masked, denoms).withColumn("variant", F.lit("equal")).unionByName(
        pt.inverse_vol(masked, denoms).select("day", "ret").withColumn("variant", F.lit("invvol"))
    ).unionByName(streams)
    return pt.drawdown_throttle(both).select("variant", "day", rd("ret", 8).alias("ret"), "throttled")
