"""Performance measures of return streams (keys, day, ret)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .numeric import floor_index


def _stream(keys: Sequence[str], order: str):
    return Window.partitionBy(*keys).orderBy(order)


def with_equity(returns: DataFrame, keys: Sequence[str], order: str = "day") -> DataFrame:
    """Add equity (starting at 1.0), its running peak and the drawdown.

    Compounding uses products: a return of -1 stays a total loss.
    """
    upto = _stream(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    grown = returns.withColumn("equity", F.product(F.col("ret") + 1.0).over(upto))
    peaked = grown.withColumn("peak", F.greatest(F.lit(1.0), F.max("equity").over(upto)))
    return peaked.withColumn("drawdown", F.least(F.lit(0.0), F.col("equity") / F.col("peak") - 1.0))


def trailing_cum_return(n: int, keys: Sequence[str] = ("symbol",), order: str = "day") -> Column:
    """Compounded return of the stream's previous n rows; NULL until there are n."""
    frame = _stream(keys, order).rowsBetween(-n, -1)
    return F.when(F.count("ret").over(frame) >= n, F.product(F.col("ret") + 1.0).over(frame) - 1.0)


def horizon_return(h: int, keys: Sequence[str], order: str = "day") -> Column:
    """Compounded return of the next h rows including this one; NULL near the end."""
    frame = _stream(keys, order).rowsBetween(0, h - 1)
    return F.when(F.count("ret").over(frame) >= h, F.product(F.col("ret") + 1.0).over(frame) - 1.0)


# ------------------------------------------------------------ column formulas


def cagr(final: Column, days: Column) -> Column:
    grown = F.pow(final, F.lit(365.0) / days) - 1.0
    return F.when(days <= 0, F.lit(0.0)).when(final == 0, F.lit(-1.0)).otherwise(grown)


def volatility(sd: Column, n: Column, ppy: Column | int) -> Column:
    return F.when(n < 2, F.lit(0.0)).otherwise(sd * F.sqrt(F.lit(ppy) if isinstance(ppy, int) else ppy))


def sharpe(mean: Column, sd: Column, n: Column, ppy: int = 365, rf: float = 0.0) -> Column:
    return F.when((n < 2) | (sd == 0), F.lit(0.0)).otherwise((mean - rf / ppy) / sd * math.sqrt(ppy))


def sortino(mean: Column, downside: Column, n: Column, ppy: int = 365, rf: float = 0.0) -> Column:
    return F.when((n < 2) | (downside == 0), F.lit(0.0)).otherwise((mean - rf / ppy) * ppy / downside)


def calmar(cagr_value: Column, mdd: Column) -> Column:
    return F.when(mdd >= 0, F.lit(0.0)).otherwise(cagr_value / F.abs(mdd))


# ------------------------------------------------------------ aggregates


def downside(ppy: int = 365, rf: float = 0.0, ret: str = "ret") -> Column:
    short = F.least(F.col(ret) - rf / ppy, F.lit(0.0))
    return F.coalesce(F.sqrt(F.avg(short * short)) * math.sqrt(ppy), F.lit(0.0))


def skew(ret: str = "ret") -> Column:
    n, value = F.count(ret), F.skewness(ret)
    return F.when((n < 3) | value.isNull() | F.isnan(value), F.lit(0.0)).otherwise(value)


def raw_kurtosis(ret: str = "ret") -> Column:
    n, value = F.count(ret), F.kurtosis(ret) + 3.0
    return F.when((n < 4) | value.isNull() | F.isnan(value), F.lit(3.0)).otherwise(value)


def tail(returns: DataFrame, keys: Sequence[str], alpha: float = 0.95) -> DataFrame:
    """var (order statistic at int((1-alpha) n)) and es (mean of the lowest max(1, int((1-alpha) n)))."""
    n = F.count("ret").over(Window.partitionBy(*keys))
    rank = F.row_number().over(_stream(keys, "ret"))
    ranked = returns.select(*keys, "ret", n.alias("_n"), rank.alias("_rk"))
    at = floor_index(F.col("_n"), 1 - alpha) + 1
    low = F.greatest(F.lit(1), F.floor(F.lit(1 - alpha) * F.col("_n")))
    return ranked.groupBy(*keys).agg(
        F.max(F.when(F.col("_rk") == at, F.col("ret"))).alias("var95"), F.avg(F.when(F.col("_rk") <= low, F.col("ret"))).alias("es95")
    )


def summary(
    returns: DataFrame,
    keys: Sequence[str],
    ppy: int = 365,
    rf: float = 0.0,
    days: Column | None = None,
    order: str = "day",
    extra: dict[str, Column] | None = None,
) -> DataFrame:
    """One row per stream: n, final, cagr, vol, sharpe, sortino, calmar, max_drawdown.

    `days` is an aggregate expression; the default counts rows as days.
    """
    n = F.count("ret")
    grouped = with_equity(returns, keys, order).groupBy(*keys).agg(
        n.alias("n"),
        F.max_by("equity", order).alias("final"),
        F.avg("ret").alias("_mean"),
        F.stddev_samp("ret").alias("_sd"),
        F.min("drawdown").alias("max_drawdown"),
        downside(ppy, rf).alias("_down"),
        (days if days is not None else n).cast("double").alias("_days"),
        *[c.alias(k) for k, c in (extra or {}).items()],
    )
    measured = grouped.withColumns(
        {
            "cagr": cagr(F.col("final"), F.col("_days")),
            "vol": volatility(F.col("_sd"), F.col("n"), ppy),
            "sharpe": sharpe(F.col("_mean"), F.col("_sd"), F.col("n"), ppy, rf),
            "sortino": sortino(F.col("_mean"), F.col("_down"), F.col("n"), ppy, rf),
        }
    )
    return measured.withColumn("calmar", calmar(F.col("cagr"), F.col("max_drawdown"))).drop("_mean", "_sd", "_down", "_days")
