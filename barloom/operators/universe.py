"""Point-in-time universe construction and liquidity screens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordered import asof_split
from ..sources.panels import DAY_MS

# Bases that track fiat or are not plain coins, and leveraged-token suffixes.
NON_VANILLA = ["USDC", "FDUSD", "TUSD", "DAI", "BUSD", "USDP", "EUR", "AEUR", "USD1", "PAXG", "XUSD", "USDE", "BFUSD"]
LEVERAGED = ["UP", "DOWN", "BULL", "BEAR"]
YEAR_MS = 366 * DAY_MS


def vanilla_symbols(tickers: DataFrame, quote: str) -> DataFrame:
    """Symbols ending in the quote currency whose base is neither stable nor leveraged."""
    base = F.expr(f"substring(symbol, 1, length(symbol) - {len(quote)})")
    kept = tickers.where(F.col("symbol").endswith(quote)).withColumn("base", base)
    return kept.where(~F.col("base").isin(NON_VANILLA) & ~F.col("base").rlike("(" + "|".join(LEVERAGED) + ")$"))


def top_symbols(tickers: DataFrame, quote: str, n: int) -> DataFrame:
    """Top n by quote volume, then symbol, both descending (a top-k heap per task, no full sort)."""
    return vanilla_symbols(tickers, quote).orderBy(F.desc("quote_volume"), F.desc("symbol")).limit(n)


def listing_dates(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol").agg(F.min("open_time").alias("first_bar"), F.max("open_time").alias("last_bar"))


def median_turnover(bars: DataFrame, lookback: int = 30) -> DataFrame:
    """Median notional of the last bars; NULL as soon as one of them carries no volume."""
    w = Window.partitionBy("symbol").orderBy(F.desc("open_time"))
    notional = F.coalesce(F.abs("quote_volume"), F.abs(F.col("volume") * F.col("close")))
    recent = bars.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= lookback).withColumn("_v", notional)
    agg = recent.groupBy("symbol").agg(F.median("_v").alias("m"), F.bool_or(F.col("_v").isNull()).alias("blind"))
    return agg.select("symbol", F.when(~F.col("blind"), F.col("m")).alias("median_turnover"))


def liquidity_reason(median: Column, floor: float) -> Column:
    return F.when(median.isNull(), "no volume data").when(median < floor, "below floor").otherwise("ok")


def trailing_adv(bars: DataFrame, days: DataFrame, window: int = 30) -> DataFrame:
    """(symbol, day, adv): mean of the last `window` known quote volumes strictly before each day."""
    w = Window.partitionBy("symbol").orderBy("open_time").rowsBetween(-(window - 1), 0)
    known = bars.where("quote_volume is not null").select(
        "symbol", F.col("open_time").alias("day"), F.avg("quote_volume").over(w).alias("adv")
    )
    return asof_split(days, known, ["symbol"], "day", ["adv"], YEAR_MS)


def pit_eligibility(bars: DataFrame, timeline: DataFrame, min_history_days: int, min_adv: float, window: int = 30) -> DataFrame:
    """eligible(day, symbol) from each symbol's own past only.

    The listing span x calendar expansion is the result's own size; the
    calendar side is broadcast because it holds one row per day.
    """
    spans = listing_dates(bars).select(
        "symbol",
        (F.col("first_bar") + F.lit(min_history_days * DAY_MS)).alias("_from"),
        (F.col("last_bar") + F.lit(2 * DAY_MS)).alias("_to"),
    )
    days = spans.join(F.broadcast(timeline), F.col("day").between(F.col("_from"), F.col("_to"))).select("symbol", "day")
    adv = trailing_adv(bars, days, window)
    return adv.where(F.col("adv").isNull() | (F.col("adv") >= min_adv)).select("day", "symbol")


def pit_from_snapshots(members: DataFrame, timeline: DataFrame) -> DataFrame:
    """Observed membership on timeline days; days without a snapshot are omitted, never interpolated."""
    return members.join(F.broadcast(timeline), "day").select("day", "symbol").distinct()


def snapshot_coverage(snapshot_days: DataFrame, timeline: DataFrame) -> DataFrame:
    """One row: requested, covered and missing days and the covered fraction."""
    seen = snapshot_days.select("day").distinct().withColumn("hit", F.lit(1))
    joined = timeline.join(seen, "day", "left")
    return joined.agg(
        F.count(F.lit(1)).alias("days_requested"),
        F.count("hit").alias("days_covered"),
        F.count(F.when(F.col("hit").isNull(), 1)).alias("days_missing"),
        F.coalesce(F.try_divide(F.count("hit"), F.count(F.lit(1))), F.lit(0.0)).alias("fraction_covered"),
        F.min(F.when(F.col("hit").isNull(), F.col("day"))).alias("first_missing"),
    )


def membership_violations(contributors: DataFrame, eligible: DataFrame) -> DataFrame:
    """Contributor rows outside the eligible set (should be none)."""
    return contributors.join(eligible, ["day", "symbol"], "left_anti")


def history_screen(bars: DataFrame, min_bars: int, now_ms: int, max_age_days: float) -> DataFrame:
    """Admission per symbol with the reason of a refusal."""
    agg = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_bars"), F.max("open_time").alias("last_bar"))
    stale = F.lit(now_ms) - F.col("last_bar") > F.lit(int(max_age_days * DAY_MS))
    reason = F.when(F.col("n_bars") < min_bars, "short history").when(stale, "stale").otherwise("ok")
    return agg.withColumn("reason", reason).withColumn("admitted", F.col("reason") == "ok")
