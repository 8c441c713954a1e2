"""Cross-sectional portfolio construction over masked contributor streams.

Input streams are long tables (symbol, day, ret) *after* the membership mask:
mask first (left semi join), then weight, so an ineligible sleeve can neither
earn nor take weight.  Histories are each symbol's own contributed rows.
Windows partition by symbol (at most one row per calendar day) or by day (at
most one row per symbol).
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.performance import trailing_cum_return

VOL_WINDOW, CAP_MULTIPLE = 20, 2.0
TILT_ROWS, MAX_TILT = 90, 0.5
CORR_ROWS, CORR_LIMIT, DERISK = 60, 0.60, 0.60
DD_TRIGGER, DD_EXIT, THROTTLE = -0.10, -0.05, 0.5


def denominators(timeline: DataFrame, eligible: DataFrame | None, n_assets: int | None = None) -> DataFrame:
    """(day, denom): fixed count, or the eligible count of the day (at least 1)."""
    if eligible is None:
        return timeline.withColumn("denom", F.lit(n_assets))
    counted = eligible.groupBy("day").agg(F.count(F.lit(1)).alias("_n"))
    return timeline.join(counted, "day", "left").select("day", F.greatest(F.lit(1), F.coalesce("_n", F.lit(0))).alias("denom"))


def mask(streams: DataFrame, eligible: DataFrame) -> DataFrame:
    return streams.join(eligible, ["day", "symbol"], "left_semi")


def equal_weight(masked: DataFrame, denoms: DataFrame) -> DataFrame:
    """(day, ret): missing capital stays in cash."""
    total = masked.groupBy("day").agg(F.sum("ret").alias("_s"))
    return denoms.join(total, "day", "left").select("day", (F.coalesce("_s", F.lit(0.0)) / F.col("denom")).alias("ret"))


def inverse_vol_scores(masked: DataFrame, window: int = VOL_WINDOW) -> DataFrame:
    """Add hist_n (past rows in the window) and raw = 1 / max(annualised vol, 1e-6)."""
    past = Window.partitionBy("symbol").orderBy("day").rowsBetween(-window, -1)
    n, sd = F.count("ret").over(past), F.stddev_samp("ret").over(past)
    raw = F.when(n < 2, F.lit(1.0)).otherwise(F.lit(1.0) / F.greatest(sd * F.lit(365.0**0.5), F.lit(1e-6)))
    return masked.withColumns({"hist_n": n, "raw": raw})


def waterfill(scored: DataFrame, cap: Column, keys: Sequence[str] = ("day",)) -> DataFrame:
    """Normalise `raw` to 1 per key under a hard cap (closed form).

    Sorted by raw descending, the capped names are the longest prefix whose
    proportional share of the remaining mass still exceeds the cap.
    """
    order = Window.partitionBy(*keys).orderBy(F.desc("raw"), "symbol")
    rest = order.rowsBetween(0, Window.unboundedFollowing)
    staged = scored.withColumns({"_rk": F.row_number().over(order), "_tail": F.sum("raw").over(rest), "_cap": cap})
    share = (F.lit(1.0) - (F.col("_rk") - 1) * F.col("_cap")) * F.col("raw") / F.col("_tail")
    staged = staged.withColumn("_over", (share > F.col("_cap") + 1e-15).cast("int"))
    staged = staged.withColumn("_in", F.min("_over").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy(*keys)
    capped = F.sum("_in").over(whole)
    free = F.sum(F.when(F.col("_in") == 0, F.col("raw")).otherwise(0.0)).over(whole)
    w = F.when(F.col("_in") == 1, F.col("_cap")).otherwise((F.lit(1.0) - capped * F.col("_cap")) * F.col("raw") / free)
    staged = staged.withColumn("_w", w)
    return staged.withColumn("weight", F.col("_w") / F.sum("_w").over(whole)).drop("_rk", "_tail", "_cap", "_over", "_in", "_w")


def inverse_vol_weights(masked: DataFrame, window: int = VOL_WINDOW, multiple: float = CAP_MULTIPLE) -> DataFrame:
    """Capped inverse-volatility weights; equal until any present symbol has a full window."""
    day = Window.partitionBy("day")
    scored = inverse_vol_scores(masked, window).withColumn("present", F.count(F.lit(1)).over(day))
    ready = F.max("hist_n").over(day) >= window
    filled = waterfill(scored.withColumn("_ready", ready), F.lit(multiple) / F.col("present"))
    return filled.withColumn("weight", F.when(F.col("_ready"), F.col("weight")).otherwise(F.lit(1.0) / F.col("present"))).drop("_ready")


def tilt_multiplier(scored: DataFrame, keys: Sequence[str] = ("day",), max_tilt: float = MAX_TILT) -> DataFrame:
    """Linear-in-rank multipliers by `mom` ascending (ties by symbol), mean 1 over the ranked; neutral otherwise."""
    day = Window.partitionBy(*keys)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.asc_nulls_last("mom"), "symbol"))
    staged = scored.withColumns({"_k": F.count("mom").over(day), "_i": rank - 1})
    raw = F.lit(1.0 - max_tilt) + F.lit(2.0 * max_tilt) * F.try_divide(F.col("_i"), F.col("_k") - 1)
    staged = staged.withColumn("_raw", F.when(F.col("mom").isNotNull() & (F.col("_k") >= 2), raw))
    mult = F.coalesce(F.col("_raw") / F.avg("_raw").over(day), F.lit(1.0))
    return staged.withColumn("multiplier", mult).drop("_k", "_i", "_raw")


def tilt(weighted: DataFrame) -> DataFrame:
    """Apply the momentum tilt on days where every present symbol is ranked and there are at least two.

    Momenta equal to 12 digits are ties, which the symbols' order decides:
    sleeves in cash compound the same returns, but not to the same last bit.
    """
    day = Window.partitionBy("day")
    scored = tilt_multiplier(weighted.withColumn("mom", F.round(trailing_cum_return(TILT_ROWS), 12)))
    staged = scored.withColumns({"_all": F.count("mom").over(day) == F.count(F.lit(1)).over(day), "_w": F.col("weight") * F.col("multiplier")})
    tilted = F.col("_w") / F.sum("_w").over(day)
    active = F.col("_all") & (F.count(F.lit(1)).over(day) >= 2)
    return staged.withColumn("weight", F.when(active, tilted).otherwise(F.col("weight"))).drop("_all", "_w", "multiplier")


def average_correlation(masked: DataFrame, rows: int = CORR_ROWS) -> DataFrame:
    """(day, avg_corr): mean pairwise correlation of the last `rows` own returns, aligned by position.

    With unit-norm z-scores the sum over all pairs collapses to per-position
    sums, so no pair is ever materialised:
    mean rho = (sum_p (sum_i z_ip)^2 - n) / (n (n - 1)).
    """
    past = Window.partitionBy("symbol").orderBy("day").rowsBetween(-rows, -1)
    staged = masked.select(
        "day", "symbol", F.collect_list("ret").over(past).alias("h"), F.avg("ret").over(past).alias("m"), F.var_pop("ret").over(past).alias("v")
    ).where((F.size("h") >= rows) & (F.col("v") > 0))
    z = staged.select("day", F.posexplode("h").alias("pos", "x"), "m", (F.sqrt(F.col("v") * float(rows))).alias("norm"))
    by_pos = z.groupBy("day", "pos").agg(F.sum((F.col("x") - F.col("m")) / F.col("norm")).alias("s"), F.count(F.lit(1)).alias("n"))
    agg = by_pos.groupBy("day").agg(F.sum(F.col("s") * F.col("s")).alias("q"), F.max("n").alias("n"))
    return agg.where("n >= 2").select("day", ((F.col("q") - F.col("n")) / (F.col("n") * (F.col("n") - 1))).alias("avg_corr"))


def crisis_exposure(corr: Column, limit: float = CORR_LIMIT, derisk: float = DERISK) -> Column:
    return F.when(corr > limit, F.lit(derisk)).otherwise(F.lit(1.0))


def combine(weighted: DataFrame, denoms: DataFrame, corr: DataFrame | None = None) -> DataFrame:
    """(day, ret, present, exposure): weighted sum x present/denominator x crisis factor."""
    agg = weighted.groupBy("day").agg(F.sum(F.col("weight") * F.col("ret")).alias("_g"), F.count(F.lit(1)).alias("present"))
    joined = denoms.join(agg, "day", "left")
    exposure = F.coalesce("present", F.lit(0)) / F.col("denom")
    if corr is not None:
        joined = joined.join(corr, "day", "left")
        exposure = exposure * crisis_exposure(F.col("avg_corr"))
    staged = joined.withColumn("exposure", exposure)
    return staged.select(
        "day", (F.coalesce("_g", F.lit(0.0)) * F.col("exposure")).alias("ret"), F.coalesce("present", F.lit(0)).alias("present"), "exposure"
    )


def inverse_vol(masked: DataFrame, denoms: DataFrame) -> DataFrame:
    return combine(inverse_vol_weights(masked), denoms)


def rule(masked: DataFrame, denoms: DataFrame, use_tilt: bool = True, use_crisis: bool = True) -> DataFrame:
    """Inverse volatility, then tilt, then crisis de-risking."""
    weighted = inverse_vol_weights(masked)
    weighted = tilt(weighted) if use_tilt else weighted
    return combine(weighted, denoms, average_correlation(masked) if use_crisis else None)


def drawdown_throttle(
    streams: DataFrame, keys: Sequence[str] = ("variant",), trigger: float = DD_TRIGGER, exit_: float = DD_EXIT, factor: float = THROTTLE
) -> DataFrame:
    """Halve the exposure while the *throttled* equity is in a deep drawdown.

    The state depends on its own output, so the fold runs once per variant over
    at most one row per calendar day.
    """
    schema = ", ".join(f"{k} {dict(streams.dtypes)[k]}" for k in keys) + ", day bigint, ret double, throttled boolean"

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("day", ignore_index=True)
        equity = peak = 1.0
        on, rets, flags = False, [], []
        for base in pdf["ret"].to_numpy():
            dd = equity / peak - 1.0
            on = dd <= exit_ if on else dd <= trigger
            out = base * factor if on else base
            equity *= 1.0 + out
            peak = max(peak, equity)
            rets.append(out)
            flags.append(on)
        return pdf[[*keys, "day"]].assign(ret=rets, throttled=flags)

    return streams.groupBy(*keys).applyInPandas(fold, schema)


def weight_turnover(weights: DataFrame, timeline: DataFrame) -> DataFrame:
    """(day, turnover): half the absolute weight change per day over the union of names.

    Works on the sparse table: a row contributes its change against the
    previous calendar day, and its exit on the next one - no dense day x symbol
    grid is built.  The first calendar day is compared with an empty book.
    """
    cal = timeline.withColumn("_d", F.row_number().over(Window.orderBy("day")))  # one row per calendar day
    w = Window.partitionBy("symbol").orderBy("_d")
    rows = weights.join(F.broadcast(cal), "day").select("symbol", "_d", "weight").withColumns(
        {"_pd": F.lag("_d").over(w), "_pw": F.lag("weight").over(w), "_nd": F.lead("_d").over(w)}
    )
    before = F.when(F.col("_pd") == F.col("_d") - 1, F.col("_pw")).otherwise(F.lit(0.0))
    gone = F.when(F.col("_nd").isNull() | (F.col("_nd") > F.col("_d") + 1), F.abs("weight")).otherwise(F.lit(0.0))
    moves = rows.select(
        F.explode(F.array(F.struct("_d", F.abs(F.col("weight") - before).alias("c")), F.struct((F.col("_d") + 1).alias("_d"), gone.alias("c")))).alias("m")
    ).select("m._d", "m.c")
    total = moves.groupBy("_d").agg((F.sum("c") / 2).alias("turnover"))
    return cal.join(total, "_d", "left").select("day", F.coalesce("turnover", F.lit(0.0)).alias("turnover"))


def cost_line(turns: Column, rate: str = "0.0015") -> Column:
    """Return lost to trading: -rate * turns to 6 digits, ties away from zero, in decimals.

    Turnover is a sum of fractions 1/2n of at most 31 names, so at 9 digits it has no ties, and what the order of
    the sum leaves in the last bits is gone before the tie at 6 digits is decided.
    """
    return F.round(F.lit(-Decimal(rate)) * turns.cast("decimal(24,9)"), 6).cast("double") + F.lit(0.0)
