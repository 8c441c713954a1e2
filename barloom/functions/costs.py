"""Cost model columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .numeric import INF

BPS = 10_000.0
VOL_FLOOR_MULT, VOL_CAP_MULT, REFERENCE_VOL = 0.5, 3.0, 0.60  # fixed values


def flat_rate(fee: float, spread_bps: float = 0.0, slippage_bps: float = 0.0) -> float:
    """Cost per unit of turnover."""
    return fee + (spread_bps + slippage_bps) / BPS


def vol_multiplier(rv: Column, reference: float = REFERENCE_VOL, floor: float = VOL_FLOOR_MULT, cap: float = VOL_CAP_MULT) -> Column:
    """clamp(sqrt(rv / reference)); 1.0 when the volatility is missing or not positive."""
    usable = rv.isNotNull() & ~F.isnan(rv) & (rv > 0) & (rv < F.lit(INF))
    scaled = F.greatest(F.lit(floor), F.least(F.lit(cap), F.sqrt(rv / F.lit(reference))))
    return F.when(usable, scaled).otherwise(F.lit(1.0)) if reference > 0 else F.lit(1.0)


def sqrt_impact(turnover: Column, daily_vol: Column, adv_to_equity: Column, k: float = 1.0) -> Column:
    """k * daily_vol * sqrt(participation); 0 on degenerate inputs."""
    ok = (adv_to_equity > 0) & (turnover > 0) & (daily_vol > 0) & (turnover < F.lit(INF)) & (daily_vol < F.lit(INF))
    return F.when(ok, F.lit(k) * daily_vol * F.sqrt(turnover / adv_to_equity)).otherwise(F.lit(0.0))


def tier_fee(volume_30d: Column, tiers: list[tuple[float, float]]) -> Column:
    """Fee of the last tier whose floor is reached; tiers are a fixed short list, ascending."""
    fee = F.lit(tiers[0][1])
    for floor, rate in tiers:
        fee = F.when(volume_30d >= floor, F.lit(rate)).otherwise(fee)
    return fee


def cost_observation(orders: DataFrame) -> DataFrame:
    """Turnover events with mid, spread, fill-versus-mid, drift and a side-signed shortfall proxy.

    bround is half-even, like the rounding of the recorded observations.
    """
    drift = F.when(F.col("decision_close") > 0, (F.col("exec_price") / F.col("decision_close") - 1.0) * BPS)
    side = F.when(F.col("side") == "BUY", 1.0).when(F.col("side") == "SELL", -1.0)
    quoted = (F.col("bid") > 0) & (F.col("ask") > 0)
    mid = F.when(quoted, (F.col("bid") + F.col("ask")) / 2)
    staged = orders.withColumns({"_mid": mid, "_drift": drift, "_side": side})

    def bp(c: Column) -> Column:
        return F.bround(c, 4)

    return staged.withColumns(
        {
            "turnover": F.bround(F.abs(F.col("target_weight") - F.col("previous_weight")), 6),
            "mid": bp(F.col("_mid")),
            "quoted_spread_bps": bp((F.col("ask") - F.col("bid")) / F.col("_mid") * BPS),
            "fill_vs_mid_bps": bp((F.col("exec_price") / F.col("_mid") - 1.0) * BPS),
            "decision_to_exec_drift_bps": bp(F.col("_drift")),
            "observed_cost_proxy_bps": bp(F.col("_side") * F.col("_drift")),
        }
    ).drop("_mid", "_drift", "_side")


def vol_overlay(returns: DataFrame, keys: list[str], target: float = 0.25, window: int = 20, fee: float = 0.0015) -> DataFrame:
    """Scale a return stream to a trailing-volatility target (uses input returns only, so no recursion)."""
    w = Window.partitionBy(*keys).orderBy("day")
    past = w.rowsBetween(-window, -1)
    rv = F.stddev_samp("ret").over(past) * F.lit(365.0**0.5)
    ready = F.count("ret").over(past) >= window
    exposure = F.when(ready & (rv > 0), F.least(F.lit(1.0), F.lit(target) / rv)).otherwise(F.lit(1.0))
    staged = returns.withColumn("exposure", exposure)
    change = F.abs(F.col("exposure") - F.lag("exposure", 1, 1.0).over(w))
    return staged.withColumn("ret", F.col("exposure") * F.col("ret") - F.lit(fee) * change)
