"""Order planning over a table of trading cycles (cycle, symbol, qty, price, cash, target, stale)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import finite, positive

HELD = 1e-12
EPSILON = 1e-4


def valid_target(target: str = "target") -> Column:
    return F.coalesce(finite(target).between(0.0, 1.0), F.lit(False))


def gross_cap(rows: DataFrame, cap: float) -> DataFrame:
    """Scale tradeable targets so that their sum fits what blocked holdings leave of the cap.

    Sums are aggregated per cycle and joined back, so a cycle with very many
    symbols is never sorted or held in one task.
    """
    value = F.when(F.abs("qty") > HELD, F.col("qty") * positive("price")).otherwise(F.lit(0.0))
    tradeable = ~F.col("blocked") & valid_target()
    sums = rows.groupBy("cycle").agg(
        (F.max("cash") + F.sum(value)).alias("_equity"),
        F.bool_or((F.abs("qty") > HELD) & positive("price").isNull()).alias("_unmarked"),
        F.sum(F.when(F.col("blocked"), value).otherwise(0.0)).alias("_locked"),
        F.sum(F.when(tradeable, F.col("target")).otherwise(0.0)).alias("_gross"),
    )
    locked = F.when(~F.col("_unmarked") & (F.col("_equity") > 0), F.col("_locked") / F.col("_equity")).otherwise(0.0)
    room = F.greatest(F.lit(0.0), F.lit(cap) - locked)
    scale = F.when(F.col("_gross") > room + 1e-12, room / F.col("_gross")).otherwise(F.lit(1.0))
    planned = sums.select("cycle", locked.alias("locked_weight"), scale.alias("scale"))
    return rows.join(planned, "cycle").withColumn(
        "scaled_target", F.when(tradeable, F.col("target") * F.col("scale")).otherwise(F.col("target"))
    )


def _equity(rows: DataFrame) -> DataFrame:
    return rows.groupBy("cycle").agg(
        (F.max("cash") + F.sum(F.col("qty") * F.coalesce(positive("price"), F.lit(0.0)))).alias("_equity"),
        F.bool_or((F.abs("qty") > HELD) & positive("price").isNull()).alias("_unmarked"),
    )


def decide(rows: DataFrame) -> DataFrame:
    """One decision per (cycle, symbol), first matching reason wins; plus the idempotency key."""
    joined = rows.join(_equity(rows), "cycle")
    flat = (F.abs("qty") <= HELD) & (F.col("target") == 0.0)
    current = F.when(flat, F.lit(0.0)).otherwise(F.col("qty") * F.col("price") / F.col("_equity"))
    action = (
        F.when(F.col("stale"), "blocked_stale")
        .when(F.col("_unmarked"), "blocked_missing_mark")
        .when(~valid_target(), "blocked_invalid_target")
        .when(flat, "hold")
        .when(positive("price").isNull(), "blocked_invalid_price")
        .when(~F.coalesce(positive("_equity").isNotNull(), F.lit(False)), "blocked_invalid_equity")
        .when(F.abs(F.col("target") - current) <= EPSILON, "hold")
        .when(F.col("target") > current, "BUY")
        .otherwise("SELL")
    )
    out = joined.withColumn("action", action)
    open_ = ~F.col("action").startswith("blocked")
    key = F.concat_ws("|", F.col("cycle").cast("string"), "symbol", F.lit("REBAL"), F.format_string("%.4f", F.col("target")))
    return out.withColumn("current_weight", F.when(open_, current)).withColumn("idem_key", F.when(open_, key)).drop("_unmarked")


def buy_scale(decisions: DataFrame, fee: float = 0.001) -> DataFrame:
    """Per cycle: cash after sells, buy notional, and the common scale of all buys."""
    trades = decisions.where(F.col("action").isin("BUY", "SELL"))
    delta = F.col("target") * F.col("_equity") - F.col("qty") * F.col("price")
    agg = trades.withColumn("_delta", delta).groupBy("cycle").agg(
        (F.max("cash") + F.sum(F.when(F.col("_delta") < 0, -F.col("_delta") * (1.0 - fee)).otherwise(0.0))).alias("projected_cash"),
        F.sum(F.when(F.col("_delta") > 0, F.col("_delta")).otherwise(0.0)).alias("buy_notional"),
    )
    need = F.col("buy_notional") * (1.0 + fee)
    return agg.withColumn("scale", F.when(need > HELD, F.least(F.lit(1.0), F.col("projected_cash") / need)).otherwise(F.lit(1.0)))


def audit_positions(rows: DataFrame) -> DataFrame:
    """Held positions with value and weight; weights are NULL when a held mark is missing."""
    joined = rows.where(F.abs("qty") > HELD).join(_equity(rows), "cycle")
    value = F.col("qty") * positive("price")
    weight = F.when(~F.col("_unmarked"), value / F.greatest(F.col("_equity"), F.lit(1e-9)))
    equity = F.when(~F.col("_unmarked"), F.col("_equity"))
    return joined.select("cycle", "symbol", "qty", positive("price").alias("price"), value.alias("value"), weight.alias("weight"), equity.alias("equity"))
