"""Exact self-financing accounting of a weight stream."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .numeric import finite, positive


def transition(
    w0: Column, w1: Column, p0: Column, x: Column, p1: Column, cost: Column, cash_rate: Column, basis: str
) -> dict[str, Column]:
    """One session as columns, with all legs.

    Capital 1 enters at close p0 holding w0, trades to w1 at x, ends at close
    p1.  `basis` says whether idle cash earns on the old ('previous') or the
    new ('target') allocation.
    """
    rf_open = cash_rate if basis == "previous" else F.lit(0.0)
    rf_close = cash_rate if basis == "target" else F.lit(0.0)
    asset_open = w0 * (x / p0)
    idle = F.lit(1.0) - w0
    cash_open = idle * (F.lit(1.0) + rf_open)
    wealth_open = asset_open + cash_open
    drifted = asset_open / wealth_open
    turnover = F.abs(w1 - drifted)
    paid = cost * turnover * wealth_open
    after = wealth_open - paid
    asset_post, cash_post = w1 * after, (F.lit(1.0) - w1) * after
    asset_close = asset_post * (p1 / x)
    cash_close = cash_post * (F.lit(1.0) + rf_close)
    return {
        "ret": asset_close + cash_close - 1.0,
        "overnight": asset_open - w0,
        "intraday": (asset_close - asset_post) + (cash_close - cash_post),
        "cash": (cash_open - idle) + (cash_close - cash_post if basis == "target" else F.lit(0.0)),
        "turnover": turnover,
        "cost": paid,
        "wealth_open": wealth_open,
        "wealth_after_cost": after,
        "wealth_close": asset_close + cash_close,
        "drifted_weight": drifted,
    }


def transition_problem(w0: str, w1: str, p0: str, x: str, p1: str, cost: str, cash_rate: str) -> Column:
    """Why a transition row is invalid; NULL when it is fine."""
    bad_w = [F.when(~F.coalesce(finite(c).between(0.0, 1.0), F.lit(False)), F.lit(f"{c} outside [0,1]")) for c in (w0, w1)]
    bad_p = [F.when(positive(c).isNull(), F.lit(f"{c} not positive")) for c in (p0, x, p1)]
    return F.coalesce(
        *bad_w,
        *bad_p,
        F.when(~F.coalesce(finite(cost) >= 0, F.lit(False)), F.lit("cost negative")),
        F.when(~F.coalesce(finite(cash_rate) > -1, F.lit(False)), F.lit("cash rate invalid")),
    )


def open_or_fallback(op: Column, previous_close: Column) -> Column:
    """Today's open when usable, else the previous close."""
    return F.coalesce(positive(op), previous_close)


def stream_return(w0: Column, w1: Column, p0: Column, op: Column, p1: Column, cost: Column, rf: Column, execution: str) -> dict[str, Column]:
    """ret / cost / traded (turnover in units of starting wealth) of one bar in a given execution mode.

    `drag` is the return lost per unit of cost rate: with wealth growing by g
    after the trade, ret(c) = wealth_open g - 1 - c turnover wealth_open g.
    """
    if execution == "next_open":
        leg = transition(w0, w1, p0, open_or_fallback(op, p0), p1, cost, rf, "previous")
    else:
        leg = transition(w0, w1, p0, p0, p1, cost, rf, "target")
    growth = leg["wealth_close"] / leg["wealth_after_cost"]
    traded = leg["turnover"] * leg["wealth_open"]
    return {"ret": leg["ret"], "cost": leg["cost"], "traded": traded, "drag": traded * growth}


def account(
    weighted: DataFrame,
    keys: Sequence[str],
    cost_rate: float,
    rf_annual: float = 0.0,
    periods_per_year: int = 365,
    execution: str = "close",
    latency: int = 0,
    idx: str = "bar_idx",
    cost: Column | None = None,
    band: float = 0.0,
) -> DataFrame:
    """Return stream of a weight: (keys, open_time, bar_idx, target) -> ret, cost, traded, w.

    Needs columns open, close, prev_close, weight; the first bar of a slice
    yields no return and the stream starts flat.  With a `band`, a new target is
    acted on only when it leaves the band around the weight held.
    """
    w = Window.partitionBy(*keys).orderBy("open_time")
    held = F.col("weight") if latency == 0 else F.coalesce(F.lag("weight", latency).over(w), F.lit(0.0))
    if latency:
        held = F.when(F.col(idx) - latency >= 1, held).otherwise(F.lit(0.0))
    staged = weighted.withColumn("w", F.when(F.col(idx) >= 1, held).otherwise(F.lit(0.0)))
    if band:
        staged = hold_pool_with_band(staged.withColumn("w", F.array("w")), keys, band, "w").withColumn("w", F.get("w", F.lit(0)))
    staged = staged.withColumn("w_prev", F.lag("w", 1, 0.0).over(w)).where(F.col(idx) >= 1)
    legs = stream_return(
        F.col("w_prev"), F.col("w"), F.col("prev_close"), F.col("open"), F.col("close"),
        F.lit(cost_rate) if cost is None else cost, F.lit(rf_annual / periods_per_year), execution,
    )
    return staged.withColumns({k: legs[k] for k in ("ret", "cost", "traded")})


def hold_with_band(targets: DataFrame, keys: Sequence[str], band: Column | str = "band") -> DataFrame:
    """Path-dependent holding: trade only when the target leaves the band around the held weight.

    Input (keys, open_time, weight, band); output adds `held`.  The recurrence
    runs once per key over at most one row per calendar day, in Arrow batches.
    """
    schema = f"{targets.schema.simpleString()[7:-1].replace(':', ' ')}, held double"

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("open_time", ignore_index=True)
        held, out = 0.0, []
        for target, width in zip(pdf["weight"].to_numpy(), pdf["band"].to_numpy()):
            if abs(target - held) > width:
                held = target
            out.append(held)
        return pdf.assign(held=out)

    return targets.groupBy(*keys).applyInPandas(fold, schema)


def hold_pool_with_band(rows: DataFrame, keys: Sequence[str], band: float, column: str = "ws") -> DataFrame:
    """Replace the target weights of a whole pool, one array per bar, by the weights a band lets through.

    The held weights of all candidates are one vector, carried over the bars of
    a key in one pass: bars are sorted once, whatever the size of the pool, and
    a key has at most one bar per calendar day.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("open_time", ignore_index=True)
        targets = np.stack(pdf[column].to_numpy()).astype(float)
        held = np.zeros(targets.shape[1])
        for i, row in enumerate(targets):
            held = np.where(np.abs(row - held) > band, row, held)
            targets[i] = held
        return pdf.assign(**{column: list(targets)})

    return rows.groupBy(*keys).applyInPandas(fold, rows.schema)


def signal_cash(bars: DataFrame, fee: float = 0.001) -> DataFrame:
    """All-in / all-out ledger from buy and sell events, per symbol.

    A buy while flat or a sell while invested is a trade; repeated signals are
    ignored.  The value is the product of the price ratios of the invested
    stretches times the fee factors, so no cash loop is needed.
    Input columns: symbol, open_time, close, signal ('buy'/'sell'/'hold').
    """
    w = Window.partitionBy("symbol").orderBy("open_time")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    intent = F.when(F.col("signal") == "buy", 1).when(F.col("signal") == "sell", 0)
    state = F.coalesce(F.last(intent, ignorenulls=True).over(upto), F.lit(0))
    staged = bars.withColumn("pos", state)
    staged = staged.withColumn("pos_prev", F.lag("pos", 1, 0).over(w)).withColumn("p0", F.lag("close").over(w))
    traded = F.col("pos") != F.col("pos_prev")
    growth = F.when(F.col("pos_prev") == 1, F.col("close") / F.col("p0")).otherwise(1.0) * F.when(traded, 1.0 - fee).otherwise(1.0)
    return staged.groupBy("symbol").agg(
        F.product(growth).alias("growth"),
        F.count(F.when(traded, 1)).alias("trades"),
        (F.max_by("close", "open_time") / F.min_by("close", "open_time") - 1.0).alias("buy_hold"),
    )
