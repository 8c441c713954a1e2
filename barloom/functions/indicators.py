"""Rolling indicators over a bar series.

A feature is a tuple such as ("sma", 50).  All features of a series share one
window specification, so Spark plans one exchange and one sort for the lot.
By default a feature at bar i uses bars up to i-1 only; `through=0` includes
bar i itself (the reading after the last close).
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

YEAR = 365  # indicator volatility is annualised with 365 for every symbol

Feature = tuple


def feature_name(f: Feature) -> str:
    return "_".join(str(x) for x in f)


def series(bars: DataFrame, keys: Sequence[str] = ("symbol",), order: str = "open_time") -> DataFrame:
    """Add bar_idx, prev_close, prev_time, lr (log return), up and dn (absolute gains and losses)."""
    w = Window.partitionBy(*keys).orderBy(order)
    staged = bars.withColumn("bar_idx", (F.row_number().over(w) - 1).cast("bigint")).withColumns(
        {"prev_close": F.lag("close").over(w), "prev_time": F.lag(order).over(w)}
    )
    change = F.col("close") - F.col("prev_close")
    return staged.withColumns(
        {
            "lr": F.ln(F.col("close") / F.col("prev_close")),
            "up": F.greatest(change, F.lit(0.0)),
            "dn": F.greatest(-change, F.lit(0.0)),
        }
    )


def feature_column(f: Feature, w: WindowSpec, through: int = -1) -> Column:
    """Column of one feature; `through` is the last bar used relative to the row."""
    kind, n = f[0], f[1]
    frame = w.rowsBetween(through - n + 1, through)
    end = through + 1  # bars strictly before bar_idx + end are visible
    seen = F.col("bar_idx") + end

    def when_filled(need: int, value: Column) -> Column:
        return F.when(seen >= need, value)

    def past(c: str, k: int) -> Column:
        """Value of the k-th most recent visible bar (k=1 is the newest)."""
        return F.lag(c, k - end).over(w) if k > end else F.col(c)

    if kind == "px":
        return past("close", n)
    if kind == "sma":
        return when_filled(n, F.avg("close").over(frame))
    if kind == "psd":
        return when_filled(n, F.stddev_samp("close").over(frame))
    if kind == "vol":
        return when_filled(n + 1, F.stddev_samp("lr").over(frame) * F.lit(math.sqrt(YEAR)))
    if kind == "max":
        return when_filled(n, F.max("close").over(frame))
    if kind == "min":
        return when_filled(n, F.min("close").over(frame))
    if kind == "mom":
        return F.ln(past("close", 1) / past("close", 1 + n))
    if kind == "rsi":
        gains, losses = F.sum("up").over(frame), F.sum("dn").over(frame)
        value = (
            F.when(losses <= 0, F.lit(100.0))
            .when(gains <= 0, F.lit(0.0))
            .otherwise(F.lit(100.0) - F.lit(100.0) / (F.lit(1.0) + gains / losses))
        )
        return when_filled(n + 1, value)
    raise ValueError(f"unknown feature {f}")


def add_features(
    prepared: DataFrame,
    features: Iterable[Feature],
    keys: Sequence[str] = ("symbol",),
    order: str = "open_time",
    through: int = -1,
) -> DataFrame:
    """Append the requested feature columns to a prepared series."""
    w = Window.partitionBy(*keys).orderBy(order)
    wanted = {feature_name(f): feature_column(f, w, through) for f in features if f[0] != "macd"}
    return prepared.withColumns(wanted) if wanted else prepared


def add_macd(bars: DataFrame, specs: Sequence[tuple[int, int, int]], keys: Sequence[str], through: int = -1) -> DataFrame:
    """MACD line and signal per slice, as columns macd_f_s_g and macdsig_f_s_g.

    The EMA is a recurrence seeded with the first close of the slice, so one
    grouped Arrow batch holds one slice: at most one row per calendar day.
    """
    fields = ", ".join(f"macd_{f}_{s}_{g} double, macdsig_{f}_{s}_{g} double" for f, s, g in specs)
    schema = f"{bars.schema.simpleString()[7:-1].replace(':', ' ')}, {fields}"
    shift = -through

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("open_time", ignore_index=True)
        close = pdf["close"]
        for f, s, g in specs:
            line = close.ewm(span=f, adjust=False).mean() - close.ewm(span=s, adjust=False).mean()
            signal = line.ewm(span=g, adjust=False).mean()
            pdf[f"macd_{f}_{s}_{g}"] = line.shift(shift)
            pdf[f"macdsig_{f}_{s}_{g}"] = signal.shift(shift)
        return pdf

    return bars.groupBy(*keys).applyInPandas(fold, schema)


def realized_vol(window: int, periods_per_year: int, keys: Sequence[str] = ("symbol",)) -> Column:
    """Annualised sample volatility of the last `window` log returns up to this bar; NULL in warm-up."""
    w = Window.partitionBy(*keys).orderBy("open_time").rowsBetween(-(window - 1), 0)
    return F.when(F.col("bar_idx") >= window, F.stddev_samp("lr").over(w) * F.lit(math.sqrt(periods_per_year)))
