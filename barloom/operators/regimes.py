"""Market regimes of a proxy, their segments and stress days."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import performance as pf
from ..sources.panels import DAY_MS

BULL, BEAR, LOOKBACK_DAYS = 0.25, -0.25, 180  # fixed values


def labels(bars: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """(keys, day, label) on the proxy's own days from its trailing 180-day return.

    Range frames end strictly before the day, and before day - 180.
    """
    w = Window.partitionBy(*keys).orderBy("open_time")
    past = w.rangeBetween(Window.unboundedPreceding, -1)
    older = w.rangeBetween(Window.unboundedPreceding, -LOOKBACK_DAYS * DAY_MS - 1)
    now, then = F.last("close").over(past), F.last("close").over(older)
    i, j = F.count(F.lit(1)).over(past), F.count(F.lit(1)).over(older)
    ret = now / then - 1.0
    label = F.when((j <= 0) | (i - j < 10), "sideways").when(ret >= BULL, "bull").when(ret <= BEAR, "bear").otherwise("sideways")
    return bars.select(*keys, F.col("open_time").alias("day"), label.alias("label"))


def segments(labelled: DataFrame, keys: Sequence[str] = ("symbol",), min_days: int = 30) -> DataFrame:
    """Runs of one label lasting at least `min_days` calendar days."""
    w = Window.partitionBy(*keys).orderBy("day")
    change = (F.lag("label").over(w).isNull() | (F.lag("label").over(w) != F.col("label"))).cast("int")
    runs = labelled.withColumn("_c", change).withColumn("run", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    agg = runs.groupBy(*keys, "run", "label").agg(F.min("day").alias("start"), F.max("day").alias("end"))
    return agg.where((F.col("end") - F.col("start")) / F.lit(float(DAY_MS)) + 1 >= min_days).drop("run")


def stress(series: DataFrame, keys: Sequence[str] = ("symbol",), window: int = 30, drop: float = -0.20, pct: float = 0.90) -> DataFrame:
    """(keys, day, stressed): 30-day return <= drop, or 30-day volatility in its own top decile."""
    w = Window.partitionBy(*keys).orderBy("open_time")
    near = w.rangeBetween(-window * DAY_MS, -1)  # bars inside the last 30 calendar days
    enough = (F.col("bar_idx") >= window + 1) & (F.count(F.lit(1)).over(near) >= window)
    ret = F.lag("close", 1).over(w) / F.lag("close", 1 + window).over(w) - 1.0
    vol = F.stddev_samp("lr").over(w.rowsBetween(-window, -1)) * F.lit(365.0**0.5)
    staged = series.select(*keys, F.col("open_time").alias("day"), F.when(enough, ret).alias("tr"), F.when(enough, vol).alias("vol"))
    ordered = staged.groupBy(*keys).agg(F.sort_array(F.collect_list("vol")).alias("_v"))  # one value per calendar day
    at = F.floor(F.size("_v") * pct).cast("int")
    cut = ordered.select(*keys, F.when(F.size("_v") > 0, F.element_at("_v", F.when(at > 0, at).otherwise(F.lit(-1)))).alias("cut"))
    return staged.join(cut, list(keys)).select(
        *keys, "day", (F.coalesce(F.col("tr") <= drop, F.lit(False)) | F.coalesce(F.col("vol") >= F.col("cut"), F.lit(False))).alias("stressed")
    )


def regime_performance(returns: DataFrame, labelled: DataFrame, keys: Sequence[str], ppy: int = 365, rf: float = 0.0) -> DataFrame:
    """Metrics of each stream inside each label; equity compounds over the label's own days.

    `labelled(day, label)` holds one row per calendar day, so it is broadcast.
    """
    total = labelled.agg(F.count(F.lit(1)).alias("_days"))
    tagged = returns.join(F.broadcast(labelled), "day", "left").withColumn("label", F.coalesce("label", F.lit("sideways")))
    out = pf.summary(tagged, [*keys, "label"], ppy, rf, extra={"hit_rate": F.avg((F.col("ret") > 0).cast("double"))})
    return out.join(F.broadcast(total)).withColumn("share_of_window", F.col("n") / F.greatest(F.col("_days"), F.lit(1))).drop("_days")


def segment_metrics(returns: DataFrame, segs: DataFrame, keys: Sequence[str], seg_keys: Sequence[str]) -> DataFrame:
    """Metrics of each stream inside each [start, end] segment (interval join on a handful of segments)."""
    joined = returns.join(F.broadcast(segs), F.col("day").between(F.col("start"), F.col("end")))
    return pf.summary(joined, [*keys, *seg_keys], 365, 0.0)
