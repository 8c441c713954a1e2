"""Expanding and purged fold boundaries, and the assignment of bars to folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.panels import DAY_MS


def _first_day_at_or_after(folds: DataFrame, days: DataFrame, keys: list[str], bound: Column, name: str, how: str) -> DataFrame:
    """Add the first calendar day >= bound.  A calendar holds one row per day, so the range join stays small."""
    f, d = folds.alias("f"), days.alias("d")
    cond = [F.col(f"f.{k}") == F.col(f"d.{k}") for k in keys] + [F.col("d.day") >= bound]
    joined = f.join(d, cond, how)
    return joined.groupBy(*[F.col(f"f.{c}").alias(c) for c in folds.columns]).agg(F.min("d.day").alias(name))


def _epochs(days: DataFrame, keys: list[str], train_days: int, test_days: int) -> DataFrame:
    span = days.groupBy(*keys).agg(F.min("day").alias("t0"), F.max("day").alias("t1"))
    n = F.floor((F.col("t1") - F.col("t0")) / F.lit(test_days * DAY_MS)).cast("int")
    rows = span.select(*keys, "t0", F.explode(F.sequence(F.lit(0), n)).alias("fold_id"))
    return rows.select(
        *keys, "fold_id", (F.col("t0") + (F.col("fold_id").cast("bigint") * test_days + train_days) * F.lit(DAY_MS)).alias("bound")
    )


def expanding_folds(days: DataFrame, train_days: int, test_days: int, keys: list[str] | None = None) -> DataFrame:
    """folds(keys, fold_id, train_end_ms, test_end_ms) of each calendar `days(keys, day)`."""
    keys = keys or []
    base = _epochs(days, keys, train_days, test_days)
    one = _first_day_at_or_after(base, days, keys, F.col("f.bound"), "train_end_ms", "inner").drop("bound")
    bound = F.col("f.train_end_ms") + F.lit(test_days * DAY_MS)
    return _first_day_at_or_after(one, days, keys, bound, "test_end_ms", "inner")


def purged_folds(
    days: DataFrame, train_days: int, test_days: int, purge_days: int, keys: list[str] | None = None, min_test: int = 30
) -> DataFrame:
    """Inner folds with a purge gap; test_end_ms is NULL when the test runs to the end of the data.

    Folds stop at the first one whose test has fewer than `min_test` bars.
    """
    keys = keys or []
    base = _epochs(days, keys, train_days, test_days)
    one = _first_day_at_or_after(base, days, keys, F.col("f.bound"), "train_end_ms", "inner").drop("bound")
    two = _first_day_at_or_after(
        one, days, keys, F.col("f.train_end_ms") + F.lit(purge_days * DAY_MS), "test_start_ms", "inner"
    )
    three = _first_day_at_or_after(
        two, days, keys, F.col("f.test_start_ms") + F.lit(test_days * DAY_MS), "test_end_ms", "left"
    )
    f, d = three.alias("f"), days.alias("d")
    cond = [F.col(f"f.{k}") == F.col(f"d.{k}") for k in keys] + [
        F.col("d.day") >= F.col("f.test_start_ms"),
        F.col("f.test_end_ms").isNull() | (F.col("d.day") < F.col("f.test_end_ms")),
    ]
    sized = f.join(d, cond).groupBy(*[F.col(f"f.{c}").alias(c) for c in three.columns]).agg(F.count(F.lit(1)).alias("n_test"))
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("fold_id").rowsBetween(Window.unboundedPreceding, 0)
    return sized.withColumn("_ok", F.min((F.col("n_test") >= min_test).cast("int")).over(w)).where("_ok = 1").drop("_ok")


def fold_train_rows(series: DataFrame, folds: DataFrame) -> DataFrame:
    """(symbol, fold_id, train_end_idx, test_end_idx, n_bars): fold bounds as bar counts per symbol.

    Folds a symbol has no history for are skipped: fewer than two training
    bars, or no bar at or after the training end.
    """
    per = series.select("symbol", "open_time").join(F.broadcast(folds))
    agg = per.groupBy("symbol", "fold_id", "train_end_ms", "test_end_ms").agg(
        F.count(F.when(F.col("open_time") < F.col("train_end_ms"), 1)).alias("train_end_idx"),
        F.count(F.when(F.col("open_time") < F.col("test_end_ms"), 1)).alias("test_end_idx"),
        F.count(F.lit(1)).alias("n_bars"),
    )
    ok = (F.col("train_end_idx") >= 2) & (F.col("train_end_idx") < F.col("n_bars")) & (F.col("test_end_idx") > F.col("train_end_idx"))
    return agg.where(ok)


def test_slices(series: DataFrame, bounds: DataFrame) -> DataFrame:
    """Bars of each fold's test slice, both boundary bars included, with the slice-local index."""
    joined = series.join(bounds.select("symbol", "fold_id", "train_end_idx", "test_end_idx"), "symbol")
    rows = joined.where(F.col("bar_idx").between(F.col("train_end_idx"), F.col("test_end_idx")))
    return rows.withColumn("slice_idx", F.col("bar_idx") - F.col("train_end_idx")).drop("train_end_idx", "test_end_idx")


def selection_rows(series: DataFrame, bounds: DataFrame, embargo: int = 0) -> DataFrame:
    """Bars a fold may select on: idx < max(2, train_end - embargo)."""
    cut = F.greatest(F.lit(2), F.col("train_end_idx") - embargo)
    joined = series.join(bounds.select("symbol", "fold_id", "train_end_idx"), "symbol")
    return joined.where(F.col("bar_idx") < cut).drop("train_end_idx")
