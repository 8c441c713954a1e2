"""Block-bootstrap index tables and resampled streams.

Replicates are ordinary rows: an index table (keys, rep, pos, idx) is joined to
the numbered returns, and every statistic is a grouped aggregate over
(keys, rep).  No loop runs on the driver and nothing is drawn from a stateful
generator, so a lost task recomputes the same draw.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import performance as pf
from ..functions.hashing import mix, uniform
from ..functions.numeric import order_stat

SEED_RESTART, SEED_START, SEED_SHUFFLE = 11, 23, 37


def lengths(returns: DataFrame, keys: Sequence[str]) -> DataFrame:
    return returns.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def numbered(returns: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add i = 0-based position of each return in its stream."""
    w = Window.partitionBy(*keys).orderBy("day")
    return returns.withColumn("i", (F.row_number().over(w) - 1).cast("bigint"))


def _slots(sizes: DataFrame, reps: int, emit: Column) -> DataFrame:
    grid = sizes.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    return grid.withColumn("pos", F.explode(F.sequence(F.lit(0).cast("bigint"), emit - 1)))


def stationary(sizes: DataFrame, keys: Sequence[str], reps: int, block: int, emit: Column | None = None, seed: int = 0) -> DataFrame:
    """Geometric blocks with mean length `block` into a domain of n observations."""
    slots = _slots(sizes, reps, emit if emit is not None else F.col("n"))
    restart = (F.col("pos") == 0) | (uniform(SEED_RESTART + seed, F.col("rep"), F.col("pos")) < 1.0 / block)
    start = F.floor(uniform(SEED_START + seed, F.col("rep"), F.col("pos")) * F.col("n")).cast("bigint")
    w = Window.partitionBy(*keys, "rep").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(restart, F.struct(start.alias("s"), F.col("pos").alias("p"))), ignorenulls=True).over(w)
    staged = slots.withColumn("b", last)
    return staged.select(*keys, "rep", "pos", F.pmod(F.col("b.s") + F.col("pos") - F.col("b.p"), F.col("n")).alias("idx"))


def circular(sizes: DataFrame, keys: Sequence[str], reps: int, block: int, seed: int = 1) -> DataFrame:
    """Fixed-length wrap-around blocks."""
    slots = _slots(sizes, reps, F.col("n"))
    b = F.floor(F.col("pos") / block).cast("bigint")
    start = F.floor(uniform(SEED_START + seed, F.col("rep"), b) * F.col("n")).cast("bigint")
    return slots.select(*keys, "rep", "pos", F.pmod(start + F.col("pos") % block, F.col("n")).alias("idx"))


def moving(sizes: DataFrame, keys: Sequence[str], reps: int, block: int, seed: int = 2) -> DataFrame:
    """Fixed-length blocks from non-wrapping starts, clamped at the last observation."""
    slots = _slots(sizes, reps, F.col("n"))
    b = F.floor(F.col("pos") / block).cast("bigint")
    span = F.greatest(F.lit(1).cast("bigint"), F.col("n") - block + 1)
    start = F.floor(uniform(SEED_START + seed, F.col("rep"), b) * span).cast("bigint")
    return slots.select(*keys, "rep", "pos", F.least(start + F.col("pos") % block, F.col("n") - 1).alias("idx"))


def shuffled(sizes: DataFrame, keys: Sequence[str], reps: int) -> DataFrame:
    """A random permutation of each stream per replicate: rank by hash."""
    slots = _slots(sizes, reps, F.col("n"))
    w = Window.partitionBy(*keys, "rep").orderBy(mix(SEED_SHUFFLE, F.col("rep"), F.col("pos")), "pos")
    return slots.select(*keys, "rep", (F.row_number().over(w) - 1).cast("bigint").alias("pos"), F.col("pos").alias("idx"))


def resampled(index: DataFrame, returns: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, rep, pos, ret): the returns the index table points at."""
    src = numbered(returns, keys).select(*keys, F.col("i").alias("idx"), "ret")
    return index.join(src, [*keys, "idx"]).select(*[c for c in index.columns if c != "idx"], "ret")


def path_metrics(paths: DataFrame, keys: Sequence[str], ppy: int = 365) -> DataFrame:
    """Per replicate: cagr, sharpe (rf 0), max drawdown, time under water, final."""
    under = F.avg((F.col("equity") < F.col("peak")).cast("double"))
    return pf.summary(paths, [*keys, "rep"], ppy, 0.0, None, "pos", {"tuw": under})


def bands(metrics: DataFrame, keys: Sequence[str], wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """Order-statistic quantiles over replicates: {output: (metric, p)}; arrays hold one value per replicate."""
    used = sorted({m for m, _ in wanted.values()})
    agg = metrics.groupBy(*keys).agg(*[F.sort_array(F.collect_list(m)).alias(f"_{m}") for m in used])
    return agg.select(*keys, *[order_stat(F.col(f"_{m}"), p).alias(name) for name, (m, p) in wanted.items()])


def finite_p(exceed: Column, reps: Column | int) -> Column:
    """(exceed + 1) / (B + 1): never zero."""
    return (exceed + 1) / (F.lit(reps) + 1 if isinstance(reps, int) else reps + 1)
