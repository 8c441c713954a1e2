"""Order-dependent columns over keys of unbounded size.

A window partitioned by the key alone would put all rows of a hot key into one
task.  These helpers cut the key's sequence into chunks of the ordering column,
work inside (key, chunk), and carry only one boundary row per chunk across.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK_ROWS = 100_000


def seq_chunk(seq: str, rows: int = CHUNK_ROWS) -> Column:
    """Chunk number of a dense integer sequence column."""
    return F.floor(F.col(seq) / F.lit(rows)).cast("bigint")


def null_safe_join(rows: DataFrame, parts: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """Join on columns in which NULL is a value like any other; the columns of `rows` stay."""
    named = parts.withColumnsRenamed({c: f"_j_{c}" for c in by})
    same = [rows[c].eqNullSafe(named[f"_j_{c}"]) for c in by]
    return rows.join(named, same, how).drop(*[f"_j_{c}" for c in by])


def _place(keys: list[str], chunk: Column) -> Column:
    """(keys, chunk) as one key: a struct equals another with NULL in the same fields, so rows dealt and sorted for the
    windows inside a chunk stay where they are when the chunk's carried value is joined to them."""
    return F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], chunk.alias("chunk"))


def _across(keys: list[str]):
    """The chunks of a key in order, over rows with the column `_at`."""
    return Window.partitionBy(*[F.col("_at")[f"k{i}"] for i in range(len(keys))] or [F.lit(0)]).orderBy(F.col("_at")["chunk"])


def lag_split(df: DataFrame, keys: list[str], order: list[str], values: dict[str, str], chunk: Column) -> DataFrame:
    """lag(values) over (keys, order), computed chunk by chunk.

    `values` maps output names to source columns.  `chunk` must be
    non-decreasing in `order`.
    """
    staged = df.withColumn("_at", _place(keys, chunk))
    inner = Window.partitionBy("_at").orderBy(*order)
    packed = F.struct(*[F.col(src).alias(name) for name, src in values.items()])
    carried = (
        staged.groupBy("_at")
        .agg(F.max_by(packed, F.struct(*order)).alias("_last"))
        .withColumn("_carry", F.lag("_last").over(_across(keys)))
        .drop("_last")
    )
    local = staged.withColumn("_lag", F.lag(packed).over(inner))
    joined = local.join(carried, "_at")
    prior = F.coalesce(F.col("_lag"), F.col("_carry"))
    return joined.select(*df.columns, *[prior[name].alias(name) for name in values])


def running_sum_split(df: DataFrame, keys: list[str], order: list[str], values: dict[str, str], chunk: Column, source: DataFrame | None = None) -> DataFrame:
    """Inclusive running sums over (keys, order), computed chunk by chunk.

    The totals of the chunks are taken from `source`, where the same rows are there before other steps.
    """
    place = _place(keys, chunk)
    inner = Window.partitionBy("_at").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = _across(keys).rowsBetween(Window.unboundedPreceding, -1)
    totals = (df if source is None else source).groupBy(place.alias("_at")).agg(*[F.sum(src).alias(f"_t_{name}") for name, src in values.items()])
    offsets = totals.select("_at", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0.0)).alias(f"_o_{n}") for n in values])
    local = df.withColumn("_at", place).select("*", *[F.sum(src).over(inner).alias(f"_r_{name}") for name, src in values.items()])
    joined = local.join(offsets, "_at")
    return joined.select(*df.columns, *[(F.col(f"_r_{n}") + F.col(f"_o_{n}")).alias(n) for n in values])


def max_before_split(df: DataFrame, keys: list[str], order: list[str], values: dict[str, str], chunk: Column) -> DataFrame:
    """Largest value of all earlier rows over (keys, order), NULL where there is none, computed chunk by chunk."""
    staged = df.withColumn("_at", _place(keys, chunk))
    inner = Window.partitionBy("_at").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = _across(keys).rowsBetween(Window.unboundedPreceding, -1)
    tops = staged.groupBy("_at").agg(*[F.max(src).alias(f"_t_{name}") for name, src in values.items()])
    carried = tops.select("_at", *[F.max(f"_t_{n}").over(before).alias(f"_o_{n}") for n in values])
    local = staged.select("*", *[F.max(src).over(inner).alias(f"_r_{name}") for name, src in values.items()])
    joined = local.join(carried, "_at")
    return joined.select(*df.columns, *[F.greatest(f"_r_{n}", f"_o_{n}").alias(n) for n in values])


def asof_split(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    time: str,
    values: list[str],
    bucket: int,
    strict: bool = True,
) -> DataFrame:
    """Backward as-of join: the last `right` row before (or at) each left time.

    Both sides share the columns `keys` and `time`.  They are unioned and the
    last right row is carried forward inside (keys, time bucket); one carried
    row per bucket crosses bucket borders, so a hot key is spread over buckets.
    """
    packed = F.struct(*values)
    side = 0 if strict else 1  # at equal times, right rows must sort after (strict) or before (not strict)
    lhs = left.withColumn("_rank", F.lit(side)).withColumn("_pack", F.lit(None).cast(right.select(packed.alias("p")).schema["p"].dataType))
    rhs = right.select(*keys, time, F.lit(1 - side).alias("_rank"), packed.alias("_pack"))
    both = lhs.unionByName(rhs, allowMissingColumns=True).withColumn("_at", _place(keys, F.floor(F.col(time) / F.lit(bucket)).cast("bigint")))
    inner = Window.partitionBy("_at").orderBy(time, "_rank").rowsBetween(Window.unboundedPreceding, 0)
    lasts = both.groupBy("_at").agg(
        F.max_by("_pack", F.when(F.col("_pack").isNotNull(), F.struct(time, "_rank"))).alias("_last")
    )
    outer = _across(keys).rowsBetween(Window.unboundedPreceding, -1)
    carry = lasts.select("_at", F.last("_last", ignorenulls=True).over(outer).alias("_carry"))
    local = both.withColumn("_seen", F.last("_pack", ignorenulls=True).over(inner)).where(F.col("_rank") == side)
    hit = F.coalesce(F.col("_seen"), F.col("_carry"))
    return local.join(carry, "_at").select(*left.columns, *[hit[v].alias(v) for v in values])
