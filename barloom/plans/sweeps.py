"""Sensitivity sweeps and ablations over walk-forward selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import accounting as ac
from ..functions import performance as pf
from ..functions import weights as wt
from . import walkforward as wf
from .candidates import Spec, trend_vol

# The swept levels.
LOOKBACKS, TARGETS = [25, 50, 75, 100, 150, 200], [0.20, 0.30, 0.40]
COST_BPS = [5, 10, 20, 50, 100]
LATENCIES = [0, 1, 2]
MODES = ["close", "next_open"]


def grid_pool() -> list[Spec]:
    return [trend_vol(n, t) for n in LOOKBACKS for t in TARGETS]


def grid_metrics(streams: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Zero-rate summary of a stitched stream, days counted as rows."""
    return pf.summary(streams, list(keys), 365, 0.0)


def cost_levels(features: DataFrame, pool: list[Spec], bounds: DataFrame, setup: wf.Setup, levels: Sequence[float]) -> DataFrame:
    """Re-select and trade at every friction level: (level, symbol, fold_id, day, ret, w, traded).

    A session's return is linear in the cost rate, ret(c) = r0 - c q, so one
    frictionless accounting pass gives the training moments of every level:
    sums of r0, q, r0^2, r0 q and q^2.
    """
    free = setup.with_(cost_rate=0.0)
    streams = wf.training_streams(features, pool, free, bounds, with_drag=True)
    x, q = F.col("ret"), F.col("drag")
    sums = (
        streams.groupBy("symbol", "pool_idx", "tag")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(x).alias("x"), F.sum(q).alias("q"), F.sum(x * x).alias("xx"), F.sum(x * q).alias("xq"), F.sum(q * q).alias("qq"))
    )
    b = bounds.select(F.col("symbol").alias("bs"), "fold_id")
    prefix = sums.join(b, (F.col("symbol") == F.col("bs")) & (F.col("tag") <= F.col("fold_id"))).groupBy("symbol", "fold_id", "pool_idx").agg(
        *[F.sum(c).alias(c) for c in ("n", "x", "q", "xx", "xq", "qq")]
    )
    each = prefix.withColumn("level", F.explode(F.array(*[F.lit(float(v)) for v in levels])))
    c, n = F.col("level"), F.col("n")
    mean = (F.col("x") - c * F.col("q")) / n
    m2 = (F.col("xx") - 2 * c * F.col("xq") + c * c * F.col("qq")) / n - mean * mean
    sd = F.sqrt(m2 * n / (n - 1))
    score = F.when((n < 2) | (m2 <= 1e-10 * mean * mean), F.lit(0.0)).otherwise((mean - setup.rf / setup.ppy) / sd * float(setup.ppy) ** 0.5)
    scored = each.where("n >= 2").select("level", "symbol", "fold_id", "pool_idx", F.round(score, wf.SCORE_DIGITS).alias("sharpe"))
    picks = wf.argmax(scored, ["level", "symbol", "fold_id"]).select("level", "symbol", "fold_id", "pool_idx")
    return trade_keyed(features, pool, bounds, picks, "level", setup, cost=F.col("level"))


def trade_keyed(features: DataFrame, pool: list[Spec], bounds: DataFrame, picks: DataFrame, key: str, setup: wf.Setup, cost=None) -> DataFrame:
    """Trade several pick tables at once; `key` names the variant."""
    joined = wf.test_rows(features, pool, bounds).withColumn("ws", wt.pool_weights(pool, F.col("slice_idx"))).join(picks, ["symbol", "fold_id"])
    rows = joined.withColumn("weight", F.element_at(F.col("ws"), F.col("pool_idx") + 1))
    keep = [key, "symbol", "fold_id", "pool_idx", "open_time", "slice_idx", "open", "close", "prev_close", "weight"]
    out = ac.account(
        rows.select(*keep), [key, "symbol", "fold_id"], setup.cost_rate, setup.rf, setup.ppy, setup.execution, setup.latency, "slice_idx", cost
    )
    return out.select(key, "symbol", "fold_id", "pool_idx", F.col("open_time").alias("day"), "ret", "w", "traded")


def variants(features: DataFrame, pool: list[Spec], bounds: DataFrame, setups: dict[str, wf.Setup], key: str) -> DataFrame:
    """Re-select and trade under several setups that change the streams themselves (latency, execution)."""
    out = None
    for label, setup in setups.items():
        picks = wf.select_argmax(features, pool, bounds, setup).select("symbol", "fold_id", "pool_idx")
        part = wf.picked_streams(features, pool, bounds, picks, setup).withColumn(key, F.lit(label))
        out = part if out is None else out.unionByName(part)
    return out


def family_ablation(features: DataFrame, pool: list[Spec], bounds: DataFrame, setup: wf.Setup) -> DataFrame:
    """Streams with one family omitted at a time ('none' = full pool); scores are computed once."""
    spark = features.sparkSession
    members = spark.createDataFrame([(i, s.family) for i, s in enumerate(pool)], "pool_idx int, family string")
    omitted = members.select(F.col("family").alias("omitted")).distinct().unionByName(spark.createDataFrame([("none",)], "omitted string"))
    scores = wf.train_scores(features, pool, bounds, setup).join(F.broadcast(members), "pool_idx")
    each = scores.join(F.broadcast(omitted), F.col("family") != F.col("omitted")).select("omitted", "symbol", "fold_id", "pool_idx", "sharpe")
    picks = wf.argmax(each, ["omitted", "symbol", "fold_id"]).select("omitted", "symbol", "fold_id", "pool_idx")
    return trade_keyed(features, pool, bounds, picks, "omitted", setup)


def grid_stability(grid: DataFrame, keys: Sequence[str], metric: str = "sharpe") -> DataFrame:
    """Spread and neighbour roughness of a (lookback, target) grid per key: 18 cells each."""
    v = F.col(metric)
    down = F.lead(metric).over(Window.partitionBy(*keys, "target").orderBy("lookback"))
    right = F.lead(metric).over(Window.partitionBy(*keys, "lookback").orderBy("target"))
    staged = grid.withColumns({"d1": F.abs(down - v), "d2": F.abs(right - v), "_max": F.max(metric).over(Window.partitionBy(*keys))})
    agg = staged.groupBy(*keys).agg(
        F.min(metric).alias("min"), F.sort_array(F.collect_list(metric)).alias("_s"), F.max(metric).alias("max"),
        F.avg((v >= 0.5 * F.col("_max")).cast("double")).alias("share_above_half_max"),
        F.try_divide(F.coalesce(F.sum("d1"), F.lit(0.0)) + F.coalesce(F.sum("d2"), F.lit(0.0)), F.count("d1") + F.count("d2")).alias("mean_neighbor_delta"),
    )
    mid = F.element_at("_s", (F.floor(F.size("_s") / 2) + 1).cast("int"))
    return agg.select(*keys, "min", mid.alias("median"), "max", "share_above_half_max", F.coalesce("mean_neighbor_delta", F.lit(0.0)).alias("mean_neighbor_delta"))
