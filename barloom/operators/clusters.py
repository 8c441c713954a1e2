"""Clusters of correlated strategies and the effective number of trials."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_dir


def near_duplicates(pairs: DataFrame, threshold: float = 0.995) -> DataFrame:
    return pairs.where(F.abs("rho") >= threshold)


def single_linkage(nodes: DataFrame, pairs: DataFrame, keys: Sequence[str], threshold: float = 0.90) -> DataFrame:
    """(keys, node, cluster): connected components of |rho| >= threshold, named by the smallest member.

    Each round takes the smallest label among the neighbours and then follows
    the label of the label (pointer jumping), so long chains need logarithmic
    rounds.  Every round is checkpointed to the shared folder, which keeps the
    plan short and lets a lost executor re-read it.
    """
    spark = nodes.sparkSession
    checkpoint_dir(spark)
    keys = list(keys)
    strong = pairs.where(F.abs("rho") >= threshold)
    edges = strong.select(*keys, F.col("a").alias("node"), F.col("b").alias("other")).unionByName(
        strong.select(*keys, F.col("b").alias("node"), F.col("a").alias("other"))
    ).checkpoint()
    labels = nodes.select(*keys, "node", F.col("node").alias("label")).checkpoint()
    while True:
        around = edges.join(labels.withColumnRenamed("node", "other"), [*keys, "other"]).groupBy(*keys, "node").agg(F.min("label").alias("near"))
        stepped = labels.join(around, [*keys, "node"], "left").select(
            *keys, "node", "label", F.least("label", F.coalesce("near", "label")).alias("next")
        )
        jump = stepped.select(*keys, F.col("node").alias("next"), F.col("next").alias("far"))
        moved = stepped.join(jump, [*keys, "next"], "left").select(
            *keys, "node", F.least("next", F.coalesce("far", "next")).alias("new"), "label"
        ).checkpoint()
        changed = moved.where("new <> label").limit(1).count()
        labels = moved.select(*keys, "node", F.col("new").alias("label"))
        if not changed:
            break
    return labels.withColumnRenamed("label", "cluster")


def effective_trials(nodes: DataFrame, pairs: DataFrame, clusters: DataFrame, keys: Sequence[str]) -> DataFrame:
    """n, clusters, mean correlation and n / (1 + (n-1) max(rho, 0)) per key."""
    n = nodes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_strategies"))
    rho = pairs.groupBy(*keys).agg(F.avg("rho").alias("avg_pairwise_corr"))
    k = clusters.groupBy(*keys).agg(F.countDistinct("cluster").alias("n_clusters"))
    joined = n.join(k, list(keys)).join(rho, list(keys), "left").withColumn("avg_pairwise_corr", F.coalesce("avg_pairwise_corr", F.lit(0.0)))
    spread = F.col("n_strategies") / (F.lit(1.0) + (F.col("n_strategies") - 1) * F.greatest(F.col("avg_pairwise_corr"), F.lit(0.0)))
    return joined.withColumn("n_effective", F.when(F.col("n_strategies") < 2, F.col("n_strategies").cast("double")).otherwise(spread))
