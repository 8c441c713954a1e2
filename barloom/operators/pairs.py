"""Pairwise products of aligned series, without emitting pairs per day."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_DAYS = 256


def common_days(streams: DataFrame, series: str = "series_id") -> DataFrame:
    """Rows on days every series has (two aggregates and a semi join)."""
    total = streams.agg(F.countDistinct(series).alias("n_all"))  # one row
    full = streams.groupBy("day").agg(F.countDistinct(series).alias("n")).join(F.broadcast(total)).where("n = n_all")
    return streams.join(F.broadcast(full.select("day")), "day", "left_semi")


def pair_moments(streams: DataFrame, tiles: int = 1, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, a, b, n, sa, sb, saa, sbb, sab) of all unordered pairs of aligned series.

    Days are cut into blocks and series into `tiles` hash tiles; each task
    holds one block of two tiles as a dense matrix and emits one partial Gram
    entry per pair *and block* - a factor BLOCK_DAYS fewer rows than a
    self-join on the day - which Spark then sums.
    """
    tile = F.pmod(F.xxhash64("series_id"), F.lit(tiles)).cast("int")
    every = F.sequence(F.lit(0), F.lit(tiles - 1))
    rows = streams.select(
        *keys, "series_id", "day", "ret", tile.alias("t"), F.explode(every).alias("o"),
        F.floor(F.col("day") / F.lit(BLOCK_DAYS * 86_400_000)).alias("block"),
    ).select(*keys, "series_id", "day", "ret", "t", "block", F.least("t", "o").alias("ti"), F.greatest("t", "o").alias("tj"))

    def gram(pdf: pd.DataFrame) -> pd.DataFrame:
        ti, tj = int(pdf["ti"].iloc[0]), int(pdf["tj"].iloc[0])
        wide = pdf.pivot_table(index="day", columns="series_id", values="ret", aggfunc="first")
        names = wide.columns.to_numpy()
        home = pdf.drop_duplicates("series_id").set_index("series_id")["t"].reindex(names).to_numpy()
        x = wide.to_numpy()
        prod = x.T @ x
        s = x.sum(axis=0)
        ii, jj = np.triu_indices(len(names), k=1)
        # a pair belongs to exactly one tile pair
        keep = (np.minimum(home[ii], home[jj]) == ti) & (np.maximum(home[ii], home[jj]) == tj)
        ii, jj = ii[keep], jj[keep]
        d = np.diag(prod)
        head = {k: pdf[k].iloc[0] for k in keys}
        out = pd.DataFrame(
            {"a": names[ii], "b": names[jj], "n": len(x), "sa": s[ii], "sb": s[jj], "saa": d[ii], "sbb": d[jj], "sab": prod[ii, jj]}
        )
        return out.assign(**head)[[*keys, *out.columns]]

    schema = "".join(f"{k} {dict(streams.dtypes)[k]}, " for k in keys) + "a string, b string, n bigint, sa double, sb double, saa double, sbb double, sab double"
    partial = rows.groupBy(*keys, "block", "ti", "tj").applyInPandas(gram, schema)
    return partial.groupBy(*keys, "a", "b").agg(*[F.sum(c).alias(c) for c in ("n", "sa", "sb", "saa", "sbb", "sab")])


def correlation() -> Column:
    """Pearson coefficient from the moments; 0 when a side has no variance."""
    n = F.col("n")
    va = n * F.col("saa") - F.col("sa") * F.col("sa")
    vb = n * F.col("sbb") - F.col("sb") * F.col("sb")
    flat = (va <= n * F.col("saa") * 1e-13) | (vb <= n * F.col("sbb") * 1e-13)
    cov = n * F.col("sab") - F.col("sa") * F.col("sb")
    return F.when(flat, F.lit(0.0)).otherwise(cov / F.sqrt(va * vb))


def pairwise_corr(streams: DataFrame, tiles: int = 1, keys: tuple[str, ...] = ()) -> DataFrame:
    return pair_moments(streams, tiles, keys).select(*keys, "a", "b", "n", correlation().alias("rho"))
