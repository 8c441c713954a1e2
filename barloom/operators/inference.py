"""Multiple-testing statistics over candidate return streams."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import performance as pf
from ..functions.normal import norm_cdf, norm_ppf
from . import paths
from . import resample as rs

EULER_GAMMA = 0.5772156649015329
E_CONST = 2.718281828459045


def _group_moments(returns: DataFrame, keys: Sequence[str]) -> DataFrame:
    return returns.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("sd"), pf.skew().alias("skew"), pf.raw_kurtosis().alias("kurt")
    )


def reality_check(streams: DataFrame, keys: Sequence[str], series: str, reps: int, block: int, ppy: int = 365, studentised: bool = False) -> DataFrame:
    """Max-statistic bootstrap against the 'no skill anywhere' null.

    All series of a key are aligned, so one index set per (key, replicate)
    preserves their correlation.  Plain: maximum Sharpe of the demeaned
    resample.  Studentised: maximum sqrt(n) mean / original sd, flat series
    excluded.
    """
    obs = streams.groupBy(*keys, series).agg(F.count(F.lit(1)).alias("n"), F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("sd"))
    if studentised:
        obs = obs.where("sd > 0").withColumn("stat", F.sqrt(F.col("n").cast("double")) * F.col("mean") / F.col("sd"))
    else:
        obs = obs.withColumn("stat", pf.sharpe(F.col("mean"), F.col("sd"), F.col("n"), ppy))
    best = obs.groupBy(*keys).agg(F.max("stat").alias("best"), F.count(F.lit(1)).alias("n_series"))
    sizes = obs.groupBy(*keys).agg(F.max("n").alias("n"))
    centred = rs.numbered(streams, [*keys, series]).join(obs.select(*keys, series, "mean"), [*keys, series]).join(sizes, list(keys))
    centred = centred.select(*keys, series, F.col("i").alias("idx"), (F.col("ret") - F.col("mean")).alias("x"), "n")
    sums = paths.drawn_sums(centred, keys, series, reps, block).join(obs.select(*keys, series, "n", F.col("sd").alias("sd0")), [*keys, series])
    m = F.col("s1") / F.col("n")
    if studentised:
        stat = F.sqrt(F.col("n").cast("double")) * m / F.col("sd0")
    else:
        var = (F.col("s2") - F.col("n") * m * m) / (F.col("n") - 1)
        stat = F.when(var <= 1e-10 * m * m, F.lit(0.0)).otherwise(m / F.sqrt(var) * float(ppy) ** 0.5)
    tops = sums.withColumn("stat", stat).groupBy(*keys, "rep").agg(F.max("stat").alias("top"))
    counted = tops.join(best, list(keys)).groupBy(*keys).agg(
        F.max("best").alias("best"), F.max("n_series").alias("n_series"), F.count(F.when(F.col("top") >= F.col("best"), 1)).alias("exceed"), F.count(F.lit(1)).alias("reps")
    )
    return counted.withColumn("p_value", rs.finite_p(F.col("exceed"), F.col("reps")))


def psr_z(sharpe_period: Column, benchmark_period: Column, n: Column, skew: Column, kurt: Column) -> Column:
    """z of the probabilistic Sharpe; NULL where the probability is 0.5 by convention."""
    denom = F.lit(1.0) - skew * sharpe_period + (kurt - 1.0) / 4.0 * sharpe_period * sharpe_period
    return F.when((n >= 4) & (denom > 0), (sharpe_period - benchmark_period) * F.sqrt(n - 1) / F.sqrt(denom))


def psr(returns: DataFrame, keys: Sequence[str], ppy: int = 365, benchmark: DataFrame | None = None) -> DataFrame:
    """(keys, n, z, psr) against zero, or against `benchmark(keys, benchmark_sharpe)` (annual)."""
    m = _group_moments(returns, keys)
    m = m.withColumn("benchmark_sharpe", F.lit(0.0)) if benchmark is None else m.join(benchmark, list(keys))
    per = F.when((F.col("n") < 2) | (F.col("sd") == 0), F.lit(0.0)).otherwise(F.col("mean") / F.col("sd"))
    z = psr_z(per, F.col("benchmark_sharpe") / float(ppy) ** 0.5, F.col("n"), F.col("skew"), F.col("kurt"))
    staged = m.withColumn("z", z)
    return staged.withColumn("psr", F.coalesce(norm_cdf(F.col("z")), F.lit(0.5))).drop("mean", "sd", "skew", "kurt")


def expected_max_sharpe(trials: DataFrame, keys: Sequence[str], n_trials: Column | None = None) -> DataFrame:
    """(keys, benchmark_sharpe, n_trials): expected best annual Sharpe of N unskilled trials.

    `trials(keys, sharpe)`; N defaults to the number of trials.
    """
    agg = trials.groupBy(*keys).agg(F.var_samp("sharpe").alias("v"), F.count("sharpe").alias("k"))
    staged = agg.withColumn("n_trials", F.col("k") if n_trials is None else n_trials)
    usable = (F.col("n_trials") >= 2) & (F.col("k") >= 2) & (F.col("v") > 0)
    n = F.col("n_trials").cast("double")
    staged = staged.withColumns({"z1": norm_ppf(F.lit(1.0) - F.lit(1.0) / n), "z2": norm_ppf(F.lit(1.0) - F.lit(1.0) / (n * E_CONST))})
    value = F.sqrt("v") * (F.lit(1.0 - EULER_GAMMA) * F.col("z1") + F.lit(EULER_GAMMA) * F.col("z2"))
    return staged.select(*keys, F.when(usable, value).otherwise(F.lit(0.0)).alias("benchmark_sharpe"), F.col("n_trials").cast("bigint").alias("n_trials"))


def dsr(returns: DataFrame, trials: DataFrame, keys: Sequence[str], ppy: int = 365, n_trials: Column | None = None) -> DataFrame:
    """Deflated Sharpe: psr against the expected maximum of the trials."""
    bench = expected_max_sharpe(trials, keys, n_trials)
    return psr(returns, keys, ppy, bench).withColumnRenamed("psr", "dsr")


def selection_adjusted(returns: DataFrame, ledger: DataFrame, pool: DataFrame, keys: Sequence[str], ppy: int = 365) -> DataFrame:
    """PSR plus a DSR against the largest search that really happened.

    ledger(keys, sharpe nullable) holds the search entries; pool(keys,
    pool_size, prespecified).  The DSR is withheld, with a reason, when no
    search is recorded or fewer than two trial Sharpes exist; pre-specified
    rows count as one trial.
    """
    counts = ledger.groupBy(*keys).agg(F.count(F.lit(1)).alias("ledger_n"), F.count("sharpe").alias("n_sharpes"))
    facts = pool.join(counts, list(keys), "left").withColumns(
        {"ledger_n": F.coalesce("ledger_n", F.lit(0)), "n_sharpes": F.coalesce("n_sharpes", F.lit(0))}
    )
    facts = facts.withColumn("n_trials", F.greatest("ledger_n", "pool_size"))
    sized = ledger.join(facts.select(*keys, "n_trials"), list(keys))
    bench = sized.groupBy(*keys).agg(F.var_samp("sharpe").alias("v"), F.count("sharpe").alias("k"), F.max("n_trials").alias("n_trials"))
    n = F.col("n_trials").cast("double")
    bench = bench.withColumns({"z1": norm_ppf(F.lit(1.0) - F.lit(1.0) / n), "z2": norm_ppf(F.lit(1.0) - F.lit(1.0) / (n * E_CONST))})
    value = F.sqrt("v") * (F.lit(1.0 - EULER_GAMMA) * F.col("z1") + F.lit(EULER_GAMMA) * F.col("z2"))
    bench = bench.select(*keys, F.when((F.col("k") >= 2) & (F.col("v") > 0) & (n >= 2), value).otherwise(F.lit(0.0)).alias("benchmark_sharpe"))
    base = psr(returns, keys, ppy).select(*keys, "psr")
    deflated = psr(returns, keys, ppy, bench).select(*keys, F.col("psr").alias("_dsr"), "benchmark_sharpe")
    joined = base.join(facts, list(keys)).join(deflated, list(keys), "left")
    reason = F.when(F.col("prespecified"), F.lit(None)).when(F.col("n_trials") <= 1, "no search history").when(F.col("n_sharpes") < 2, "fewer than two trial Sharpes")
    value = F.when(F.col("prespecified"), F.col("psr")).when(reason.isNull(), F.col("_dsr"))
    return joined.select(
        *keys, "psr", value.alias("dsr"), reason.alias("reason"),
        F.when(F.col("prespecified"), F.lit(1)).otherwise(F.col("n_trials")).cast("bigint").alias("n_trials"),
        F.when(F.col("prespecified"), F.lit(0.0)).when(reason.isNull(), F.col("benchmark_sharpe")).alias("benchmark_sharpe"),
    )


def holm(tests: DataFrame, keys: Sequence[str], alpha: Column | float) -> DataFrame:
    """Step-down family-wise decision: (.., rank, threshold, rejected)."""
    order = Window.partitionBy(*keys).orderBy("p_value", "arm_id")
    m = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    alpha = F.lit(alpha) if isinstance(alpha, float) else alpha
    staged = tests.withColumns({"rank": F.row_number().over(order) - 1, "_m": m})
    staged = staged.withColumn("threshold", alpha / (F.col("_m") - F.col("rank")))
    passed = F.min((F.col("p_value") <= F.col("threshold")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return staged.withColumn("rejected", passed == 1).drop("_m")


def bayesian_sharpe(returns: DataFrame, keys: Sequence[str], draws: int, ppy: int = 365, seed: int = 42, benchmark: float = 0.0) -> DataFrame:
    """Posterior of the annual Sharpe under a Jeffreys prior, `draws` samples per stream.

    One row per (stream, draw chunk) is sampled in Arrow batches with a
    generator seeded by the chunk, so results do not depend on partitioning.
    """
    stats = returns.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("ret").alias("mean"), F.var_samp("ret").alias("v")).where("n >= 3")
    chunk = 1000
    tasks = stats.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit((draws - 1) // chunk)))).withColumn("h", F.crc32(F.concat_ws("|", *keys)))
    schema = ", ".join(f"{k} {dict(stats.dtypes)[k]}" for k in keys) + ", n bigint, sample double"

    def sample(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                rng = np.random.default_rng([seed, int(row.h), int(row.chunk)])
                size = min(chunk, draws - int(row.chunk) * chunk)
                g = rng.chisquare(row.n - 1, size)
                sigma2 = (row.n - 1) * row.v / g
                mu = rng.normal(row.mean, np.sqrt(sigma2 / row.n))
                value = mu / np.sqrt(sigma2) * np.sqrt(ppy) if row.v > 1e-24 else np.zeros(size)  # no dispersion: no Sharpe
                yield pd.DataFrame({**{k: getattr(row, k) for k in keys}, "n": row.n, "sample": value})

    samples = tasks.mapInPandas(sample, schema)
    agg = samples.groupBy(*keys).agg(
        F.max("n").alias("n"), F.avg("sample").alias("posterior_mean"), F.sort_array(F.collect_list("sample")).alias("_s"),
        F.avg((F.col("sample") > benchmark).cast("double")).alias("prob_above"), F.count(F.lit(1)).alias("draws"),
    )
    from ..functions.numeric import order_stat

    return agg.select(
        *keys, "n", "draws", "posterior_mean", order_stat(F.col("_s"), 0.05).alias("ci_low"), order_stat(F.col("_s"), 0.95).alias("ci_high"),
        order_stat(F.col("_s"), 0.5).alias("median"), "prob_above",
    )
