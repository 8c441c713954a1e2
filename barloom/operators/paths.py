"""Resampled paths as arrays: many replicates of one stream in a task, one row per replicate out.

A stream has at most one return per calendar day, so it travels as one array.
A row of work is (stream, block of replicates); its draws come from the same
counter hashing as the index tables of `resample`, evaluated for the whole
block at once, and equity and drawdown are running products over an axis.  No
row per (replicate, day) exists and nothing is sorted per replicate.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import MODULUS, POS_MUL, REP_MUL, ROUNDS, SEED_MUL
from .resample import SEED_RESTART, SEED_SHUFFLE, SEED_START

CELLS = 200_000  # replicates times days of a row of work


def mix_of(seed: int, rep: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """`functions.hashing.mix` over arrays: all products stay inside 64 bits."""
    x = (seed * SEED_MUL + rep.astype(np.int64) * REP_MUL + pos.astype(np.int64) * POS_MUL + 1) % MODULUS
    for c in ROUNDS:
        x = (x * x + x * c + 12345 + c) % MODULUS
    return x


def uniform_of(seed: int, rep: np.ndarray, pos: np.ndarray) -> np.ndarray:
    return mix_of(seed, rep, pos) / float(MODULUS)


def stationary_draws(n: int, reps: np.ndarray, block: int, emit: int | None = None, seed: int = 0) -> np.ndarray:
    """Positions drawn by each replicate, one row each: geometric blocks."""
    pos = np.arange(n if emit is None else emit)
    rep = reps[:, None]
    restart = uniform_of(SEED_RESTART + seed, rep, pos) < 1.0 / block
    restart[:, 0] = True
    start = np.floor(uniform_of(SEED_START + seed, rep, pos) * n).astype(np.int64)
    last = np.maximum.accumulate(np.where(restart, pos, 0), axis=1)
    return (np.take_along_axis(start, last, axis=1) + pos - last) % n


def circular_draws(n: int, reps: np.ndarray, block: int, seed: int = 1) -> np.ndarray:
    pos = np.arange(n)
    start = np.floor(uniform_of(SEED_START + seed, reps[:, None], pos // block) * n).astype(np.int64)
    return (start + pos % block) % n


def moving_draws(n: int, reps: np.ndarray, block: int, seed: int = 2) -> np.ndarray:
    pos = np.arange(n)
    start = np.floor(uniform_of(SEED_START + seed, reps[:, None], pos // block) * max(1, n - block + 1)).astype(np.int64)
    return np.minimum(start + pos % block, n - 1)


def shuffle_draws(n: int, reps: np.ndarray) -> np.ndarray:
    """A permutation per replicate: positions in the order of their hash, ties by position."""
    pos = np.arange(n)
    return np.argsort(mix_of(SEED_SHUFFLE, reps[:, None], pos), axis=1, kind="stable")


def path_measures(paths: np.ndarray, ppy: int = 365) -> dict[str, np.ndarray]:
    """final, cagr, sharpe (no risk-free rate), max_drawdown and share of days under water of each row."""
    n = paths.shape[1]
    equity = np.cumprod(1.0 + paths, axis=1)
    peak = np.maximum(1.0, np.maximum.accumulate(equity, axis=1))
    final = equity[:, -1]
    mean = paths.mean(axis=1)
    sd = paths.std(axis=1, ddof=1) if n > 1 else np.zeros(len(paths))
    with np.errstate(invalid="ignore", divide="ignore"):
        return {
            "final": final,
            "cagr": np.where(final == 0, -1.0, np.power(final, 365.0 / n) - 1.0),
            "sharpe": np.where(sd == 0, 0.0, mean / sd * np.sqrt(float(ppy))),
            "max_drawdown": np.minimum(0.0, (equity / peak - 1.0).min(axis=1)),
            "tuw": (equity < peak).mean(axis=1),
        }


MEASURES = ["final", "cagr", "sharpe", "max_drawdown", "tuw"]


def loss_shares(horizon: int) -> Callable[[np.ndarray], dict[str, np.ndarray]]:
    """Share of windows of `horizon` days that lose; none for a shorter path."""

    def measure(paths: np.ndarray) -> dict[str, np.ndarray]:
        if paths.shape[1] < horizon:
            return {"q": np.full(len(paths), np.nan)}
        windows = np.lib.stride_tricks.sliding_window_view(1.0 + paths, horizon, axis=1)
        return {"q": np.array([(row.prod(axis=1) < 1.0).mean() for row in windows])}

    return measure


def replicate(
    returns: DataFrame, keys: Sequence[str], reps: int, draws: Callable[[int, np.ndarray], np.ndarray],
    measures: Callable[[np.ndarray], dict[str, np.ndarray]] = path_measures, names: Sequence[str] = tuple(MEASURES), emit: int | None = None,
) -> DataFrame:
    """(keys, rep, measures) of `reps` resampled paths of every stream of `returns(keys, day, ret)`.

    `draws(n, reps)` gives the positions of each replicate, a row each.
    """
    whole = returns.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("day", "ret"))).alias("_s")).withColumn("_x", F.col("_s.ret")).drop("_s")
    days = F.size("_x") if emit is None else F.lit(emit)
    step = F.greatest(F.lit(1), F.least(F.lit(reps), F.floor(F.lit(CELLS) / days)))
    work = whole.withColumn("_n", step.cast("int")).withColumn("_lo", F.explode(F.sequence(F.lit(0), F.lit(reps - 1), F.col("_n"))))
    kinds = dict(returns.dtypes)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                x = np.asarray(row[len(keys)], dtype=float)
                lo, n = int(row[len(keys) + 2]), int(row[len(keys) + 1])
                block = np.arange(lo, min(reps, lo + n))
                out = measures(x[draws(len(x), block)])
                named = {k: pd.Series([row[j]] * len(block), dtype=object if kinds[k] == "string" else None) for j, k in enumerate(keys)}
                yield pd.DataFrame(named | {"rep": block} | {k: out[k] for k in names})

    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", rep int, " + ", ".join(f"{k} double" for k in names)
    # the rows of work are few and heavy: deal them out one by one
    return work.select(*keys, "_x", "_n", "_lo").repartition(*keys, "_lo").mapInPandas(run, schema)


def drawn_sums(centred: DataFrame, keys: Sequence[str], series: str, reps: int, block: int, width: int = 256) -> DataFrame:
    """(keys, rep, series, s1, s2): sums and sums of squares of each series over the days each replicate draws.

    `centred(keys, series, idx, x, n)` is cut into blocks of `width` positions.
    A block of a key is one matrix product: how often each replicate draws each
    day, times the series on those days; Spark adds up the blocks.
    """
    kinds = dict(centred.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + f", rep int, {series} {kinds[series]}, s1 double, s2 double"

    def product(frame: pd.DataFrame) -> pd.DataFrame:
        n, lo = int(frame["n"].iloc[0]), int(frame["_block"].iloc[0]) * width
        wide = frame.pivot_table(index="idx", columns=series, values="x", aggfunc="sum", fill_value=0.0)
        at, x = wide.index.to_numpy() - lo, wide.to_numpy()
        size = min(width, n - lo)
        counts = np.zeros((reps, size))
        step = max(1, 2_000_000 // n)
        for first in range(0, reps, step):
            some = np.arange(first, min(reps, first + step))
            drawn = stationary_draws(n, some, block) - lo
            hit = (drawn >= 0) & (drawn < size)
            row = np.broadcast_to(np.arange(len(some))[:, None], drawn.shape)[hit]
            counts[some] = np.bincount(row * size + drawn[hit], minlength=len(some) * size).reshape(len(some), size)
        c = counts[:, at]
        s1, s2 = c @ x, c @ (x * x)
        names = wide.columns.to_numpy()
        out = {k: [frame[k].iloc[0]] * s1.size for k in keys} | {"rep": np.repeat(np.arange(reps), len(names)), series: np.tile(names, reps), "s1": s1.ravel(), "s2": s2.ravel()}
        return pd.DataFrame({k: pd.Series(v, dtype=object) if kinds.get(k) == "string" else v for k, v in out.items()})

    blocked = centred.withColumn("_block", F.floor(F.col("idx") / width))
    parts = blocked.groupBy(*keys, "_block").applyInPandas(product, schema)
    return parts.groupBy(*keys, "rep", series).agg(F.sum("s1").alias("s1"), F.sum("s2").alias("s2"))
