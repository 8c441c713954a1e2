"""Walk-forward selection over a candidate pool as one Spark plan.

Training windows all start at bar 0, and weights are causal, so the training
slices of all folds are prefixes of a single accounting pass.  Each bar is
tagged with the first fold that may train on it, moments are summed per
(symbol, candidate, tag), and a fold's statistics are the sum of the tags up to
it - one pass instead of one per fold.

Test slices restart flat: the slice-local index drives the warm-up, the
full-history features are reused (see functions.weights).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import accounting as ac
from ..functions import indicators as ind
from ..functions import performance as pf
from ..functions import weights as wt
from ..operators import folds as fo
from ..sources.sinks import store
from .candidates import Spec, pool_features

BAR_COLUMNS = ["symbol", "open_time", "bar_idx", "open", "close", "prev_close", "prev_time"]
SCORE_DIGITS = 9  # scores equal to 9 decimals count as ties, which the pool order decides


@dataclass(frozen=True)
class Setup:
    """Costs and conventions of a walk-forward run."""

    cost_rate: float = 0.002
    rf: float = 0.03
    ppy: int = 365
    execution: str = "next_open"
    latency: int = 0
    embargo: int = 30
    band: float = 0.0  # targets within the band around the held weight are not traded

    def with_(self, **changes) -> Setup:
        return replace(self, **changes)


def _macd_sets(pool: Sequence[Spec]) -> list[tuple]:
    return [f[1:] for f in pool_features(pool) if f[0] == "macd"]


def featured(bars: DataFrame, pool: Sequence[Spec]) -> DataFrame:
    """Bars with every feature the pool needs (recurrent MACD columns are added per slice later)."""
    return ind.add_features(ind.series(bars), pool_features(pool))


def with_macd(rows: DataFrame, pool: Sequence[Spec], keys: list[str]) -> DataFrame:
    sets = _macd_sets(pool)
    return ind.add_macd(rows, sets, keys) if sets else rows


def fold_bounds(bars: DataFrame, folds: DataFrame) -> DataFrame:
    """(symbol, fold_id, train_end_idx, test_end_idx, n_bars)."""
    return fo.fold_train_rows(bars, folds)


# ------------------------------------------------------------------ training


def training_streams(features: DataFrame, pool: list[Spec], setup: Setup, bounds: DataFrame, with_drag: bool = False) -> DataFrame:
    """Return rows (symbol, pool_idx, bar_idx, open_time, tag, ret, traded) of every candidate over all training bars.

    Weights stay in one array per bar until after the lag, so the lag needs one
    window per symbol instead of one per candidate.  The tag, the first fold
    that may train on a bar, depends on the bar alone: it is joined before the
    candidates fan out, and bars that no fold trains on end there.  `with_drag`
    adds the return lost per unit of cost rate.
    """
    rows = with_macd(features, pool, ["symbol"])
    w = Window.partitionBy("symbol").orderBy("open_time")
    zero = F.array_repeat(F.lit(0.0), len(pool))
    now = wt.pool_weights(pool, F.col("bar_idx"))
    rows = rows.select(*BAR_COLUMNS, now.alias("ws"))
    lagged = F.lag("ws", setup.latency).over(w) if setup.latency else F.col("ws")
    rows = rows.withColumn("ws", F.when(F.col("bar_idx") - setup.latency >= 1, F.coalesce(lagged, zero)).otherwise(zero))
    if setup.band:
        rows = ac.hold_pool_with_band(rows, ["symbol"], setup.band)
    rows = rows.withColumn("wp", F.coalesce(F.lag("ws").over(w), zero)).where("bar_idx >= 1")
    first = F.get(F.filter("cuts", lambda c: c["cut"] > F.col("bar_idx")), F.lit(0))["fold_id"]
    tagged = rows.join(fold_cuts(bounds, setup.embargo), "symbol").withColumn("tag", first).where("tag is not null")  # one row per symbol; left to AQE
    flat = tagged.select(
        "symbol", "bar_idx", "open_time", "tag", "open", "close", "prev_close", F.posexplode(F.arrays_zip("ws", "wp")).alias("pool_idx", "z")
    )
    legs = ac.stream_return(
        F.col("z.wp"), F.col("z.ws"), F.col("prev_close"), F.col("open"), F.col("close"),
        F.lit(setup.cost_rate), F.lit(setup.rf / setup.ppy), setup.execution,
    )
    extra = [legs["drag"].alias("drag")] if with_drag else []
    return flat.select("symbol", "pool_idx", "bar_idx", "open_time", "tag", legs["ret"].alias("ret"), legs["traded"].alias("traded"), *extra)


def fold_cuts(bounds: DataFrame, embargo: int) -> DataFrame:
    """(symbol, cuts) with cuts = array<struct<cut, fold_id>> ascending: one short array per symbol."""
    cut = F.greatest(F.lit(2), F.col("train_end_idx") - embargo)
    return bounds.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct(cut.alias("cut"), "fold_id"))).alias("cuts"))


def training_moments(streams: DataFrame, bounds: DataFrame, by: Sequence[str] = ("symbol", "pool_idx")) -> DataFrame:
    """(by, fold_id, n, s1..s4, turnover) of each fold's training prefix, from tagged streams."""
    x = F.col("ret")
    sums = (
        streams.groupBy(*by, "tag")
        .agg(
            F.count(F.lit(1)).alias("n"),
            *[F.sum(p).alias(f"s{k}") for k, p in enumerate((x, x * x, x * x * x, x * x * x * x), start=1)],
            F.sum("traded").alias("turnover"),
        )
    )
    fold_ids = bounds.select("symbol", "fold_id")
    m, b = sums.alias("m"), fold_ids.alias("b")
    spread = m.join(b, (F.col("m.symbol") == F.col("b.symbol")) & (F.col("m.tag") <= F.col("b.fold_id")))
    keys = [F.col(f"m.{k}").alias(k) for k in by]
    return spread.groupBy(*keys, F.col("b.fold_id").alias("fold_id")).agg(*[F.sum(f"m.{c}").alias(c) for c in ("n", "s1", "s2", "s3", "s4", "turnover")])


def moment_stats(moments: DataFrame, setup: Setup) -> DataFrame:
    """Sharpe, skew, raw kurtosis and the standard error of the Sharpe from power sums."""
    n, s1, s2, s3, s4 = (F.col(c) for c in ("n", "s1", "s2", "s3", "s4"))
    mean = s1 / n
    m2 = s2 / n - mean * mean
    m3 = s3 / n - 3 * mean * s2 / n + 2 * mean * mean * mean
    m4 = s4 / n - 4 * mean * s3 / n + 6 * mean * mean * s2 / n - 3 * mean * mean * mean * mean
    flat = m2 <= 1e-10 * mean * mean  # constant streams: cash only
    sd = F.sqrt(m2 * n / (n - 1))
    score = F.when((n < 2) | flat, F.lit(0.0)).otherwise((mean - setup.rf / setup.ppy) / sd * F.lit(float(setup.ppy)) ** 0.5)
    out = moments.where("n >= 2").withColumns(
        {
            "sharpe": F.round(score, SCORE_DIGITS),
            "skew": F.when(flat | (n < 3), F.lit(0.0)).otherwise(m3 / F.pow(m2, F.lit(1.5))),
            "kurt": F.when(flat | (n < 4), F.lit(3.0)).otherwise(m4 / (m2 * m2)),
        }
    )
    return out.withColumn("se", sharpe_standard_error(F.col("sharpe"), n, setup.ppy, F.col("skew"), F.col("kurt")))


MIN_SE_ROWS = 8


def sharpe_standard_error(sharpe: Column, n: Column, ppy: int, skew: Column, kurt: Column) -> Column:
    """Asymptotic standard error of an annual Sharpe with skew and kurtosis terms; infinite below 8 rows."""
    per = sharpe / F.sqrt(F.lit(float(ppy)))
    var = (F.lit(1.0) - skew * per + F.lit(0.25) * (kurt - 1.0) * per * per) / n
    return (
        F.when(n < MIN_SE_ROWS, F.lit(float("inf"))).when(var <= 0, F.lit(0.0)).otherwise(F.sqrt(var) * F.sqrt(F.lit(float(ppy))))
    )


def argmax(scores: DataFrame, keys: Sequence[str], score: str = "sharpe", descending: bool = True) -> DataFrame:
    """Best candidate per key; the first in pool order wins a tie (an aggregate, no sort)."""
    rank = F.struct(F.col(score) if descending else -F.col(score), -F.col("pool_idx"))
    carried = [c for c in scores.columns if c not in keys]
    best = scores.where(F.col(score).isNotNull()).groupBy(*keys).agg(F.max_by(F.struct(*carried), rank).alias("b"))
    return best.select(*keys, *[F.col(f"b.{c}").alias(c) for c in carried])


def train_scores(features: DataFrame, pool: list[Spec], bounds: DataFrame, setup: Setup) -> DataFrame:
    return moment_stats(training_moments(training_streams(features, pool, setup, bounds), bounds), setup)


# ------------------------------------------------------------------ testing


def test_rows(features: DataFrame, pool: list[Spec], bounds: DataFrame) -> DataFrame:
    """Test-slice bars with all features and the slice-local index."""
    return with_macd(fo.test_slices(features, bounds), pool, ["symbol", "fold_id"])


def picked_streams(features: DataFrame, pool: list[Spec], bounds: DataFrame, picks: DataFrame, setup: Setup) -> DataFrame:
    """Trade each fold's pick over its test slice: (symbol, fold_id, day, ret, w, traded).

    Only the picked element of the weight array is kept, so nothing fans out by
    candidate.  `picks` may carry `alpha` and `prior_idx` for a blended pick.
    """
    joined = test_rows(features, pool, bounds).join(picks, ["symbol", "fold_id"])
    ws = wt.pool_weights(pool, F.col("slice_idx"))
    weight = F.element_at(F.col("ws"), F.col("pool_idx") + 1)
    if "alpha" in picks.columns:
        mixed = F.col("alpha") * weight + (F.lit(1.0) - F.col("alpha")) * F.element_at(F.col("ws"), F.col("prior_idx") + 1)
        weight = F.when(F.col("alpha") < 1.0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), mixed))).otherwise(weight)
    rows = joined.withColumn("ws", ws).withColumn("weight", weight)
    keep = ["symbol", "fold_id", "pool_idx", "open_time", "slice_idx", "open", "close", "prev_close", "weight"]
    out = ac.account(
        rows.select(*keep), ["symbol", "fold_id"], setup.cost_rate, setup.rf, setup.ppy, setup.execution, setup.latency, "slice_idx", band=setup.band
    )
    return out.select("symbol", "fold_id", "pool_idx", F.col("open_time").alias("day"), "ret", "w", "traded")


def fixed_streams(features: DataFrame, pool: list[Spec], bounds: DataFrame, setup: Setup) -> DataFrame:
    """Out-of-sample stream of every candidate with no selection: (symbol, fold_id, pool_idx, day, ret, w, traded)."""
    rows = test_rows(features, pool, bounds)
    w = Window.partitionBy("symbol", "fold_id").orderBy("open_time")
    zero = F.array_repeat(F.lit(0.0), len(pool))
    staged = rows.select("symbol", "fold_id", "open_time", "slice_idx", "open", "close", "prev_close", wt.pool_weights(pool, F.col("slice_idx")).alias("ws"))
    lagged = F.lag("ws", setup.latency).over(w) if setup.latency else F.col("ws")
    staged = staged.withColumn("ws", F.when(F.col("slice_idx") - setup.latency >= 1, F.coalesce(lagged, zero)).otherwise(zero))
    if setup.band:
        staged = ac.hold_pool_with_band(staged, ["symbol", "fold_id"], setup.band)
    staged = staged.withColumn("wp", F.coalesce(F.lag("ws").over(w), zero)).where("slice_idx >= 1")
    flat = staged.select(
        "symbol", "fold_id", "open_time", "open", "close", "prev_close", F.posexplode(F.arrays_zip("ws", "wp")).alias("pool_idx", "z")
    )
    legs = ac.stream_return(
        F.col("z.wp"), F.col("z.ws"), F.col("prev_close"), F.col("open"), F.col("close"),
        F.lit(setup.cost_rate), F.lit(setup.rf / setup.ppy), setup.execution,
    )
    return flat.select(
        "symbol", "fold_id", "pool_idx", F.col("open_time").alias("day"), legs["ret"].alias("ret"), F.col("z.ws").alias("w"), legs["traded"].alias("traded")
    )


def stitched_summary(streams: DataFrame, keys: Sequence[str] = ("symbol",), setup: Setup = Setup()) -> DataFrame:
    """Stitch fold tests per key: metrics over the joined days, exposure and turnover weighted by fold days.

    The day count is last - first + 1.
    """
    days = (F.max("day") - F.min("day")) / F.lit(86_400_000.0) + 1
    size = F.count(F.lit(1)).over(Window.partitionBy(*keys, "fold_id"))  # rows of the fold
    extra = {
        "n_folds": F.size(F.collect_set("fold_id")).cast("bigint"),
        "exposure": F.avg("w"),  # fold means weighted by fold days
        "turnover": F.sum(F.col("traded") * F.col("_d")) / F.count(F.lit(1)),
    }
    return pf.summary(streams.withColumn("_d", size), list(keys), setup.ppy, setup.rf, days, extra=extra)


# ------------------------------------------------------------------ selection rules


def select_argmax(features: DataFrame, pool: list[Spec], bounds: DataFrame, setup: Setup) -> DataFrame:
    """(symbol, fold_id, pool_idx, sharpe): best training Sharpe."""
    return argmax(train_scores(features, pool, bounds, setup), ["symbol", "fold_id"])


def select_nested(features: DataFrame, pool: list[Spec], bounds: DataFrame, inner_train: int, inner_test: int, purge: int, setup: Setup) -> DataFrame:
    """Pick by the mean Sharpe over purged inner folds of each training slice.

    Inner folds are a second-level fold table keyed by (symbol, outer fold);
    each inner test is an ordinary restarted slice.
    """
    train = fo.selection_rows(features.select("symbol", "open_time", "bar_idx"), bounds, setup.embargo)
    days = train.select("symbol", "fold_id", F.col("open_time").alias("day"), "bar_idx").withColumnRenamed("fold_id", "outer")
    inner = fo.purged_folds(days.select("symbol", "outer", "day"), inner_train, inner_test, purge, ["symbol", "outer"])
    size = days.groupBy("symbol", "outer").agg(F.max("bar_idx").alias("last_idx"))
    marks = days.select("symbol", "outer", "day", "bar_idx")
    start = inner.join(marks, [inner.symbol == marks.symbol, inner.outer == marks.outer, inner.test_start_ms == marks.day]).select(
        inner.symbol, inner.outer, inner.fold_id.alias("inner"), inner.n_test, F.col("bar_idx").alias("train_end_idx")
    )
    # the test slice keeps its end bar when there is one inside the training slice
    sliced = start.join(size, ["symbol", "outer"]).select(
        "symbol",
        F.struct("outer", "inner").alias("fold_id"),
        "train_end_idx",
        F.least(F.col("train_end_idx") + F.col("n_test"), F.col("last_idx")).alias("test_end_idx"),
    )
    streams = fixed_streams(features, pool, sliced, setup)
    scored = streams.groupBy("symbol", "fold_id", "pool_idx").agg(
        F.count(F.lit(1)).alias("n"), F.avg("ret").alias("m"), F.stddev_samp("ret").alias("sd")
    )
    each = scored.withColumn("s", pf.sharpe(F.col("m"), F.col("sd"), F.col("n"), setup.ppy, setup.rf))
    mean = each.groupBy("symbol", F.col("fold_id.outer").alias("fold_id"), "pool_idx").agg(
        F.round(F.avg("s"), SCORE_DIGITS).alias("sharpe")
    )
    return argmax(mean, ["symbol", "fold_id"])


def within_one_se(scores: DataFrame, multiplier: float = 1.0) -> DataFrame:
    """Candidates within `multiplier` standard errors of the best of their fold."""
    best = argmax(scores, ["symbol", "fold_id"]).select(
        "symbol", "fold_id", F.col("sharpe").alias("best_sharpe"), F.col("se").alias("best_se"), F.col("pool_idx").alias("best_idx")
    )
    joined = scores.join(best, ["symbol", "fold_id"])
    ok = F.col("sharpe") >= F.col("best_sharpe") - multiplier * F.col("best_se")
    return joined.where(ok | (F.col("pool_idx") == F.col("best_idx")))


DEGENERATE_SHARPE, SUBWINDOWS = 10.0, 3  # fixed values


def chunk_sharpe(mean: Column, sd: Column, ppy: int, rf: float) -> Column:
    """Sharpe of one sub-window; without dispersion the sign of the mean decides."""
    flat = F.when(mean > 0, F.lit(DEGENERATE_SHARPE)).when(mean < 0, F.lit(-DEGENERATE_SHARPE)).otherwise(F.lit(0.0))
    return F.when(sd <= 1e-12, flat).otherwise((mean - rf / ppy) / sd * F.lit(float(ppy)) ** 0.5)


def subwindow_sharpes(streams: DataFrame, keys: Sequence[str], order: str, setup: Setup, k: int = SUBWINDOWS) -> DataFrame:
    """(keys, block, sharpe) of k contiguous blocks; the last takes the remainder, blocks under 2 rows give none."""
    w = Window.partitionBy(*keys)
    rn = F.row_number().over(w.orderBy(order)) - 1
    staged = streams.select(*keys, "ret", rn.alias("i"), F.count(F.lit(1)).over(w).alias("n"))
    parts = F.least(F.lit(k), F.col("n"))
    size = F.floor(F.col("n") / parts)
    block = F.least(F.floor(F.col("i") / size), parts - 1)
    agg = staged.where(size >= 2).groupBy(*keys, block.cast("int").alias("block")).agg(F.avg("ret").alias("m"), F.stddev_samp("ret").alias("sd"))
    return agg.select(*keys, "block", chunk_sharpe(F.col("m"), F.col("sd"), setup.ppy, setup.rf).alias("sharpe"))


def worst_subwindow(streams: DataFrame, keys: Sequence[str], order: str, setup: Setup, k: int = SUBWINDOWS) -> DataFrame:
    blocks = subwindow_sharpes(streams, keys, order, setup, k)
    return blocks.groupBy(*keys).agg(F.round(F.min("sharpe"), SCORE_DIGITS).alias("worst"))


def training_rows_of(streams: DataFrame, bounds: DataFrame, wanted: DataFrame, embargo: int) -> DataFrame:
    """Training-prefix returns of selected (symbol, fold_id, pool_idx) only."""
    cut = F.greatest(F.lit(2), F.col("train_end_idx") - embargo)
    limits = wanted.select("symbol", "fold_id", "pool_idx").join(bounds.select("symbol", "fold_id", cut.alias("cut")), ["symbol", "fold_id"])
    return streams.join(limits, ["symbol", "pool_idx"]).where(F.col("bar_idx") < F.col("cut")).drop("cut")


def select_one_se(features: DataFrame, pool: list[Spec], bounds: DataFrame, setup: Setup, tie_break: str = "worst_subwindow") -> DataFrame:
    """Within one standard error of the best: lowest turnover, or best worst sub-window."""
    streams = training_streams(features, pool, setup, bounds)
    scores = store(moment_stats(training_moments(streams, bounds), setup), "scores")
    kept = within_one_se(scores)
    if tie_break == "lowest_turnover":
        return argmax(kept.withColumn("turnover", F.round("turnover", SCORE_DIGITS)), ["symbol", "fold_id"], "turnover", descending=False)
    worst = worst_subwindow(training_rows_of(streams, bounds, kept, setup.embargo), ["symbol", "fold_id", "pool_idx"], "open_time", setup)
    return argmax(kept.join(worst, ["symbol", "fold_id", "pool_idx"]), ["symbol", "fold_id"], "worst")


def credibility(gap: Column, se: Column) -> Column:
    """gap / (gap + se): the trust in a selection that beat its prior by `gap`."""
    return (
        F.when(gap <= 0, F.lit(0.0)).when(se == F.lit(float("inf")), F.lit(0.0)).when(se <= 0, F.lit(1.0)).otherwise(gap / (gap + se))
    )


def select_robust(features: DataFrame, pool: list[Spec], bounds: DataFrame, setup: Setup, prior_idx: int | None = None) -> DataFrame:
    """One-SE, minimax over sub-windows, then optional shrinkage to the prior (a pool member)."""
    picks = select_one_se(features, pool, bounds, setup)
    if prior_idx is None:
        return picks
    alone = training_streams(features, [pool[prior_idx]], setup, bounds)  # the prior is the only stream needed again
    prior = moment_stats(training_moments(alone, bounds), setup)
    prior = prior.where("pool_idx = 0").withColumn("pool_idx", F.lit(prior_idx)).where(F.col("pool_idx") == prior_idx).select("symbol", "fold_id", F.col("sharpe").alias("prior_sharpe"))
    joined = picks.join(prior, ["symbol", "fold_id"], "left")
    alpha = F.coalesce(credibility(F.col("sharpe") - F.col("prior_sharpe"), F.col("best_se")), F.lit(1.0))
    return joined.withColumn("alpha", alpha).withColumn("prior_idx", F.lit(prior_idx))
