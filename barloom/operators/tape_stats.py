"""Aggregates over a nested forward tape (one row per session day)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import performance as pf
from .audits import lifecycle_problems
from .calendar import closure

# Slippage buckets, closed on the left.
BUCKETS = [(1.0, "0-1bps"), (5.0, "1-5bps"), (10.0, "5-10bps"), (25.0, "10-25bps")]
LAST_BUCKET, UNKNOWN = "25bps+", "unknown"
EXAMPLES, EXAMPLE_BUCKETS = 5, 64
PENALTY = {"partial": 5.0, "outage": 10.0, "duplicate": 5.0, "malformed": 10.0, "snapshot": 5.0, "repro": 10.0, "benchmark": 10.0}


def day_kind(entry_date: Column) -> Column:
    """full / partial / dark / closed of a tape row (columns assets, outages, day_status)."""
    notes = F.transform(F.map_values("assets"), lambda a: a["note"])
    noted = F.filter(notes, lambda n: n.isNotNull())
    live = F.size(notes) - F.size(noted)
    quiet = F.coalesce(F.size("outages"), F.lit(0)) <= 0
    closed = F.forall(noted, lambda n: n == "session_closed")
    pending = F.forall(noted, lambda n: n == "session_pending")
    holiday = F.coalesce(F.col("day_status") == "market_closed", F.lit(False)) | closure(entry_date).isNotNull()
    return (
        F.when(F.coalesce(F.size("assets"), F.lit(0)) <= 0, "dark").when(live == F.size(notes), "full").when(closed & quiet, "closed")
        .when(pending & quiet & holiday, "closed").when(live > 0, "partial").otherwise("dark")
    )


def forward_performance(days: DataFrame, keys: Sequence[str], anchor: str | None = None, rf: float = 0.0) -> DataFrame:
    """Per tape: every row compounds; the Sharpe is withheld, with a reason, on thin or degraded tapes.

    Needs (keys, date, port_ret, kind) and, when `anchor` names a column, the
    freeze date the cadence is measured from.
    """
    keys = list(keys)
    rows = days.select(*keys, F.col("date").alias("day"), F.col("port_ret").alias("ret"), "kind", *([anchor] if anchor else []))
    bad = F.count(F.when(F.col("kind").isin("partial", "dark"), 1))
    extra = {
        "dark": F.count(F.when(F.col("kind") == "dark", 1)), "bad": bad, "first": F.min("day"), "last": F.max("day"),
        "mean": F.avg("ret"), "sd": F.stddev_samp("ret"), **({"anchor": F.min(anchor)} if anchor else {}),
    }
    s = pf.summary(rows, keys, 365, 0.0, extra=extra)
    since_first = F.datediff("last", "first")
    use = F.col("anchor").isNotNull() & (F.col("anchor") < F.col("last")) if anchor else F.lit(False)
    span = F.when(use, F.datediff("last", "anchor")).otherwise(since_first) if anchor else since_first
    periods = F.when(use, F.col("n")).otherwise(F.col("n") - 1)
    ppy = F.when((span > 0) & (periods > 0), F.lit(365.2425) * periods / span)
    whole = F.greatest(F.lit(1.0), F.bround(ppy, 0))
    sharpe = F.when(F.col("sd") == 0, F.lit(0.0)).otherwise((F.col("mean") - F.lit(rf) / whole) / F.col("sd") * F.sqrt(whole))
    unmeasured = F.col("dark") == F.col("n")
    reason = (
        F.when(unmeasured, "unmeasured").when(F.col("n") < 2, "fewer than two rows").when(F.col("bad") > 0, "degraded").when(ppy.isNull(), "unknown cadence")
    )
    return s.select(
        *keys, "n", F.when(~unmeasured, F.col("final") - 1.0).alias("ret"), F.when(~unmeasured, F.col("max_drawdown")).alias("max_drawdown"),
        F.when(~unmeasured, ppy).alias("periods_per_year"), F.when(reason.isNull(), sharpe).alias("sharpe"), reason.alias("sharpe_reason"),
    )


def exploded_orders(tape: DataFrame) -> DataFrame:
    """(date, order, problems) of every order on the tape."""
    rows = tape.select("date", F.explode("orders").alias("order"))
    return rows.withColumn("problems", lifecycle_problems(F.col("order"), F.col("date")))


def lifecycle_audit(tape: DataFrame) -> DataFrame:
    """(reason, n, examples): flagged orders per reason, with up to five of the smallest date:symbol labels.

    The labels are cut to five inside hash buckets first, so no reason collects all its labels.
    """
    rows = exploded_orders(tape).select("date", F.col("order.symbol").alias("symbol"), F.explode("problems").alias("reason"))
    label = F.concat_ws(":", F.col("date").cast("string"), "symbol")
    named = rows.groupBy("reason", label.alias("label")).agg(F.count(F.lit(1)).alias("n"))
    dealt = named.groupBy("reason", F.pmod(F.xxhash64("label"), F.lit(EXAMPLE_BUCKETS)).alias("bucket"))
    parts = dealt.agg(F.sum("n").alias("n"), F.slice(F.array_sort(F.collect_list("label")), 1, EXAMPLES).alias("labels"))
    few = F.slice(F.array_sort(F.flatten(F.collect_list("labels"))), 1, EXAMPLES)
    return parts.groupBy("reason").agg(F.sum("n").alias("n"), few.alias("examples"))


def trusted_orders(tape: DataFrame) -> DataFrame:
    return exploded_orders(tape).where(F.size("problems") == 0)


def usable_observations(tape: DataFrame) -> DataFrame:
    """(date, symbol, slippage_bps) excluding whole days with an untrustworthy order."""
    bad = exploded_orders(tape).where(F.size("problems") > 0).select("date").distinct()
    rows = tape.join(bad, "date", "left_anti").select("date", F.explode("assets").alias("symbol", "a"))
    return rows.where("a.slippage_bps is not null").select("date", "symbol", F.col("a.slippage_bps").alias("slippage_bps"))


def bucket(value: Column) -> Column:
    size = F.abs(value)
    label = F.when(value.isNull(), F.lit(UNKNOWN))
    for limit, name in BUCKETS:
        label = label.when(size < limit, name)
    return label.otherwise(F.lit(LAST_BUCKET))


def quality_score(partial: Column, outage: Column, duplicate: Column, malformed: Column, snapshot: Column, repro_fail: Column, no_benchmark: Column) -> Column:
    total = (
        F.lit(100.0) - PENALTY["partial"] * partial - PENALTY["outage"] * outage - PENALTY["duplicate"] * duplicate - PENALTY["malformed"] * malformed
        - PENALTY["snapshot"] * snapshot - F.when(repro_fail, PENALTY["repro"]).otherwise(0.0) - F.when(no_benchmark, PENALTY["benchmark"]).otherwise(0.0)
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), total))
