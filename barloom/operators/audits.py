"""Quality and provenance audits of observation tapes, ledgers and fills."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import finite
from ..functions.ordered import lag_split, null_safe_join, running_sum_split

# The lifecycle stamps of an order, in order.
LIFECYCLE = ["signal_generated_ts", "intent_ts", "submitted_ts", "fill_ts"]
ISO = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:\d{2})?$"
ZONED = r"(Z|[+-]\d{2}:\d{2})$"
MAX_SKEW_SECONDS = 300
REQUIRED = ["ts", "symbol", "side", "decision_close", "exec_price", "turnover"]
IDENTITY = ["ts", "symbol", "side", "turnover", "decision_close", "exec_price"]


def zoned_ts(c: Column) -> Column:
    """Timestamp of an ISO string with a zone; NULL for naive or unparseable text."""
    return F.when(c.rlike(ISO) & c.rlike(ZONED), F.try_to_timestamp(c))


def _compact(*items: Column) -> Column:
    return F.array_compact(F.array(*items))


def lifecycle_problems(order: Column, session_date: Column) -> Column:
    """array<string> of distinct reasons an order's stamps cannot be trusted."""
    raw = [order[f] for f in LIFECYCLE]
    parsed = [zoned_ts(c) for c in raw]
    naive = F.exists(F.array(*raw), lambda c: c.isNotNull() & c.rlike(ISO) & ~c.rlike(ZONED))
    garbage = F.exists(F.array(*raw), lambda c: c.isNotNull() & ~c.rlike(ISO))
    present = F.array_compact(F.array(*parsed))
    ordered = F.array_sort(present) == present
    skew = F.abs(F.unix_timestamp(parsed[1]) - F.unix_timestamp(session_date.cast("timestamp")))
    return _compact(
        F.when(F.coalesce(naive, F.lit(False)), "naive timezone"),
        F.when(F.coalesce(garbage, F.lit(False)), "unparseable"),
        F.when(~ordered, "out of order"),
        F.when(skew > 86_400, "intent far from session"),
    )


def missing_problems() -> Column:
    empty = [F.when(F.col(c).isNull() | (F.col(c).cast("string") == ""), F.lit(c)) for c in REQUIRED]
    return F.array_distinct(_compact(*empty, F.when(~F.coalesce(F.col("side").isin("BUY", "SELL", "FLAT"), F.lit(False)), "side")))


def numeric_problems() -> Column:
    """Non-finite, negative, non-positive or out-of-range numbers (NULL is not a problem here)."""
    def bad(c: str, rule: Column | None = None) -> Column:
        wrong = finite(c).isNull() if rule is None else finite(c).isNull() | rule
        return F.when(F.col(c).isNotNull() & wrong, F.lit(f"invalid {c}"))

    return _compact(
        bad("turnover", F.col("turnover") < 0),
        bad("predicted_cost_bps", F.col("predicted_cost_bps") < 0),
        bad("decision_close", F.col("decision_close") <= 0),
        bad("exec_price", F.col("exec_price") <= 0),
        bad("target_weight", ~F.col("target_weight").between(0.0, 1.0)),
        bad("previous_weight", ~F.col("previous_weight").between(0.0, 1.0)),
        bad("observed_cost_proxy_bps"),
    )


def temporal_problems(now: Column) -> Column:
    ts, signal = zoned_ts(F.col("ts")), zoned_ts(F.col("signal_ts"))
    return _compact(
        F.when(ts.isNull(), "unparseable ts"),
        F.when(F.unix_timestamp(ts) - F.unix_timestamp(now) > MAX_SKEW_SECONDS, "future ts"),
        F.when(signal > ts, "signal after execution"),
        F.when(F.col("signal_ts").isNotNull() & signal.isNull(), "unparseable signal_ts"),
    )


def _first_of(survivors: DataFrame, seq: str) -> DataFrame:
    """Sequence number of the first row of each six-field identity (an aggregate, so hot duplicates combine early)."""
    return survivors.groupBy(*IDENTITY).agg(F.min(seq).alias("_first"))


def classify(rows: DataFrame, universe: DataFrame, frozen_at: Column, now: Column, seq: str = "seq") -> DataFrame:
    """Add `class` and `reason`; replay is decided only among rows that pass every earlier check."""
    tagged = rows.join(universe.select("symbol", F.lit(True).alias("_in")), "symbol", "left")
    early = (
        F.when(F.size(missing_problems()) > 0, F.lit("missing_data"))
        .when(F.size(numeric_problems()) > 0, "invalid_numeric")
        .when(F.col("_in").isNull(), "fixture_test")
        .when(zoned_ts(F.col("ts")) < frozen_at, "wrong_freeze")
        .when(F.size(temporal_problems(now)) > 0, "bad_timestamps")
    )
    staged = tagged.withColumn("_early", early).drop("_in")
    firsts = _first_of(staged.where("_early is null"), seq)
    joined = null_safe_join(staged, firsts, IDENTITY, "left")
    reason = F.coalesce(F.col("_early"), F.when(F.col(seq) > F.col("_first"), F.lit("replay")), F.lit(""))
    klass = (
        F.when(reason == "", "forward-paper").when(reason == "replay", "replay").when(reason == "fixture_test", "fixture")
        .when(reason == "wrong_freeze", "historical-sim").otherwise("invalid")
    )
    return joined.withColumns({"reason": reason, "class": klass}).drop("_early", "_first")


def verified(rows: DataFrame, universe: DataFrame, freeze_id: str, commit: str, code: str, frozen_at: Column, freeze_date: str, now: Column, seq: str = "seq") -> DataFrame:
    """Add `exclusion`: NULL for verified forward rows, else the first reason (or 'no_turnover')."""
    tagged = rows.join(universe.select("symbol", F.lit(True).alias("_in")), "symbol", "left")
    ts, signal = zoned_ts(F.col("ts")), zoned_ts(F.col("signal_ts"))
    off = (F.col("freeze_id") != freeze_id) | F.col("freeze_id").isNull()
    off = off | (F.col("commit") != commit) | F.col("commit").isNull() | (F.col("code") != code) | F.col("code").isNull()
    late = ts.isNull() | signal.isNull() | (signal <= frozen_at) | (F.to_date(ts) <= F.to_date(F.lit(freeze_date)))
    early = (
        F.when(F.col("evidence_class") == "fixture", F.lit("fixture_test"))
        .when(F.col("evidence_class").isNull() | (F.col("evidence_class") != "forward-paper"), "other_class")
        .when(F.col("_in").isNull(), "fixture_test")
        .when(off, "wrong_freeze")
        .when(F.col("run_id").isNull() | (F.col("source") != "forward-runner"), "missing_data")
        .when(late, "wrong_freeze")
    )
    staged = tagged.withColumn("_early", early).drop("_in")
    joined = null_safe_join(staged, _first_of(staged.where("_early is null"), seq), IDENTITY, "left")
    exclusion = (
        F.when(F.col("_early").isNotNull(), F.col("_early"))
        .when(F.col(seq) > F.col("_first"), "replay")
        .when(F.size(missing_problems()) > 0, "missing_data")
        .when(F.size(numeric_problems()) > 0, "invalid_numeric")
        .when(F.size(temporal_problems(now)) > 0, "bad_timestamps")
        .when(F.col("turnover") <= 1e-9, "no_turnover")
    )
    return joined.withColumn("exclusion", exclusion).drop("_early", "_first")


def scope_reason(expected: dict[str, str], anchor: str) -> Column:
    """Why a tape row does not count for an experiment; NULL when it does."""
    stamp = F.col("experiment")
    checks = [
        F.when(F.col("date").try_cast("date").isNull(), F.lit("unparseable date")),
        F.when(F.col("date").try_cast("date") <= F.lit(anchor).cast("date"), F.lit("on or before the freeze date")),
        F.when(stamp.isNull(), F.lit("no experiment stamp")),
    ]
    checks += [F.when(~stamp[k].eqNullSafe(F.lit(v)), F.lit(f"{k} differs")) for k, v in expected.items()]
    return F.coalesce(*checks)


def hash_chain(ledger: DataFrame, chunk: Column, body: Column) -> DataFrame:
    """Per row: id gap, timestamp regression, content mismatch, broken link.

    One chain can hold every row of the tape, so the previous row is found
    chunk by chunk instead of in one global window.
    """
    prev = lag_split(ledger, [], ["id"], {"p_id": "id", "p_ts": "timestamp", "p_hash": "hash"}, chunk)
    return prev.withColumns(
        {
            "gap": F.col("id") != F.coalesce(F.col("p_id"), F.lit(0)) + 1,
            "regression": F.coalesce(F.col("timestamp") < F.col("p_ts"), F.lit(False)),
            "edited": F.col("hash") != F.sha2(body, 256),
            "broken_link": F.col("prev_hash").isNotNull() & ~F.col("prev_hash").eqNullSafe(F.col("p_hash")),
        }
    )


def running_balance(fills: DataFrame, chunk: Column, keys: Sequence[str] = ("account",)) -> DataFrame:
    """Fill problems per row: side, cash continuity, notional, cash arithmetic, position continuity, duplicate key."""
    keys = list(keys)
    with_prev = lag_split(fills, keys, ["seq"], {"p_cash": "cash_after"}, chunk)
    held = running_sum_split(with_prev, [*keys, "symbol"], ["seq"], {"position": "qty"}, chunk, fills)
    copies = fills.groupBy("idem_key").agg(F.min("seq").alias("_first"), F.max("seq").alias("_last")).where("idem_key is not null and _last > _first")
    rows = held.join(copies.drop("_last"), "idem_key", "left")  # fills without a key duplicate nothing
    signed = F.when(F.col("side") == "BUY", -F.col("notional")).otherwise(F.col("notional")) - F.col("fee")
    expected = F.abs(F.col("qty")) * F.col("price")
    loose = F.greatest(F.lit(2e-5), F.lit(1e-9) * F.greatest(F.abs("notional"), F.abs(expected)))
    problem = _compact(
        F.when(F.col("seq") > F.col("_first"), "duplicate key"),
        F.when((F.col("qty") > 1e-12) & (F.col("side") != "BUY") | (F.col("qty") < -1e-12) & (F.col("side") != "SELL"), "side"),
        F.when(F.abs(F.col("cash_before") - F.col("p_cash")) > 2e-5, "cash continuity"),
        F.when(F.abs(F.col("notional") - expected) > loose, "notional"),
        F.when(F.abs(F.col("cash_after") - F.col("cash_before") - signed) > 2e-5, "cash arithmetic"),
        F.when(F.abs(F.col("position_after") - F.col("position")) > 2e-5, "position continuity"),
    )
    return rows.withColumn("problems", problem).drop("_first")


def already_read(events: DataFrame) -> DataFrame:
    """Read events that follow an earlier read of the same plan."""
    first = events.where("kind = 'read'").groupBy("plan_id").agg(F.min("seq").alias("_first"))
    return events.where("kind = 'read'").join(first, "plan_id").where(F.col("seq") > F.col("_first")).drop("_first")


def accounting_model(version: Column, stamp: Column) -> Column:
    return F.coalesce(stamp, F.when(version.isin("v2", "v3"), F.lit("self-financing")), F.lit("legacy"))


def merge_tape(existing: DataFrame, incoming: DataFrame, cutoff: str) -> DataFrame:
    """Rows of both sides with `status`: kept, added, duplicate or dropped (on or before the cutoff)."""
    firsts = incoming.where(F.col("date") > cutoff).groupBy("date").agg(F.min("seq").alias("_first"))
    taken = existing.select("date").distinct().withColumn("_taken", F.lit(True))
    status = (
        F.when(F.col("_taken"), "duplicate").when(F.col("date") <= cutoff, "dropped").when(F.col("seq") > F.col("_first"), "duplicate").otherwise("added")
    )
    new = incoming.join(taken, "date", "left").join(firsts, "date", "left").withColumn("status", status).drop("_taken", "_first")
    return existing.withColumn("status", F.lit("kept")).unionByName(new)


def merge_snapshots(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """(date, status): added, duplicate or conflict, by content of the membership."""
    a = existing.select("date", F.sha2("body", 256).alias("ha"))
    b = incoming.select("date", F.sha2("body", 256).alias("hb"))
    joined = a.join(b, "date", "full_outer")
    status = F.when(F.col("hb").isNull(), "kept").when(F.col("ha").isNull(), "added").when(F.col("ha") == F.col("hb"), "duplicate").otherwise("conflict")
    return joined.select("date", status.alias("status"))


def log_profile(rows: DataFrame, keys: Sequence[str], order: str, value: str, chunk: Column) -> DataFrame:
    """Rows, distinct and duplicate dates, sortedness, first and last date per tape."""
    prev = lag_split(rows, list(keys), [order], {"p": value}, chunk)
    return prev.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct(value).alias("n_dates"), (F.count(F.lit(1)) - F.countDistinct(value)).alias("duplicates"),
        (F.count(F.when(F.col(value) < F.col("p"), 1)) == 0).alias("sorted"), F.min(value).alias("first_date"), F.max(value).alias("last_date"),
    )


def diff_metrics(stored: DataFrame, fresh: DataFrame, keys: Sequence[str], metrics: Sequence[str], tol: float) -> DataFrame:
    """(keys, metric, stored, fresh) that differ beyond the tolerance or are missing on one side."""
    def long(df: DataFrame, name: str) -> DataFrame:
        return df.unpivot(list(keys), list(metrics), "metric", name)

    both = long(stored, "stored").join(long(fresh, "fresh"), [*keys, "metric"], "full_outer")
    gap = F.abs(F.col("stored") - F.col("fresh"))
    scale = F.greatest(F.lit(1.0), F.abs("stored"), F.abs("fresh"))
    one_sided = F.col("stored").isNull() != F.col("fresh").isNull()
    return both.where(one_sided | (gap > tol * scale))


def one_row_per(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
