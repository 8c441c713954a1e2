"""Cleaning, gap handling and alignment of bar panels (all keyed by symbol)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import finite, non_negative, positive
from ..functions.ordered import lag_split
from ..sources.panels import DAY_MS

def by_time(*keys: str):
    """Window of one symbol (or other keys) in time order."""
    return Window.partitionBy(*(keys or ("symbol",))).orderBy("open_time")


def clean_bars(raw: DataFrame, seq: str = "ingest_seq") -> DataFrame:
    """Valid bars, one per (symbol, open_time).

    Per timestamp the row with the highest valid volume wins, the later row on
    a tie.  Done as one aggregate, so a timestamp repeated millions of times
    reduces on the map side.
    """
    valid = raw.where((F.col("open_time") >= 0) & positive("close").isNotNull()).select(
        "symbol",
        "open_time",
        positive("open").alias("open"),
        positive("high").alias("high"),
        positive("low").alias("low"),
        "close",
        non_negative("volume").alias("volume"),
        non_negative("quote_volume").alias("quote_volume"),
        F.col(seq).alias("_seq"),
    )
    fields = ["open", "high", "low", "close", "volume", "quote_volume"]
    best = valid.groupBy("symbol", "open_time").agg(
        F.max_by(F.struct(*fields), F.struct(F.coalesce("volume", F.lit(0.0)), "_seq")).alias("b")
    )
    return best.select("symbol", "open_time", *[F.col(f"b.{f}").alias(f) for f in fields])


def recent_window(bars: DataFrame, n: int) -> DataFrame:
    """The last `n` bars of each symbol."""
    w = Window.partitionBy("symbol").orderBy(F.desc("open_time"))
    return bars.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def stale_symbols(bars: DataFrame, symbols: DataFrame, now_ms: Column, max_age_days: float) -> DataFrame:
    """Freshness per listed symbol: 'empty', 'future', 'stale' or 'fresh'."""
    last = bars.groupBy("symbol").agg(F.max("open_time").alias("last_open_time"))
    joined = symbols.join(last, "symbol", "left").withColumn(
        "age_days", (now_ms - F.col("last_open_time")) / F.lit(float(DAY_MS))
    )
    status = (
        F.when(F.col("last_open_time").isNull(), "empty")
        .when(F.col("age_days") < -0.05, "future")
        .when(F.col("age_days") > max_age_days, "stale")
        .otherwise("fresh")
    )
    return joined.withColumn("status", status)


def gap_report(bars: DataFrame, interval_ms: int = DAY_MS) -> DataFrame:
    """Consecutive bars more than 1.5 intervals apart."""
    prev = F.lag("open_time").over(by_time())
    gaps = bars.select("symbol", prev.alias("start"), F.col("open_time").alias("end"))
    days = (F.col("end") - F.col("start")) / F.lit(float(interval_ms))
    return gaps.withColumn("days", days).where("days > 1.5")


def fill_small_gaps(bars: DataFrame, max_gap_days: int = 3) -> DataFrame:
    """Insert flat bars into gaps of at most `max_gap_days` missing days."""
    step = bars.select(
        "symbol",
        F.lag("open_time").over(by_time()).alias("_prev_time"),
        F.lag("close").over(by_time()).alias("_prev_close"),
        F.col("open_time").alias("_time"),
    )
    gap = (F.col("_time") - F.col("_prev_time")) / F.lit(float(DAY_MS))
    missing = F.floor(gap).cast("bigint") - 1
    holes = step.withColumn("_n", missing).where((gap > 1.5) & missing.between(1, max_gap_days))
    flat = holes.select(
        "symbol", "_time", "_prev_close", "_n", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_n"))).alias("_k")
    ).select(
        "symbol",
        (F.col("_time") - (F.col("_n") + 1 - F.col("_k")) * F.lit(DAY_MS)).alias("open_time"),
        *[F.col("_prev_close").alias(c) for c in ("open", "high", "low", "close")],
        F.lit(0.0).alias("volume"),
        F.lit(None).cast("double").alias("quote_volume"),
        F.lit(True).alias("filled"),
    )
    return bars.withColumn("filled", F.lit(False)).unionByName(flat)


def align_to_timeline(returns: DataFrame, timeline: DataFrame, keys: list[str]) -> DataFrame:
    """Streams on a shared calendar: inner holes earn 0.0, outside days stay absent.

    `timeline(day)` holds calendar days only, so broadcasting it is bounded by
    the calendar, not by the data.
    """
    span = returns.groupBy(*keys).agg(F.min("day").alias("_first"), F.max("day").alias("_last"))
    grid = span.join(F.broadcast(timeline), F.col("day").between(F.col("_first"), F.col("_last")))
    return grid.select(*keys, "day").join(returns, [*keys, "day"], "left").select(
        *keys, "day", F.coalesce("ret", F.lit(0.0)).alias("ret")
    )


def delist_markdown(bars: DataFrame, delist: DataFrame, cost_bps: float = 10.0) -> DataFrame:
    """Truncate each delisted symbol and mark its last print down."""
    cut = bars.join(delist, "symbol", "left").where(F.col("delist_at").isNull() | (F.col("open_time") <= F.col("delist_at")))
    last = F.max("open_time").over(Window.partitionBy("symbol"))
    hit = F.col("delist_at").isNotNull() & (F.col("open_time") == last)
    factor = F.when(hit, 1.0 - cost_bps / 10_000.0).otherwise(1.0)
    staged = cut.withColumn("_factor", factor)
    return (
        staged.withColumn("close", F.col("close") * F.col("_factor"))
        .withColumn("open", F.col("open") * F.col("_factor"))
        .withColumn("note", F.when(F.col("_factor") != 1.0, F.lit("simulated delisting")))
        .drop("_factor", "delist_at")
    )


def bar_problem() -> Column:
    """First reason to refuse a bar for execution; NULL when it is sound."""
    close, op, hi, lo = (positive(c) for c in ("close", "open", "high", "low"))
    return F.coalesce(
        F.when(close.isNull(), F.lit("invalid close")),
        F.when(F.col("open").isNotNull() & op.isNull(), F.lit("non-finite/zero open")),
        F.when(F.col("high").isNull() != F.col("low").isNull(), F.lit("partial high/low")),
        F.when(F.col("high").isNotNull() & (hi.isNull() | lo.isNull()), F.lit("non-finite/zero high/low")),
        F.when(hi < lo, F.lit("high<low")),
        F.when((close < lo / 1.001) | (close > hi * 1.001), F.lit("close outside range")),
        F.when(F.abs(close / op - 1.0) > 0.5, F.lit("open-close move")),
    )


def feed_problems(feed: DataFrame, chunk: Column) -> DataFrame:
    """First ordering or value problem of each symbol's feed, in arrival order.

    Feeds are raw and can be arbitrarily long, so the previous timestamp is
    found chunk by chunk.
    """
    with_prev = lag_split(feed, ["symbol"], ["seq"], {"prev_ts": "ts_ms"}, chunk)
    reason = F.coalesce(
        F.when(F.col("ts_ms").isNull() | (F.col("ts_ms") < 0), F.lit("invalid timestamp")),
        F.when(finite("price").isNull() | (F.col("price") <= 0), F.lit("invalid close")),
        F.when(F.col("ts_ms") <= F.col("prev_ts"), F.lit("not strictly increasing")),
    )
    return (
        with_prev.withColumn("reason", reason)
        .groupBy("symbol")
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.min_by("reason", F.when(F.col("reason").isNotNull(), F.col("seq"))).alias("problem"),
            F.count("reason").alias("n_problems"),
        )
    )


def resample(tick_rows: DataFrame, width: str = "1 day") -> DataFrame:
    """Ticks -> OHLCV bars; first/last are decided by the unique sequence number."""
    return (
        tick_rows.groupBy("symbol", F.window("ts", width).alias("w"))
        .agg(
            F.min_by("price", "seq").alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", "seq").alias("close"),
            F.sum("size").alias("volume"),
            F.sum(F.col("price") * F.col("size")).alias("quote_volume"),
        )
        .withColumn("open_time", F.unix_millis(F.col("w.start")))
        .drop("w")
    )


def fingerprint(bars: DataFrame) -> DataFrame:
    """Order-sensitive hash per symbol: month hashes first, then a hash of those."""
    line = F.concat_ws("|", F.col("open_time"), F.round(F.col("close") * 1_000_000).cast("bigint"))
    month = F.date_format(F.timestamp_millis("open_time"), "yyyy-MM")

    def joined(order: str, value: str) -> Column:
        pairs = F.array_sort(F.collect_list(F.struct(order, value)))
        return F.sha2(F.array_join(F.transform(pairs, lambda p: p[value]), ","), 256)

    monthly = bars.select("symbol", month.alias("month"), "open_time", line.alias("line")).groupBy("symbol", "month").agg(
        joined("open_time", "line").alias("h")
    )
    return monthly.groupBy("symbol").agg(joined("month", "h").alias("fingerprint"))
