"""Windows over ticks; every function takes a batch or a streaming DataFrame."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordered import max_before_split

NEVER_MS = 253_402_300_799_000  # end of the year 9999


def ohlc(rows: DataFrame, width: str, slide: str | None = None) -> DataFrame:
    """Tumbling (or sliding) bars; first and last by the unique sequence number."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return rows.groupBy("symbol", w.alias("w")).agg(
        F.min_by("price", "seq").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "seq").alias("close"),
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("volume"),
    ).select("symbol", F.unix_millis("w.start").alias("start_ms"), "open", "high", "low", "close", "n", "volume")


def panes(rows: DataFrame, width: str = "1 hour") -> DataFrame:
    """Mergeable moments per symbol and pane: count, sum, squared deviations from the pane's own mean, volume."""
    return rows.groupBy("symbol", F.window("ts", width).alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("price").alias("total"), (F.var_pop("price") * F.count("price")).alias("m2"), F.sum("size").alias("volume")
    ).select("symbol", F.unix_millis("w.start").alias("start_ms"), "n", "total", "m2", "volume")


def trailing_stats(parts: DataFrame, pane_ms: int = 3_600_000, count: int = 24) -> DataFrame:
    """Trailing mean, deviation and volume over the last `count` panes, at every pane end with a tick in reach.

    A pane stands for the ends up to the next pane, at most `count`, so quiet
    stretches cost rows and busy ones do not; sums over a range of panes give
    each window.  Deviations are taken from the symbol's first pane mean, which
    keeps the sums of squares small.
    """
    line = Window.partitionBy("symbol").orderBy("start_ms")
    mean = F.col("total") / F.col("n")
    near = parts.withColumns({"next": F.lead("start_ms").over(line), "c": F.first(mean).over(line)})
    shifted = near.withColumns({"s1": F.col("total") - F.col("n") * F.col("c"), "s2": F.col("m2") + F.col("n") * (mean - F.col("c")) * (mean - F.col("c"))})
    last = F.least(F.coalesce(F.col("next"), F.col("start_ms") + count * pane_ms), F.col("start_ms") + count * pane_ms) - pane_ms
    ends = shifted.withColumn("at", F.explode(F.sequence("start_ms", last, F.lit(pane_ms))))
    own = F.col("at") == F.col("start_ms")
    reach = Window.partitionBy("symbol").orderBy("at").rangeBetween(-(count - 1) * pane_ms, 0)
    sums = {k: F.sum(F.when(own, F.col(k))).over(reach) for k in ("n", "s1", "s2", "volume")}
    wide = ends.select("symbol", "at", "c", *[v.alias(k) for k, v in sums.items()])
    m2 = F.greatest(F.col("s2") - F.col("s1") * F.col("s1") / F.col("n"), F.lit(0.0))
    sd = F.when(F.col("n") > 1, F.sqrt(m2 / (F.col("n") - 1)))
    return wide.where("n > 0").select("symbol", (F.col("at") + pane_ms).alias("end_ms"), "n", (F.col("c") + F.col("s1") / F.col("n")).alias("mean"), sd.alias("sd"), "volume")


def partial_bursts(rows: DataFrame, gap: str, buckets: int = 8) -> DataFrame:
    """Activity spells of parts of each symbol's rows, dealt by sequence number: a hot symbol is `buckets` keys."""
    bucket = F.pmod(F.xxhash64("seq"), F.lit(buckets)).alias("bucket")
    return rows.groupBy("symbol", bucket, F.session_window("ts", gap).alias("s")).agg(F.count(F.lit(1)).alias("n"), F.sum("price").alias("total")).select(
        "symbol", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n", "total"
    )


def bursts(parts: DataFrame) -> DataFrame:
    """Activity spells per symbol from partial ones: a spell is a run of overlapping parts, so starts, ends, counts and totals merge."""
    line = Window.partitionBy("symbol").orderBy("start", "end")
    reach = F.max("end").over(line.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(reach.isNull() | (F.col("start") >= reach), 1).otherwise(0)
    spells = parts.withColumn("opens", opens).withColumn("spell", F.sum("opens").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    return spells.groupBy("symbol", "spell").agg(
        F.unix_millis(F.min("start")).alias("start_ms"), F.unix_millis(F.max("end")).alias("end_ms"), F.sum("n").alias("n"), F.sum("total").alias("total")
    ).drop("spell")


def once_per_session(rows: DataFrame, delay: str = "2 days") -> DataFrame:
    """First row of each (symbol, session_date); a rerun of the same date is a no-op."""
    dated = rows.withColumn("session_date", F.to_date("ts"))
    if rows.isStreaming:
        def first(frames):  # of an Arrow batch, so that a busy date sends few rows to its state
            for frame in frames:
                yield frame.drop_duplicates(["symbol", "session_date"])

        thin = dated.select("symbol", "session_date", "ts")
        return thin.mapInPandas(first, thin.schema).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["symbol", "session_date"])
    return dated.dropDuplicates(["symbol", "session_date"])


def future_status(rows: DataFrame, now: str) -> DataFrame:
    """Prints later than the clock are set aside, not processed."""
    return rows.withColumn("status", F.when(F.col("ts") > F.to_timestamp(F.lit(now)), "future").otherwise("kept"))


def order_policy(anchor: str, out: str, state: str, rows_per_chunk: int = 100_000):
    """foreachBatch handler of the tape rule: dates only go forward.

    Rows on or before the freeze date are `refused`, rows dated before the
    newest accepted date of their symbol `out_of_order`.  The state is that date
    per symbol, one small folder per batch id: a batch reads the folder of the
    one before and replaces its own, so a batch that runs again changes nothing.
    Inside a batch, dates are carried over chunks of the arrival order.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        day = F.to_date("ts")
        dated = batch.withColumn("day", F.when(day > F.to_date(F.lit(anchor)), day))
        chunk = F.floor(F.col("arrive") / F.lit(rows_per_chunk)).cast("bigint")
        seen = max_before_split(dated, ["symbol"], ["arrive", "seq"], {"newest": "day"}, chunk)
        known = spark.read.parquet(f"{state}/batch={batch_id - 1}") if batch_id else spark.createDataFrame([], "symbol string, accepted date")
        joined = seen.join(known, "symbol", "left")
        newest = F.greatest("newest", "accepted")
        status = F.when(F.col("day").isNull(), "refused").when(F.col("day") < newest, "out_of_order").otherwise("kept")
        joined.withColumn("status", status).select(*batch.columns, "status").write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        tops = dated.groupBy("symbol").agg(F.max("day").alias("top"))
        after = known.join(tops, "symbol", "full").select("symbol", F.greatest("accepted", "top").alias("accepted")).where("accepted is not null")
        after.write.mode("overwrite").parquet(f"{state}/batch={batch_id}")

    return handle


def session_status(rows: DataFrame, sessions: DataFrame, calendar: DataFrame) -> DataFrame:
    """closed / pending / open per print, from a stream-static join with the closure calendar.

    `sessions(symbol, session)` and `calendar(date, closed)` hold one row per
    symbol type and per day.
    """
    joined = rows.withColumn("date", F.to_date("ts")).join(F.broadcast(sessions), "symbol", "left").join(F.broadcast(calendar), "date", "left")
    minute = F.hour("ts") * 60 + F.minute("ts")
    equity = F.col("session") == "us_equity"
    return joined.withColumn(
        "status", F.when(equity & F.coalesce("closed", F.lit(False)), "closed").when(equity & (minute < 21 * 60 + 15), "pending").otherwise("open")
    )


def silence_alerts(rows: DataFrame, limit_ms: int, delay: str = "0 seconds") -> DataFrame:
    """(symbol, last_ms, n, status): 'fresh' with each batch of a symbol's rows, 'stale' once the clock is `limit_ms` past its newest.

    The state of a symbol is two numbers, its alarm an event-time timer: silence
    is reported although no row comes.  Rows are reduced inside tasks first.
    """
    schema = "symbol string, ts timestamp, n long"

    def newest(frames):
        for frame in frames:
            by = frame.groupby("symbol", dropna=False)["ts"]
            yield by.agg(ts="max", n="size").reset_index()[["symbol", "ts", "n"]].astype({"symbol": object})

    def watch(key, frames, state):
        last, n = state.get if state.exists else (0, 0)
        if not state.hasTimedOut:
            for frame in frames:
                last = max(last, int(frame["ts"].max().value // 1_000_000))
                n += int(frame["n"].sum())
        state.update((last, n))
        # one alert per silence: after it, only a new row sets the alarm again
        state.setTimeoutTimestamp(NEVER_MS if state.hasTimedOut else max(last + limit_ms, state.getCurrentWatermarkMs() + 1))
        status = "stale" if state.hasTimedOut else "fresh"
        yield pd.DataFrame({"symbol": pd.Series([key[0]], dtype=object), "last_ms": [last], "n": [n], "status": pd.Series([status], dtype=object)})

    reduced = rows.select("symbol", "ts").mapInPandas(newest, schema).withWatermark("ts", delay)
    # clock rows have no symbol; the condition names ts, or it would be moved in front of the watermark that they drive
    named = reduced.where(F.when(F.col("ts").isNotNull(), F.col("symbol")).isNotNull())
    return named.groupBy("symbol").applyInPandasWithState(watch, "symbol string, last_ms long, n long, status string", "last long, n long", "update", "EventTimeTimeout")
