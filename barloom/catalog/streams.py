"""Streaming queries: events replayed through Structured Streaming and drained."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import r as rd
from ..operators import calendar as cal
from ..sources import panels, sinks
from ..sources.panels import Tables
from ..streaming import runner, sleeves, ticks
from .evidence import tape_flat
from .portfolio import masked_inputs
from .registry import cte, query, r, sql


def tick_stream(t: Tables) -> DataFrame:
    raw = runner.table_stream(t.spark, f"{t.root}/events.parque[t]")  # a glob, so one file or a folder of files both work
    return raw.select(
        F.col("event_type").alias("symbol"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"),
        F.get_json_object("props", "$.k").cast("double").alias("size"), "user_id",
    )


BAR_SQL = """SELECT symbol, epoch_ms(time_bucket(INTERVAL '1 hour', ts)::TIMESTAMP) AS start_ms, min_by(price, seq) AS open, max(price) AS high, min(price) AS low, max_by(price, seq) AS close, count(*) AS n, sum(size) AS volume FROM ticks GROUP BY 1, 2"""


@query("st_tumbling", sql(BAR_SQL, "ticks"))
def _(t: Tables) -> DataFrame:
    return runner.Clocked(tick_stream(t), lambda rows: ticks.ohlc(rows.withWatermark("ts", "1 day"), "1 hour"), "tumbling").closed()


@query(
    "st_sliding",
    sql(
        f"""SELECT symbol, epoch_ms(e) AS end_ms, count(*) AS n, {r('avg(price)', 'mean', 9)}, {r('stddev_samp(price)', 'sd')}, sum(size) AS volume FROM (
              SELECT symbol, price, size, unnest(generate_series(time_bucket(INTERVAL '1 hour', ts)::TIMESTAMP + INTERVAL 1 HOUR, time_bucket(INTERVAL '1 hour', ts)::TIMESTAMP + INTERVAL 24 HOUR, INTERVAL 1 HOUR)) AS e FROM ticks) GROUP BY 1, 2""",
        "ticks",
    ),
)
def _(t: Tables) -> DataFrame:
    """Hourly panes from the stream, windows of 24 panes on read."""
    parts = runner.Clocked(tick_stream(t), lambda rows: ticks.panes(rows.withWatermark("ts", "1 day")), "sliding").closed()
    out = ticks.trailing_stats(parts)
    return out.select("symbol", "end_ms", "n", rd("mean", 9).alias("mean"), rd("sd").alias("sd"), "volume")


@query(
    "st_session",
    sql(
        f"""SELECT symbol, epoch_us(min(ts)) // 1000 AS start_ms, epoch_us(max(ts) + INTERVAL 2 HOUR) // 1000 AS end_ms, count(*) AS n, {r('sum(price)', 'total', 4)} FROM (SELECT *, sum(brk) OVER (PARTITION BY symbol ORDER BY ts, seq) AS spell FROM (
              SELECT *, coalesce((ts >= lag(ts) OVER (PARTITION BY symbol ORDER BY ts, seq) + INTERVAL 2 HOUR)::INT, 0) AS brk FROM ticks)) GROUP BY symbol, spell""",
        "ticks",
    ),
)
def _(t: Tables) -> DataFrame:
    """Partial spells from the stream, merged on read."""
    parts = runner.Clocked(tick_stream(t), lambda rows: ticks.partial_bursts(rows.withWatermark("ts", "1 day"), "2 hours"), "spells").closed()
    spells = ticks.bursts(parts)
    return spells.withColumn("total", rd("total", 4))


@query("st_dedupe_date", sql("SELECT DISTINCT symbol, ts::DATE::VARCHAR AS session_date FROM ticks", "ticks"))
def _(t: Tables) -> DataFrame:
    path = runner.drain_to_parquet(ticks.once_per_session(tick_stream(t)), "sessions")
    return t.spark.read.parquet(path).select("symbol", F.col("session_date").cast("string").alias("session_date"))


def by_status(t: Tables, stream: DataFrame, label: str) -> DataFrame:
    path = runner.drain_to_parquet(stream, label, partition="status")
    return t.spark.read.parquet(path).groupBy("symbol", F.col("status").cast("string").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("st_future_drop", sql("SELECT symbol, CASE WHEN ts > TIMESTAMP '2024-01-25 12:00:00' THEN 'future' ELSE 'kept' END AS status, count(*) AS n FROM ticks GROUP BY 1, 2", "ticks"))
def _(t: Tables) -> DataFrame:
    return by_status(t, ticks.future_status(tick_stream(t), "2024-01-25 12:00:00"), "future")


cte("arrivals", "SELECT *, seq + CASE WHEN seq % 50 = 7 THEN 1500 ELSE 0 END AS arrive, CASE WHEN ts::DATE > DATE '2024-01-05' THEN ts::DATE END AS day FROM ticks", "ticks")


@query(
    "st_late_policy",
    sql(
        """SELECT symbol, status, count(*) AS n FROM (SELECT symbol, CASE WHEN day IS NULL THEN 'refused'
             WHEN day < max(day) OVER (PARTITION BY symbol ORDER BY arrive, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 'out_of_order' ELSE 'kept' END AS status FROM arrivals) GROUP BY 1, 2""",
        "arrivals",
    ),
)
def _(t: Tables) -> DataFrame:
    """Every 50th print arrives 1500 places late; those whose date has passed by then are set aside."""
    late = F.when(F.col("seq") % 50 == 7, 1500).otherwise(0)
    out, state = (sinks.scratch(t.spark, f"late{part}") for part in ("", "-state"))
    runner.drain_batches(tick_stream(t).withColumn("arrive", F.col("seq") + late), ticks.order_policy("2024-01-05", out, state, 1000), "late")
    return t.spark.read.parquet(out).groupBy("symbol", "status").agg(F.count(F.lit(1)).alias("n"))


@query(
    "st_session_gate",
    sql(
        """SELECT symbol, CASE WHEN symbol IN ('purchase', 'click') AND (isodow(ts) >= 6 OR ts::DATE IN (DATE '2024-01-01', DATE '2024-01-15')) THEN 'closed'
             WHEN symbol IN ('purchase', 'click') AND hour(ts) * 60 + minute(ts) < 1275 THEN 'pending' ELSE 'open' END AS status, count(*) AS n FROM ticks GROUP BY 1, 2""",
        "ticks",
    ),
)
def _(t: Tables) -> DataFrame:
    base = panels.ticks(t)
    sessions = base.select("symbol").distinct().withColumn("session", F.when(F.col("symbol").isin("purchase", "click"), "us_equity").otherwise("continuous"))
    days = cal.calendar(base.select(F.to_date("ts").alias("date")).distinct()).select("date", "closed")
    return by_status(t, ticks.session_status(tick_stream(t), sessions, days), "gate")


@query(
    "st_staleness",
    sql(
        """SELECT symbol, n, epoch_us(last_ts) // 1000 AS last_ms, CASE WHEN last_ts < TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 30 MINUTE THEN 'stale' ELSE 'fresh' END AS status
           FROM (SELECT symbol, count(*) AS n, max(ts) AS last_ts FROM ticks GROUP BY 1)""",
        "ticks",
    ),
)
def _(t: Tables) -> DataFrame:
    """Silence of half an hour before the clock's midnight raises an alert by timer; the newest message of a symbol is its state."""
    watch = runner.Clocked(tick_stream(t), lambda rows: ticks.silence_alerts(rows, 1_800_000), "freshness", "update").run().tick("2024-01-31 00:00:00")
    newest = watch.rows().groupBy("symbol").agg(F.max_by(F.struct("n", "last_ms", "status"), "batch").alias("m"))
    return newest.select("symbol", "m.n", "m.last_ms", "m.status")


@query(
    "join_stream_static",
    sql(f"SELECT c_mktsegment AS segment, count(*) AS n, {r('sum(price)', 'total', 4)} FROM (SELECT user_id, value AS price FROM events) JOIN customer ON user_id = c_custkey GROUP BY 1"),
)
def _(t: Tables) -> DataFrame:
    static = t.customer.select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("segment"))

    def daily(rows: DataFrame) -> DataFrame:
        # an outer join, as an inner one would filter the clock rows before they reach the watermark
        known = rows.withWatermark("ts", "1 day").join(static, "user_id", "left")
        return known.groupBy("segment", F.window("ts", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("price").alias("total")).select("segment", "n", "total")

    parts = runner.Clocked(tick_stream(t), daily, "static").closed().where("segment is not null")
    return parts.groupBy("segment").agg(F.sum("n").alias("n"), rd(F.sum("total"), 4).alias("total"))


# ---------------------------------------------------------------- sleeves and portfolio

cte(
    "sl_in",
    "SELECT symbol, day, w AS target, prev_close, close, note, row_number() OVER (PARTITION BY symbol ORDER BY day) AS i, open FROM (SELECT f.*, b.open FROM flat f JOIN bars b ON f.symbol = b.symbol AND f.day = b.open_time)",
    "flat",
    "bars",
)
cte(
    "sl",
    """SELECT symbol, i, day, CASE WHEN note IS NULL THEN close END AS mark, 0.0::DOUBLE AS held, 0.0::DOUBLE AS ret FROM sl_in WHERE i = 1
       UNION ALL -- recursive
       SELECT symbol, i, day, CASE WHEN idle THEN coalesce(mark, CASE WHEN note IS NULL THEN close END) ELSE close END, CASE WHEN idle THEN held ELSE new END,
              CASE WHEN idle THEN 0.0::DOUBLE ELSE new * af * (close / open) + (1 - new) * af - 1 END FROM (
         SELECT *, op - 0.002::DOUBLE * abs(new - held * (open / mark) / op) * op AS af FROM (SELECT *, held * (open / mark) + (1 - held) AS op FROM (
           SELECT s.symbol, s.i, s.day, s.note, s.open, s.close, e.held, e.mark, s.note IS NOT NULL OR e.mark IS NULL AS idle, CASE WHEN abs(s.target - e.held) > 0.05 THEN s.target ELSE e.held END AS new
           FROM sl e JOIN sl_in s ON s.symbol = e.symbol AND s.i = e.i + 1)))""",
    "sl_in",
)


def session_rows(t: Tables) -> DataFrame:
    return tape_flat(t).select("symbol", F.col("open_time").alias("day"), F.col("w").alias("target"), "open", "close", F.coalesce("note", F.lit("")).alias("note"))


@query("st_sleeve_state", sql(f"SELECT symbol, day, {r('held', 'held')}, {r('ret', 'ret', 8)}, {r('mark', 'mark')} FROM sl", "sl"))
def _(t: Tables) -> DataFrame:
    source = sinks.scratch(t.spark, "sessions-in")
    session_rows(t).write.parquet(source)
    states = sleeves.sleeve_states(runner.table_stream(t.spark, source))
    out = t.spark.read.parquet(runner.drain_to_parquet(states, "sleeves"))
    return out.select("symbol", "day", rd("held").alias("held"), rd("ret", 8).alias("ret"), rd("mark").alias("mark"))


@query(
    "st_portfolio_day",
    sql(
        f"""SELECT day, {r('g * exposure', 'ret', 8)}, present, {r('exposure', 'exposure')} FROM (SELECT d.day, coalesce(sum(w.weight * w.ret), 0) AS g, count(w.symbol) AS present,
              count(w.symbol) / (SELECT count(DISTINCT p_brand) FROM part)::DOUBLE * max(CASE WHEN c.avg_corr > 0.6::DOUBLE THEN 0.6::DOUBLE ELSE 1.0::DOUBLE END) AS exposure
            FROM (SELECT DISTINCT day FROM masked) d LEFT JOIN tilt_w w ON d.day = w.day LEFT JOIN avg_corr c ON d.day = c.day GROUP BY 1)""",
        "masked",
        "tilt_w",
        "avg_corr",
    ),
)
def _(t: Tables) -> DataFrame:
    masked, _timeline, _denoms = masked_inputs(t)
    source = sinks.scratch(t.spark, "sleeve-days")
    year = F.year(F.timestamp_millis("day"))
    stored = sinks.scratch(t.spark, "sleeve-all")
    masked.select("symbol", "day", "ret").write.parquet(stored)
    rows = t.spark.read.parquet(stored)
    # one file per block of years, written oldest first: the file source replays them in that order
    for lo, hi in ((0, 1997), (1998, 1999), (2000, 9999)):
        rows.where(year.between(lo, hi)).coalesce(1).write.mode("append").parquet(source)
    stream = runner.table_stream(t.spark, source, files_per_trigger=1)
    out = sleeves.portfolio_days(stream, t.spark, t.part.select("p_brand").distinct().count())
    days = t.spark.read.parquet(out)
    return days.select("day", rd("ret", 8).alias("ret"), "present", rd("exposure").alias("exposure"))
