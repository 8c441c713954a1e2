"""Price-bar panels built from star-schema fact tables.

Every builder aggregates the fact rows per (symbol, day) *before* any window
runs, so a window partition holds at most one row per calendar day whatever
the size of the fact table; a symbol that owns a third of all fact rows only
costs map-side partial sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DAY_MS = 86_400_000
SMOOTHING_ROWS = 60


class Tables:
    """Lazy access to the parquet tables of one scale-factor folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self._kept: dict[str, DataFrame] = {}

    def keep(self, name: str, build) -> DataFrame:
        """A table stored on first use and shared by the rest of the query."""
        if name not in self._kept:
            from .sinks import store

            self._kept[name] = store(build(), name)
        return self._kept[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.root}/{name}.parquet")


def day_ms(ts: Column) -> Column:
    """Epoch milliseconds of the UTC midnight of a date or timestamp."""
    return F.unix_date(F.to_date(ts)).cast("bigint") * F.lit(DAY_MS)


def smoothed_bars(daily: DataFrame) -> DataFrame:
    """(symbol, open_time, price, volume, quote_volume, n) -> OHLCV bars.

    The close is the trailing 60-row mean of the day price (the raw synthetic
    price is close to white noise); the open gaps off the previous close by a
    few per mille that depend on the row count of the day.
    """
    w = Window.partitionBy("symbol").orderBy("open_time")
    closes = daily.withColumn(
        "close", F.round(F.avg("price").over(w.rowsBetween(-(SMOOTHING_ROWS - 1), 0)), 6)
    )
    gap = F.lit(1.0) + ((F.col("n") % 7) - 3) / F.lit(1000.0)
    opened = closes.withColumn("open", F.coalesce(F.lag("close").over(w) * gap, F.col("close")))
    return opened.select(
        "symbol",
        "open_time",
        "open",
        (F.greatest("open", "close") * 1.002).alias("high"),
        (F.least("open", "close") * 0.998).alias("low"),
        "close",
        "volume",
        "quote_volume",
    )


def brand_bars(t: Tables) -> DataFrame:
    """25 symbols (part brands); the day price is a volume-weighted unit price."""
    daily = (
        t.lineitem.select("l_partkey", "l_shipdate", "l_quantity", "l_extendedprice")
        .join(t.part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(F.col("p_brand").alias("symbol"), day_ms(F.col("l_shipdate")).alias("open_time"))
        .agg(
            F.round(F.sum("l_quantity"), 2).alias("volume"),
            F.round(F.sum("l_extendedprice"), 2).alias("quote_volume"),
            F.count(F.lit(1)).alias("n"),
        )
        .withColumn("price", F.col("quote_volume") / F.col("volume"))
    )
    return smoothed_bars(daily)


def stored_brand_bars(t: Tables) -> DataFrame:
    """The brand panel written once per query: at most brands x days rows, whatever the fact table holds."""
    return t.keep("brand-bars", lambda: brand_bars(t))


def _order_daily(t: Tables, symbol: Column, joined: DataFrame) -> DataFrame:
    return (
        joined.groupBy(symbol.alias("symbol"), day_ms(F.col("o_orderdate")).alias("open_time"))
        .agg(
            F.count(F.lit(1)).cast("double").alias("volume"),
            F.round(F.sum("o_totalprice"), 2).alias("quote_volume"),
            F.count(F.lit(1)).alias("n"),
        )
        .withColumn("price", F.col("quote_volume") / F.col("volume"))
    )


def segment_bars(t: Tables) -> DataFrame:
    """5 symbols (market segments) with long histories; BUILDING is the proxy market."""
    joined = t.orders.select("o_custkey", "o_orderdate", "o_totalprice").join(
        t.customer.select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey")
    )
    return smoothed_bars(_order_daily(t, F.col("c_mktsegment"), joined))


def region_bars(t: Tables) -> DataFrame:
    """5 symbols (region keys as text) through a three-way join."""
    joined = (
        t.orders.select("o_custkey", "o_orderdate", "o_totalprice")
        .join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .join(
            F.broadcast(t.nation.select("n_nationkey", "n_regionkey")),  # 25 rows at every scale
            F.col("c_nationkey") == F.col("n_nationkey"),
        )
    )
    return smoothed_bars(_order_daily(t, F.concat(F.lit("R"), F.col("n_regionkey").cast("string")), joined))


def ticks(t: Tables) -> DataFrame:
    """Event rows as ticks: (symbol, seq, ts_ms, price, size)."""
    return t.events.select(
        F.col("event_type").alias("symbol"),
        F.col("event_id").alias("seq"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("value").alias("price"),
        F.get_json_object("props", "$.k").cast("double").alias("size"),
    )
