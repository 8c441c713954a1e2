"""Parsers for exchange and index payloads.

Each parser takes a DataFrame with one payload (or line) per row, so it works
the same on `spark.read.text(path, wholetext=True)` and on a stream of files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import finite, positive

CHART_SCHEMA = (
    "chart struct<result: array<struct<timestamp: array<bigint>, indicators: struct<quote: array<struct<"
    "open: array<double>, close: array<double>, volume: array<double>>>>>>>"
)


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: (file, payload) and the columns in the names of its folders."""
    pages = spark.read.text(path, wholetext=True)
    return pages.select(F.input_file_name().alias("file"), F.col("value").alias("payload"), *[c for c in pages.columns if c != "value"])


def _number(k: Column, i: int) -> Column:
    return F.get(k, F.lit(i)).try_cast("double")


def parse_klines(pages: DataFrame, keep: list[str]) -> DataFrame:
    """Kline arrays `[[t,o,h,l,c,v,_,qv,...],...]` in column `payload` -> bars."""
    rows = pages.select(*keep, F.explode(F.from_json("payload", "array<array<string>>")).alias("k"))
    k = F.col("k")
    return rows.select(
        *keep,
        F.get(k, F.lit(0)).try_cast("bigint").alias("open_time"),
        _number(k, 1).alias("open"),
        _number(k, 2).alias("high"),
        _number(k, 3).alias("low"),
        _number(k, 4).alias("close"),
        _number(k, 5).alias("volume"),
        finite(_number(k, 7)).alias("quote_volume"),
    )


def _chart_quote(payload: str = "payload") -> Column:
    return F.get(F.from_json(payload, CHART_SCHEMA)["chart"]["result"], F.lit(0))


def parse_chart(pages: DataFrame, keep: list[str]) -> DataFrame:
    """Chart payload with parallel arrays -> bars; rows without a positive close are dropped."""
    res = pages.select(*keep, _chart_quote().alias("res"))
    quote = F.get(F.col("res.indicators.quote"), F.lit(0))
    zipped = F.arrays_zip(
        F.col("res.timestamp").alias("ts"), quote["open"].alias("o"), quote["close"].alias("c"), quote["volume"].alias("v")
    )
    rows = res.select(*keep, F.explode(zipped).alias("z"))
    out = rows.select(
        *keep,
        (F.col("z.ts") * 1000).alias("open_time"),
        positive("z.o").alias("open"),
        positive("z.c").alias("close"),
        positive("z.v").alias("volume"),
    )
    return out.where(F.col("close").isNotNull() & F.col("open_time").isNotNull())


def parse_index_csv(lines: DataFrame, keep: list[str]) -> DataFrame:
    """`date,value` lines; '.' and empty mean missing."""
    rec = F.from_csv(F.col("value"), "date string, close string")
    rows = lines.select(*keep, rec.alias("rec"))
    return rows.select(
        *keep, F.col("rec.date").try_cast("date").alias("date"), F.col("rec.close").try_cast("double").alias("close")
    ).where(F.col("close").isNotNull() & F.col("date").isNotNull())


def read_index_csv(spark: SparkSession, path: str) -> DataFrame:
    """Index CSV files with a header line."""
    schema = "observation_date date, close double"  # folder names add their columns
    frame = spark.read.csv(path, header=True, schema=schema, nullValue=".")
    rest = [c for c in frame.columns if c not in ("observation_date", "close")]
    return frame.select(*rest, F.col("observation_date").alias("date"), "close").where("close is not null")


def parse_index_json(pages: DataFrame, keep: list[str]) -> DataFrame:
    """Chart payload -> (date, close), null closes dropped."""
    res = pages.select(*keep, _chart_quote().alias("res"))
    quote = F.get(F.col("res.indicators.quote"), F.lit(0))
    rows = res.select(*keep, F.explode(F.arrays_zip(F.col("res.timestamp").alias("ts"), quote["close"].alias("c"))).alias("z"))
    return rows.select(
        *keep, F.to_date(F.timestamp_seconds("z.ts")).alias("date"), F.col("z.c").alias("close")
    ).where("close is not null")


def stitch_pages(paged: DataFrame, max_candles: int) -> DataFrame:
    """Pages of bars -> one history per symbol: overlap bars once, oldest `max_candles` rows.

    The overlap is removed by an aggregate (map-side combine), not by a window
    over raw pages, so a symbol fetched many times stays cheap.
    """
    from pyspark.sql import Window

    values = [c for c in paged.columns if c not in ("symbol", "open_time", "page")]
    once = paged.groupBy("symbol", "open_time").agg(F.min_by(F.struct(*values), "page").alias("b"))
    w = Window.partitionBy("symbol").orderBy("open_time")
    ranked = once.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= max_candles)
    return ranked.select("symbol", "open_time", *[F.col(f"b.{v}").alias(v) for v in values])
