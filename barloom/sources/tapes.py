"""Append-only JSONL tapes: strict and lenient readers, snapshot logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ordered import lag_split
from .sinks import store


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, at, value, last): the lines of all text files below a folder that are not blank, with their order.

    A file is read in blocks by several tasks; `at` grows with the lines of a
    block, so (block, at) is the order of the lines of a file, and `block` a
    chunk of it.  Stored, so that the order is the same for every reader.
    """
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value"
    )
    lines = store(raw.where(F.length(F.trim("value")) > 0), "tape-lines")
    tails = lines.groupBy("file").agg(F.max(F.struct("block", "at")).alias("tail"))
    return lines.join(tails, "file").select("file", "block", "at", "value", (F.struct("block", "at") == F.col("tail")).alias("last"))


def read_tape(spark: SparkSession, path: str) -> DataFrame:
    """Entries of JSONL evidence tapes with the first rule each line breaks: (file, block, at, date, port_ret, entry, reason).

    Rules in order: JSON, an object, a date, a valid one, one not seen before, one after the line before, a number as
    return, a finite one not under -1, and at least one asset.  Only a last line that is no JSON is a `torn_tail`.
    """
    lines = numbered_lines(spark, path).withColumn("entry", F.try_parse_json("value"))

    def kind(field: str) -> Column:
        return F.coalesce(F.schema_of_variant(F.try_variant_get("entry", field, "variant")), F.lit("VOID"))

    day = F.when(kind("$.date") == "STRING", F.try_variant_get("entry", "$.date", "string"))
    number = kind("$.port_ret").rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    value = F.when(number, F.try_variant_get("entry", "$.port_ret", "double"))
    typed = lines.withColumns(
        {
            "object": F.coalesce(F.schema_of_variant("entry").startswith("OBJECT"), F.lit(False)),
            "day": day,
            "date": F.when(day.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(day, "yyyy-MM-dd")),
            "port_ret": value,
            "assets": kind("$.assets").rlike("^OBJECT<.+>$"),
        }
    )
    before = lag_split(typed.where("date is not null").select("file", "block", "at", "date"), ["file"], ["block", "at"], {"previous": "date"}, F.col("block"))
    firsts = before.groupBy("file", "date").agg(F.min(F.struct("block", "at")).alias("first"))
    placed = typed.join(before.select("file", "block", "at", "previous"), ["file", "block", "at"], "left").join(firsts, ["file", "date"], "left")
    reason = (
        F.when(F.col("entry").isNull(), F.when(F.col("last"), "torn_tail").otherwise("not_json"))
        .when(~F.col("object"), "not_an_object")
        .when(F.col("day").isNull(), "no_date")
        .when(F.col("date").isNull(), "invalid_date")
        .when(F.struct("block", "at") > F.col("first"), "repeated_date")
        .when(F.col("date") <= F.col("previous"), "not_increasing")
        .when(F.col("port_ret").isNull(), "invalid_return")
        .when(F.isnan("port_ret") | (F.abs("port_ret") == float("inf")) | (F.col("port_ret") < -1), "impossible_return")
        .when(~F.col("assets"), "no_assets")
    )
    return placed.select("file", "block", "at", "date", "port_ret", "entry", F.coalesce(reason, F.lit("ok")).alias("reason"))


def tape_reasons(entries: DataFrame, tape: Column) -> DataFrame:
    """(tape, reason, n, voided): lines of each tape by reason; any reason but a torn tail voids the tape."""
    counts = entries.groupBy(tape.alias("tape"), "reason").agg(F.count(F.lit(1)).alias("n"))
    bad = ~F.col("reason").isin("ok", "torn_tail")
    return counts.withColumn("voided", F.max(bad).over(Window.partitionBy("tape")))


def parse_tape(lines: DataFrame, schema: str, keep: list[str]) -> DataFrame:
    """Lines (`value`) -> `row` struct plus `corrupt` flag."""
    parsed = F.from_json("value", schema + ", _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return lines.select(*keep, parsed.alias("row")).withColumn("corrupt", F.col("row._corrupt").isNotNull() | F.col("row").isNull())


SNAPSHOT_SCHEMA = "date string, universe array<struct<symbol: string, quote_volume_usd: double>>"


def snapshot_members(parsed: DataFrame) -> DataFrame:
    """(line_id, date, symbols) of well-formed snapshot lines; symbols once each, sorted."""
    return parsed.where("not corrupt and row.date is not null and row.universe is not null").select(
        "line_id", F.col("row.date").alias("date"), F.array_sort(F.array_distinct(F.col("row.universe.symbol"))).alias("symbols")
    )


def snapshot_conflicts(members: DataFrame) -> DataFrame:
    """Per date: number of lines and whether two of them disagree on the set."""
    key = F.sha2(F.concat_ws(",", "symbols"), 256)
    return members.groupBy("date").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.max(F.size("symbols")).cast("bigint").alias("n_symbols"),
        (F.min(key) != F.max(key)).alias("conflict"),
    )
