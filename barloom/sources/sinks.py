"""Idempotent writers for tapes, quarantine splits and report tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh folder below the shared checkpoint folder of the session."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def store(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write an intermediate once to the shared folder and read it back.

    Used where a plan consumes the same expensive table several times: the fact
    scan behind it then happens once, and a lost executor re-reads files
    instead of recomputing the lineage.
    """
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def append_rows(new: DataFrame, path: str, keys: list[str]) -> None:
    """Append rows whose key the tape does not hold yet; existing rows never change."""
    spark = new.sparkSession
    fresh = new.dropDuplicates(keys)
    try:
        existing = spark.read.schema(new.schema).parquet(path).select(*keys)
        fresh = fresh.join(existing, keys, "left_anti")
    except Exception as exc:  # first append: nothing to read yet
        if "PATH_NOT_FOUND" not in str(exc):
            raise
    fresh.write.mode("append").parquet(path)


def write_lines(lines: DataFrame, by: str, order: str, path: str) -> None:
    """Text files of the column `value`, one file for each value of `by`, its lines by `order`.

    Dealt by a hash of `by`: after a join on `by` itself a repartition by it is dropped from the plan, and where
    that join turns into a broadcast at run time, the lines of a value stay spread over all tasks, a file in each.
    """
    dealt = lines.repartition(F.xxhash64(by)).sortWithinPartitions(by, order)
    dealt.select(by, "value").write.partitionBy(by).text(path)


def file_bytes(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of every file below a folder, a row per file that is not empty (of at most 2 GB), read by the tasks."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")


def write_quarantine(spark: SparkSession, source: str, classified: DataFrame, path: str) -> None:
    """Three outputs: every file of `source` byte for byte with its checksum, all rows annotated, verified rows only."""
    file_bytes(spark, source).withColumn("sha256", F.sha2("content", 256)).write.mode("overwrite").parquet(f"{path}/archive")
    classified.write.mode("overwrite").partitionBy("verdict").parquet(f"{path}/annotated")
    # The verified set is one partition of the annotated output: no second pass over the input.
    spark.read.parquet(f"{path}/annotated").where("verdict = 'verified'").drop("verdict").write.mode("overwrite").parquet(f"{path}/verified")


def write_report(metrics: DataFrame, path: str, run_id: str = "run_id") -> None:
    """Metric rows, partitioned by run."""
    metrics.write.mode("overwrite").partitionBy(run_id).parquet(path)
