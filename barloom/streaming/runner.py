"""Start, drain and store streaming queries on shared storage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.sinks import scratch

END_OF_TIME = "2200-01-01 00:00:00"


def table_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A parquet folder (or file) as a stream, with the schema of the files already there."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def drain_to_parquet(stream: DataFrame, label: str, mode: str = "append", partition: str | None = None) -> str:
    """Process everything available into a parquet folder and return it (exactly once by the file sink's log)."""
    spark = stream.sparkSession
    out, log = scratch(spark, label), scratch(spark, f"{label}-log")
    writer = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", log).outputMode(mode)
    if partition:
        writer = writer.partitionBy(partition)
    writer.trigger(availableNow=True).start().awaitTermination()
    return out


def drain_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None], label: str, mode: str = "append") -> None:
    """Process everything available through `handle(batch, batch_id)`, which must be idempotent per batch id."""
    log = scratch(stream.sparkSession, f"{label}-log")
    stream.writeStream.foreachBatch(handle).option("checkpointLocation", log).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def batch_sink(out: str) -> Callable[[DataFrame, int], None]:
    """Writer of one folder per batch id: a batch that runs again replaces its own rows and no others."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return write


class Clocked:
    """A stream with a clock beside it, so that time passes, and windows close, without new rows.

    The clock is a folder of rows that hold a time only.  `run` processes what
    is there; `tick` sets the clock and runs again on the same checkpoint.  The
    result has a folder per batch.  `late` counts the rows that came after
    their window had closed.
    """

    def __init__(self, rows: DataFrame, build: Callable[[DataFrame], DataFrame], label: str, mode: str = "append", time: str = "ts"):
        spark = rows.sparkSession
        self.spark, self.mode, self.time, self.late = spark, mode, time, 0
        self.out, self.log, self.beats = (scratch(spark, f"{label}{part}") for part in ("", "-log", "-clock"))
        spark.createDataFrame([], f"{time} timestamp").write.parquet(self.beats)
        clock = spark.readStream.schema(f"{time} timestamp").parquet(self.beats)
        self.stream = build(rows.unionByName(clock, allowMissingColumns=True))

    def run(self) -> Clocked:
        sink = self.stream.writeStream.foreachBatch(batch_sink(self.out)).option("checkpointLocation", self.log).outputMode(self.mode)
        query = sink.trigger(availableNow=True).start()
        query.awaitTermination()
        self.late += sum(int(op["numRowsDroppedByWatermark"]) for p in query.recentProgress for op in p["stateOperators"])
        return self

    def tick(self, now: str) -> Clocked:
        """Let the clock show `now` (UTC)."""
        self.spark.sql("SELECT 1").select(F.to_timestamp(F.lit(now)).alias(self.time)).write.mode("append").parquet(self.beats)
        return self.run()

    def rows(self) -> DataFrame:
        """All result rows with the id of their batch."""
        return self.spark.read.schema(self.stream.schema.add("batch", "long")).parquet(self.out)

    def closed(self) -> DataFrame:
        """The whole result of a bounded source: run, then let the clock pass every window."""
        return self.run().tick(END_OF_TIME).rows().drop("batch")
