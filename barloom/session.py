"""Session settings shared by the entry points, the bench and the tests."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import SparkSession

# Settings that only shape plans and semantics; nothing machine specific.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings every query of the package relies on."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = 8, app: str = "barloom", memory: str = "16g") -> SparkSession:
    """A local session for tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.warehouse.dir", os.environ.get("BARLOOM_WAREHOUSE", "/tmp/barloom-warehouse"))
        .config("spark.driver.extraJavaOptions", "-XX:+UseParallelGC")
        # Panels are small but CPU heavy per row: a local run should not coalesce their shuffles into one task.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
    )
    for key, value in RUNTIME_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """Folder for lineage cuts: the one the cluster names, else `fallback`.

    The cluster's `spark.checkpoint.dir` always wins, so a lost executor can
    re-read the data from shared storage.  Without either, a local master gets
    a temporary folder, removed when Python ends; any other master is refused,
    as executors would write to their own disks.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    chosen = configured or fallback
    current = spark.sparkContext.getCheckpointDir()
    if chosen is None:
        if current:
            return current
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        chosen = tempfile.mkdtemp(prefix="barloom-checkpoint-")
        atexit.register(shutil.rmtree, chosen, ignore_errors=True)
    if not current or (configured and not _inside(current, configured)):
        spark.sparkContext.setCheckpointDir(chosen)
    return chosen


def _inside(path: str, folder: str) -> bool:
    """Whether a checkpoint path lies below a folder, whatever scheme either is written with."""
    bare = [x.split(":", 1)[-1].lstrip("/") if ":" in x else x.lstrip("/") for x in (path, folder)]
    return bare[0].startswith(bare[1].rstrip("/"))
