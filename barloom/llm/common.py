"""Shared helpers of the operators: tables, lineage cuts, bytes of a batch as arrays, components, dense ranks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"
MASK64 = (1 << 64) - 1
SENT = 32 << 20  # bytes of a table that is sent to every executor: the driver builds it and may hold several


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where that is unset and the master is local."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="spark-llm-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def store(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more; what was derived from them must have been stored."""
    for table in tables:
        spark = table.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def words(text: Column) -> Column:
    """Array of the words of a text; empty for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def only(df: DataFrame, keys: DataFrame, key: str, how: str = "left_semi", bound: int | None = None) -> DataFrame:
    """Join a wide table with a narrow one of keys: a semi join (the default), anti join or inner join.

    A table of at most `bound` rows is broadcast, so the wide rows stay where
    they are; a longer one is joined by shuffle.  By default these are the rows
    that fill `SENT` in the driver: a slot, a header and eight bytes a column.
    """
    bound = SENT // (40 + 8 * len(keys.columns)) if bound is None else bound
    short = keys.limit(bound + 1).count() <= bound
    return df.join(F.broadcast(keys) if short else keys, key, how)


# ---------------------------------------------------------------- bytes of a batch


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BASE = 0x9E3779B97F4A7C15 | 1
BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
LOWER = BYTE.copy()
LOWER[65:91] = BYTE[97:123]
STEPS = mix(np.arange(901, 965, dtype=np.uint64)) | np.uint64(1)
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64 for i < n, kept per worker."""
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for key, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            table = np.ones(size, dtype=np.uint64)
            step = 1
            while step < size:
                table[step : 2 * step] = table[:step] * np.uint64(pow(base, step, 1 << 64))
                step *= 2
            _POWERS[key] = table
    return _POWERS["up"][:n], _POWERS["down"][:n]


def prefix_hash(data: np.ndarray, table: np.ndarray = BYTE) -> np.ndarray:
    """P with P[j] - P[i] the position-weighted sum of data[i:j]."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(table[data] * up[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of data[start:end], equal for equal bytes wherever they stand."""
    _, down = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start])


def text_chunks(column: pa.Array, limit: int = 2 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows holding about `limit` bytes; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    row, rows = 0, len(column)
    while row < rows:
        end = int(np.searchsorted(off, off[row] + limit, side="right")) - 1
        end = min(rows, max(row + 1, end))
        yield row, end, raw[off[row] : off[end]], off[row : end + 1] - off[row]
        row = end


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word; words never cross rows."""
    gap = np.ones(len(data) + 1, dtype=bool)
    gap[:-1] = _IS_SPACE[data]
    inner = offsets[1:-1]
    first = ~gap[:-1]
    first[1:] &= gap[:-2]
    heads = inner[(inner < len(data))]
    first[heads] = ~gap[heads]
    start = np.flatnonzero(first)
    last = ~gap[:-1]
    last[:-1] &= gap[1:-1]
    tails = inner[inner > 0] - 1
    last[tails] = ~gap[tails]
    end = np.flatnonzero(last) + 1
    row = np.searchsorted(offsets, start, side="right") - 1
    return start, end, row


def word_grams(hashes: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and index of the first word of every n-word window inside one row."""
    if len(hashes) < n:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    size = len(hashes) - n + 1
    total = np.zeros(size, dtype=np.uint64)
    for k in range(n):
        total += hashes[k : k + size] * STEPS[k]
    at = np.flatnonzero(row[:size] == row[n - 1 :])
    return mix(total[at]), at


# ---------------------------------------------------------------- graphs and ranks


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, component): the smallest node reachable over the undirected edges (a, b); nodes without an edge are absent.

    Every round takes the smallest label around a node and the label that this
    label had itself, so a chain of length n settles in about log n rounds.  A
    round is one stored table; the loop ends when no label moves.
    """
    both = store(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), f"{label}-edges")
    state = store(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("component")), label)
    while True:
        around = both.join(state.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        stepped = state.join(around, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("near"))
        far = state.select(F.col("node").alias("near"), F.col("component").alias("far"))
        state = store(stepped.join(far, "near", "left").select("node", "old", F.least("near", "far").alias("component")), label)
        moved = state.where("old <> component").limit(1).count()
        state = state.select("node", "component")
        if not moved:
            return state


def dense_rank(df: DataFrame, by: list[str], chunk: str, order: list, name: str) -> DataFrame:
    """Add a gapless 0-based rank within `by`, ordered by (chunk, order...).

    Rows are sorted inside (by, chunk) only; the counts of the chunks, a small
    table, give each chunk its offset.  No task holds a whole group.
    """
    counts = df.groupBy(*by, chunk).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = Window.partitionBy(*by, chunk).orderBy(*order)
    ranked = df.withColumn("_at", F.row_number().over(within) - 1)
    return ranked.join(starts, [*by, chunk]).withColumn(name, (F.col("_before") + F.col("_at")).cast("long")).drop("_before", "_at")
