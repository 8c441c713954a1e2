"""Best-fit packing under conflicts.

Texts are cut into pieces of at most `capacity` tokens (words); full pieces are
bins of their own, the rests are packed.  Spark deals the rests by hash into
groups of about `GROUP` documents, so every group has the same mix of sources
and lengths; inside a group, best fit in decreasing order keeps the open bins
sorted by residual.  A bin carries bitmaps of its sources and duplicate
clusters.  The search starts at the tightest bin that has room and goes on to
its successors until one has no conflict; a new bin is opened only where none
is left.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, mix, prefix_hash, span_hash, store, text_chunks, word_spans

CAPACITY = 2048
GROUP = 4096
PER_SOURCE = 2


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, source, n_tokens and cluster (hash of the lower-cased word sequence) of every row."""

    def run(batches):
        for batch in batches:
            counts, keys = np.zeros(len(batch), dtype=np.int64), np.zeros(len(batch), dtype=np.uint64)
            for first, end, data, offsets in text_chunks(batch.column("text")):
                start, stop, row = word_spans(data, offsets)
                hashes = span_hash(prefix_hash(data, LOWER), start, stop)
                lo = np.searchsorted(row, np.arange(end - first + 1))
                place = np.arange(len(row)) - lo[row] if len(row) else np.zeros(0, dtype=np.int64)
                sums = np.zeros(len(row) + 1, dtype=np.uint64)
                np.cumsum(mix(hashes + mix(place.astype(np.uint64))), out=sums[1:])
                counts[first:end] = np.diff(lo)
                keys[first:end] = sums[lo[1:]] - sums[lo[:-1]]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("source"), pa.array(counts), pa.array(keys.view(np.int64))], ["doc_id", "source", "n_tokens", "cluster"]
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, source string, n_tokens long, cluster long")


def best_fit(items: Iterable[tuple[int, object, object]], capacity: int, per_source: int) -> list[tuple[int, int]]:
    """(bin, offset) of each (size, source, cluster), taken in the given order; sizes are between 1 and capacity.

    A bin takes at most `per_source` items of a source and one of a cluster.
    """
    items = list(items)
    sources = {s: k for k, s in enumerate(dict.fromkeys(s for _, s, _ in items))}
    often = Counter(c for _, _, c in items)
    clusters = {c: k for k, c in enumerate(c for c, n in often.items() if n > 1)}
    mask = (1 << per_source) - 1
    source_bits: list[int] = []
    cluster_bits: list[int] = []
    residuals: list[tuple[int, int]] = []  # (room left, bin), sorted
    out = []
    for size, source, cluster in items:
        shift, bit = sources[source] * per_source, 1 << clusters[cluster] if cluster in clusters else 0
        at = bisect_left(residuals, (size, -1))
        while at < len(residuals):
            chosen = residuals[at][1]
            if (source_bits[chosen] >> shift) & mask != mask and not cluster_bits[chosen] & bit:
                break
            at += 1
        if at < len(residuals):
            room, chosen = residuals.pop(at)
        else:
            room, chosen = capacity, len(source_bits)
            source_bits.append(0)
            cluster_bits.append(0)
        used = (source_bits[chosen] >> shift) & mask
        source_bits[chosen] |= (used + 1 | used) << shift  # unary: one more bit of this source
        cluster_bits[chosen] |= bit
        out.append((chosen, capacity - room))
        if room > size:
            insort(residuals, (room - size, chosen))
    return out


def pack(docs: DataFrame, capacity: int = CAPACITY, per_source: int = PER_SOURCE, group: int = GROUP) -> DataFrame:
    """(doc_id, source, piece, n_tokens, bin_id, bin_offset): the pieces of every row of `docs` and their places.

    Piece k holds the words from k * capacity on.  Texts without words (null,
    empty) are returned once with piece 0, no tokens and no bin.  A null source
    is a source.  Repeated rows are packed each, in different bins as they are
    one duplicate cluster.  Ties go by doc_id, then by row.  An empty table
    gives an empty result.
    """
    rows = store(measured(docs).withColumn("line", F.monotonically_increasing_id()), "op3-rows")
    rest = (F.col("n_tokens") % capacity).cast("long")
    groups = max(1, -(-rows.where(rest > 0).count() // group))

    def place(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["n_tokens", "doc_id", "line"], ascending=[False, True, True], kind="stable", na_position="last")
        found = best_fit(zip(part["n_tokens"].tolist(), part["source"].where(part["source"].notna(), None).tolist(), part["cluster"].tolist(), strict=True), capacity, per_source)
        bins = np.array([b for b, _ in found], dtype=np.int64)
        return pd.DataFrame(
            {
                "doc_id": part["doc_id"].astype("Int64"), "source": part["source"], "piece": part["piece"], "n_tokens": part["n_tokens"],
                "bin_id": part["group"].astype("int64").to_numpy() * (1 << 32) + bins, "bin_offset": np.array([o for _, o in found], dtype=np.int64),
            }
        )

    schema = "doc_id long, source string, piece long, n_tokens long, bin_id long, bin_offset long"
    rests = rows.where(rest > 0).select(
        "doc_id", "source", F.floor(F.col("n_tokens") / capacity).cast("long").alias("piece"), rest.alias("n_tokens"), "cluster", "line", F.pmod(F.xxhash64("line"), F.lit(groups)).alias("group")
    )
    packed = rests.groupBy("group").applyInPandas(place, schema)
    # full pieces are bins of their own: ids below zero
    full = rows.where(F.col("n_tokens") >= capacity).select(
        "doc_id", "source", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n_tokens") / capacity).cast("long") - 1)).alias("piece"), F.lit(capacity).cast("long").alias("n_tokens"), "line"
    )
    alone = full.select("doc_id", "source", "piece", "n_tokens", (-1 - F.monotonically_increasing_id()).alias("bin_id"), F.lit(0).cast("long").alias("bin_offset"))
    none = rows.where("n_tokens = 0").select(
        "doc_id", "source", F.lit(0).cast("long").alias("piece"), "n_tokens", F.lit(None).cast("long").alias("bin_id"), F.lit(None).cast("long").alias("bin_offset")
    )
    return packed.unionByName(alone).unionByName(none)
