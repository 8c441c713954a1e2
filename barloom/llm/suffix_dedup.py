"""Removal of repeated byte strings by sampled suffixes.

A byte goes when a string of `LENGTH` bytes over it also starts earlier.  Like
a difference-cover construction this sorts sampled suffixes first, names them,
and decides the remaining ones from (bytes up to a sample, name of the sample),
comparing prefixes up to `LENGTH` only.  The sample is not taken by residues
but by content (a synchronising set): a position is sampled when its `GRAM`-byte
name is the smallest among those of some string of LENGTH bytes.  Equal strings
then hold the same sample at the same place, so samples whose name is unique in
the corpus settle all strings around them at once.  README has the figures that
rule out residues.

1. Equal texts collapse to the first one; the others repeat whole.
2. Samples with a repeated name are kept, with the hash of their context (all
   strings that they decide) as the name of the next level.
3. Equal contexts collapse again: all but the first are repeated.
4. For names with several contexts, the strings of each context are sorted by
   hash and position next to each other; all but the first are repeated.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only, prefix_hash, mix, span_hash, store, text_chunks

LENGTH = 100
GRAM = 32
REACH = LENGTH - GRAM + 1  # GRAM-byte names in a string
PLACE = np.uint64((1 << 28) - 1)  # low bits of a sort key: the position
CROWD = 50_000  # contexts of one name beyond which Spark sorts the strings instead of one task


def samples(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, first, last, name, context) of each sample: it decides the strings starting at first .. last of its row."""
    none = np.zeros(0, dtype=np.int64)
    if len(data) < LENGTH:
        return none, none, none, none, none
    prefix = prefix_hash(data)
    grams = np.arange(len(data) - GRAM + 1)
    names = span_hash(prefix, grams, grams + GRAM)
    least = names & ~PLACE | grams.astype(np.uint64)
    width = 1
    while 2 * width <= REACH:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < REACH:
        least = np.minimum(least[: len(data) - LENGTH + 1], least[REACH - width :])
    at = (least & PLACE).astype(np.int64)
    starts = np.arange(len(at))
    row = np.searchsorted(offsets, starts, side="right") - 1
    valid = np.flatnonzero(starts + LENGTH <= offsets[row + 1])
    if not len(valid):
        return none, none, none, none, none
    at, row = at[valid], row[valid]
    head = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (row[1:] != row[:-1])]))
    tail = np.concatenate([head[1:], [len(at)]]) - 1
    first, last, place = valid[head], valid[tail], at[head]
    context = mix(span_hash(prefix, first, last + LENGTH) + mix((place - first).astype(np.uint64)))
    base = offsets[row[head]]
    return row[head], first - base, last - base, names[place].view(np.int64), context.view(np.int64)


def sampled(docs: DataFrame, contexts: bool) -> DataFrame:
    """name alone, or (name, context, doc_id, first, last), of every sample."""

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            for start, _, data, offsets in text_chunks(batch.column("text")):
                row, first, last, name, context = samples(data, offsets)
                if not len(row):
                    continue
                if not contexts:
                    yield pa.RecordBatch.from_arrays([pa.array(name)], ["name"])
                    continue
                yield pa.RecordBatch.from_arrays(
                    [pa.array(name), pa.array(context), ids.take(pa.array(start + row)), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))],
                    ["name", "context", "doc_id", "first", "last"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "name long, context long, doc_id long, first int, last int" if contexts else "name long")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, two hashes and the sha256 of every text."""

    def run(batches):
        for batch in batches:
            one, two, sizes, shas = [], [], [], []
            for text in batch.column("text").to_pylist():
                raw = (text or "").encode("utf-8")
                digest = hashlib.sha256(raw)
                one.append(int.from_bytes(digest.digest()[:8], "little", signed=True))
                two.append(int.from_bytes(digest.digest()[8:16], "little", signed=True))
                sizes.append(len(raw))
                shas.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(shas, pa.string())], ["doc_id", "n_bytes", "h1", "h2", "sha"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, h1 long, h2 long, sha string")


def contexts_of(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(name, doc_id, first, body): the bytes of listed contexts, cut from the texts of their documents."""
    wanted = rows.groupBy("doc_id").agg(F.collect_list(F.struct("name", "first", "last")).alias("wanted"))  # at most the samples of a text

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for doc_id, text, listed in zip(ids, batch.column("text").to_pylist(), batch.column("wanted").to_pylist()):
                raw = text.encode("utf-8")
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([x["name"] for x in listed], pa.int64()), pa.array([doc_id] * len(listed), pa.int64()), pa.array([x["first"] for x in listed], pa.int32()),
                        pa.array([raw[x["first"] : x["last"] + LENGTH] for x in listed], pa.binary()),
                    ],
                    ["name", "doc_id", "first", "body"],
                )

    return docs.select("doc_id", "text").join(wanted, "doc_id").mapInArrow(run, "name long, doc_id long, first int, body binary")


def _strings(bodies: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, start within the body) of every LENGTH-byte string of the bodies."""
    bodies = bodies.combine_chunks() if isinstance(bodies, pa.ChunkedArray) else bodies
    _, offsets, data = bodies.buffers()
    off = np.frombuffer(offsets, dtype=np.int32)[bodies.offset : bodies.offset + len(bodies) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]]
    off = off - off[0]
    count = np.maximum(np.diff(off) - LENGTH + 1, 0)
    row = np.repeat(np.arange(len(count)), count)
    start = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    at = off[row] + start
    return span_hash(prefix_hash(raw), at, at + LENGTH), row, start


def _spans(row: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merge string starts, sorted within rows, into (row, start, end) of covered bytes."""
    if not len(row):
        return row, start, start
    head = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (start[1:] > start[:-1] + LENGTH)]))
    tail = np.concatenate([head[1:], [len(row)]]) - 1
    return row[head], start[head], start[tail] + LENGTH


def repeated_inside(bodies: DataFrame) -> DataFrame:
    """(doc_id, start, end): bytes of strings that stand in an earlier context of the same name; one task per set of names."""
    ordered = bodies.repartition("name").sortWithinPartitions("name", "doc_id", "first")

    def judged(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        hashes, row, start = _strings(table.column("body"))
        order = np.lexsort((start, row, hashes))  # rows are sorted by document and position within a name
        later = np.zeros(len(row), dtype=bool)
        later[order[1:]] = hashes[order[1:]] == hashes[order[:-1]]
        row, lo, hi = _spans(row[later], start[later])
        first = table.column("first").to_numpy().astype(np.int64)[row]
        ids = table.column("doc_id").combine_chunks() if isinstance(table.column("doc_id"), pa.ChunkedArray) else table.column("doc_id")
        return pa.RecordBatch.from_arrays([ids.take(pa.array(row)), pa.array(first + lo), pa.array(first + hi)], ["doc_id", "start", "end"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size < 20_000:
                continue
            table = pa.Table.from_batches(held)
            names = table.column("name").to_numpy()
            cut = int(np.searchsorted(names, names[-1]))  # the last name may go on in the next batch
            if cut:
                yield judged(table.slice(0, cut))
                held, size = table.slice(cut).to_batches(), table.num_rows - cut
        if size:
            yield judged(pa.Table.from_batches(held))

    return ordered.mapInArrow(run, "doc_id long, start long, end long")


def repeated_in_crowd(bodies: DataFrame) -> DataFrame:
    """The same for names with very many contexts: every string is a row, the first of each hash is found with map-side combine."""

    def run(batches):
        for batch in batches:
            hashes, row, start = _strings(batch.column("body"))
            first = batch.column("first").to_numpy().astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), batch.column("doc_id").take(pa.array(row)), pa.array(first[row] + start)], ["hash", "doc_id", "start"])

    each = bodies.mapInArrow(run, "hash long, doc_id long, start long")
    firsts = each.groupBy("hash").agg(F.min(F.struct("doc_id", "start")).alias("least"))
    later = each.join(firsts, "hash").where(F.struct("doc_id", "start") > F.col("least"))
    return later.select("doc_id", "start", (F.col("start") + LENGTH).alias("end")).distinct()


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) of every row of `docs` (doc_id, text).

    `kept` is the remaining bytes, null where nothing was removed.  Null and
    empty texts have no bytes; texts under `LENGTH` bytes never lose any.
    doc_id is the key and gives the order; rows without one are returned whole
    and match nothing.  An empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    prints = store(fingerprints(rows), "op6-texts")
    known = prints.where("doc_id is not null")
    heads = known.groupBy("h1", "h2", "n_bytes").agg(F.min("doc_id").alias("head"))
    linked = store(known.join(heads, ["h1", "h2", "n_bytes"]).select("doc_id", "head", "n_bytes"), "op6-copies")
    copies = linked.where("doc_id <> head").select("doc_id").distinct()
    texts = only(rows.where("doc_id is not null"), copies, "doc_id", "left_anti")

    # stored, so that the join below has plain shuffles on both sides and a name in very many texts can be split
    shared = store(sampled(texts, False).groupBy("name").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("name"), "op6-names")
    hits = store(sampled(texts, True).join(shared, "name"), "op6-samples")
    classes = store(hits.groupBy("name", "context").agg(F.min(F.struct("doc_id", "first", "last")).alias("least")), "op6-contexts")
    again = hits.join(classes, ["name", "context"]).where(F.struct("doc_id", "first", "last") > F.col("least")).select(
        "doc_id", F.col("first").cast("long").alias("start"), (F.col("last") + LENGTH).cast("long").alias("end")
    )
    several = classes.groupBy("name").agg(F.count(F.lit(1)).alias("contexts")).where("contexts > 1")
    open_rows = store(classes.join(several, "name").select("name", "contexts", "least.doc_id", "least.first", "least.last"), "op6-open")
    calm = contexts_of(only(texts, open_rows.select("doc_id").distinct(), "doc_id"), open_rows.where(F.col("contexts") <= CROWD))
    covered = again.unionByName(repeated_inside(calm))
    crowd = open_rows.where(F.col("contexts") > CROWD)
    if crowd.limit(1).count():
        covered = covered.unionByName(repeated_in_crowd(store(contexts_of(only(texts, crowd.select("doc_id").distinct(), "doc_id"), crowd), "op6-crowd")))
    spans = store(covered.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("spans")), "op6-spans")  # at most the samples of a text

    def cut(batches):
        for batch in batches:
            ids, removed, counts, shas, kept = batch.column("doc_id"), [], [], [], []
            for text, listed in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                raw, pieces, at, n, gone = text.encode("utf-8"), [], 0, 0, 0
                reach = -1
                for lo, hi in sorted((x["start"], x["end"]) for x in listed):
                    if lo > reach:
                        pieces.append(raw[at:lo])
                        n += 1
                    gone += max(0, hi - max(lo, reach))
                    reach = max(reach, hi)
                    at = reach
                pieces.append(raw[at:])
                rest = b"".join(pieces)
                removed.append(gone)
                counts.append(n)
                shas.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest)
            yield pa.RecordBatch.from_arrays([ids, pa.array(removed, pa.int64()), pa.array(counts, pa.int64()), pa.array(shas, pa.string()), pa.array(kept, pa.binary())], ["doc_id", "n_removed", "n_spans", "cut_sha", "kept"])

    touched = only(texts, spans.select("doc_id"), "doc_id").join(spans, "doc_id").mapInArrow(cut, "doc_id long, n_removed long, n_spans long, cut_sha string, kept binary")
    whole = linked.where((F.col("doc_id") != F.col("head")) & (F.col("n_bytes") >= LENGTH)).select("doc_id").distinct().withColumn("whole", F.lit(True))
    out = prints.join(touched, "doc_id", "left").join(whole, "doc_id", "left")
    gone = F.coalesce("whole", F.lit(False))
    return out.select(
        "doc_id", "n_bytes", F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(gone, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.sha2(F.lit(b""), 256)).otherwise(F.coalesce("cut_sha", "sha")).alias("kept_sha256"),
        F.when(gone, F.lit(b"")).otherwise(F.col("kept")).alias("kept"),
    )
