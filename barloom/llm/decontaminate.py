"""Benchmark decontamination by templates.

Words are canonicalised: numbers, names (capitals inside a sentence) and units
after a number become typed placeholders, case and edge punctuation go.  Every
window of `WINDOW` canonical words of a document whose hash occurs among the
windows of the benchmark is joined with them by hash in Spark, and the slots of
matching runs must agree: one value of the item always stands for one value of
the document.  A document that covers enough of an item's windows, or holds an
unbroken run of `EXCERPT` of its words, is contaminated, also when the question
was given other numbers or names.

Capitals and line ends decide what is a name, and copies change them.  Windows
with names are therefore looked up in a second form too, in which names are
lower-cased words like all others and only numbers and units are placeholders:
a copy in lower, upper or title case or with other line breaks matches there.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, prefix_hash, span_hash, store, text_chunks, word_grams, word_spans

WINDOW = 6
SHORTEST = 4  # items of fewer words are too common to look for
COVERAGE = 0.4
EXCERPT = 13  # words of an excerpt that counts whatever its share of the item
BLOCK_KEYS = 2_000_000  # benchmark windows looked up in one pass over the documents
NUMERAL = re.compile(r"[+-]?[$€£]?[0-9][0-9.,:/]*(?:%|[a-z]{1,3})?")
EDGES = b".,;:?!\"'()[]{}<>*%&#|-_=/\\~`"
#: Units that follow a number.
UNITS = frozenset("mm cm m km in ft mi mg g kg t lb oz ml l s sec second seconds min minute minutes h hour hours day days week weeks month months year years am pm percent $ € £ dollars euros mph kmh °c °f °".split())
MARKS = mix(np.array([11, 22, 33], dtype=np.uint64))  # placeholders of number, name and unit


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(chars)] = True
    return out


_ENDS, _EDGE, _DIGIT, _SIGN = _table(b".!?:\n"), _table(EDGES), _table(b"0123456789"), _table(b"+-$" + "€£".encode())


def _pairs() -> np.ndarray:
    """Lower case of every code point below 0x800, where that is one letter of two bytes."""
    out = np.arange(0x800)
    for point in range(0x80, 0x800):
        low = chr(point).lower()
        if len(low) == 1 and 0x80 <= ord(low) < 0x800:
            out[point] = ord(low)
    return out


_LOW = _pairs()


def lowered(data: np.ndarray) -> np.ndarray:
    """Bytes in lower case, for letters of one and two bytes (other scripts are compared as written)."""
    low = data.copy()
    low[(data >= 65) & (data <= 90)] += 32
    lead = np.flatnonzero((data[:-1] >= 0xC2) & (data[:-1] <= 0xDF) & (data[1:] >= 0x80) & (data[1:] <= 0xBF))
    points = _LOW[(data[lead].astype(np.int64) & 0x1F) << 6 | (data[lead + 1] & 0x3F)]
    low[lead], low[lead + 1] = 0xC0 | points >> 6, 0x80 | points & 0x3F
    return low


def _text(data: np.ndarray, start: int, end: int) -> str:
    return bytes(data[start:end]).decode("utf-8", "replace")


def canonical(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, name-blind hash, row, start, end, is_value, is_name) of the canonical words of a chunk; words of edge punctuation only are left out."""
    start, end, row = word_spans(data, offsets)
    if not len(start):
        none = np.zeros(0, dtype=np.uint64)
        return none, none, row, start, end, np.zeros(0, dtype=bool), np.zeros(0, dtype=bool)
    opens = np.ones(len(start), dtype=bool)  # first of a row, or after the end of a sentence or line
    opens[1:] = (row[1:] != row[:-1]) | _ENDS[data[end[:-1] - 1]] | (data[np.minimum(end[:-1], len(data) - 1)] == 10)
    place = np.arange(len(data))
    inner = ~_EDGE[data]
    after = np.minimum.accumulate(np.where(inner, place, len(data))[::-1])[::-1]
    before = np.maximum.accumulate(np.where(inner, place, -1))
    start, end = after[start], before[end - 1] + 1
    keep = start < end
    start, end, row, opens = start[keep], end[keep], row[keep], opens[keep]
    if not len(start):
        none = np.zeros(0, dtype=np.uint64)
        return none, none, row, start, end, np.zeros(0, dtype=bool), np.zeros(0, dtype=bool)
    low = lowered(data)
    hashes = span_hash(prefix_hash(low), start, end)

    number = np.zeros(len(start), dtype=bool)  # a digit first, or after a sign; the few candidates are read as text
    for k in np.flatnonzero(_DIGIT[data[start]] | (_SIGN[data[start]] & (end - start > 1))).tolist():
        number[k] = NUMERAL.fullmatch(_text(low, start[k], end[k])) is not None
    unit = np.zeros(len(start), dtype=bool)
    for k in (np.flatnonzero(number[:-1] & (row[1:] == row[:-1])) + 1).tolist():
        unit[k] = not number[k] and _text(low, start[k], end[k]) in UNITS
    # a capital and then no other one; two-byte capitals are followed by their next letter two bytes on
    changed = low != data
    wide = (data[start] >= 0xC3) & (data[start] <= 0xDF)
    first = np.where(wide, start + 1, start)
    second = np.minimum(first + 1, len(data) - 1)
    second = np.where((data[second] >= 0xC3) & (data[second] <= 0xDF), np.minimum(second + 1, len(data) - 1), second)
    title = changed[first] & (first + 1 < end) & ~changed[second] & ~opens & ~unit
    hashes[number], hashes[unit] = MARKS[0], MARKS[2]
    blind = hashes.copy()
    hashes[title] = MARKS[1]
    return hashes, blind, row, start, end, number | unit, title


def windows(texts: DataFrame, key: str, lengths: tuple[int, ...], wanted: np.ndarray | None) -> DataFrame:
    """(key, n_words, size, position, hash, slots) of template windows; only those with a wanted hash, where given.

    A window with names has two rows, one a form; the forms of others are the same.
    """
    bits = 20
    mask = None
    if wanted is not None:
        wanted = np.sort(wanted.astype(np.int64).view(np.uint64))
        mask = np.zeros(1 << bits, dtype=bool)
        mask[(wanted >> np.uint64(64 - bits)).astype(np.int64)] = True

    def run(batches):
        for batch in batches:
            ids = batch.column(key)
            for first, _, data, offsets in text_chunks(batch.column("text")):
                hashes, blind, row, start, end, value, name = canonical(data, offsets)
                begins = np.searchsorted(row, np.arange(len(offsets)))
                named = np.concatenate([[0], np.cumsum(name)])
                for size in lengths:
                    for form, slot in ((hashes, value | name), (blind, value)):
                        grams, at = word_grams(form, row, size)
                        if form is blind:
                            other = named[at + size] > named[at]
                            grams, at = grams[other], at[other]
                        if mask is not None:
                            hit = np.flatnonzero(mask[(grams >> np.uint64(64 - bits)).astype(np.int64)])
                            hit = hit[wanted[np.minimum(np.searchsorted(wanted, grams[hit]), len(wanted) - 1)] == grams[hit]]
                            grams, at = grams[hit], at[hit]
                        if not len(at):
                            continue
                        values = [[_text(data, start[j], end[j]).lower() for j in range(p, p + size) if slot[j]] for p in at.tolist()]
                        rows = row[at]
                        yield pa.RecordBatch.from_arrays(
                            [
                                ids.take(pa.array(first + rows)), pa.array((begins[rows + 1] - begins[rows]).astype(np.int32)), pa.array(np.full(len(at), size, dtype=np.int32)),
                                pa.array((at - begins[rows]).astype(np.int32)), pa.array(grams.view(np.int64)), pa.array(values, pa.list_(pa.string())),
                            ],
                            [key, "n_words", "size", "position", "hash", "slots"],
                        )

    return texts.select(key, "text").mapInArrow(run, f"{key} long, n_words int, size int, position int, hash long, slots array<string>")


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, item_id, n_windows, item_windows, coverage, reparameterised): documents that hold an item or its template.

    Null and empty texts on either side match nothing; items under `SHORTEST`
    words are not looked for, those under `WINDOW` words are one window.  Rows
    without a doc_id are not returned.  Repeated rows and equal items give the
    same pairs once.  Empty tables give an empty result.
    """
    lengths = tuple(range(SHORTEST, WINDOW + 1))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null").distinct()
    parts = windows(items, "item_id", lengths, None).where((F.col("size") == WINDOW) | (F.col("size") == F.col("n_words")))
    parts = store(parts.where(F.col("size") == F.least("n_words", F.lit(WINDOW))), "op9-items")
    whole = parts.groupBy("item_id").agg(F.countDistinct("position").alias("item_windows"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    lengths = tuple(sorted(r["size"] for r in parts.select("size").distinct().collect())) or (WINDOW,)  # three values at most
    keys = parts.select("hash").distinct()
    rounds = max(1, -(-keys.count() // BLOCK_KEYS))
    found = None
    for k in range(rounds):  # one pass over the documents for each BLOCK_KEYS windows of the benchmark
        wanted = np.array([r.hash for r in keys.where(F.pmod("hash", F.lit(rounds)) == k).collect()], dtype=np.int64)
        if not len(wanted):
            continue
        hits = windows(texts, "doc_id", lengths, wanted)
        found = hits if found is None else found.union(hits)
    if found is None:
        found = windows(texts.limit(0), "doc_id", lengths, None)
    found = store(found, "op9-hits")
    item = parts.select("item_id", "size", "hash", F.col("position").alias("item_position"), F.col("slots").alias("item_slots"))
    match = found.join(item, ["hash", "size"]).withColumn("run", F.col("position") - F.col("item_position"))
    pairs = F.transform(F.arrays_zip("item_slots", "slots"), lambda z: F.struct(z["item_slots"].alias("of"), z["slots"].alias("to")))
    # a run holds at most one window per position of its item; both steps below use the one shuffle
    windowed = match.withColumn("pairs", pairs).withColumn("worded", F.size("slots") < F.col("size")).repartition("doc_id", "item_id", "run")
    each = windowed.groupBy("doc_id", "item_id", "run", F.col("item_position").alias("at")).agg(F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"), F.max("worded").alias("worded"))
    each = each.withColumn("other", F.exists("pairs", lambda p: p["of"] != p["to"]))
    runs = each.groupBy("doc_id", "item_id", "run").agg(F.array_sort(F.collect_list(F.struct("at", "pairs", "worded", "other"))).alias("w"))

    def agree(pairs):
        return F.size(pairs) == F.size(F.array_distinct(F.transform(pairs, lambda p: p["of"])))

    def pairs_of(windows):
        return F.array_distinct(F.flatten(F.transform(windows, lambda x: x["pairs"])))

    span = EXCERPT - WINDOW + 1  # consecutive windows of an excerpt

    def excerpt(k):
        part = F.slice("w", k + 1, span)
        # windows of slots only say nothing when their values differ
        return (F.element_at(part, -1)["at"] - F.element_at(part, 1)["at"] == span - 1) & F.forall(part, lambda x: x["worded"] | ~x["other"]) & agree(pairs_of(part))

    begins = F.when(F.size("w") >= span, F.filter(F.sequence(F.lit(0), F.size("w") - span), excerpt)).otherwise(F.array().cast("array<int>"))
    runs = runs.withColumn("begins", begins).withColumn("whole", agree(pairs_of(F.col("w")))).where(F.col("whole") | (F.size("begins") > 0))
    inside = F.array_distinct(F.flatten(F.transform("begins", lambda k: F.sequence(k, k + span - 1))))
    held = F.when(F.col("whole"), F.col("w")).otherwise(F.transform(inside, lambda k: F.get("w", k)))
    held = runs.select("doc_id", "item_id", (F.size("begins") > 0).alias("excerpt"), held.alias("w"))
    kept = held.select("doc_id", "item_id", "excerpt", F.explode("w.at").alias("position"), F.exists("w", lambda x: x["other"]).alias("other"))
    covered = kept.groupBy("doc_id", "item_id", "position").agg(F.min("other").alias("other"), F.max("excerpt").alias("excerpt"))
    covered = covered.groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("n_windows"), F.max("other").alias("reparameterised"), F.max("excerpt").alias("excerpt"))
    share = covered.join(whole, "item_id").withColumn("coverage", F.col("n_windows") / F.col("item_windows"))
    return share.where((F.col("coverage") >= coverage) | F.col("excerpt")).select("doc_id", "item_id", "n_windows", "item_windows", "coverage", "reparameterised")
