"""Cross-tokenizer alignment: groups and links of two token sequences over the same bytes, with corpus-wide link counts.

Tokenizer A is a byte-level BPE, tokenizer B a piece BPE that puts a space in
front.  Both cut before every space that follows a non-space, so a text falls
into segments that are tokenised apart and whose alignments are kept per
distinct segment.

1. An array maps each A id to the B id with the same bytes.  A group of one A
   and one B token always has equal bytes, so groups that follow the array are
   counted in one vector of vocabulary length per task.
2. Only links of the other groups leave a task as (pair, count), summed in the
   task first; the shuffle adds them up to the corpus-wide counts.
3. A second pass aligns again and reads each link's count.  A pair table of at
   most `PAIR_LIMIT` rows goes to the tasks, a larger one is joined by shuffle.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import store

TOKENIZERS = "/opt/tokenizers"
A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
PAIR_LIMIT = 4_000_000  # rows of the pair table sent to tasks, 24 bytes each
KEPT = 500_000  # segments a worker keeps aligned, some 350 bytes each
KEPT_CHARS = 16_000_000
CHUNK_CHARS = 4_000_000
RUN = 20_000  # characters of segments encoded in one call
SHIFT = 32
CUT = re.compile(r"(?<=\S)(?= )")
ODD = re.compile(r"\s ")
SPACE = "▁"
_LOADED: dict[str, Vocabularies] = {}
_MEMORIES: dict[str, Memory] = {}


def byte_letters() -> dict[str, int]:
    """The printable stand-ins of byte-level BPE: printable Latin-1 stands for itself, the rest follows from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabularies:
    """Both tokenizers with the bytes of their ids; loaded once per worker."""

    def __init__(self, folder: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        path = os.path.join(folder, A_FILE)
        self.a = Tokenizer.from_file(path)
        self.a.encode_special_tokens = True
        letters = byte_letters()
        with open(path, encoding="utf-8") as f:
            entries = json.load(f)["model"]["vocab"]
        self.a_bytes = [b""] * (max(entries.values()) + 1)
        for entry, k in entries.items():
            self.a_bytes[k] = bytes(letters[c] for c in entry) if all(c in letters for c in entry) else entry.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_file=os.path.join(folder, B_FILE))
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace(SPACE, " ").encode() for k, p in enumerate(pieces)]
        self.space = self.b.piece_to_id(SPACE)
        # the segments below are exact only while no piece goes on after a space
        self.splits = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces)
        same = {t: k for k, t in enumerate(self.b_bytes) if not self.b.is_control(k) and not self.b.is_unknown(k)}
        self.identity = np.array([same.get(t, -1) if t else -1 for t in self.a_bytes], dtype=np.int64)
        self.a_len = np.array([len(t) for t in self.a_bytes], dtype=np.int64)
        self.b_len = np.array([len(t) for t in self.b_bytes], dtype=np.int64)
        self.texts: list[str] = []

    def segments(self, text: str) -> list[str]:
        """Segments of space+text without the space each begins with."""
        if not self.splits:
            return [text]
        if ODD.search(text) or text[:1] == " ":
            return [s[1:] for s in CUT.split(" " + text)]
        return text.split(" ")

    def encode(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """A ids and B ids of the segments one after the other, and per segment its bytes and whether both sides give them back.

        Segments are joined and encoded in runs, which the cuts make exact.  A
        segment that ends in white space would not be cut there, and a run that
        comes back with other bytes is encoded again segment by segment.
        """
        a, b, sizes, fine = [], [], [], []
        lo = 0
        while lo < len(segments):
            hi, held = lo + 1, len(segments[lo])
            while self.splits and hi < len(segments) and held < RUN and segments[hi - 1][-1:].strip():
                held += len(segments[hi]) + 1
                hi += 1
            if not self._run(segments[lo:hi], a, b, sizes, fine):
                for one in segments[lo:hi]:
                    if not self._run([one], a, b, sizes, fine):
                        sizes.append([0])
                        fine.append([False])
            lo = hi
        ids = (np.fromiter(itertools.chain.from_iterable(x), dtype=np.int64) for x in (a, b))
        return *ids, np.fromiter(itertools.chain.from_iterable(sizes), dtype=np.int64), np.fromiter(itertools.chain.from_iterable(fine), dtype=bool)

    def _run(self, segments: list[str], a: list, b: list, sizes: list, fine: list) -> bool:
        text = " ".join(segments)
        left = self.a.encode_batch_fast([f" {text}"], add_special_tokens=False)[0].ids
        right = self.b.encode(text, num_threads=1) if text else [self.space]
        whole = f" {text}".encode()
        if not b"".join(map(self.a_bytes.__getitem__, left)) == whole == b"".join(map(self.b_bytes.__getitem__, right)):
            return False
        a.append(left)
        b.append(right)
        sizes.append([len(s.encode()) + 1 for s in segments])
        fine.append([True] * len(segments))
        return True

def vocabularies(folder: str) -> Vocabularies:
    if folder not in _LOADED:
        _LOADED[folder] = Vocabularies(folder)
    return _LOADED[folder]


class Memory:
    """Alignments of distinct segments, numbered; a worker keeps them over its tasks and over both passes."""

    def __init__(self, v: Vocabularies) -> None:
        self.v = v
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.chars = 0
        self.sizes = np.zeros((4, 0), dtype=np.int64)  # whether both sides give the bytes back, n_a, n_b, n_groups
        self.links: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # segment, code, follows the identity map
        self.groups: list[bytes] = []
        self.unwritten: list[tuple] = []

    def full(self) -> bool:
        return len(self.number) > KEPT or self.chars > KEPT_CHARS

    def learn(self, fresh: list[str]) -> None:
        v, first, count = self.v, len(self.number), len(fresh)
        *ids, size, ok = v.encode(fresh)
        ends = np.cumsum(size)
        stops = [np.cumsum(length[i]) for length, i in zip((v.a_len, v.b_len), ids, strict=True)]
        total = int(ends[-1]) if count else 0
        marks = np.zeros((2, total + 1), dtype=bool)
        for mark, stop in zip(marks, stops, strict=True):
            mark[stop] = True
        every = np.flatnonzero(marks[0] | marks[1])  # elementary ranges end where a token of either side ends
        common = marks[0][every] & marks[1][every]
        # an elementary range is in the token after those that ended before it
        at = [np.cumsum(mark, dtype=np.int32)[every] - mark[every] for mark in marks]
        codes = (ids[0][at[0]] << SHIFT) | ids[1][at[1]]
        alone = common.copy()  # one A and one B token: the group begins where this elementary range begins
        alone[1:] &= common[:-1]
        mapped = alone & (v.identity[codes >> SHIFT] == codes & ((1 << SHIFT) - 1))
        of = np.repeat(np.arange(count), np.diff(np.searchsorted(every, ends, side="right"), prepend=0))
        sizes = np.zeros((4, count), dtype=np.int64)
        sizes[0] = ok
        for k in range(2):
            sizes[1 + k] = np.diff(np.searchsorted(stops[k], ends, side="right"), prepend=0)
        sizes[3] = np.bincount(of[common], minlength=count)
        self.sizes = np.concatenate([self.sizes, sizes], axis=1)
        self.links.append((of + first, codes, mapped))
        closed = np.cumsum(marks[0] & marks[1], dtype=np.int32)
        group = [closed[s] - (marks[0] & marks[1])[s] for s in stops]
        self.unwritten.append((*(i.astype(np.int32) for i in ids), *group, sizes[1] + sizes[2]))
        self.number.update(zip(fresh, range(first, first + count), strict=True))
        self.chars += sum(map(len, fresh))

    def write(self) -> list[bytes]:
        """`a1,a2|b1;a3|b2,b3` of each segment."""
        while self.unwritten:
            *ids, group_a, group_b, size = self.unwritten.pop(0)
            self.groups.extend(self._strings(ids, [group_a, group_b], size))
        return self.groups

    def _strings(self, ids: list[np.ndarray], group: list[np.ndarray], size: np.ndarray) -> Iterator[bytes]:
        """Both sides' tokens in the order of their groups, each with what follows it."""
        if not self.v.texts:
            last = (len(self.v.a_len), len(self.v.b_len))
            self.v.texts = [f"{k}{after}" for n, pair in zip(last, (",|", ",;"), strict=True) for after in pair for k in range(n)]
        # where in its list a token with its separator stands: A with a comma, A with a bar, B with a comma, B with a semicolon
        table, base = [], 0
        for i, g, n in zip(ids, group, (len(self.v.a_len), len(self.v.b_len)), strict=True):
            ends = np.append(g[1:] != g[:-1], True) if len(g) else np.zeros(0, dtype=bool)
            table.append(base + np.where(ends, n, 0) + i)
            base += 2 * n
        order = np.argsort(np.concatenate([2 * group[0], 2 * group[1] + 1]), kind="stable")
        written = list(map(self.v.texts.__getitem__, np.concatenate(table)[order].tolist()))
        lo = 0
        for n in size.tolist():
            yield "".join(written[lo : lo + n])[:-1].encode()
            lo += n


def memory(folder: str) -> Memory:
    if folder not in _MEMORIES:
        _MEMORIES[folder] = Memory(vocabularies(folder))
    return _MEMORIES[folder]


class Aligner:
    """What a task counts or reads over the worker's memory."""

    def __init__(self, folder: str, lookup=None) -> None:
        self.m, self.v, self.lookup = memory(folder), vocabularies(folder), lookup
        self.restart()

    def restart(self) -> None:
        self.seen = np.zeros(len(self.m.number), dtype=np.int64)
        self.read = np.zeros((2, 0), dtype=np.int64)  # n_best and count_sum of each segment
        self.looked = 0

    def numbers(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Segment numbers of all texts and the number of segments of each."""
        split = list(map(self.v.segments, texts))
        number = self.m.number
        fresh = list(set().union(*split).difference(number))
        if fresh:
            self.m.learn(fresh)
        self.seen = np.concatenate([self.seen, np.zeros(len(number) - len(self.seen), dtype=np.int64)])
        size = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
        return np.fromiter(map(number.__getitem__, itertools.chain.from_iterable(split)), dtype=np.int64, count=int(size.sum())), size

    def values(self) -> np.ndarray:
        """n_best and count_sum of all segments, by the pair table."""
        if self.looked < len(self.m.links):
            more = np.zeros((2, len(self.m.number) - self.read.shape[1]), dtype=np.int64)
            base = self.read.shape[1]
            for of, codes, _ in self.m.links[self.looked :]:
                n, best = self.lookup(codes)
                np.add.at(more[0], of[best] - base, 1)
                np.add.at(more[1], of - base, n)
            self.read = np.concatenate([self.read, more], axis=1)
            self.looked = len(self.m.links)
        return self.read

    def count(self, number: np.ndarray, size: np.ndarray) -> None:
        """Add the segments of the whole texts that both tokenizers keep."""
        number = number[np.repeat(self.kept(number, size), size)]
        self.seen += np.bincount(number, minlength=len(self.seen))

    def kept(self, number: np.ndarray, size: np.ndarray) -> np.ndarray:
        bad = np.bincount(np.repeat(np.arange(len(size)), size)[self.m.sizes[0][number] == 0], minlength=len(size))
        return bad == 0

    def counted(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The vector of identity groups by A id, and code and count of all other links; counting starts anew."""
        vector = np.zeros(len(self.v.a_bytes), dtype=np.int64)
        codes, times = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for of, code, mapped in self.m.links:
            n = self.seen[of]
            np.add.at(vector, code[mapped] >> SHIFT, n[mapped])
            rest = ~mapped & (n > 0)
            codes.append(code[rest])
            times.append(n[rest])
        code, inverse = np.unique(np.concatenate(codes), return_inverse=True)
        total = np.zeros(len(code), dtype=np.int64)
        np.add.at(total, inverse, np.concatenate(times))
        self.restart()
        return vector, code, total

    def relieve(self) -> None:
        """Forget all segments once they are too many."""
        if self.m.full():
            self.m.clear()
            self.restart()


def chunks(batches, limit: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Runs of rows of about `limit` characters with their texts; a null counts as empty."""
    for batch in batches:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        lo, held = 0, 0
        for k, t in enumerate(texts):
            held += len(t)
            if held >= limit or k + 1 == len(texts):
                yield batch.slice(lo, k + 1 - lo), texts[lo : k + 1]
                lo, held = k + 1, 0


def pair_counts(docs: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """(code, n, best): the number of links of every id pair of the corpus, code = A id * 2**32 + B id; best: no pair of the B id has more."""

    def run(batches):
        aligner = Aligner(folder)
        vector = np.zeros(len(aligner.v.a_bytes), dtype=np.int64)

        def spill():
            nonlocal vector
            same, code, total = aligner.counted()
            vector += same
            return pa.RecordBatch.from_arrays([pa.array(code), pa.array(total)], ["code", "n"])

        for _, texts in chunks(batches, CHUNK_CHARS):
            whole = [t for t in texts if t]
            if whole:
                aligner.count(*aligner.numbers(whole))
            if aligner.m.full():
                yield spill()
                aligner.relieve()
        yield spill()
        at = np.flatnonzero(vector)
        yield pa.RecordBatch.from_arrays([pa.array((at << SHIFT) | aligner.v.identity[at]), pa.array(vector[at])], ["code", "n"])

    each = docs.where("text <> ''").select(F.col("text").cast("string").alias("text")).mapInArrow(run, "code long, n long")
    summed = store(each.groupBy("code").agg(F.sum("n").alias("n")), "op12-pairs")
    second = F.col("code").bitwiseAND((1 << SHIFT) - 1)
    highest = summed.groupBy(second.alias("b")).agg(F.max("n").alias("most"))  # at most one row per B id
    return store(summed.withColumn("b", second).join(F.broadcast(highest), "b").select("code", "n", (F.col("n") == F.col("most")).alias("best")), "op12-counts")


FIELDS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def align_tokens(docs: DataFrame, folder: str = TOKENIZERS, pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row of `docs` (doc_id, text).

    Null and empty texts, and texts that a tokenizer does not give back byte
    for byte, have zeros and ''.  Every row counts, so a row given twice counts
    twice and is returned twice; rows without a doc_id count too.  Texts of any
    length are aligned whole.  An empty table gives an empty result; other
    columns are ignored.  `folder` holds the two vocabulary files on every
    executor.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pairs = pair_counts(rows, folder)
    small = pairs.limit(pair_limit + 1).count() <= pair_limit
    if small:
        table = pairs.toArrow()
        code, n, best = (table.column(c).to_numpy() for c in ("code", "n", "best"))
        order = np.argsort(code)
        sent = rows.sparkSession.sparkContext.broadcast((code[order], n[order], best[order].astype(bool)))

    def lookup(codes):
        code, n, best = sent.value
        if not len(code):
            return np.zeros(len(codes), dtype=np.int64), np.zeros(len(codes), dtype=bool)
        at = np.minimum(np.searchsorted(code, codes), len(code) - 1)
        known = code[at] == codes  # the worker may remember segments of another table
        return np.where(known, n[at], 0), known & best[at]

    def run(batches):
        aligner = Aligner(folder, lookup if small else None)
        row = 0
        for part, texts in chunks(batches, CHUNK_CHARS):
            number, size = aligner.numbers(texts)
            start = np.concatenate([[0], np.cumsum(size)])
            kept = aligner.kept(number, size) & np.array([t != "" for t in texts])
            sums = np.array([np.bincount(np.repeat(np.arange(len(size)), size), weights=x[number], minlength=len(size)) for x in aligner.m.sizes[1:4]]).astype(np.int64)
            exact = np.zeros((2, len(size)), dtype=np.int64)
            if small:
                upto = np.concatenate([np.zeros((2, 1), dtype=np.int64), np.cumsum(aligner.values()[:, number], axis=1)], axis=1)
                exact = upto[:, start[1:]] - upto[:, start[:-1]]
            numbers, groups = number.tolist(), aligner.m.write()
            shas = [hashlib.sha256(b";".join([groups[i] for i in numbers[lo:hi]])).hexdigest() if k else "" for k, lo, hi in zip(kept, start[:-1], start[1:], strict=True)]
            columns = [sums[0], sums[1], sums[2], sums[0] + sums[1] - sums[2], exact[0], exact[1]]  # one link per distinct token end
            arrays = [part.column("doc_id"), *(pa.array(np.where(kept, c, 0)) for c in columns), pa.array(shas, pa.string())]
            names = ["doc_id", *FIELDS, "groups_sha256"]
            if not small:
                arrays += [pa.array(np.arange(row, row + len(texts))), *_doc_links(aligner, numbers, start, kept)]
                names += ["row", "codes", "times"]
                row += len(texts)
            yield pa.RecordBatch.from_arrays(arrays, names)
            aligner.relieve()

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    if small:
        return rows.mapInArrow(run, schema)
    wide = rows.mapInArrow(run, f"{schema}, row long, codes array<long>, times array<long>").withColumn("part", F.spark_partition_id())
    wide = store(wide, "op12-links")
    links = wide.select("part", "row", F.explode(F.arrays_zip("codes", "times")).alias("x")).select("part", "row", "x.codes", "x.times")
    of_row = links.join(pairs.withColumnRenamed("code", "codes"), "codes").groupBy("part", "row")
    read = of_row.agg(F.sum(F.col("times") * F.col("n")).alias("_sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("_best"))
    full = wide.drop("codes", "times", "n_best", "count_sum").join(read, ["part", "row"], "left")
    zero = F.lit(0).cast("long")
    return full.select("doc_id", *FIELDS[:4], F.coalesce("_best", zero).alias("n_best"), F.coalesce("_sum", zero).alias("count_sum"), "groups_sha256")


def _doc_links(aligner: Aligner, numbers: list[int], start: np.ndarray, kept: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Distinct link codes of each text and how often each occurs."""
    none = np.zeros(0, dtype=np.int64)
    of = np.concatenate([none, *(x[0] for x in aligner.m.links)])
    code = np.concatenate([none, *(x[1] for x in aligner.m.links)])
    first = np.searchsorted(of, np.arange(len(aligner.m.number) + 1))
    codes, times = [], []
    for k, ok in enumerate(kept):
        segments, n = np.unique(np.array(numbers[start[k] : start[k + 1]] if ok else [], dtype=np.int64), return_counts=True)
        size = first[segments + 1] - first[segments]
        at = np.repeat(first[segments] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum()) if len(size) else np.zeros(0, dtype=np.int64)
        own, inverse = np.unique(code[at], return_inverse=True)
        total = np.zeros(len(own), dtype=np.int64)
        np.add.at(total, inverse, np.repeat(n, size))
        codes.append(own)
        times.append(total)
    return tuple(pa.array(x, pa.list_(pa.int64())) for x in (codes, times))
