"""Toxicity of restored text: a noisy channel read by Viterbi, then a word score.

The channel writes letters as look-alikes (leetspeak), repeats them, or spaces
them out, also over several words.  A character language model counted over the whole corpus weighs the
readings of every suspicious token; Viterbi search over its character lattice
gives the best ones.  Word weights are learned from labelled training rows:
log odds of distinct texts with and without the label, lowered by their
standard error, so chance words get none.
"""

from __future__ import annotations

import math
import re
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only, store, words
from .language import CODES, TABLE, Coder, held_out

#: Letters a look-alike may stand for.
LOOKALIKES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "li", "+": "t", "(": "c", "€": "e", "£": "l"}
SUBSTITUTED, REPEATED, DROPPED, GAP = 1.0, 0.7, 4.0, 1.0  # channel costs in nats
READINGS = 4  # readings kept per state of the lattice; a parameter of the model
LEXICON = 200_000  # capacity of the model, a parameter: the heaviest words
SETTLE = 20_000  # nodes of a lattice's paths beyond which their common beginning is written down
REMEMBERED = 300_000  # tokens a task keeps read
#: Letters and look-alikes that may stand for one another in some reading share a letter of the skeleton.
KIN = {c: k[0] for k in ("il1!|£", "bg689", "o0", "z2", "e3€", "a4@", "s5$", "t7+", "c(") for c in k}
EDGES = ".,;:?!\"'()[]<>{}*%&#|-_=/\\~`"
OUTER = "".join(c for c in EDGES if c not in LOOKALIKES)
SPACERS = " .-_*"
LETTERS = re.compile(r"[^\W\d_]+")
SPACED = re.compile(r"(?<![^\W_])(?:[^\W_][ .\-_*]{1,2}){2,}[^\W_](?![^\W_])")
MARKED = re.compile(r"([^\W\d_])\1|[" + re.escape("".join(LOOKALIKES) + SPACERS) + "]")  # a doubled letter, a look-alike or a spacer
MIN_TEXTS = 5
MIN_WEIGHT = 2.0
CAUTION = 1.5  # standard errors taken off a log odds
THRESHOLD = 0.7


def language_model(docs: DataFrame) -> np.ndarray:
    """Natural log of P(letter | two letters before), from trigram counts over all texts.

    Each task adds up a table of CODES**3 counts; the sums per trigram, at most
    CODES**3 rows, come to the driver.
    """

    def run(batches):
        coder, total = Coder(), np.zeros(TABLE, dtype=np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.column("text").slice(lo, 64).to_pylist()
                total += np.bincount(np.concatenate([coder.grams(text) for text in part]), minlength=TABLE)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["gram", "n"])

    rows = docs.where("text is not null").select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(TABLE)
    for r in rows:
        counts[r.gram] = r.n
    cube = counts.reshape(CODES, CODES, CODES)
    one = cube.sum(axis=(0, 1)) + 1.0
    one /= one.sum()
    two = cube.sum(axis=0) + 20.0 * one[None, :]
    two /= two.sum(axis=1, keepdims=True)
    three = cube + 20.0 * two[None, :, :]
    three /= three.sum(axis=2, keepdims=True)
    return np.log(three).astype(np.float32)


def skeleton(text: str) -> str:
    """What every reading of a text keeps: kin letters alike, repeats squeezed, all that may be dropped inside left out."""
    out, last = [], ""
    for char in text:
        kin = KIN.get(char) or (char if char.isalpha() else "")
        if kin and kin != last:
            out.append(kin)
            last = kin
    return "".join(out)


class Gate:
    """Whether a token can be read as holding one of the wanted words: exact, as each reading is a part of the skeleton."""

    def __init__(self, words) -> None:
        import ahocorasick

        self.machine = ahocorasick.Automaton()
        for bones in {skeleton(word) for word in words} - {""}:
            self.machine.add_word(bones, True)
        self.some = len(self.machine) > 0
        if self.some:
            self.machine.make_automaton()

    def opens(self, token: str) -> bool:
        return self.some and next(self.machine.iter(skeleton(token)), None) is not None


class Restorer:
    """Readings of obfuscated tokens; one per task, with a bounded memory of what each token gives.

    With `lexicon`, only words of it are looked for, and only tokens whose
    skeleton holds one are decoded.
    """

    def __init__(self, model: np.ndarray, lexicon=None) -> None:
        self.model, self.codes, self.known = model, Coder().codes, {}
        self.lexicon, self.gate = lexicon, None if lexicon is None else Gate(lexicon)

    def code(self, char: str) -> int:
        return int(self.codes[ord(char)]) if ord(char) < 0x10000 else 1 + CODES // 2

    def read(self, token: str) -> tuple[str, ...]:
        """The best readings of a token, most likely first.

        A path is a node of a tree of readings, so equal readings are equal
        nodes and a step costs the same however long the token is.
        """
        model, before = self.model, ""
        solid = [k for k, char in enumerate(token) if char.isalnum()] or [0]
        parent, child, settled = [(-1, "")], {}, []

        def grow(node: int, letter: str) -> int:
            key = (node, letter)
            if key not in child:
                child[key] = len(parent)
                parent.append(key)
            return child[key]

        def text(node: int) -> str:
            out = []
            while node:
                node, letter = parent[node]
                out.append(letter)
            return "".join(reversed(out))

        def settle(beam):
            """Write down what all paths have in common and keep the tree of what is left."""
            front = {node for paths in beam.values() for _, node in paths}
            tops = set(front)
            while len(tops) > 1:
                last = max(tops)
                tops.remove(last)
                tops.add(parent[last][0])
            top = tops.pop()
            tails = {}
            for node in front:
                at, tail = node, []
                while at != top:
                    at, letter = parent[at]
                    tail.append(letter)
                tails[node] = tail
            settled.append(text(top))
            parent[1:] = []
            child.clear()
            moved = {}
            for node, tail in sorted(tails.items()):
                at = 0
                for letter in reversed(tail):
                    at = grow(at, letter)
                moved[node] = at
            return {k: [(s, moved[n]) for s, n in paths] for k, paths in beam.items()}

        beam, room = {(0, 0): [(0.0, 0)]}, SETTLE
        for k, char in enumerate(token):
            arcs = [(char, 0.0)] if char.isalpha() else [(x, SUBSTITUTED) for x in LOOKALIKES.get(char, "")]
            if char == before:
                arcs.append(("", REPEATED))
            elif not arcs:
                arcs.append(("", 0.0 if char in SPACERS else DROPPED))
            elif not solid[0] <= k <= solid[-1]:  # punctuation around the word
                arcs.append(("", DROPPED))
            if char in SPACERS:
                arcs.append((" ", GAP))
            grown: dict[tuple[int, int], list[tuple[float, int]]] = {}
            for (a, b), paths in beam.items():
                for letter, cost in arcs:
                    if letter == " ":
                        if b == 0:
                            continue  # a word has begun already
                        key, gain = (b, 0), float(model[a, b, 0])
                    elif letter:
                        c = self.code(letter)
                        key, gain = (b, c), float(model[a, b, c])
                    else:
                        key, gain = (a, b), 0.0
                    grown.setdefault(key, []).extend((s + gain - cost, grow(node, letter) if letter else node) for s, node in paths)
            beam = {k: _best(v) for k, v in grown.items()}
            before = char
            if len(parent) > room:
                beam = settle(beam)
                room = max(SETTLE, 2 * len(parent))
        ends: dict[str, float] = {}
        for (a, b), paths in beam.items():
            for s, node in paths:
                whole, s = ("".join(settled) + text(node)).rstrip(), s + (float(model[a, b, 0]) if b else 0.0)
                ends[whole] = max(s, ends.get(whole, -math.inf))
        return tuple(sorted(ends, key=lambda t: (-ends[t], t))[:READINGS])

    def readings(self, form: str) -> tuple[str, ...]:
        """Words of the readings of a form; none where no wanted word can be among them."""
        if self.gate and not self.gate.opens(form):
            return ()
        return tuple(w for reading in self.read(form) for w in reading.split())

    def of_token(self, token: str) -> frozenset[str]:
        """Words that a token gives as written, without quotes and the like around it, and without all edge punctuation."""
        out: set[str] = set()
        if token.isalpha():
            out.add(token)
            forms = (token,)
        else:
            core = token.strip(EDGES)
            if core.isalpha():
                out.add(core)
            else:
                out.update(LETTERS.findall(token))
            forms = {core, token.strip(OUTER)}
        for form in forms:
            if MARKED.search(form):
                out.update(self.readings(form))
        return frozenset(out if self.lexicon is None else out & self.lexicon)

    def words(self, text: str) -> set[str]:
        """Distinct lower-case words of a text (of the lexicon, if there is one), with the readings of its suspicious tokens.

        Letters are looked for as spaced out only where three tokens of one or
        two characters stand in a row.
        """
        low = text.lower()
        parts = low.split()
        known = self.known
        out: set[str] = set()
        for token in set(parts):
            found = known.get(token)
            if found is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                found = known[token] = self.of_token(token)
            if found:
                out |= found
        short = np.fromiter(map(len, parts), dtype=np.int32, count=len(parts)) <= 2
        if len(short) > 2 and (short[:-2] & short[1:-1] & short[2:]).any():
            for run in SPACED.finditer(low):
                out.update(self.readings(run[0]))
        return out if self.lexicon is None else out & self.lexicon


_KEPT: dict[str, Restorer] = {}


def restorer_of(key: str, model: np.ndarray, lexicon=None) -> Restorer:
    """The worker's restorer of a run: what a token gives is worked out once for all its tasks."""
    if key not in _KEPT:
        while len(_KEPT) > 1:
            del _KEPT[next(iter(_KEPT))]
        _KEPT[key] = Restorer(model, lexicon)
    return _KEPT[key]


def _best(paths: list[tuple[float, int]]) -> list[tuple[float, int]]:
    if len(paths) == 1:
        return paths
    seen: dict[int, float] = {}
    for score, node in paths:
        if score > seen.get(node, -math.inf):
            seen[node] = score
    return sorted(((s, n) for n, s in seen.items()), key=lambda x: (-x[0], x[1]))[:READINGS]


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, toxic): labelled rows outside the held-out fold, one per group of copies, with the group's mean label.

    Copies and most near copies share their smallest hash of three words; a
    word that only a copied text holds must not count as many.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("double").alias("toxic")).where("toxic is not null and doc_id is not null")
    marks = marks.where(~held_out()).groupBy("doc_id").agg(F.avg("toxic").alias("toxic"))
    split = only(docs.where("text is not null"), marks.select("doc_id"), "doc_id").select("doc_id", words(F.col("text")).alias("w"))
    shingles = F.transform("w", lambda x, i: F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2)))
    keys = split.where(F.size("w") > 0).select("doc_id", F.array_min(shingles).alias("key"))
    return keys.join(marks, "doc_id").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.avg("toxic").alias("toxic")).select("doc_id", "toxic")


def word_weights(docs: DataFrame, rows: DataFrame, model: np.ndarray, capacity: int = LEXICON) -> tuple[dict[str, float], float]:
    """Cautious log odds of restored words, and the log odds of the label itself; words are counted inside tasks first."""
    texts, key = only(docs.select("doc_id", "text"), rows, "doc_id", "inner"), uuid.uuid4().hex

    def run(batches):
        restorer, counts = restorer_of(key, model), {}
        for part in batches:
            for text, toxic in zip(part["text"], part["toxic"], strict=True):
                for word in restorer.words(text):
                    cell = counts.setdefault(word, [0.0, 0.0])
                    cell[0] += toxic
                    cell[1] += 1 - toxic
            if len(counts) > 500_000:
                yield frame(counts)
                counts = {}
        yield frame(counts)

    def frame(counts):
        words = sorted(counts)
        return pd.DataFrame({"word": pd.Series(words, dtype=object), "a": [counts[w][0] for w in words], "c": [counts[w][1] for w in words]})

    each = texts.mapInPandas(run, "word string, a double, c double")
    total = rows.agg(F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("clean")).first()
    toxic, clean = (total.toxic or 0.0) + 1.0, (total.clean or 0.0) + 1.0
    counts = each.groupBy("word").agg(F.sum("a").alias("a"), F.sum("c").alias("c"))
    odds = F.log((F.col("a") + 0.5) / toxic) - F.log((F.col("c") + 0.5) / clean)
    error = F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("c") + 0.5))
    weighed = counts.where(F.col("a") >= MIN_TEXTS).withColumn("weight", odds - CAUTION * error).where(F.col("weight") >= MIN_WEIGHT)
    lexicon = weighed.orderBy(F.desc("weight"), "word").limit(capacity).collect()
    return {r.word: float(r.weight) for r in lexicon}, math.log(toxic / clean)


def score_toxicity(docs: DataFrame, labels: DataFrame, capacity: int = LEXICON) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_flagged) of every row of `docs` (doc_id, text).

    Null and empty texts get the score of a text without flagged words.  Rows
    without a doc_id are scored but never learned from.  Without labels, or
    with one label only, no word has weight and scores are the prior.  Equal
    texts get equal scores; an empty table gives an empty result.  `capacity`
    bounds the model: the words of largest weight are kept.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = language_model(rows)
    training = store(training_rows(rows, labels), "op10-training")
    key = uuid.uuid4().hex
    weights, prior = word_weights(rows, training, model, capacity)

    def run(batches):
        restorer = restorer_of(key, model, frozenset(weights))
        for batch in batches:
            scores, flags = [], []
            for text in batch.column("text").to_pylist():
                found = restorer.words(text) if text else ()
                scores.append(1 / (1 + math.exp(-max(-40.0, min(40.0, prior + sum(sorted(weights[w] for w in found)))))))
                flags.append(len(found))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64()), pa.array([int(s >= THRESHOLD) for s in scores], pa.int32()), pa.array(flags, pa.int64())],
                ["doc_id", "held_out", "score", "predicted", "n_flagged"],
            )

    return rows.withColumn("held_out", held_out()).select("doc_id", "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, n_flagged long")
