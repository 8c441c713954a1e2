"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1.  An n-gram binds its letters,
each permuted by its place (a rotation), by multiplication; a text bundles its
n-grams by addition.  A language prototype is the bundle of its training texts,
built from n-gram counts that Spark adds up per language (a table bounded by
letters**n, whatever the corpus).  A document is compared with the centred
prototypes by cosine.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix

N = 3
DIM = 1024
CODES = 64  # letter codes; 0 is the gap between words
TABLE = CODES**N
BLOCK = 128
SHARPNESS = 25.0


def letter_codes() -> np.ndarray:
    """Code of every character below 0x10000: 0 for what is no letter, else 1 to CODES - 1 (a-z apart, others hashed)."""
    codes = np.zeros(0x10000, dtype=np.int32)
    for point in range(0x10000):
        if 0xD800 <= point < 0xE000:
            continue
        char = chr(point)
        if char.isalpha():
            codes[point] = point - 96 if 97 <= point <= 122 else 27 + int(mix(np.array([point], dtype=np.uint64))[0] % np.uint64(CODES - 27))
    return codes


def letter_vectors(seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).choice(np.array([-1, 1], dtype=np.int8), size=(CODES, DIM))


def gram_vectors(grams: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """Bound vectors of coded n-grams."""
    out = np.ones((len(grams), DIM), dtype=np.int8)
    for place in range(N):
        code = grams // CODES ** (N - 1 - place) % CODES
        out *= np.roll(letters, N - 1 - place, axis=1)[code]
    return out


class Coder:
    """Texts to n-gram codes; one per task."""

    def __init__(self) -> None:
        self.codes = letter_codes()

    def grams(self, text: str) -> np.ndarray:
        points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        codes = np.where(points < 0x10000, self.codes[np.minimum(points, 0xFFFF)], 1 + CODES // 2).astype(np.int64)
        codes = codes[np.concatenate([[True], (codes[1:] != 0) | (codes[:-1] != 0)])]  # one gap between words
        if len(codes) < N:
            return np.zeros(0, dtype=np.int64)
        out = np.zeros(len(codes) - N + 1, dtype=np.int64)
        for place in range(N):
            out = out * CODES + codes[place : place + len(out)]
        return out


def language_counts(docs: DataFrame, training: Column) -> DataFrame:
    """(lang, gram, n) over the training rows with a language, counted inside tasks before the shuffle."""

    def run(batches):
        coder, held = Coder(), {}
        for batch in batches:
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                grams = coder.grams(text)
                own = held.setdefault(lang, np.zeros(TABLE, dtype=np.int64)) if lang in held or len(held) < 64 else np.zeros(TABLE, dtype=np.int64)
                own += np.bincount(grams, minlength=TABLE)
                if lang not in held:  # more languages than a task holds at a time: its row goes out at once
                    yield table(lang, own)
        for lang, own in sorted(held.items()):
            yield table(lang, own)

    def table(lang, own):
        at = np.flatnonzero(own)
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(own[at])], ["lang", "gram", "n"])

    rows = docs.where(training & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
    return rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def prototypes(counts: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and their unit prototypes, centred on the mean profile of all languages.

    Bundling runs per language on the executors; only one vector of DIM numbers
    a language reaches the driver.
    """

    def bundle(rows: pd.DataFrame) -> pd.DataFrame:
        grams, n = rows["gram"].to_numpy(), rows["n"].to_numpy().astype(np.float64)
        letters, total = letter_vectors(), np.zeros(DIM)
        for lo in range(0, len(grams), 8192):
            total += n[lo : lo + 8192] @ gram_vectors(grams[lo : lo + 8192], letters).astype(np.float64)
        return pd.DataFrame({"lang": [rows["lang"].iloc[0]], "profile": [(total / max(1.0, np.linalg.norm(total))).tolist()]})

    rows = counts.groupBy("lang").applyInPandas(bundle, "lang string, profile array<double>").orderBy("lang").collect()
    names = [r.lang for r in rows]
    profiles = np.array([r.profile for r in rows], dtype=np.float64).reshape(len(names), DIM)
    return names, profiles


def predict(docs: DataFrame, names: list[str], profiles: np.ndarray) -> DataFrame:
    """doc_id, lang_pred and score of every row of doc_id and text."""
    centre = profiles.mean(axis=0) if len(names) > 1 else np.zeros(DIM)
    centred = profiles - centre
    centred /= np.maximum(np.linalg.norm(centred, axis=1, keepdims=True), 1e-12)
    axes, middle = centred.astype(np.float32), centre.astype(np.float32)

    def run(batches):
        coder, letters = Coder(), letter_vectors()
        for batch in batches:
            texts = batch.column("text").to_pylist()
            langs, scores = [None] * len(texts), [0.0] * len(texts)
            for lo in range(0, len(texts), BLOCK):
                part = [(k, coder.grams(texts[k])) for k in range(lo, min(lo + BLOCK, len(texts))) if texts[k] and any(map(str.isalpha, texts[k]))]
                if not part or not names:
                    continue
                seen = np.zeros(TABLE, dtype=bool)
                for _, grams in part:
                    seen[grams] = True
                known = np.flatnonzero(seen)
                place = np.zeros(TABLE, dtype=np.int32)
                place[known] = np.arange(len(known))
                bundles = np.zeros((len(part), DIM), dtype=np.float32)
                counts = np.stack([np.bincount(place[grams], minlength=len(known)).astype(np.float32) for _, grams in part])
                for at in range(0, len(known), 4096):
                    bundles += counts[:, at : at + 4096] @ gram_vectors(known[at : at + 4096], letters).astype(np.float32)
                bundles /= np.maximum(np.linalg.norm(bundles, axis=1, keepdims=True), 1e-9)
                bundles -= middle
                bundles /= np.maximum(np.linalg.norm(bundles, axis=1, keepdims=True), 1e-9)
                cosine = bundles @ axes.T
                odds = np.exp(SHARPNESS * (cosine - cosine.max(axis=1, keepdims=True)))
                best = cosine.argmax(axis=1)
                for row, (k, _) in enumerate(part):
                    langs[k], scores[k] = names[best[row]], float(odds[row, best[row]] / odds[row].sum())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array([x or "und" for x in langs], pa.string()), pa.array(scores, pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def held_out() -> Column:
    """Rows never learned from: crc32 of the decimal doc_id leaves 1 on division by 3."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify_languages(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of `docs` (doc_id, text, lang).

    Texts that are null or have no letter are `und` with score 0; so is every
    text when no training row has a language.  Rows without a doc_id are never
    held out.  Ties go to the first language in alphabetical order.  Repeated
    rows get equal results, an empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.withColumn("held_out", held_out())
    names, profiles = prototypes(language_counts(rows, ~F.col("held_out")))
    return predict(rows, names, profiles)
