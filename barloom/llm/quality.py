"""Quality rules with thresholds learned per language and source.

Base counts come from each text alone.  The verdict compares a document with
its own group: mergeable quantile sketches of every ratio are built per
(language, source), merged upwards per language and over everything, and give
fences around the usual values.  Groups too small to speak for themselves use
the merged sketch above them.  Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import store, words

WINDOW = 8
SYMBOLS = "#*$%&|<>"
LOUD = "!?"
MIN_WORDS = 20
FEW_LINES = 4  # a repeated line says little in a text of few lines
#: Ratio, and the least distance of its fence from the upper quartile.
RATIOS = {"word_length": 3.0, "symbols": 0.25, "loud": 0.3, "capitals": 0.25, "dup_lines": 0.3, "repeats": 0.15, "stutter": 0.1}
SPREAD = 6.0
MIN_GROUP = 200


def _without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def base_counts(docs: DataFrame) -> DataFrame:
    """doc_id, group_lang, group_source, the base counts and the ratios of every row.

    Arrays are materialised as columns before a lambda indexes them, so each
    text is split once and windows cost O(1) array reads each.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    step = docs.select(
        F.col("doc_id").cast("long"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("group_lang"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("group_source"),
        text.alias("text"),
        words(F.col("text").cast("string")).alias("w"),
        F.filter(F.split(text, "\n"), lambda line: F.translate(line, " \t\n\x0b\x0c\r", "") != "").alias("lines"),
    )
    step = step.select(
        "*",
        F.size("w").cast("long").alias("n_words"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("wh"),
        _without(F.col("text"), " \t\n\x0b\x0c\r").cast("long").alias("word_chars"),
        (F.length("text") - _without(F.col("text"), SYMBOLS)).cast("long").alias("n_symbols"),
        (F.length("text") - _without(F.col("text"), LOUD)).cast("long").alias("n_loud"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        (F.length("text") - F.length(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("long").alias("n_capitals"),
    ).drop("w", "lines", "text")
    starts = F.when(F.col("n_words") >= WINDOW, F.sequence(F.lit(0), (F.col("n_words") - WINDOW).cast("int"))).otherwise(F.array().cast("array<int>"))
    step = step.withColumn("n_stutter", F.size(F.filter("wh", lambda x, i: x == F.get("wh", i - 1)))).withColumn("h", F.transform(starts, lambda i: F.xxhash64(*[F.get("wh", i + k) for k in range(WINDOW)]))).drop("wh")
    again = F.size(F.array_distinct("h")) < F.size("h")
    pairs = F.when(again, F.array_sort(F.transform("h", lambda x, i: F.struct(x.alias("x"), i.alias("i")))))
    step = step.withColumn("s", pairs).drop("h")
    twice = F.transform("s", lambda e, k: F.when((e["x"] == F.get("s", k - 1)["x"]) | (e["x"] == F.get("s", k + 1)["x"]), e["i"]))
    step = step.withColumn("p", F.array_sort(F.filter(twice, lambda i: i.isNotNull()))).drop("s")
    covered = F.aggregate(F.transform("p", lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get("p", k + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)
    step = step.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("p")
    n, chars, lines = (F.greatest(F.col(c), F.lit(1)) for c in ("n_words", "word_chars", "n_lines"))
    return step.select(
        "doc_id", "group_lang", "group_source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))).alias("base_failed"),
        (F.col("word_chars") / n).alias("word_length"), (F.col("n_symbols") / n).alias("symbols"), (F.col("n_loud") / n).alias("loud"),
        (F.col("n_capitals") / chars).alias("capitals"), (F.col("n_dup_lines") / (lines + FEW_LINES)).alias("dup_lines"), (F.col("n_repeat_words") / n).alias("repeats"), (F.col("n_stutter") / n).alias("stutter"),
    )


def fences(counts: DataFrame) -> DataFrame:
    """(group_lang, group_source, name_low, name_high ...) per language and source, from merged sketches.

    One row per group of the input; sketch states have a fixed size and merge
    before the shuffle, so a source with a third of all rows costs no more.
    """
    usable = counts.where("not base_failed")
    own = usable.groupBy("group_lang", "group_source").agg(F.count(F.lit(1)).alias("n"), *[F.kll_sketch_agg_double(r).alias(r) for r in RATIOS])
    own = store(own, "op4-sketches")
    merged = [F.sum("n").alias("n"), *[F.kll_merge_agg_double(r).alias(r) for r in RATIOS]]
    by_lang = own.groupBy("group_lang").agg(*merged)
    total = own.agg(*merged).first()  # one row of fixed-size sketches

    def renamed(df: DataFrame, tag: str) -> DataFrame:
        return df.select(*[F.col(c).alias(f"{tag}_{c}") if c in RATIOS or c == "n" else F.col(c) for c in df.columns])

    groups = counts.select("group_lang", "group_source").distinct()
    wide = groups.join(renamed(own, "own"), ["group_lang", "group_source"], "left").join(renamed(by_lang, "lang"), "group_lang", "left")
    out = []
    for r, least in RATIOS.items():
        sketch = F.when(F.col("own_n") >= MIN_GROUP, F.col(f"own_{r}")).when(F.col("lang_n") >= MIN_GROUP, F.col(f"lang_{r}")).otherwise(F.lit(total[r]).cast("binary"))
        low, high = F.kll_sketch_get_quantile_double(sketch, F.lit(0.25)), F.kll_sketch_get_quantile_double(sketch, F.lit(0.75))
        reach = F.greatest(SPREAD * (high - low), F.lit(least))
        out += [(low - reach).alias(f"{r}_low"), (high + reach).alias(f"{r}_high")]
    return wide.select("group_lang", "group_source", *out)


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row per row of `docs` (doc_id, text, lang, source; other columns are ignored).

    Null and empty texts have no words and fail the base rule.  Null languages
    and sources form groups of their own.  Equal rows get equal verdicts.  With
    no usable document at all nothing is fenced.  An empty table gives an empty
    result.
    """
    counts = store(base_counts(docs), "op4-counts")
    limits = store(fences(counts), "op4-fences")
    judged = counts.join(limits, ["group_lang", "group_source"], "left")
    inside = F.lit(True)
    for r in RATIOS:
        inside = inside & F.coalesce(F.col(r).between(F.col(f"{r}_low"), F.col(f"{r}_high")), F.lit(True))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & inside).alias("kept")
    )
