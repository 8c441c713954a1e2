"""Secret scan with corpus-wide ownership frequency.

Base patterns give spans that always stay.  Every candidate value, base or
high-entropy token, is hashed; per hash Spark counts the distinct repositories
(`source`) and owners (`owner`, the document where no such column exists) that
hold it.  Exact copies of a text count once, as one owner in one repository,
unless they fill more repositories than a value may have owners.  Values in few places are owner-specific and look live; values copied
widely are examples.  High-entropy tokens that are owner-specific become spans
of kind `live`.
"""

from __future__ import annotations

import hashlib
import math
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import store

#: The base patterns in the order of their kinds.
ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "live")
#: Spans of the method: long tokens of the usual key alphabet.
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
MIN_BITS = 3.5
MAX_REPOSITORIES = 1
MAX_OWNERS = 5
_CUES = ("password", "passwd", "secret", "token", "apikey", "api_key")


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in (value.count(x) for x in set(value)))


def looks_random(value: str) -> bool:
    kinds = sum(any(test(c) for c in value) for test in (str.islower, str.isupper, str.isdigit))
    return kinds >= 2 and any(c.isdigit() for c in value) and entropy(value) >= MIN_BITS


def scan(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind index, end, value) of the base candidates and high-entropy tokens, sorted."""
    out = []
    lowered = text.lower() if "=" in text or ":" in text else ""
    if any(cue in lowered for cue in _CUES):
        out += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    base = list(out)
    for m in TOKEN.finditer(text):
        if looks_random(m[0]) and not any(a < m.end() and m.start() < b for a, _, b, _ in base):
            out.append((m.start(), 3, m.end(), m[0]))
    return sorted(out)


SPANS = "array<struct<start:int,kind:int,end:int,hash:string>>"


def find_candidates(docs: DataFrame) -> DataFrame:
    """doc_id, repository, owner, copy (hash of the text) and the candidate spans with hashed values (the values themselves are not kept)."""
    owner = F.col("owner").cast("string") if "owner" in docs.columns else F.col("doc_id").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("repository"), owner.alias("owner"), F.col("text").cast("string").alias("text"))

    def run(batches):
        for part in batches:
            spans = [
                [{"start": a, "kind": k, "end": b, "hash": hashlib.sha256(v.encode("utf-8", "surrogatepass")).hexdigest()[:32]} for a, k, b, v in scan(t)] if t else []
                for t in part["text"]
            ]
            copies = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest()[:32] if s else None for t, s in zip(part["text"], spans)]
            yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "repository": part["repository"], "owner": part["owner"], "copy": pd.Series(copies, dtype=object, index=part.index), "spans": spans})

    return rows.mapInPandas(run, f"doc_id long, repository string, owner string, copy string, spans {SPANS}")


def ownership(found: DataFrame) -> DataFrame:
    """Distinct repositories and owners of every candidate hash, and whether it looks live.

    A text that has copies stands once, in its first repository and with its
    first owner there.  Distinct (hash, repository) and (hash, owner) are formed with map-side
    combine before counting, so a value in a third of all documents is no
    large group anywhere.
    """
    rows = found.select("repository", "owner", "copy", F.explode("spans.hash").alias("hash"))
    places = rows.groupBy("hash", "copy", "repository").agg(F.min("owner").alias("owner"))
    texts = places.groupBy("hash", "copy").agg(F.min(F.struct("repository", "owner")).alias("first"), F.count(F.lit(1)).alias("n"))
    texts = store(texts, "op5-texts")
    each = texts.select("hash", "first.repository", "first.owner")
    spread = texts.groupBy("hash").agg(F.max("n").alias("spread"))
    repositories = each.select("hash", "repository").distinct().groupBy("hash").agg(F.count(F.lit(1)).alias("n_repositories"))
    owners = each.select("hash", "owner").distinct().groupBy("hash").agg(F.count(F.lit(1)).alias("n_owners"))
    live = (F.col("n_repositories") <= MAX_REPOSITORIES) & (F.col("n_owners") <= MAX_OWNERS) & (F.col("spread") <= MAX_OWNERS)
    return repositories.join(owners, "hash").join(spread, "hash").withColumn("live", live)


def scan_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_examples) of every row of `docs`.

    Null and empty texts have no spans.  A null source is a repository of its
    own.  Rows are scanned one by one; rows with the same doc_id or the same
    text count as the same owner.  An empty table gives an empty result.
    """
    found = store(find_candidates(docs).withColumn("row", F.monotonically_increasing_id()), "op5-candidates")
    verdicts = store(ownership(found), "op5-ownership")
    each = found.where(F.size("spans") > 0).select("row", F.explode("spans").alias("s")).select("row", "s", F.col("s.hash").alias("hash"))
    judged = each.join(verdicts.select("hash", "live"), "hash").where((F.col("s.kind") < 3) | F.col("live"))
    packed = judged.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("s.start", "s.kind", "s.end", "live"))).alias("spans"))
    rows = found.select("row", "doc_id").join(packed, "row", "left").withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<start:int,kind:int,end:int,live:boolean>>")))

    def digest(spans):
        names = F.array(*[F.lit(k) for k in KINDS])
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("spans", lambda s: s["kind"] < 3)

    def count(kind: int):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    return rows.select(
        "doc_id", *[count(k).alias(f"n_{KINDS[k]}") for k in range(3)], F.sha2(digest(base), 256).alias("base_sha256"), digest(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live"), F.size(F.filter("spans", lambda s: ~s["live"])).cast("long").alias("n_examples"),
    )
