"""Personal data by weak supervision, in DataFrame functions.

Candidates come from base patterns (always kept) and from looser shapes that
alone prove nothing.  Four labelers vote on every candidate: its own format,
a gazetteer, the words before it, and its edges.  Votes are counted per kind
and vote pattern; expectation-maximisation on these counts (at most 3**4
patterns a kind, whatever the corpus) estimates how reliable each labeler is.
The resulting soft labels train a naive Bayes span classifier, whose weights
decide which loose candidates are added.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import store

#: The base patterns, in the order of their kinds.  The card
#: pattern is the same language as "[0-9]([ -]?[0-9])+ with 12 to 19 digits":
#: runs are maximal, so the edges can be said as lookarounds.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = (
    r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}\x20?\(?[0-9]{1,4}\)?(?:[\x20.-][0-9]{2,4}){2,3}|[0-9]{13,19}|[0-9]{3}-[0-9]{2}-[0-9]{4}|[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}"
    r"|\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}"
    r"|[A-Za-z0-9._-]+\x20?[\[(](?:at|AT)[\])]\x20?[A-Za-z0-9-]+\x20?(?:\.|[\[(](?:dot|DOT)[\])])\x20?[A-Za-z]{2,}"
    r"|(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Madame|Monsieur)\.?\x20[A-Z][a-z]+(?:\x20[A-Z][a-z]+)?)(?![0-9A-Za-z])"
)
#: Gazetteers and cue words.
DOMAINS = "com|org|net|edu|gov|io|de|fr|es|uk|it|eu|info"
NAMES = "anna|anne|carlos|charles|david|emma|hans|james|jean|john|juan|laura|linda|maria|marie|martin|mary|michael|paul|peter|pierre|robert|sarah|smith|thomas|miller|garcia|schmidt|weber|martinez|dupont|johnson"
CUES = "mail|contact|call|phone|tel|fax|mobile|card|visa|credit|ssn|social security|iban|account|address|ip|name|write to|kontakt|telefon|correo|adresse"
AGAINST = "version|isbn|order|invoice|build|page|figure|chapter|model|serial|part"
LABELERS = ("format", "gazetteer", "context", "edges")
ROUNDS = 50
BEFORE = 40


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(match: Column) -> Column:
    digits = _digits(match)
    last = F.length(digits)

    def value(k: Column) -> Column:
        d = F.substring(digits, k, F.lit(1)).cast("int") * F.when((last - k) % 2 == 1, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(1), last), F.lit(0), lambda a, k: a + value(k))
    return total % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        parts = F.transform(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.try_to_number(F.substring(p, 1, 3), F.lit("999")) <= 255))
    if kind == "card":
        return _luhn(match)
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    return F.lit(True)


def _loose_kind(match: Column) -> Column:
    return (
        F.when(match.startswith("+"), "intl_phone")
        .when(match.rlike("^[0-9]{13,19}$"), "card_number")
        .when(match.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn")
        .when(match.rlike(r"^[A-Z]{2}[0-9]{2}"), "iban")
        .when(match.rlike(r"^\(?[0-9]{3}"), "local_phone")
        .when(match.rlike(r"[\[(](?:at|AT)[\])]"), "masked_email")
        .otherwise("name")
    )


def _format_vote(kind: Column, match: Column) -> Column:
    digits = _digits(match)
    return (
        F.when(kind == "email", match.rlike(r"\.[A-Za-z]{2,}$"))
        .when(kind == "ip", ~match.rlike(r"^0|\.0[0-9]"))
        .when(kind == "card", F.length(digits).isin(13, 15, 16, 19))
        .when(kind.isin("phone", "intl_phone"), F.length(digits).between(10, 13))
        .when(kind == "card_number", _luhn(match))
        .when(kind == "ssn", ~match.rlike("^(000|666|9)|-00-|-0000$"))
        .when(kind == "iban", F.length(F.translate(match, " ", "")).between(15, 34))
        .when(kind == "local_phone", match.rlike(r"^\(?[2-9]"))
        .when(kind == "masked_email", match.rlike(r"[a-z]{2,}$"))
        .otherwise(match.rlike(r"\.\x20|\x20.*\x20"))
    )


def _gazetteer_vote(kind: Column, match: Column) -> Column:
    low = F.lower(match)
    return (
        F.when(kind.isin("email", "masked_email"), F.when(low.rlike(rf"[.\])\x20](?:{DOMAINS})$"), True))
        .when(kind == "ip", ~match.rlike(r"^(0|127|255)\."))
        .when(kind.isin("card", "card_number"), F.when(match.rlike("^[3-6]"), True))
        .when(kind.isin("phone", "intl_phone"), match.rlike(r"^\+[1-9]"))
        .when(kind == "iban", F.when(match.rlike("^(AT|BE|CH|DE|ES|FR|GB|IT|NL|PT)"), True).otherwise(False))
        .when(kind == "name", F.when(low.rlike(rf"\b(?:{NAMES})\b"), True))
    )


def candidates(docs: DataFrame) -> DataFrame:
    """`docs` with an array `cands` of structs: start, rank, kind, end, base and one vote per labeler (null: abstains)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    patterns = BASE | {"loose": LOOSE}
    step = docs.withColumn("_text", text)
    step = step.withColumns({f"_m_{k}": F.regexp_extract_all(F.col("_text"), F.lit(p), F.lit(0)) for k, p in patterns.items()})
    step = step.withColumns(
        {f"_p_{k}": F.when(F.size(f"_m_{k}") > 0, F.transform(F.split(F.col("_text"), p, -1), lambda x: F.length(x))) for k, p in patterns.items()}
        | {f"_l_{k}": F.transform(f"_m_{k}", lambda x: F.length(x)) for k in patterns}
    )
    def total(name: str, n: Column) -> Column:
        return F.aggregate(F.slice(F.col(name), F.lit(1), n), F.lit(0), lambda a, x: a + x)

    def spans_of(rank: int, kind: str) -> Column:
        def span(match: Column, at: Column) -> Column:
            start = total(f"_p_{kind}", at + 1) + total(f"_l_{kind}", at)
            named = _loose_kind(match) if kind == "loose" else F.lit(kind)
            return F.struct(start.alias("start"), F.lit(rank).alias("rank"), named.alias("kind"), (start + F.length(match)).alias("end"), match.alias("match"))

        return F.filter(F.transform(f"_m_{kind}", span), lambda s: _valid(kind, s["match"]))

    found = [spans_of(rank, kind) for rank, kind in enumerate(patterns)]
    step = step.withColumn("_found", F.array_sort(F.concat(*found))).drop(*[f"_{c}_{k}" for c in "mpl" for k in patterns])
    base = F.filter("_found", lambda s: s["rank"] < len(BASE))
    step = step.withColumn("_found", F.filter("_found", lambda s: (s["rank"] < len(BASE)) | ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))))

    def voted(s: Column) -> Column:
        lead = F.greatest(s["start"] - BEFORE, F.lit(0))
        before = F.lower(F.substring(F.col("_text"), lead + 1, s["start"] - lead))
        after = F.substring(F.col("_text"), s["end"] + 1, F.lit(1))
        cue = F.when(before.rlike(rf"\b(?:{AGAINST})\b"), False).when(before.rlike(rf"\b(?:{CUES})"), True)
        edges = ~(before.rlike(r"[a-z0-9]$") | after.rlike(r"^[A-Za-z0-9]"))
        return F.struct(
            s["start"].alias("start"), s["rank"].alias("rank"), s["kind"].alias("kind"), s["end"].alias("end"), (s["rank"] < len(BASE)).alias("base"),
            _format_vote(s["kind"], s["match"]).alias("format"), _gazetteer_vote(s["kind"], s["match"]).alias("gazetteer"), cue.alias("context"), edges.alias("edges"),
            F.least(F.length(s["match"]) / 4, F.lit(9)).cast("int").alias("length"), before.rlike(r"[:=]\x20?$").alias("after_colon"),
        )

    return step.withColumn("cands", F.transform("_found", voted)).drop("_text", "_found")


def reliabilities(patterns: list[tuple[str, tuple, int]]) -> dict[str, tuple[float, list[float], list[float]]]:
    """Per kind: prior, P(vote yes | personal) and P(vote yes | not) of each labeler, by EM on counted vote patterns."""
    by_kind = defaultdict(list)
    for kind, votes, count in patterns:
        by_kind[kind].append((votes, count))
    out = {}
    for kind, rows in by_kind.items():
        prior, yes, no = 0.7, [0.8] * len(LABELERS), [0.3] * len(LABELERS)
        for _ in range(ROUNDS):
            total = [1.0, 1.0]  # one pseudo-count each keeps every estimate inside (0, 1)
            heard = [[[1.6, 2.0], [0.6, 2.0]] for _ in LABELERS]
            for votes, count in rows:
                p = posterior((prior, yes, no), votes)
                for side, weight in enumerate((p * count, (1 - p) * count)):
                    total[side] += weight
                    for j, v in enumerate(votes):
                        if v is not None:
                            heard[j][side][0] += weight * v
                            heard[j][side][1] += weight
            prior = total[0] / sum(total)
            yes, no = ([h[side][0] / h[side][1] for h in heard] for side in (0, 1))
        out[kind] = (prior, yes, no)
    return out


def posterior(model: tuple[float, list[float], list[float]], votes: tuple) -> float:
    prior, yes, no = model
    odds = math.log(prior / (1 - prior))
    for v, a, b in zip(votes, yes, no, strict=True):
        if v is not None:
            odds += math.log(a / b) if v else math.log((1 - a) / (1 - b))
    return 1 / (1 + math.exp(-max(-50.0, min(50.0, odds))))


def train(cands: DataFrame) -> tuple[dict, dict]:
    """Labeler reliabilities, and naive Bayes weights of the span features trained on their soft labels."""
    each = cands.select(F.explode("cands").alias("c")).select("c.*")
    features = ["length", "after_colon"]
    rows = each.groupBy("kind", *LABELERS, *features).agg(F.count(F.lit(1)).alias("n")).collect()  # at most 11 kinds x 81 patterns x 20 features
    patterns: dict[tuple, int] = defaultdict(int)
    for r in rows:
        patterns[(r.kind, tuple(r[x] for x in LABELERS))] += r.n
    model = reliabilities([(k, v, n) for (k, v), n in sorted(patterns.items(), key=str)])
    soft: dict[tuple, list[float]] = defaultdict(lambda: [1.0, 1.0])
    whole: dict[str, list[float]] = defaultdict(lambda: [2.0, 2.0])
    for r in rows:
        p = posterior(model[r.kind], tuple(r[x] for x in LABELERS))
        for name in (*LABELERS, *features):
            cell = soft[(r.kind, name, str(r[name]).lower())]
            cell[0] += p * r.n
            cell[1] += (1 - p) * r.n
        whole[r.kind][0] += p * r.n
        whole[r.kind][1] += (1 - p) * r.n
    weights = {f"{k}|{name}|{v}": math.log(a / whole[k][0]) - math.log(b / whole[k][1]) for (k, name, v), (a, b) in soft.items()}
    weights |= {f"{k}|prior|": math.log(a / b) for k, (a, b) in whole.items()}
    return model, weights


def accepted(weights: dict[str, float]) -> Column:
    """Sorted spans (start, rank, kind, end, base, probability): base ones, and loose ones that the classifier takes."""
    flat = [F.lit(x) for kv in sorted(weights.items()) for x in kv]
    table = F.create_map(*flat) if flat else F.create_map().cast("map<string,double>")

    def scored(c: Column) -> Column:
        odds = F.coalesce(F.element_at(table, F.concat(c["kind"], F.lit("|prior|"))), F.lit(0.0))
        for name in (*LABELERS, "length", "after_colon"):
            key = F.concat(c["kind"], F.lit(f"|{name}|"), F.coalesce(c[name].cast("string"), F.lit("none")))
            odds = odds + F.coalesce(F.element_at(table, key), F.lit(0.0))
        return F.struct(*[c[x].alias(x) for x in ("start", "rank", "kind", "end", "base")], (1 / (1 + F.exp(-odds))).alias("probability"))

    return F.filter(F.transform("cands", scored), lambda c: c["base"] | (c["probability"] >= 0.5))


def find_pii(docs: DataFrame) -> DataFrame:
    """`docs` with a column `pii`, the accepted spans in code points (end exclusive), sorted by start.

    Null and empty texts have none.  Rows are judged one by one, so repeated
    rows get the same spans and nothing depends on their order.  Columns of
    `docs` named cands or pii are replaced.  An empty table gives an empty result.
    """
    kept = store(candidates(docs.drop("cands", "pii")), "op8-candidates")
    _, weights = train(kept)
    return kept.withColumn("pii", accepted(weights)).drop("cands")


def redact(found: DataFrame) -> DataFrame:
    """Replace every span of `pii` in the text by <KIND>; overlapping spans become one gap."""
    step = found.withColumn("_prior", F.transform("pii", lambda s, k: F.coalesce(F.array_max(F.transform(F.slice("pii", F.lit(1), k), lambda x: x["end"])), F.lit(0))))
    pieces = F.transform(
        "pii",
        lambda s, k: F.when(s["start"] < F.get("_prior", k), "").otherwise(
            F.concat(F.substring(F.col("text"), F.get("_prior", k) + 1, s["start"] - F.get("_prior", k)), F.lit("<"), F.upper(s["kind"]), F.lit(">"))
        ),
    )
    tail = F.coalesce(F.array_max(F.transform("pii", lambda s: s["end"])), F.lit(0))
    cleaned = F.concat(F.array_join(pieces, ""), F.substring(F.col("text"), tail + 1, F.length("text")))
    return step.withColumn("text", F.when(F.size("pii") > 0, cleaned).otherwise(F.col("text"))).drop("_prior", "pii")


def span_digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def pii_report(docs: DataFrame) -> DataFrame:
    """Counts and digests of the base spans and all spans of every row."""
    found = find_pii(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    base = F.filter("pii", lambda s: s["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter("pii", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in BASE]
    return found.select("doc_id", *counts, F.sha2(span_digest(base), 256).alias("base_sha256"), span_digest(F.col("pii")).alias("spans"))
