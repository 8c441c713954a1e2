"""Similarity join, repeated strings and benchmark passages against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from barloom.llm import common, ngram_join, suffix_dedup
from barloom.llm.common import components, dense_rank, only, text_chunks, word_spans
from barloom.llm.decontaminate import contaminated_pairs
from barloom.llm.ngram_join import ngram_jaccard_join, part_keys, size_classes
from barloom.llm.suffix_dedup import remove_repeats

from ..conftest import SF_DIR

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, n):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def brute_components(texts, n, percent):
    sets = {i: shingles(t, n) for i, t in texts.items()}
    holders, root = {}, {i: i for i in texts}
    for i, s in sets.items():
        for g in s:
            holders.setdefault(g, []).append(i)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in sets.items():
        common = {}
        for g in s:
            for j in holders[g]:
                if j < i:
                    common[j] = common.get(j, 0) + 1
        for j, o in common.items():
            if 100 * o >= percent * (len(s) + len(sets[j]) - o):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in texts}


@pytest.mark.parametrize("n,percent", [(4, 85), (5, 80)])
def test_join_matches_brute_force(corpus, texts, n, percent):
    rows = ngram_jaccard_join(corpus, n, percent).collect()
    assert len(rows) == corpus.count()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows if r.doc_id is not None} == brute_components(texts, n, percent)


def edited_copies(count, words, edits, seed):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10_000)}" for _ in range(words)]
    out = {}
    for k in range(count):
        own = list(base)
        for _ in range(rng.randrange(edits + 1)):
            own[rng.randrange(words)] = f"x{rng.randrange(10**9)}"
        out[k] = " ".join(own)
    return out


def test_join_of_a_large_group_of_near_copies(spark):
    """Copies near the threshold: some link to the source only, some to others only, some to none."""
    made = edited_copies(250, 130, 8, 3) | {1000 + k: t for k, t in edited_copies(40, 9, 1, 4).items()} | {2000 + k: t for k, t in edited_copies(60, 40, 3, 5).items()}
    rows = ngram_jaccard_join(spark.createDataFrame(list(made.items()), "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute_components(made, 4, 85)


def test_meeting_documents_tie_their_leaders_only(spark, monkeypatch):
    """Documents that meet in many keys add no edge for each key they meet in, and the components stay the same."""
    made, edges, plain = edited_copies(400, 130, 12, 6), {}, ngram_join.components

    def counted(links, label):
        edges[label] = links.count()
        return plain(links, label)

    monkeypatch.setattr(ngram_join, "components", counted)
    rows = ngram_jaccard_join(spark.createDataFrame(list(made.items()), "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute_components(made, 4, 85)
    assert edges["op1-clusters"] <= len(made)


def test_long_tables_do_not_go_through_the_driver(spark, monkeypatch):
    """Beyond a few rows, runs and tiles reach the sets by shuffle; the links stay the same."""
    made = edited_copies(120, 130, 8, 3) | {2000 + k: t for k, t in edited_copies(60, 40, 3, 5).items()}
    docs, sent, broadcast = spark.createDataFrame(list(made.items()), "doc_id long, text string"), [], F.broadcast
    monkeypatch.setattr(F, "broadcast", lambda df: sent.append((len(df.columns), df.count())) or broadcast(df))
    monkeypatch.setattr(ngram_join, "ROWS", 10, raising=False)
    few = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard_join(docs).collect()}
    assert sent and all(rows <= 10 for columns, rows in sent if columns >= 4)
    assert few == brute_components(made, 4, 85)
    monkeypatch.setattr(common, "SENT", 0, raising=False)  # nor do keys
    sent.clear()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard_join(docs).collect()} == few
    assert not any(rows for _, rows in sent)


def test_tables_are_sent_by_their_bytes(spark):
    rows = spark.range(500_000).withColumnRenamed("id", "doc_id")
    wide = rows.select("doc_id", *[F.lit(k).cast("long").alias(f"c{k}") for k in range(5)])
    hinted = [("broadcast" in only(rows, keys, "doc_id", "inner")._jdf.queryExecution().logical().toString()) for keys in (rows, wide, wide.limit(1000))]
    assert hinted == [True, False, True]


def test_join_along_chains(spark):
    """Neighbours link, ends do not: most links are found between members that no pivot reaches."""
    words = [f"w{k}" for k in range(900)]
    made = {7 * k % 61 + 100: " ".join(words[6 * k : 6 * k + 150]) for k in range(61)}
    made |= {1000 + k: " ".join(words[600 + 4 * k : 700 + 4 * k]) for k in range(30)}
    rows = ngram_jaccard_join(spark.createDataFrame(list(made.items()), "doc_id long, text string")).collect()
    want = brute_components(made, 4, 85)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == want
    assert len({c for _, c in want.values()}) < 5


def test_linked_sets_share_a_part():
    rng, bounds = np.random.default_rng(1), size_classes(85, 1 << 40)
    for n in [6, 7, 8, 13, 20, 60, 200, 777]:
        for _ in range(20):
            a = np.unique(rng.integers(0, 1 << 63, size=n).astype(np.uint64))
            keep = int(np.ceil(0.85 * n))
            b = np.unique(np.concatenate([rng.permutation(a)[: max(keep, n - int(0.081 * n))], rng.integers(0, 1 << 63, size=int(0.06 * n)).astype(np.uint64)]))
            common = len(np.intersect1d(a, b))
            if 100 * common >= 85 * (len(a) + len(b) - common):
                (x, need_x), (y, need_y) = part_keys(a, 85, bounds), part_keys(b, 85, bounds)
                shared = np.intersect1d(x, y)
                by_class = [int((shared & np.uint64(1) == k).sum()) for k in (0, 1)]
                # in the larger one's class, which both are dealt into, either bound is kept
                assert any(0 < max(need_x[k], need_y[k]) <= by_class[k] for k in (0, 1))


@pytest.mark.parametrize("pruned", [True, False])
def test_tiles_of_many_short_documents_hold_few(spark, monkeypatch, tmp_path, pruned):
    """Documents that share a passage without linking fall before any tile; of short ones, unpruned, every tile notes its rows."""
    if not pruned:
        bound = ngram_join.possible
        monkeypatch.setattr(ngram_join, "possible", lambda shared, needs, label: bound(shared, needs.withColumns({"need0": F.lit(1), "need1": F.lit(1)}), label))
    line = "all rights reserved under the usual licence"
    made = {k: f"{line} a{k} b{k} c{k}" for k in range(1500)}
    if pruned:  # half of each longer text is shared
        made = {k: " ".join([f"w{j}" for j in range(50)] + [f"x{k}y{j}" for j in range(50)]) for k in range(400)}
    forest, seen = ngram_join.tile_forest, str(tmp_path)

    def noted(percent):
        run = forest(percent)

        def told(rows):
            with open(f"{seen}/{rows['i'].iloc[0]}-{rows['j'].iloc[0]}-{rows['doc_id'].min()}", "w") as out:
                out.write(str(len(rows)))
            return run(rows)

        return told

    monkeypatch.setattr(ngram_join, "tile_forest", noted)
    monkeypatch.setattr(ngram_join, "TILE_DOCS", 100, raising=False)
    got = {r.doc_id: r.component_id for r in ngram_jaccard_join(spark.createDataFrame(list(made.items()), "doc_id long, text string")).collect()}
    assert got == {k: k for k in made}
    rows = [int(f.read_text()) for f in tmp_path.iterdir()]
    assert not rows if pruned else rows and max(rows) <= 2 * 100 * 1.6  # two blocks dealt by hash


def test_join_of_nothing(empty):
    assert ngram_jaccard_join(empty).collect() == []


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(100, 180)] + [(5, 7), (7, 5), (9, 9)], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {k: 100 for k in range(100, 181)} | {5: 5, 7: 5}


def test_dense_rank_is_gapless(spark):
    df = spark.range(500).selectExpr("id", "id % 3 g", "id % 7 chunk")
    rows = dense_rank(df, ["g"], "chunk", ["id"], "place").collect()
    for g in range(3):
        own = sorted((r.place, r.chunk, r.id) for r in rows if r.g == g)
        assert [p for p, _, _ in own] == list(range(len(own))) and [(c, i) for _, c, i in own] == sorted((c, i) for _, c, i in own)


def test_word_spans_stop_at_rows():
    column = pa.array(["ab c", None, "", "d", " e  é ", "fg"])
    got = []
    for first, _, data, offsets in text_chunks(column, limit=5):
        start, end, row = word_spans(data, offsets)
        got += [(first + r, bytes(data[s:e]).decode()) for s, e, r in zip(start, end, row)]
    assert got == [(0, "ab"), (0, "c"), (3, "d"), (4, "e"), (4, "é"), (5, "fg")]


def brute_repeats(texts):
    seen, out = set(), {}
    for i in sorted(texts):
        raw = texts[i].encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - 99):
            if raw[k : k + 100] in seen:
                gone[k : k + 100] = b"\1" * 100
            else:
                seen.add(raw[k : k + 100])
        rest = bytes(c for c, g in zip(raw, gone) if not g)
        out[i] = (len(raw), sum(gone), sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1])), hashlib.sha256(rest).hexdigest())
    return out


def as_told(rows):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows if r.doc_id is not None}


def test_repeats_match_brute_force(corpus, texts):
    rows = remove_repeats(corpus).collect()
    assert len(rows) == corpus.count()
    assert as_told(rows) == brute_repeats(texts)


@pytest.mark.parametrize("crowd", [50_000, 2])
def test_repeats_in_near_copies_and_periods(spark, monkeypatch, crowd):
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    made = edited_copies(60, 80, 6, 9)
    made |= {100: "ab" * 300, 101: "x" + "ab" * 120, 102: "q" * 99, 103: "q" * 100, 104: "q" * 101, 105: made[7][50:260] + "é" + made[7][40:300]}
    made |= {106: made[3], 107: made[3] + made[3]}
    rows = remove_repeats(spark.createDataFrame(list(made.items()), "doc_id long, text string")).collect()
    assert as_told(rows) == brute_repeats(made)


def test_repeats_of_nothing(empty):
    assert remove_repeats(empty).collect() == []


def test_whole_items_and_templates_are_found(spark, corpus, texts):
    bench = spark.read.parquet(f"{SF_DIR}/benchmark.parquet").select("item_id", "text")
    mine = spark.createDataFrame(
        [(1001, "A train leaves Springfield at 7 am and covers 180 km in 3 hours. How fast does the train of John move on average?"), (1002, None), (1003, "x"), (1004, "")], bench.schema
    )
    told = "Well. A train leaves Oldtown at 9 am and covers 240 km in 4 hours. How fast does the train of Mary move on average?"
    twisted = "A train leaves Oldtown at 9 am and covers 9 km in 4 hours. "  # nothing contradicts: each slot has one value
    clash = "A train leaves Oldtown at 9 am and covers 240 km in 4 hours, in 5 hours. How fast"
    docs = spark.createDataFrame([(1, told), (2, twisted), (3, clash), (4, "a train leaves"), (5, None)], "doc_id long, text string")
    pairs = {(r.doc_id, r.item_id): r for r in contaminated_pairs(docs, bench.union(mine)).collect()}
    assert pairs[(1, 1001)].coverage > 0.9 and pairs[(1, 1001)].reparameterised
    assert not {d for d, _ in pairs} & {4, 5}

    def plain(t):
        return " ".join(w for w in (w.strip(".,;:!?|").lower() for w in t.split()) if w)

    items = {r.item_id: plain(r.text) for r in bench.collect()}
    want = {(i, k) for i, t in texts.items() for k, q in items.items() if q in plain(t)}
    got = {(r.doc_id, r.item_id) for r in contaminated_pairs(corpus, bench).collect()}
    assert want <= got and len(got - want) <= 0.02 * len(texts)


def test_inconsistent_slots_do_not_count(spark):
    item = [(1, "from 5 to 5 and 5 then 5 or 5 so 5 by 5 at 5")]
    docs = [(1, "from 8 to 8 and 8 then 8 or 8 so 8 by 8 at 8"), (2, "from 1 to 2 and 3 then 4 or 5 so 6 by 7 at 8")]
    got = contaminated_pairs(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(item, "item_id long, text string")).collect()
    assert [r.doc_id for r in got] == [1]


def test_excerpts_of_long_items(spark):
    plain = " ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26)}x" for k in range(400))
    numbers = " ".join([*(f"v{chr(97 + k % 26)}{chr(97 + k // 26)}y" for k in range(200)), *(str(k * 7 + 3) for k in range(20))])
    w = plain.split()
    twice = " ".join(w[:20] + ["5", *w[20:40], "5"] + w[40:])
    items = spark.createDataFrame([(1, plain), (2, numbers), (3, twice)], "item_id long, text string")
    docs = [
        (1, "so it says " + " ".join(w[100:113]) + " and ends"),
        (2, "so it says " + " ".join(w[100:112]) + " and ends"),  # one word short
        (3, " ".join(str(k * 5 + 1) for k in range(20))),  # other numbers alone are no template
        (4, "the numbers " + " ".join(str(k * 7 + 3) for k in range(5, 18))),
        (5, " ".join([*w[:6], *("gap" for _ in range(9)), *w[30:36], *("gap" for _ in range(9)), *w[60:66]])),  # no run
        (6, twice.replace(" 5 ", " 8 ", 1)),  # the two slots contradict, long runs do not
    ]
    got = {(r.doc_id, r.item_id): r for r in contaminated_pairs(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()}
    assert set(got) == {(1, 1), (4, 2), (6, 1), (6, 3), (1, 3)}
    assert got[(1, 1)].n_windows == 8 and got[(1, 1)].coverage < 0.4 and not got[(1, 1)].reparameterised


def test_copies_in_another_case_or_with_other_line_ends(spark):
    item = "Then Anna gave Boris and Clara the old map of Dover.\nTomorrow Edgar and Fiona will sail from Genoa to Haifa\nwith 12 km of rope for Ivan and Élodie while Жанна reads"
    copies = [item, item.lower(), item.upper(), item.title(), item.replace("\n", " "), item.replace(" ", "\n"), item.lower().replace("\n", " "), "He said that " + " ".join(item.upper().split()[9:25]) + " and left"]
    docs = spark.createDataFrame([(k, c) for k, c in enumerate(copies)], "doc_id long, text string")
    rows = {r.doc_id: r for r in contaminated_pairs(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert set(rows) == set(range(len(copies)))
    assert all(rows[k].coverage == 1 and not rows[k].reparameterised for k in range(7))


def test_contamination_of_nothing(spark, empty, corpus):
    bench = spark.read.parquet(f"{SF_DIR}/benchmark.parquet")
    assert contaminated_pairs(empty, bench).collect() == []
    assert contaminated_pairs(corpus, bench.limit(0)).collect() == []
