"""Token alignment against whole texts encoded at once and links compared one by one."""

import hashlib
from collections import Counter

import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from barloom.llm.token_align import TOKENIZERS, align_tokens, byte_letters

TEXTS = [
    (1, "plain words, twice plain words"),
    (2, "  two  spaces \n\n and\ttabs \r\n x\n y "),
    (3, "<|endoftext|> <s> </s> <unk> <0x41> #$% 12345"),
    (4, "a▁b is not given back"),
    (5, "日本語のテキスト é ﬁ ① \U0001f600\U0001f600 　 x\x1c y\x85 z"),
    (6, None),
    (7, ""),
    (8, " "),
    (9, "x" * 3000 + " " * 50 + "aaaaaaaa" * 200),
    (None, "a row without an id"),
    (1, "plain words, twice plain words"),
    (10, "don't  we'll  see;\r {\r }\r"),
]


@pytest.fixture(scope="module")
def tools():
    a = Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=f"{TOKENIZERS}/piece_bpe_32k.model")


def spans(tokens):
    at, out = 0, []
    for k, raw in tokens:
        out.append((k, at, at + len(raw)))
        at += len(raw)
    return out


def aligned(tools, text):
    """Groups as two id lists and all links, by comparing every pair of ranges."""
    a, b = tools
    if not text:
        return [], []
    letters, whole = byte_letters(), (" " + text).encode()
    left = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    right = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
    if any(b"".join(t for _, t in side) != whole for side in (left, right)):
        return [], []
    left, right = spans(left), spans(right)
    ends = sorted({e for *_, e in left} & {e for *_, e in right})
    groups, rest = [], (iter(left), iter(right))
    for end in ends:
        sides = ([], [])
        for side, tokens in zip(sides, rest):
            for i, _, e in tokens:
                side.append(i)
                if e == end:
                    break
        groups.append(sides)
    links, k = [], 0
    for i, s, e in left:
        while right[k][2] <= s:
            k += 1
        j = k
        while j < len(right) and right[j][1] < e:
            links.append((i, right[j][0]))
            j += 1
    return groups, links


def expected(tools, rows):
    each = [(i, *aligned(tools, t)) for i, t in rows]
    count = Counter(link for _, _, links in each for link in links)
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for i, groups, links in each:
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        sha = hashlib.sha256(text.encode()).hexdigest() if groups else ""
        n_a, n_b = (sum(len(g[k]) for g in groups) for k in (0, 1))
        out.append((i, n_a, n_b, len(groups), len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), sha))
    return sorted(out, key=str)


@pytest.mark.parametrize("limit", [4_000_000, 0])
def test_odd_texts_match_brute_force(spark, tools, limit):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("code", "n", "row", "codes", "best", "part")})
    got = sorted((tuple(r) for r in align_tokens(docs.repartition(3), pair_limit=limit).collect()), key=str)
    assert got == expected(tools, TEXTS)


def test_corpus_matches_brute_force(spark, tools, corpus):
    rows = [(r.doc_id, r.text) for r in corpus.collect()]
    assert sorted((tuple(r) for r in align_tokens(corpus).collect()), key=str) == expected(tools, rows)


def test_counts_of_a_memo_are_handed_over_once(tools):
    from barloom.llm import token_align

    aligner = token_align.Aligner(TOKENIZERS)
    whole = [t for _, t in TEXTS if t]
    aligner.count(*aligner.numbers(whole))
    vector, code, total = aligner.counted()
    links = Counter(x for _, t in TEXTS for x in aligned(tools, t)[1])
    have = Counter({(int(c) >> 32, int(c) & 0xFFFFFFFF): int(n) for c, n in zip(code, total)})
    for k in vector.nonzero()[0]:
        have[int(k), int(aligner.v.identity[k])] += int(vector[k])
    assert have == links and not aligner.seen.any()
    assert not any(x.size and x.any() for x in aligner.counted())


def test_nothing_to_align(empty):
    assert align_tokens(empty).collect() == []


def test_one_unbroken_megabyte(spark, tools):
    text = "ab1c" * 250_000
    row = align_tokens(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.n_links == row.n_a + row.n_b - row.n_groups > 0 and row.groups_sha256
