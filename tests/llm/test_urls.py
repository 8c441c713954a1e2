"""Url filter: parts, rules, shrinkage against plain loops, SQL."""

import math
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from barloom.llm import queries, url_filter
from barloom.llm.url_filter import CUTOFF, DEVIATIONS, RULES, SPREAD, TERMS, filter_urls, host_reputation

from ..conftest import SF_DIR

ODD = [
    (1, None), (2, ""), (3, "no scheme/en/"), (4, "HTTP://WWW.Example.COM/en/X?q#f"), (5, "http://example.com/en/x"), (6, "http://a.example.com/EN/x"),
    (7, "http://com/"), (8, "http://x.com"), (9, "http://notcom/"), (10, "http://a.net/es/"), (11, "http://a.net/es"), (12, "http://net/fr/1"),
    (13, "a://b://c.net/fr/"), (14, "http://u@h.co.uk:80/p?x"), (15, "http://10.0.0.1/en/"), (16, "://x\n.net/\nfr/"), (17, "http://É.NET/fr/"), (18, "http://www.example.com.evil.org/en/"),
    (19, "http://a.com?x=/en/"), (20, "http://spam.example.org/1"), (20, "http://spam.example.org/1"), (None, "http://spam.example.org/2"), (21, "http://b.www.example.com/en/"), (22, "x" * 1_000_000 + "://y.net/es/" + "z" * 1_000_000),
]


def brute(rows):
    parsed = []
    for i, url in rows:
        url = url or ""
        host, path = "", ""
        if "://" in url:
            rest = url.split("://", 1)[1]
            host = re.match(r"[^/?#]*", rest)[0]
            path = re.match(r"[^?#]*", rest[len(host):])[0]
            host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits)[1:] if fits else (None, None)
        bad = verdict == "block" if rule else any(t in url.lower() for t in TERMS)
        parsed.append((i, host, path, rule, verdict, bad))
    hosts = {}
    for _, host, _, _, _, bad in parsed:
        n, k = hosts.get(host, (0, 0))
        hosts[host] = (n + 1, k + bad)

    def names(host):
        site = re.sub(r":[0-9]*$", "", re.sub(r"^.*@", "", host))
        if re.fullmatch(r"[0-9.]*", site):
            return site, ""
        labels = site.split(".")
        wide = ".".join(labels[-2:]) in url_filter.DOUBLE_SUFFIXES
        return ".".join(labels[-3:] if wide else labels[-2:]), ".".join(labels[-2:] if wide else labels[-1:])

    def group(units, key):
        out = {}
        for name, (n, k) in units.items():
            a, b = out.get(key(name), (0, 0))
            out[key(name)] = (a + n, b + k)
        return out

    def strength(units, above):
        top = sum((k / n - above[u]) ** 2 - above[u] * (1 - above[u]) / n for u, (n, k) in units.items())
        scale = sum((n - 1) / n * above[u] * (1 - above[u]) for u, (n, k) in units.items())
        return 1 / min(max(top / scale if scale else 0.1, SPREAD[0]), SPREAD[1]) - 1

    def rest(children, parents, over, key):
        m = strength(parents, over)
        return {c: (parents[key(c)][1] - k + m * over[key(c)]) / (parents[key(c)][0] - n + m) for c, (n, k) in children.items()}

    domains = group(hosts, names)
    suffixes = group(domains, lambda d: d[1])
    n, k = (sum(v[x] for v in suffixes.values()) for x in (0, 1))
    root = (k + 0.5) / (n + 1)
    of_suffix = {s: root for s in suffixes}
    of_domain = rest(domains, suffixes, of_suffix, lambda d: d[1])
    of_host = rest(hosts, domains, of_domain, names)
    m = strength(hosts, of_host)
    out = []
    for i, host, path, rule, verdict, _ in parsed:
        n, k = hosts[host]
        mean = (k + m * of_host[host]) / (n + m)
        bound = mean - DEVIATIONS * math.sqrt(mean * (1 - mean) / (n + m + 1))
        out.append((i, host, path, rule, verdict or ("block" if bound > CUTOFF else "allow"), *hosts[host], round(mean, 9), round(bound, 9)))
    return sorted(out, key=str)


def rounded(df):
    return sorted((tuple(r)[:7] + (round(r.reputation, 9), round(r.bound, 9)) for r in df.collect()), key=str)


def test_odd_urls_match_brute_force(spark):
    df = spark.createDataFrame(ODD, "page_id long, url string").withColumns({c: F.lit(1) for c in ("host", "path", "n", "bad", "rule", "low", "mean")})
    assert rounded(filter_urls(df)) == brute(ODD)


def test_pages_match_brute_force_and_sql(spark):
    pages = spark.read.parquet(f"{SF_DIR}/pages.parquet")
    rows = [(r.page_id, r.url) for r in pages.select("page_id", "url").collect()]
    assert rounded(filter_urls(pages)) == brute(rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{SF_DIR}/pages.parquet')")
    got = con.execute(queries.ORACLES["op13_host_reputation_filter"]).fetchall()
    want = [tuple(r) for r in queries.QUERIES["op13_host_reputation_filter"](spark, SF_DIR).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_hosts_of_flagged_pages_are_blocked_and_others_left_alone(spark):
    rows = filter_urls(spark.read.parquet("/root/testdata/sf0.1/pages.parquet")).where("rule is null").collect()
    flagged = [r for r in rows if any(t in r.host for t in TERMS)]
    assert len(flagged) >= 10 and all(r.verdict == "block" for r in flagged if r.host_pages > 3)
    assert all(r.verdict == "allow" for r in rows if not any(t in r.host for t in TERMS))


def test_one_bad_page_says_less_than_many(spark):
    rows = [("one.a.org", True)] + [("many.b.org", True)] * 50 + [(f"h{k}.c.org", j == 0 and k % 2 == 0) for k in range(100) for j in range(5)]
    got = {r.host: r for r in host_reputation(spark.createDataFrame(rows, "host string, bad boolean")).collect()}
    assert got["one.a.org"].reputation < got["many.b.org"].reputation
    assert got["one.a.org"].reputation - DEVIATIONS * got["one.a.org"].deviation < CUTOFF < got["many.b.org"].reputation - DEVIATIONS * got["many.b.org"].deviation
    # a new host of a bad domain inherits its reputation
    rows += [("new.b.org", None)]
    more = {r.host: r for r in host_reputation(spark.createDataFrame(rows, "host string, bad boolean")).collect()}
    assert more["new.b.org"].n == 0 and more["new.b.org"].reputation > 0.5 > more["h1.c.org"].reputation


def test_given_outcomes_replace_the_screen(spark):
    pages = spark.createDataFrame([(k, f"http://h{k % 2}.org/{k}") for k in range(40)], "page_id long, url string")
    given = spark.createDataFrame([(k, k % 2) for k in range(20)] + [(1, 0), (None, 1)], "page_id long, bad int")
    got = {r.page_id: r.verdict for r in filter_urls(pages, outcomes=given).collect()}
    assert got == {k: "block" if k % 2 else "allow" for k in range(40)}


@pytest.mark.parametrize("bound", [1_000_000, 0])
def test_of_nothing_and_by_shuffle(spark, bound, monkeypatch):
    assert filter_urls(spark.createDataFrame([], "page_id long, url string")).collect() == []
    plain = url_filter.only
    monkeypatch.setattr(url_filter, "only", lambda *a, **k: plain(*a, **k, bound=bound))
    assert rounded(filter_urls(spark.createDataFrame(ODD, "page_id long, url string"))) == brute(ODD)
