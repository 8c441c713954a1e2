"""URL filter: fixed rules first, then the empirical-Bayes reputation of the host.

A page's outcome is bad when a rule blocks it, or when no rule judges it and
its url holds a screened term; other outcomes can be given instead.  Outcomes
are counted per host and shrunk along host, registered domain and suffix: each
level has a beta prior around the posterior mean of the level above without the
unit itself, so no page counts twice; the prior's strength is fitted to how
widely the rates of that level spread in the corpus (moments of the
beta-binomial).  A host is blocked when the lower bound of its
posterior rate exceeds `CUTOFF`; one bad page says little, a known bad host a lot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import only, store

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Fixed values: (verdict, host, path).
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
#: Screened terms of the default outcomes; a parameter.
TERMS = ("adult", "ads-", "bets", "casino", "pills", "porn", "spam", "viagra")
#: Suffixes of two labels under which names are registered; a parameter.
DOUBLE_SUFFIXES = ("ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "org.uk")
CUTOFF = 0.4
DEVIATIONS = 1.2816  # of the posterior below its mean
SPREAD = (0.001, 0.999)  # limits of the fitted correlation of outcomes within a unit


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path of a url; both empty without `://`."""
    text = F.coalesce(url.cast("string"), F.lit(""))
    return F.translate(F.regexp_extract(text, PARTS, 1), UPPER, LOWER), F.regexp_extract(text, PARTS, 2)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits; null where none does."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))

    def pick(value):
        fits = [((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p)) for _, h, p in ordered]
        return F.coalesce(*(F.when(fit, F.lit(value(r))) for fit, r in zip(fits, ordered, strict=True)), F.lit(None).cast("string"))

    return pick(lambda r: r[1] + r[2]), pick(lambda r: r[0])


def registered(host: Column, double: tuple[str, ...]) -> tuple[Column, Column]:
    """Registered domain and suffix of a host without user and port; an address of digits is its own domain without suffix."""
    site = F.regexp_replace(host, r"^.*@|:[0-9]*$", "")
    labels = F.when(F.substring_index(site, ".", -2).isin(*double), 2).otherwise(1)
    digits = site.rlike(r"^[0-9.]*$")
    two, three = F.substring_index(site, ".", -2), F.substring_index(site, ".", -3)
    return F.when(digits, site).when(labels == 2, three).otherwise(two), F.when(digits, F.lit("")).when(labels == 2, two).otherwise(F.substring_index(site, ".", -1))


def concentration(units: DataFrame, limits: tuple[float, float] = SPREAD) -> float:
    """Strength of the beta prior of units (n, bad, mean above), by the moments of the beta-binomial.

    Every unit's rate counts alike, so a giant host does not speak for the small ones.
    """
    spread = F.col("above") * (1 - F.col("above"))
    beyond = F.pow(F.col("bad") / F.col("n") - F.col("above"), F.lit(2.0)) - spread / F.col("n")
    row = units.where("n > 0").agg(F.sum(beyond).alias("excess"), F.sum(spread * (F.col("n") - 1) / F.col("n")).alias("scale")).first()
    rho = row.excess / row.scale if row.scale else 0.1
    return 1 / min(max(rho, limits[0]), limits[1]) - 1


def host_reputation(outcomes: DataFrame, double: tuple[str, ...] = DOUBLE_SUFFIXES) -> DataFrame:
    """(host, n, bad, domain, suffix, reputation, deviation) from outcomes (host, bad boolean); a null outcome does not count.

    `reputation` is the posterior mean of the host's bad rate, `deviation` its
    standard deviation.  Counts are added up before the shuffle, so a host with
    most of the pages costs one row per task.
    """
    domain, suffix = registered(F.col("host"), double)
    one = F.count("bad").alias("n"), F.count_if("bad").alias("bad")
    hosts = store(outcomes.groupBy("host").agg(*one).withColumn("domain", domain).withColumn("suffix", suffix), "op13-hosts")
    sums = F.sum("n").alias("n"), F.sum("bad").alias("bad")
    domains = store(hosts.groupBy("domain", "suffix").agg(*sums), "op13-domains")
    suffixes = store(domains.groupBy("suffix").agg(*sums), "op13-suffixes")
    total = suffixes.agg(*sums).first()
    root = ((total.bad or 0) + 0.5) / ((total.n or 0) + 1.0)

    def rest(child: DataFrame, parent: DataFrame, m: float, keys: list[str]) -> DataFrame:
        """The parent's posterior mean without the child, as the mean above the child."""
        wide = child.join(parent.select(*keys, F.col("n").alias("n_all"), F.col("bad").alias("bad_all"), F.col("above").alias("over")), keys)
        return wide.withColumn("above", (F.col("bad_all") - F.col("bad") + m * F.col("over")) / (F.col("n_all") - F.col("n") + m)).drop("n_all", "bad_all", "over")

    of_suffix = store(suffixes.withColumn("above", F.lit(root)), "op13-above")
    of_domain = store(rest(domains, of_suffix, concentration(of_suffix), ["suffix"]), "op13-above")
    of_host = store(rest(hosts, of_domain, concentration(of_domain), ["domain", "suffix"]), "op13-above")
    m = concentration(of_host)
    judged = of_host.withColumn("m", F.lit(m)).withColumn("mean", (F.col("bad") + m * F.col("above")) / (F.col("n") + m))
    deviation = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + F.col("m") + 1))
    return judged.select("host", "n", "bad", "domain", "suffix", F.col("mean").alias("reputation"), deviation.alias("deviation"))


def filter_urls(pages: DataFrame, outcomes: DataFrame | None = None, rules: list[tuple[str, str, str]] = RULES, terms: tuple[str, ...] = TERMS) -> DataFrame:
    """(page_id, host, path, rule, verdict, host_pages, host_bad, reputation, bound) of every row of `pages` (page_id, url).

    Null urls and urls without `://` have an empty host and path; they share
    the reputation of the empty host.  A row given twice counts twice and is
    returned twice.  Rows without a page_id count too.  An empty table gives an
    empty result, other columns are ignored.  `outcomes` (page_id, bad) replaces
    the default outcomes; pages it does not name are then without outcome, and a
    page it names twice is bad if either says so.
    """
    host, path = url_parts(F.col("url"))
    rows = pages.select("page_id", "url").select("page_id", F.lower(F.coalesce(F.col("url").cast("string"), F.lit(""))).alias("low"), host.alias("host"), path.alias("path"))
    rule, ruled = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("ruled", ruled)
    if outcomes is None:
        screened = F.lit(False)
        for term in terms:
            screened = screened | F.contains("low", F.lit(term))
        labelled = rows.select("host", F.when(F.col("ruled").isNotNull(), F.col("ruled") == "block").otherwise(screened).alias("bad"))
    else:
        given = outcomes.where("page_id is not null").groupBy("page_id").agg(F.bool_or(F.col("bad").cast("boolean")).alias("bad"))
        labelled = rows.join(given, "page_id", "left").select("host", "bad")
    known = host_reputation(labelled).withColumn("bound", F.col("reputation") - DEVIATIONS * F.col("deviation"))
    known = store(known.select("host", F.col("n").alias("host_pages"), F.col("bad").alias("host_bad"), "reputation", "bound"), "op13-known")
    judged = only(rows.drop("low"), known, "host", "left")
    verdict = F.coalesce("ruled", F.when(F.col("bound") > CUTOFF, "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "host_pages", "host_bad", "reputation", "bound")


def oracle_sql() -> str:
    """The query over `pages` in DuckDB SQL, without the columns of floating point."""
    ordered = sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))

    def case(value):
        return "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{value((v, h, p))}'" for v, h, p in ordered) + " END"

    def strength(units):
        rho = "coalesce(sum(power(bad / n - above, 2) - above * (1 - above) / n) / nullif(sum(above * (1 - above) * (n - 1) / n), 0), 0.1)"
        return f"{units}_m AS (SELECT 1 / least(greatest({rho}, {SPREAD[0]}), {SPREAD[1]}) - 1 AS m FROM {units} WHERE n > 0)"

    def rest(child, parent, keys):
        return f"SELECT c.*, (p.bad - c.bad + m * p.above) / (p.n - c.n + m) AS above FROM {child} c JOIN {parent} p USING ({keys}), {parent}_m"

    screened = " OR ".join(f"contains(lower(coalesce(url, '')), '{t}')" for t in TERMS)
    double = ", ".join(f"'{s}'" for s in DOUBLE_SUFFIXES)
    return f"""
WITH cut AS (
  SELECT page_id, url, translate(regexp_extract(coalesce(url, ''), '{PARTS}', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(coalesce(url, ''), '{PARTS}', 2) AS path FROM pages),
ruled AS (SELECT *, {case(lambda r: r[1] + r[2])} AS rule, {case(lambda r: r[0])} AS said FROM cut),
counted AS (
  SELECT host, count(*) AS n, count(*) FILTER (WHERE CASE WHEN said IS NOT NULL THEN said = 'block' ELSE {screened} END) AS bad,
    regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS site FROM ruled GROUP BY host),
labels AS (SELECT *, string_split(site, '.') AS l FROM counted),
tails AS (SELECT *, array_to_string(l[-2:], '.') AS two, array_to_string(l[-3:], '.') AS three FROM labels),
hosts AS (
  SELECT host, n, bad, CASE WHEN regexp_matches(site, '^[0-9.]*$') THEN site WHEN two IN ({double}) THEN three ELSE two END AS domain,
    CASE WHEN regexp_matches(site, '^[0-9.]*$') THEN '' WHEN two IN ({double}) THEN two ELSE l[-1] END AS suffix FROM tails),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY ALL),
total AS (SELECT (coalesce(sum(bad), 0) + 0.5) / (coalesce(sum(n), 0) + 1.0) AS above FROM suffixes),
of_suffix AS (SELECT * FROM suffixes, total),
{strength("of_suffix")},
of_domain AS ({rest("domains", "of_suffix", "suffix")}),
{strength("of_domain")},
of_host AS ({rest("hosts", "of_domain", "domain, suffix")}),
{strength("of_host")},
known AS (SELECT host, n, bad, m, (bad + m * above) / (n + m) AS mean FROM of_host, of_host_m)
SELECT page_id, ruled.host, path, rule,
  coalesce(said, CASE WHEN mean - {DEVIATIONS} * sqrt(mean * (1 - mean) / (n + m + 1)) > {CUTOFF} THEN 'block' ELSE 'allow' END) AS verdict,
  n AS host_pages, bad::BIGINT AS host_bad
FROM ruled JOIN known ON ruled.host = known.host
"""
