"""Bootstraps, multiple testing and clustering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import performance as pf
from ..functions.normal import norm_cdf
from ..functions.numeric import r as rd
from ..operators import clusters as cl
from ..operators import inference as inf
from ..operators import pairs, paths
from ..operators import resample as rs
from ..plans import walkforward as wf
from ..sources.panels import Tables
from .metrics import brand_returns, seg_returns, big_oos
from .registry import cte, query, r, sql
from .signals import summary_sql
from .walk import POOL, SETUP, Walk

REPS, BLOCK, P = 1000, 20, 2147483647


def mix_sql(seed: str, rep: str, pos: str) -> str:
    x = f"((({seed})::BIGINT * 48271 + ({rep})::BIGINT * 7919 + ({pos})::BIGINT * 104729 + 1) % {P})"
    for c in (16807, 69621, 48271):
        x = f"(({x} * {x} + {x} * {c} + {12345 + c}) % {P})"
    return x


def u_sql(seed: int, rep: str, pos: str) -> str:
    return f"({mix_sql(str(seed), rep, pos)} / {float(P)!r}::DOUBLE)"


cte("sizes", "SELECT symbol, count(*) AS n FROM segrets GROUP BY 1", "segrets")


def idx_sql(scheme: str, sizes: str = "sizes", key: str = "symbol", reps: int = REPS, emit: str = "n", seed: int = 0) -> str:
    slots = f"(SELECT {key}, n, rep, unnest(range(0, {emit})) AS pos FROM {sizes}, range(0, {reps}) g(rep))"
    if scheme == "stationary":
        return f"""SELECT {key}, rep, pos, (s + pos - p + n) % n AS idx FROM (SELECT *, last_value(b.s IGNORE NULLS) OVER w AS s, last_value(b.p IGNORE NULLS) OVER w AS p FROM (
            SELECT *, CASE WHEN pos = 0 OR {u_sql(11 + seed, 'rep', 'pos')} < {1.0 / BLOCK!r}::DOUBLE THEN {{'s': floor({u_sql(23 + seed, 'rep', 'pos')} * n)::BIGINT, 'p': pos}} END AS b FROM {slots})
            WINDOW w AS (PARTITION BY {key}, rep ORDER BY pos ROWS UNBOUNDED PRECEDING))"""
    if scheme == "circular":
        return f"SELECT {key}, rep, pos, (floor({u_sql(24, 'rep', f'pos // {BLOCK}')} * n)::BIGINT + pos % {BLOCK}) % n AS idx FROM {slots}"
    return f"SELECT {key}, rep, pos, least(floor({u_sql(25, 'rep', f'pos // {BLOCK}')} * greatest(1, n - {BLOCK} + 1))::BIGINT + pos % {BLOCK}, n - 1) AS idx FROM {slots}"


for _scheme in ("stationary", "circular", "moving"):
    cte(f"ix_{_scheme}", idx_sql(_scheme), "sizes")
cte("numbered", "SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY day) - 1 AS i, ret FROM segrets", "segrets")
IDX_STATS = "count(*) AS n, sum(idx) AS sum_idx, min(idx) AS min_idx, max(idx) AS max_idx, sum(idx * (pos % 97)) AS weighted"


def index_of(scheme: str, sizes: DataFrame, reps: int = REPS) -> DataFrame:
    return {"stationary": rs.stationary, "circular": rs.circular, "moving": rs.moving}[scheme](sizes, ["symbol"], reps, BLOCK)


def seg_sizes(t: Tables) -> DataFrame:
    return rs.lengths(seg_returns(t), ["symbol"])


def index_query(op: str, scheme: str) -> None:
    @query(op, sql(f"SELECT symbol, rep, {IDX_STATS} FROM ix_{scheme} GROUP BY 1, 2", f"ix_{scheme}"))
    def _(t: Tables) -> DataFrame:
        return index_of(scheme, seg_sizes(t)).groupBy("symbol", "rep").agg(
            F.count(F.lit(1)).alias("n"), F.sum("idx").alias("sum_idx"), F.min("idx").alias("min_idx"), F.max("idx").alias("max_idx"),
            F.sum(F.col("idx") * (F.col("pos") % 97)).alias("weighted"),
        )


index_query("bs_stationary_idx", "stationary")
index_query("bs_circular_idx", "circular")
index_query("bs_moving_idx", "moving")


def q_sql(metric: str, p: float) -> str:
    return f"list_sort(list({metric}))[least(count(*) - 1, greatest(0, floor({p!r}::DOUBLE * count(*))))::BIGINT + 1]"


def boot_sql(scheme: str) -> str:
    label = f"bm_{scheme}"
    src = f"(SELECT x.symbol, x.rep, x.pos, n.ret FROM ix_{scheme} x JOIN numbered n ON x.symbol = n.symbol AND x.idx = n.i)"
    cte(label, summary_sql(src, "symbol, rep", 365, 0.0, "count(ret)", "pos", ", avg((equity < peak)::INT) AS tuw"), f"ix_{scheme}", "numbered")
    return label


for _scheme in ("stationary", "circular", "moving"):
    boot_sql(_scheme)

BANDS = {
    "cagr_low": ("cagr", 0.05), "cagr_high": ("cagr", 0.95), "sharpe_low": ("sharpe", 0.05), "sharpe_high": ("sharpe", 0.95),
    "mdd_median": ("max_drawdown", 0.5), "mdd_p95": ("max_drawdown", 0.05), "mdd_worst": ("max_drawdown", 0.0),
}
EXPANDED = {**{k: BANDS[k] for k in ("cagr_low", "cagr_high", "sharpe_low", "sharpe_high")}, "mdd_low": ("max_drawdown", 0.05), "mdd_high": ("max_drawdown", 0.95), "tuw_median": ("tuw", 0.5), "tuw_p95": ("tuw", 0.95)}


def bands_sql(wanted: dict) -> str:
    return ", ".join(r(q_sql(m, p), name) for name, (m, p) in wanted.items())


DRAWS = {"stationary": paths.stationary_draws, "circular": paths.circular_draws, "moving": paths.moving_draws}


def boot_metrics(t: Tables, scheme: str, returns: DataFrame | None = None) -> DataFrame:
    draws = DRAWS[scheme]
    return paths.replicate(seg_returns(t) if returns is None else returns, ["symbol"], REPS, lambda n, reps: draws(n, reps, BLOCK))


@query("bs_metrics", sql(f"SELECT symbol, {bands_sql(BANDS)} FROM bm_stationary GROUP BY 1", "bm_stationary"))
def _(t: Tables) -> DataFrame:
    out = rs.bands(boot_metrics(t, "stationary"), ["symbol"], BANDS)
    return out.select("symbol", *[rd(c).alias(c) for c in BANDS])


@query(
    "bs_expanded",
    sql(" UNION ALL ".join(f"SELECT '{s}' AS scheme, symbol, {bands_sql(EXPANDED)} FROM bm_{s} GROUP BY 2" for s in ("stationary", "circular", "moving")), "bm_stationary", "bm_circular", "bm_moving"),
)
def _(t: Tables) -> DataFrame:
    returns = t.keep("segment-returns", lambda: seg_returns(t))
    every = [boot_metrics(t, scheme, returns).withColumn("scheme", F.lit(scheme)) for scheme in DRAWS]
    out = rs.bands(every[0].unionByName(every[1]).unionByName(every[2]), ["scheme", "symbol"], EXPANDED)
    return out.select("scheme", "symbol", *[rd(c).alias(c) for c in EXPANDED])


DD = {"mdd_low": ("max_drawdown", 0.05), "mdd_high": ("max_drawdown", 0.95), "mdd_median": ("max_drawdown", 0.5), "mdd_worst": ("max_drawdown", 0.0), "tuw_median": ("tuw", 0.5), "tuw_p95": ("tuw", 0.95)}
cte("seg_actual", summary_sql("segrets", "symbol"), "segrets")


@query("bs_drawdown_ci", sql(f"SELECT b.symbol, {r('any_value(a.max_drawdown)', 'actual_mdd')}, {bands_sql({k: ('b.' + m, p) for k, (m, p) in DD.items()})} FROM bm_stationary b JOIN seg_actual a USING (symbol) GROUP BY 1", "bm_stationary", "seg_actual"))
def _(t: Tables) -> DataFrame:
    actual = pf.summary(seg_returns(t), ["symbol"]).select("symbol", rd("max_drawdown").alias("actual_mdd"))
    out = rs.bands(boot_metrics(t, "stationary"), ["symbol"], DD).join(actual, "symbol")
    return out.select("symbol", "actual_mdd", *[rd(c).alias(c) for c in DD])


def cdf_sql(z: str) -> str:
    return (
        f"(CASE WHEN ({z}) < -8 THEN 0.0::DOUBLE WHEN ({z}) > 8 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE + exp(-({z}) * ({z}) / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 160), lambda k: sign({z}) * exp((2 * k + 1) * ln(greatest(abs({z}), 1e-300)) "
        f"- ((k + 1) * ln(2.0::DOUBLE) + lgamma(k + 1.5::DOUBLE) - 0.5::DOUBLE * ln(pi()))))) END)"
    )


# ---- paired: every segment against BUILDING on shared days

cte("paired", "SELECT a.symbol, a.day, a.ret AS s, b.ret AS b, row_number() OVER (PARTITION BY a.symbol ORDER BY a.day) - 1 AS i, count(*) OVER (PARTITION BY a.symbol) AS n FROM segrets a JOIN segrets b ON a.day = b.day AND b.symbol = 'BUILDING' WHERE a.symbol <> 'BUILDING'", "segrets")
cte("paired_sizes", "SELECT symbol, max(n) AS n FROM paired GROUP BY 1", "paired")
cte("paired_ix", idx_sql("stationary", "paired_sizes"), "paired_sizes")
PAIR_M = "SELECT symbol, rep, {a} FROM (SELECT x.symbol, x.rep, p.s, p.b FROM paired_ix x JOIN paired p ON x.symbol = p.symbol AND x.idx = p.i) GROUP BY 1, 2"
SH = "CASE WHEN stddev_samp({c}) = 0 THEN 0 ELSE avg({c}) / stddev_samp({c}) * sqrt(365.0::DOUBLE) END"
GAPS = f"{SH.format(c='s')} - ({SH.format(c='b')}) AS d_sharpe, pow(product(1 + s), 365.0::DOUBLE / count(*)) - pow(product(1 + b), 365.0::DOUBLE / count(*)) AS d_cagr"
cte("pair_gaps", PAIR_M.format(a=GAPS), "paired_ix", "paired")
cte("pair_obs", f"SELECT symbol, {GAPS} FROM paired GROUP BY 1", "paired")


def paired_gaps(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Sharpe and CAGR gap of two aligned columns s and b."""
    def sharpe(c: str):
        return pf.sharpe(F.avg(c), F.stddev_samp(c), F.count(c))

    def grown(c: str):
        return pf.cagr(F.product(F.col(c) + 1.0), F.count(c).cast("double"))

    return rows.groupBy(*keys).agg((sharpe("s") - sharpe("b")).alias("d_sharpe"), (grown("s") - grown("b")).alias("d_cagr"))


@query(
    "bs_paired_diff",
    sql(
        f"""SELECT *, {r(cdf_sql('neg_z'), 'analytic_p')} FROM (SELECT g.symbol, {r('avg((g.d_cagr < 0)::INT)', 'p_worse_cagr')}, {r('avg((g.d_sharpe < 0)::INT)', 'p_worse_sharpe')}, {r('any_value(o.d_sharpe)', 'gap_sharpe')}, {r('any_value(o.d_cagr)', 'gap_cagr')},
              {r(q_sql('g.d_sharpe', 0.05), 'gap_low')}, {r(q_sql('g.d_sharpe', 0.95), 'gap_high')}, {r('-any_value(o.d_sharpe) / stddev_samp(g.d_sharpe)', 'neg_z')}
            FROM pair_gaps g JOIN pair_obs o USING (symbol) GROUP BY 1)""",
        "pair_gaps",
        "pair_obs",
    ),
)
def _(t: Tables) -> DataFrame:
    seg = seg_returns(t)
    bench = seg.where("symbol = 'BUILDING'").select("day", F.col("ret").alias("b"))
    both = seg.where("symbol <> 'BUILDING'").select("symbol", "day", F.col("ret").alias("s")).join(bench, "day")
    index = rs.stationary(rs.lengths(both, ["symbol"]), ["symbol"], REPS, BLOCK)
    src = rs.numbered(both, ["symbol"]).select("symbol", F.col("i").alias("idx"), "s", "b")
    gaps = paired_gaps(index.join(src, ["symbol", "idx"]), ["symbol", "rep"])
    obs = paired_gaps(both, ["symbol"]).select("symbol", F.col("d_sharpe").alias("o_sharpe"), F.col("d_cagr").alias("o_cagr"))
    probs = gaps.groupBy("symbol").agg(
        F.avg((F.col("d_cagr") < 0).cast("double")).alias("p_worse_cagr"), F.avg((F.col("d_sharpe") < 0).cast("double")).alias("p_worse_sharpe"), F.stddev_samp("d_sharpe").alias("sd")
    )
    band = rs.bands(gaps, ["symbol"], {"gap_low": ("d_sharpe", 0.05), "gap_high": ("d_sharpe", 0.95)})
    out = probs.join(obs, "symbol").join(band, "symbol")
    return out.select(
        "symbol", rd("p_worse_cagr").alias("p_worse_cagr"), rd("p_worse_sharpe").alias("p_worse_sharpe"), rd("o_sharpe").alias("gap_sharpe"), rd("o_cagr").alias("gap_cagr"),
        rd("gap_low").alias("gap_low"), rd("gap_high").alias("gap_high"), rd(-F.try_divide("o_sharpe", "sd")).alias("neg_z"),
    ).withColumn("analytic_p", rd(norm_cdf(F.col("neg_z"))))


HORIZON, PATHS = 252, 5000
cte("future_ix", idx_sql("stationary", emit=str(HORIZON), seed=5, reps=PATHS), "sizes")
cte("future_m", summary_sql("(SELECT x.symbol, x.rep, x.pos, n.ret FROM future_ix x JOIN numbered n ON x.symbol = n.symbol AND x.idx = n.i)", "symbol, rep", 365, 0.0, "count(ret)", "pos"), "future_ix", "numbered")
FUTURE = {"terminal_p05": ("final", 0.05), "terminal_median": ("final", 0.5), "terminal_p95": ("final", 0.95), "mdd_median": ("max_drawdown", 0.5), "mdd_p95": ("max_drawdown", 0.05), "mdd_worst": ("max_drawdown", 0.0)}


@query("bs_future_paths", sql(f"SELECT symbol, {r('avg((final < 1)::INT)', 'p_loss')}, {bands_sql(FUTURE)} FROM future_m GROUP BY 1", "future_m"))
def _(t: Tables) -> DataFrame:
    m = t.keep("future-paths", lambda: paths.replicate(seg_returns(t), ["symbol"], PATHS, lambda n, reps: paths.stationary_draws(n, reps, BLOCK, HORIZON, 5), emit=HORIZON))
    loss = m.groupBy("symbol").agg(rd(F.avg((F.col("final") < 1).cast("double"))).alias("p_loss"))
    return rs.bands(m, ["symbol"], FUTURE).join(loss, "symbol").select("symbol", "p_loss", *[rd(c).alias(c) for c in FUTURE])


cte("shuf_ix", f"SELECT symbol, rep, row_number() OVER (PARTITION BY symbol, rep ORDER BY {mix_sql('37', 'rep', 'pos')}, pos) - 1 AS pos, pos AS idx FROM (SELECT symbol, n, rep, unnest(range(0, n)) AS pos FROM sizes, range(0, {REPS}) g(rep))", "sizes")
cte("shuf_path", "SELECT x.symbol, x.rep, x.pos, n.ret FROM shuf_ix x JOIN numbered n ON x.symbol = n.symbol AND x.idx = n.i", "shuf_ix", "numbered")
cte("shuf_m", summary_sql("shuf_path", "symbol, rep", 365, 0.0, "count(ret)", "pos"), "shuf_path")


@query(
    "bs_shuffle",
    sql(
        f"""SELECT b.symbol, {r('any_value(a.max_drawdown)', 'actual_mdd')}, {r('avg((round(b.max_drawdown, 12) <= round(a.max_drawdown, 12))::INT)', 'dd_percentile')}, {r('list_sort(list(b.max_drawdown))[count(*) // 2 + 1]', 'mdd_median')}, {r('min(b.max_drawdown)', 'mdd_worst')}
            FROM shuf_m b JOIN seg_actual a USING (symbol) GROUP BY 1""",
        "shuf_m",
        "seg_actual",
    ),
)
def _(t: Tables) -> DataFrame:
    """Drawdowns of permuted streams; drawdowns equal to 12 digits are ties, as products of the same returns in another order differ in the last bits."""
    returns = seg_returns(t)
    m = paths.replicate(returns, ["symbol"], REPS, paths.shuffle_draws)
    actual = pf.summary(returns, ["symbol"]).select("symbol", F.col("max_drawdown").alias("actual_mdd"))
    agg = m.join(actual, "symbol").groupBy("symbol").agg(
        F.max("actual_mdd").alias("actual_mdd"), F.avg((F.round("max_drawdown", 12) <= F.round("actual_mdd", 12)).cast("double")).alias("dd_percentile"),
        F.sort_array(F.collect_list("max_drawdown")).alias("s"), F.min("max_drawdown").alias("mdd_worst"),
    )
    mid = F.element_at("s", (F.floor(F.size("s") / 2) + 1).cast("int"))
    return agg.select("symbol", rd("actual_mdd").alias("actual_mdd"), rd("dd_percentile").alias("dd_percentile"), rd(mid).alias("mdd_median"), rd("mdd_worst").alias("mdd_worst"))


def hz_sql(source: str, part: str, order: str) -> str:
    w = f"(PARTITION BY {part} ORDER BY {order} ROWS BETWEEN CURRENT ROW AND {HORIZON - 1} FOLLOWING)"
    return f"SELECT {part}, product(1 + ret) OVER {w} - 1 AS h, count(*) OVER {w} AS c FROM {source}"


@query(
    "bs_sequence_risk",
    sql(
        f"""SELECT o.symbol, o.n AS n_windows, {r('o.p', 'observed_p_loss')}, {r('o.worst', 'observed_worst')}, {r('o.med', 'observed_median')}, {r('s.p', 'shuffle_p_loss')}, {r('o.p - s.p', 'gap')} FROM
            (SELECT symbol, count(*) AS n, avg((h < 0)::INT) AS p, min(h) AS worst, {q_sql('h', 0.5)} AS med FROM ({hz_sql('segrets', 'symbol', 'day')}) WHERE c = {HORIZON} GROUP BY 1) o
            JOIN (SELECT symbol, avg(p) AS p FROM (SELECT symbol, rep, avg((h < 0)::INT) AS p FROM ({hz_sql('shuf_path', 'symbol, rep', 'pos')}) WHERE c = {HORIZON} GROUP BY 1, 2) GROUP BY 1) s USING (symbol)""",
        "segrets",
        "shuf_path",
    ),
)
def _(t: Tables) -> DataFrame:
    returns = seg_returns(t)
    seen = returns.select("symbol", pf.horizon_return(HORIZON, ["symbol"]).alias("h")).where("h is not null")
    lost = F.avg((F.col("h") < 0).cast("double"))
    obs = seen.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_windows"), lost.alias("p"), F.min("h").alias("worst"))
    med = rs.bands(seen, ["symbol"], {"med": ("h", 0.5)})
    sh = paths.replicate(returns, ["symbol"], REPS, paths.shuffle_draws, paths.loss_shares(HORIZON), ["q"])
    sh = sh.where("q is not null").groupBy("symbol").agg(F.avg("q").alias("q"))
    out = obs.join(med, "symbol").join(sh, "symbol")
    return out.select(
        "symbol", "n_windows", rd("p").alias("observed_p_loss"), rd("worst").alias("observed_worst"), rd("med").alias("observed_median"), rd("q").alias("shuffle_p_loss"), rd(F.col("p") - F.col("q")).alias("gap")
    )


# ---- multiple testing over out-of-sample candidate streams (per symbol, aligned by construction)

RC_REPS = 200
cte("cand", "SELECT symbol, pool_idx, name, open_time AS day, ret FROM big_test", "big_test")
cte("cand_obs", "SELECT symbol, pool_idx, count(*) AS n, avg(ret) AS m, stddev_samp(ret) AS sd FROM cand GROUP BY 1, 2", "cand")
cte("cand_sizes", "SELECT symbol, max(n) AS n FROM cand_obs GROUP BY 1", "cand_obs")
cte("cand_ix", idx_sql("stationary", "cand_sizes", reps=RC_REPS), "cand_sizes")
cte(
    "cand_boot",
    """SELECT x.symbol, x.rep, c.pool_idx, avg(c.ret - o.m) AS bm, stddev_samp(c.ret - o.m) AS bsd, any_value(o.sd) AS sd0, any_value(o.n) AS n FROM cand_ix x
       JOIN (SELECT *, row_number() OVER (PARTITION BY symbol, pool_idx ORDER BY day) - 1 AS i FROM cand) c ON c.symbol = x.symbol AND c.i = x.idx
       JOIN cand_obs o ON o.symbol = c.symbol AND o.pool_idx = c.pool_idx GROUP BY 1, 2, 3""",
    "cand_ix",
    "cand",
    "cand_obs",
)


def rc_sql(obs: str, boot: str, where: str = "true") -> str:
    return f"""SELECT symbol, any_value(k) AS n_candidates, {r('any_value(best)', 'best')}, {r('(count(*) FILTER (top >= best) + 1) / (count(*) + 1)::DOUBLE', 'p_value')} FROM
      (SELECT symbol, rep, max({boot}) AS top FROM cand_boot WHERE {where.replace('sd', 'sd0')} GROUP BY 1, 2) JOIN (SELECT symbol, count(*) AS k, max({obs}) AS best FROM cand_obs WHERE {where} GROUP BY 1) USING (symbol) GROUP BY 1"""


def candidate_streams(t: Tables) -> DataFrame:
    w = Walk(t, POOL)
    return t.keep("candidates", lambda: wf.fixed_streams(w.features, POOL, w.bounds, SETUP).select("symbol", "pool_idx", "day", "ret"))


def rc_rows(out: DataFrame) -> DataFrame:
    return out.select("symbol", F.col("n_series").alias("n_candidates"), rd("best").alias("best"), rd("p_value").alias("p_value"))


@query("mt_reality_check", sql(rc_sql("CASE WHEN sd < 1e-12 THEN 0 ELSE m / sd * sqrt(365.0::DOUBLE) END", "CASE WHEN bsd < 1e-12 THEN 0 ELSE bm / bsd * sqrt(365.0::DOUBLE) END"), "cand_boot", "cand_obs"))
def _(t: Tables) -> DataFrame:
    return rc_rows(inf.reality_check(candidate_streams(t), ["symbol"], "pool_idx", RC_REPS, BLOCK))


@query("mt_spa", sql(rc_sql("sqrt(n::DOUBLE) * m / sd", "sqrt(n::DOUBLE) * bm / sd0", "sd > 0"), "cand_boot", "cand_obs"))
def _(t: Tables) -> DataFrame:
    return rc_rows(inf.reality_check(candidate_streams(t), ["symbol"], "pool_idx", RC_REPS, BLOCK, studentised=True))


@query("bs_pvalue", sql(f"SELECT symbol, best, p_value, round(p_value * {RC_REPS + 1}) - 1 AS exceed FROM (" + rc_sql("CASE WHEN sd < 1e-12 THEN 0 ELSE m / sd * sqrt(365.0::DOUBLE) END", "CASE WHEN bsd < 1e-12 THEN 0 ELSE bm / bsd * sqrt(365.0::DOUBLE) END") + ")", "cand_boot", "cand_obs"))
def _(t: Tables) -> DataFrame:
    out = inf.reality_check(candidate_streams(t), ["symbol"], "pool_idx", RC_REPS, BLOCK)
    return out.select("symbol", rd("best").alias("best"), rd(rs.finite_p(F.col("exceed"), RC_REPS)).alias("p_value"), F.col("exceed").cast("double").alias("exceed"))


# Normal distribution in SQL: the series phi(z) * sum z^(2k+1)/(2k+1)!! and Wichura's AS241 rational approximation (published coefficients).
AS241 = {
    "a": [3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3],
    "b": [1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3],
    "c": [1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4],
    "d": [1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9],
}


def _poly(coef: list[float], x: str) -> str:
    text = f"{coef[-1]!r}::DOUBLE"
    for c in reversed(coef[:-1]):
        text = f"({text} * ({x}) + {c!r}::DOUBLE)"
    return text


def ppf_sql(p: str) -> str:
    q, rr = f"(({p}) - 0.5::DOUBLE)", f"(sqrt(-ln(least({p}, 1 - ({p})))) - 1.6::DOUBLE)"
    mid = f"(0.180625::DOUBLE - {q} * {q})"
    return f"CASE WHEN abs({q}) <= 0.425 THEN {q} * {_poly(AS241['a'], mid)} / {_poly(AS241['b'], mid)} ELSE sign({q}) * {_poly(AS241['c'], rr)} / {_poly(AS241['d'], rr)} END"


ZEXPR = "CASE WHEN n >= 4 AND 1 - skew * sp + (kurt - 1) / 4 * sp * sp > 0 THEN (sp - {b}) * sqrt(n - 1) / sqrt(1 - skew * sp + (kurt - 1) / 4 * sp * sp) END"
cte("psr_in", "SELECT symbol, n, CASE WHEN vs < 1e-24 THEN 0.0::DOUBLE ELSE m / sqrt(vs) END AS sp, CASE WHEN v < 1e-24 THEN 0.0::DOUBLE ELSE m3 / pow(v, 1.5) END AS skew, CASE WHEN v < 1e-24 THEN 3.0::DOUBLE ELSE m4 / (v * v) END AS kurt FROM (SELECT symbol, count(*) AS n, avg(ret) AS m, var_samp(ret) AS vs, var_pop(ret) AS v, avg(pow(ret - mu, 3)) AS m3, avg(pow(ret - mu, 4)) AS m4 FROM (SELECT *, avg(ret) OVER (PARTITION BY symbol) AS mu FROM big_oos) GROUP BY 1)", "big_oos")
cte("psr_z", f"SELECT *, {ZEXPR.format(b='0.0')} AS z FROM psr_in", "psr_in")


@query("mt_psr", sql(f"SELECT symbol, n, {r('z', 'z', 5)}, {r(f'coalesce({cdf_sql('z')}, 0.5)', 'psr')} FROM psr_z", "psr_z"))
def _(t: Tables) -> DataFrame:
    return inf.psr(big_oos(t), ["symbol"]).select("symbol", "n", rd("z", 5).alias("z"), rd("psr").alias("psr"))


cte("trials", "SELECT symbol, count(*) AS k, var_samp(sharpe) AS v FROM big_score GROUP BY 1", "big_score")
EMAX = f"CASE WHEN k >= 2 AND v > 0 THEN sqrt(v) * ((1 - 0.5772156649015329::DOUBLE) * ({ppf_sql('1 - 1.0::DOUBLE / k')}) + 0.5772156649015329::DOUBLE * ({ppf_sql('1 - 1.0::DOUBLE / (k * 2.718281828459045::DOUBLE)')})) ELSE 0.0 END"
cte("emax", f"SELECT symbol, k, {EMAX} AS bench FROM trials", "trials")


def trial_sharpes(t: Tables) -> DataFrame:
    w = Walk(t, POOL)
    return wf.train_scores(w.features, POOL, w.bounds, SETUP).select("symbol", "sharpe")


@query("mt_expected_max", sql(f"SELECT symbol, k AS n_trials, {r('bench', 'benchmark_sharpe')} FROM emax", "emax"))
def _(t: Tables) -> DataFrame:
    return inf.expected_max_sharpe(trial_sharpes(t), ["symbol"]).select("symbol", "n_trials", rd("benchmark_sharpe").alias("benchmark_sharpe"))


cte("dsr_z", f"SELECT symbol, n, bench, {ZEXPR.format(b='bench / sqrt(365.0::DOUBLE)')} AS z FROM psr_in JOIN emax USING (symbol)", "psr_in", "emax")


@query("mt_dsr", sql(f"SELECT symbol, n, {r('bench', 'benchmark_sharpe')}, {r('z', 'z', 5)}, {r(f'coalesce({cdf_sql('z')}, 0.5)', 'dsr')} FROM dsr_z", "dsr_z"))
def _(t: Tables) -> DataFrame:
    out = inf.dsr(big_oos(t), trial_sharpes(t), ["symbol"])
    return out.select("symbol", "n", rd("benchmark_sharpe").alias("benchmark_sharpe"), rd("z", 5).alias("z"), rd("dsr").alias("dsr"))


E_NUM, GAMMA = "2.718281828459045::DOUBLE", "0.5772156649015329::DOUBLE"
cte(
    "sel_in",
    f"""SELECT p.*, right(symbol, 1) = '5' AS pre, greatest(coalesce(t.k, 0), {len(POOL)}) AS n_trials, coalesce(t.k, 0) AS n_sharpes, t.v FROM psr_z p
        LEFT JOIN (SELECT * FROM trials WHERE right(symbol, 1) <> '4') t USING (symbol)""",
    "psr_z",
    "trials",
)
cte(
    "sel_bench",
    f"""SELECT *, CASE WHEN n_sharpes >= 2 AND v > 0 AND n_trials >= 2 THEN sqrt(v) * ((1 - {GAMMA}) * ({ppf_sql('1 - 1.0::DOUBLE / n_trials')}) + {GAMMA} * ({ppf_sql(f'1 - 1.0::DOUBLE / (n_trials * {E_NUM})')})) ELSE 0.0 END AS bench,
          CASE WHEN pre THEN NULL WHEN n_trials <= 1 THEN 'no search history' WHEN n_sharpes < 2 THEN 'fewer than two trial Sharpes' END AS reason FROM sel_in""",
    "sel_in",
)
cte("sel_z", f"SELECT *, coalesce({cdf_sql('z')}, 0.5) AS psr, {ZEXPR.format(b='bench / sqrt(365.0::DOUBLE)')} AS bz FROM sel_bench", "sel_bench")


@query(
    "mt_selection_adjusted",
    sql(
        f"""SELECT symbol, CASE WHEN pre THEN 1 ELSE n_trials END AS n_trials, reason, {r('psr', 'psr')}, {r(f'CASE WHEN pre THEN psr WHEN reason IS NULL THEN coalesce({cdf_sql("bz")}, 0.5) END', 'dsr')},
              {r('CASE WHEN pre THEN 0.0 WHEN reason IS NULL THEN bench END', 'benchmark_sharpe')} FROM sel_z""",
        "sel_z",
    ),
)
def _(t: Tables) -> DataFrame:
    # ledger: the recorded trial Sharpes, absent for symbols ending in 4; symbols ending in 5 are pre-specified
    ledger = trial_sharpes(t).where(~F.col("symbol").endswith("4"))
    pool = brand_returns(t).select("symbol").distinct().select("symbol", F.lit(len(POOL)).alias("pool_size"), F.col("symbol").endswith("5").alias("prespecified"))
    out = inf.selection_adjusted(big_oos(t), ledger, pool, ["symbol"])
    return out.select("symbol", "n_trials", "reason", *[rd(c).alias(c) for c in ("psr", "dsr", "benchmark_sharpe")])


@query("mt_bayes_sharpe")
def _(t: Tables) -> DataFrame:
    out = inf.bayesian_sharpe(seg_returns(t), ["symbol"], 10_000)
    return out.select("symbol", "n", "draws", *[rd(c).alias(c) for c in ("posterior_mean", "ci_low", "ci_high", "median", "prob_above")])


# p-values of the candidates of each symbol (one-sided normal p of the mean), then Holm inside the symbol
cte("arm_p", f"SELECT symbol, pool_idx AS arm_id, round({cdf_sql('z')}, 9) AS p_value FROM (SELECT symbol, pool_idx, -m / sd * sqrt(n) AS z FROM cand_obs WHERE sd > 1e-12)", "cand_obs")


def candidate_p_values(t: Tables) -> DataFrame:
    obs = candidate_streams(t).groupBy("symbol", "pool_idx").agg(F.count(F.lit(1)).alias("n"), F.avg("ret").alias("m"), F.stddev_samp("ret").alias("sd")).where("sd > 1e-12")
    z = -F.col("m") / F.col("sd") * F.sqrt(F.col("n").cast("double"))
    return obs.withColumn("z", z).select("symbol", F.col("pool_idx").alias("arm_id"), F.round(norm_cdf(F.col("z")), 9).alias("p_value"))


@query(
    "mt_holm",
    sql(
        f"""SELECT symbol, arm_id, rank, {r('threshold', 'threshold')}, {r('p_value', 'p_value')}, min((p_value <= threshold)::INT) OVER (PARTITION BY symbol ORDER BY p_value, arm_id ROWS UNBOUNDED PRECEDING) = 1 AS rejected FROM (
              SELECT *, 0.2::DOUBLE / (m - rank) AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY p_value, arm_id) - 1 AS rank, count(*) OVER (PARTITION BY symbol) AS m FROM arm_p))""",
        "arm_p",
    ),
)
def _(t: Tables) -> DataFrame:
    out = inf.holm(candidate_p_values(t), ["symbol"], 0.2)
    return out.select("symbol", "arm_id", F.col("rank").cast("bigint").alias("rank"), rd("threshold").alias("threshold"), rd("p_value").alias("p_value"), "rejected")


# ---- clusters of candidate streams per symbol

TILES = 3  # hash tiles of the candidates: no task holds all series of a block

cte(
    "cand_pairs",
    "SELECT x.symbol, x.name AS a, y.name AS b, count(*) AS n, coalesce(CASE WHEN isfinite(corr(x.ret, y.ret)) THEN corr(x.ret, y.ret) END, 0.0) AS rho FROM cand x JOIN cand y ON x.symbol = y.symbol AND x.day = y.day AND x.name < y.name GROUP BY 1, 2, 3",
    "cand",
)


def named_streams(t: Tables) -> DataFrame:
    w = Walk(t, POOL)
    return t.keep("named", lambda: wf.fixed_streams(w.features, POOL, w.bounds, SETUP).select("symbol", w.name().alias("series_id"), "day", "ret"))


def candidate_pairs(t: Tables) -> DataFrame:
    return pairs.pairwise_corr(named_streams(t), TILES, ("symbol",))


@query("cl_pairwise_corr", sql(f"SELECT symbol, a, b, n, {r('rho', 'rho')} FROM cand_pairs", "cand_pairs"))
def _(t: Tables) -> DataFrame:
    return candidate_pairs(t).select("symbol", "a", "b", "n", rd("rho").alias("rho"))


@query("cl_near_duplicates", sql(f"SELECT symbol, a, b, {r('rho', 'rho')} FROM cand_pairs WHERE abs(rho) >= 0.995", "cand_pairs"))
def _(t: Tables) -> DataFrame:
    return cl.near_duplicates(candidate_pairs(t)).select("symbol", "a", "b", rd("rho").alias("rho"))


cte("reach", "SELECT symbol, name AS node, name AS other FROM (SELECT DISTINCT symbol, name FROM cand) UNION SELECT r.symbol, r.node, e.b FROM reach r JOIN (SELECT symbol, a, b FROM cand_pairs WHERE abs(rho) >= 0.9 UNION ALL SELECT symbol, b, a FROM cand_pairs WHERE abs(rho) >= 0.9) e ON e.symbol = r.symbol AND e.a = r.other", "cand", "cand_pairs")
cte("clusters", "SELECT symbol, node, min(other) AS cluster FROM reach GROUP BY 1, 2", "reach")


def clusters_of(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    streams = named_streams(t)
    found = t.keep("pairs", lambda: pairs.pairwise_corr(streams, TILES, ("symbol",)))
    nodes = streams.select("symbol", F.col("series_id").alias("node")).distinct()
    return nodes, found, cl.single_linkage(nodes, found, ["symbol"])


@query("cl_clusters", sql("SELECT symbol, node, cluster FROM clusters", "clusters", recursive=True))
def _(t: Tables) -> DataFrame:
    return clusters_of(t)[2]


@query(
    "cl_effective_trials",
    sql(
        f"""SELECT symbol, n AS n_strategies, k AS n_clusters, {r('rho', 'avg_pairwise_corr')}, {r('n / (1 + (n - 1) * greatest(rho, 0))', 'n_effective')} FROM (SELECT symbol, count(*) AS n, count(DISTINCT cluster) AS k FROM clusters GROUP BY 1)
            JOIN (SELECT symbol, avg(rho) AS rho FROM cand_pairs GROUP BY 1) USING (symbol)""",
        "clusters",
        "cand_pairs",
        recursive=True,
    ),
)
def _(t: Tables) -> DataFrame:
    nodes, found, clusters = clusters_of(t)
    out = cl.effective_trials(nodes, found, clusters, ["symbol"])
    return out.select("symbol", "n_strategies", "n_clusters", rd("avg_pairwise_corr").alias("avg_pairwise_corr"), rd("n_effective").alias("n_effective"))
