"""SQL text of features and weights for the oracles (written independently of the column builders)."""

from __future__ import annotations

from ..plans.candidates import Spec
from .registry import cte, sql

PART = "PARTITION BY symbol ORDER BY open_time"


def name(f: tuple) -> str:
    return "_".join(str(x) for x in f)


def feature_sql(f: tuple, part: str = PART) -> str:
    kind, n = f[0], f[1]
    frame = f"OVER ({part} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    if kind == "px":
        return f"lag(close, {n}) OVER ({part})"
    if kind == "sma":
        return f"CASE WHEN bar_idx >= {n} THEN avg(close) {frame} END"
    if kind == "psd":
        return f"CASE WHEN bar_idx >= {n} THEN stddev_samp(close) {frame} END"
    if kind == "vol":
        return f"CASE WHEN bar_idx >= {n + 1} THEN stddev_samp(lr) {frame} * sqrt(365.0::DOUBLE) END"
    if kind in ("max", "min"):
        return f"CASE WHEN bar_idx >= {n} THEN {kind}(close) {frame} END"
    if kind == "mom":
        return f"ln(lag(close, 1) OVER ({part}) / lag(close, {1 + n}) OVER ({part}))"
    if kind == "rsi":
        g, lo = f"sum(up) {frame}", f"sum(dn) {frame}"
        return (
            f"CASE WHEN bar_idx >= {n + 1} THEN CASE WHEN {lo} <= 0 THEN 100.0::DOUBLE WHEN {g} <= 0 THEN 0.0::DOUBLE "
            f"ELSE 100.0::DOUBLE - 100.0::DOUBLE / (1.0::DOUBLE + {g} / {lo}) END END"
        )
    raise ValueError(f)


cte(
    "series",
    """SELECT *, ln(close / prev_close) AS lr, greatest(close - prev_close, 0.0::DOUBLE) AS up, greatest(prev_close - close, 0.0::DOUBLE) AS dn
       FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY open_time) AS prev_close, lag(open_time) OVER (PARTITION BY symbol ORDER BY open_time) AS prev_time FROM idx)""",
    "idx",
)


def features_cte(label: str, features, source: str = "series", part: str = PART) -> str:
    """Register a CTE that adds the feature columns to `source`."""
    cols = ", ".join(f"{feature_sql(f, part)} AS {name(f)}" for f in features if f[0] != "macd")
    cte(label, f"SELECT *, {cols} FROM {source}", source)
    return label


def d(x: float) -> str:
    return f"{x!r}::DOUBLE"


def vol_scaled(target: float) -> str:
    return f"CASE WHEN vol_20 <= 0 THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, {d(target)} / vol_20) END"


def weight_sql(s: Spec, idx: str = "bar_idx") -> str:
    a = s.args
    if s.kind == "BuyHold":
        return "1.0::DOUBLE"
    if s.kind == "SmaCross":
        on, value = f"sma_{a[0]} > sma_{a[1]}", "1.0::DOUBLE"
    elif s.kind == "TrendVol":
        on, value = f"px_1 > sma_{a[0]}", vol_scaled(a[1])
    elif s.kind == "RsiDipBuy":
        on, value = f"px_1 > sma_{a[2]} AND rsi_{a[0]} < {d(a[1])}", "1.0::DOUBLE"
    elif s.kind == "MacdTrend":
        on, value = f"macd_{a[0]}_{a[1]}_{a[2]} > macdsig_{a[0]}_{a[1]}_{a[2]}", "1.0::DOUBLE"
    elif s.kind == "TSMom":
        on, value = f"mom_{a[0]} > 0", vol_scaled(a[1])
    elif s.kind == "DualMom":
        up = " + ".join(f"(mom_{h} > 0)::INT" for h in a[0])
        on, value = f"({up}) > 0", f"({up})::DOUBLE / {d(float(len(a[0])))} * {vol_scaled(a[1])}"
    elif s.kind == "ChanBreak":
        pos = f"((px_1 - min_{a[0]}) / nullif(max_{a[0]} - min_{a[0]}, 0))"
        on = f"max_{a[0]} > min_{a[0]} AND CASE WHEN {pos} >= {d(a[1])} THEN true WHEN {pos} <= {d(a[2])} THEN false ELSE {pos} >= {d(0.5 * (a[1] + a[2]))} END"
        value = vol_scaled(a[3])
    elif s.kind == "MeanRevZ":
        z = f"((px_1 - sma_{a[0]}) / nullif(psd_{a[0]}, 0))"
        on = f"px_1 > sma_{a[3]} AND psd_{a[0]} > 0 AND CASE WHEN {z} <= {d(a[1])} THEN true WHEN {z} >= {d(a[2])} THEN false ELSE {z} <= {d(0.5 * (a[1] + a[2]))} END"
        value = vol_scaled(a[4])
    else:
        total = " + ".join(f"{weight_sql(m, idx)} * {d(w)}" for m, w in s.members)
        return f"least(1.0::DOUBLE, greatest(0.0::DOUBLE, {total}))"
    return f"(CASE WHEN {idx} < {s.warmup} THEN 0.0::DOUBLE WHEN {on} THEN {value} ELSE 0.0::DOUBLE END)"


def weights_cte(label: str, pool: list[Spec], source: str, idx: str = "bar_idx", keep: str = "*") -> str:
    """One row per (row of source, pool member): pool_idx, name, weight."""
    ws = ", ".join(weight_sql(s, idx) for s in pool)
    names = ", ".join("'" + s.name + "'" for s in pool)
    cte(
        label,
        f"""SELECT * EXCLUDE (ws), unnest(ws) AS weight, unnest(range(0, {len(pool)})) AS pool_idx, unnest([{names}]) AS name
            FROM (SELECT {keep}, [{ws}] AS ws FROM {source})""",
        source,
    )
    return label


__all__ = ["feature_sql", "features_cte", "sql", "weight_sql", "weights_cte"]
