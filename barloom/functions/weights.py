"""Target-weight rules as column expressions over feature columns.

`idx` is the bar index *inside the slice that is traded*.  Because every rule
looks back a fixed number of bars and its warm-up covers them, the weight of a
restarted slice equals the full-history weight masked by the local warm-up, so
one feature pass serves training prefixes and test slices alike (the MACD rule,
whose recurrence is seeded at the slice start, has its own column per slice).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.candidates import VOL_WINDOW, Spec
from .indicators import feature_name
from .numeric import clamp


def _f(*feature) -> Column:
    return F.col(feature_name(feature))


def vol_scaled(target: float) -> Column:
    rv = _f("vol", VOL_WINDOW)
    return F.when(rv <= 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.lit(target) / rv))


def _signal(spec: Spec, idx: Column) -> Column:
    a = spec.args
    if spec.kind == "BuyHold":
        return F.lit(1.0)
    if spec.kind == "SmaCross":
        return F.when(_f("sma", a[0]) > _f("sma", a[1]), F.lit(1.0))
    if spec.kind == "TrendVol":
        return F.when(_f("px", 1) > _f("sma", a[0]), vol_scaled(a[1]))
    if spec.kind == "RsiDipBuy":
        return F.when((_f("px", 1) > _f("sma", a[2])) & (_f("rsi", a[0]) < a[1]), F.lit(1.0))
    if spec.kind == "MacdTrend":
        tail = "_".join(map(str, a))
        return F.when(F.col(f"macd_{tail}") > F.col(f"macdsig_{tail}"), F.lit(1.0))
    if spec.kind == "TSMom":
        return F.when(_f("mom", a[0]) > 0, vol_scaled(a[1]))
    if spec.kind == "DualMom":
        up = reduce(lambda x, y: x + y, [F.when(_f("mom", h) > 0, 1.0).otherwise(0.0) for h in a[0]])
        return F.when(up > 0, up / float(len(a[0])) * vol_scaled(a[1]))
    if spec.kind == "ChanBreak":
        hi, lo = _f("max", a[0]), _f("min", a[0])
        pos = F.try_divide(_f("px", 1) - lo, hi - lo)
        on = F.when(pos >= a[1], True).when(pos <= a[2], False).otherwise(pos >= 0.5 * (a[1] + a[2]))
        return F.when((hi > lo) & on, vol_scaled(a[3]))
    if spec.kind == "MeanRevZ":
        sd = _f("psd", a[0])
        z = F.try_divide(_f("px", 1) - _f("sma", a[0]), sd)
        on = F.when(z <= a[1], True).when(z >= a[2], False).otherwise(z <= 0.5 * (a[1] + a[2]))
        return F.when((_f("px", 1) > _f("sma", a[3])) & (sd > 0) & on, vol_scaled(a[4]))
    total = reduce(lambda x, y: x + y, [weight(m, idx) * w for m, w in spec.members])
    return clamp(total)


def weight(spec: Spec, idx: Column) -> Column:
    """Target weight in [0, 1]; 0.0 in warm-up and whenever the rule is off."""
    signal = F.coalesce(_signal(spec, idx), F.lit(0.0))
    return F.when(idx < spec.warmup, F.lit(0.0)).otherwise(signal) if spec.warmup else signal


def pool_weights(pool: list[Spec], idx: Column) -> Column:
    """array<double> with one weight per pool member, in pool order."""
    return F.array(*[weight(s, idx) for s in pool])
