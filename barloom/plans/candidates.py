"""The candidate pool: parameter rows, member lists and the features they need."""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

VOL_WINDOW = 20


class Spec(NamedTuple):
    """One rule.  `kind` doubles as the family label, `members` holds (rule, weight)."""

    kind: str
    args: tuple = ()
    members: tuple = ()

    @property
    def name(self) -> str:
        a = self.args
        if self.kind == "BuyHold":
            return "BuyHold"
        if self.kind == "SmaCross":
            return f"SmaCross({a[0]},{a[1]})"
        if self.kind in ("TrendVol", "TSMom"):
            return f"{self.kind}({a[0]},{a[1]:.2f})"
        if self.kind == "RsiDipBuy":
            return f"RsiDipBuy({a[0]},{a[1]:.0f},{a[2]})"
        if self.kind == "MacdTrend":
            return f"MacdTrend({a[0]},{a[1]},{a[2]})"
        if self.kind == "DualMom":
            return f"DualMom({'/'.join(map(str, a[0]))},{a[1]:.2f})"
        if self.kind in ("ChanBreak", "MeanRevZ"):
            return f"{self.kind}({a[0]},{a[1]:.2f},{a[2]:.2f},{a[-1]:.2f})"
        inner = ",".join(m.name if self.kind == "Ensemble" else f"{w:.4g}*{m.name}" for m, w in self.members)
        return f"{self.kind}({inner})"

    @property
    def family(self) -> str:
        return self.kind

    @property
    def warmup(self) -> int:
        """First bar index (inside its slice) that may hold a position."""
        a, v = self.args, VOL_WINDOW + 1
        if self.kind == "SmaCross":
            return a[1]
        if self.kind in ("TrendVol", "TSMom", "ChanBreak"):
            return a[0] + v
        if self.kind == "RsiDipBuy":
            return max(a[2], a[0] + 1)
        if self.kind == "MacdTrend":
            return a[1] + a[2] + 5
        if self.kind == "DualMom":
            return max(a[0]) + v
        if self.kind == "MeanRevZ":
            return max(a[0], a[3]) + v
        return 0

    @property
    def features(self) -> set[tuple]:
        a = self.args
        vol = ("vol", VOL_WINDOW)
        if self.kind == "SmaCross":
            return {("sma", a[0]), ("sma", a[1])}
        if self.kind == "TrendVol":
            return {("px", 1), ("sma", a[0]), vol}
        if self.kind == "RsiDipBuy":
            return {("px", 1), ("sma", a[2]), ("rsi", a[0])}
        if self.kind == "MacdTrend":
            return {("macd", *a)}
        if self.kind == "TSMom":
            return {("mom", a[0]), vol}
        if self.kind == "DualMom":
            return {("mom", h) for h in a[0]} | {vol}
        if self.kind == "ChanBreak":
            return {("px", 1), ("max", a[0]), ("min", a[0]), vol}
        if self.kind == "MeanRevZ":
            return {("px", 1), ("sma", a[3]), ("sma", a[0]), ("psd", a[0]), vol}
        return set().union(*[m.features for m, _ in self.members]) if self.members else set()


def buy_hold() -> Spec:
    return Spec("BuyHold")


def sma_cross(fast: int, slow: int) -> Spec:
    return Spec("SmaCross", (fast, slow))


def trend_vol(lookback: int, target: float) -> Spec:
    return Spec("TrendVol", (lookback, target))


def rsi_dip(period: int = 2, exit_above: float = 65.0, trend: int = 200) -> Spec:
    return Spec("RsiDipBuy", (period, float(exit_above), trend))


def macd(fast: int = 12, slow: int = 26, signal: int = 9) -> Spec:
    return Spec("MacdTrend", (fast, slow, signal))


def ts_mom(horizon: int, target: float) -> Spec:
    return Spec("TSMom", (horizon, target))


def dual_mom(horizons: tuple[int, ...], target: float) -> Spec:
    return Spec("DualMom", (horizons, target))


def channel(n: int, entry: float, exit_: float, target: float) -> Spec:
    return Spec("ChanBreak", (n, entry, exit_, target))


def mean_rev(window: int, entry_z: float, exit_z: float, target: float, trend: int = 200) -> Spec:
    return Spec("MeanRevZ", (window, entry_z, exit_z, trend, target))


def ensemble(*members: Spec) -> Spec:
    return Spec("Ensemble", (), tuple((m, 1.0 / len(members)) for m in members))


def blend(members: Iterable[tuple[Spec, float]]) -> Spec:
    members = tuple(members)
    total = sum(w for _, w in members)
    return Spec("Blend", (), tuple((m, w / total) for m, w in members))


def risk_ensemble() -> Spec:
    """The fixed, unselected mix used as the prior."""
    return ensemble(trend_vol(50, 0.30), trend_vol(100, 0.30), ts_mom(63, 0.30), dual_mom((63, 126, 252), 0.30), rsi_dip(2, 65, 200))


# The parameter grids of the pool, in pool order.
SMA_PAIRS = [(10, 50), (20, 100), (50, 150)]
TREND_LOOKBACKS = [25, 50, 75, 100, 125, 150, 200]
TREND_TARGETS = [0.20, 0.25, 0.30, 0.40, 0.50]
RSI_PERIODS, RSI_EXITS, RSI_TRENDS = [2, 3, 4], [55, 60, 65, 70], [150, 200]
MACD_SETS = [(12, 26, 9), (8, 21, 5), (16, 32, 9)]
MOMENTUM_SETS = [(63, 0.30), (63, 0.45), (126, 0.30), (126, 0.45), (189, 0.35)]
DUAL_SETS = [((63, 126, 252), 0.30), ((42, 84, 168), 0.35), ((63, 126), 0.30)]
CHANNELS, CHANNEL_BANDS = [30, 50, 100], [(0.80, 0.40), (0.70, 0.30), (0.90, 0.50)]
Z_WINDOWS, Z_BANDS = [20, 30, 50], [(-0.50, 0.50), (-1.00, 0.75)]
EXTENDED_TARGETS = [0.30, 0.40]


def _mixes() -> list[Spec]:
    tv, dip = trend_vol, rsi_dip
    return [
        ensemble(tv(50, 0.30), tv(100, 0.30), tv(200, 0.30)),
        ensemble(tv(50, 0.40), tv(100, 0.25), dip(2, 65, 200)),
        ensemble(tv(100, 0.40), dip(2, 65, 200), macd()),
        ensemble(tv(100, 0.40), tv(200, 0.40), dip(2, 65, 200)),
        ensemble(tv(50, 0.25), dip(3, 60, 150), macd(8, 21, 5)),
        ensemble(tv(75, 0.30), tv(150, 0.30)),
        ensemble(dip(2, 65, 200), dip(3, 60, 150), macd()),
        ensemble(tv(25, 0.40), tv(50, 0.40), tv(100, 0.40)),
        ensemble(tv(50, 0.30), ts_mom(63, 0.30), dip(2, 65, 200)),
        ensemble(ts_mom(63, 0.35), ts_mom(126, 0.35), dual_mom((63, 126, 252), 0.30)),
        risk_ensemble(),
    ]


def candidate_pool(extended: bool = False) -> list[Spec]:
    """85 rules, or 119 with the channel and z-score families."""
    pool = [buy_hold()]
    pool += [sma_cross(*p) for p in SMA_PAIRS]
    pool += [trend_vol(n, t) for n in TREND_LOOKBACKS for t in TREND_TARGETS]
    pool += [rsi_dip(p, e, t) for p in RSI_PERIODS for e in RSI_EXITS for t in RSI_TRENDS]
    pool += [macd(*m) for m in MACD_SETS]
    pool += [ts_mom(*m) for m in MOMENTUM_SETS]
    pool += [dual_mom(*m) for m in DUAL_SETS]
    pool += _mixes()
    if extended:
        pool += [channel(n, a, b, t) for n in CHANNELS for a, b in CHANNEL_BANDS for t in EXTENDED_TARGETS]
        pool += [mean_rev(n, a, b, t) for n in Z_WINDOWS for a, b in Z_BANDS for t in EXTENDED_TARGETS]
        trend, chan, z = trend_vol(100, 0.30), channel(50, 0.80, 0.40, 0.30), mean_rev(30, -0.75, 0.50, 0.30)
        pool += [ensemble(trend, chan), ensemble(trend, z), ensemble(chan, z), ensemble(trend, chan, z)]
    return pool


def pool_features(pool: Iterable[Spec]) -> list[tuple]:
    return sorted(set().union(*[s.features for s in pool]), key=str)


def candidates_table(spark: SparkSession, pool: list[Spec]) -> DataFrame:
    """candidates(pool_idx, name, family, warmup, members); fixed size, safe to broadcast."""
    rows = [(i, s.name, s.family, s.warmup, [m.name for m, _ in s.members]) for i, s in enumerate(pool)]
    return spark.createDataFrame(rows, "pool_idx int, name string, family string, warmup int, members array<string>")
