"""Small column helpers: finite checks, rounding, order statistics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: Column | str) -> Column:
    """The value when it is a finite number, else NULL (never NaN)."""
    c = col(c)
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(INF)), c)


def positive(c: Column | str) -> Column:
    """The value when finite and > 0, else NULL."""
    v = finite(c)
    return F.when(v > 0, v)


def non_negative(c: Column | str) -> Column:
    v = finite(c)
    return F.when(v >= 0, v)


def r(c: Column | str, digits: int = 6) -> Column:
    """Round for comparison; also removes a negative zero."""
    return F.round(col(c), digits) + F.lit(0.0)


def flag(c: Column) -> Column:
    """Count of rows where a condition holds (NULL counts as no)."""
    return F.count(F.when(c, F.lit(1)))


def clamp(c: Column | str, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.least(F.lit(hi), F.greatest(F.lit(lo), col(c)))


def ratio(num: Column | str, den: Column | str) -> Column:
    """num / den, NULL when the denominator is zero."""
    return F.try_divide(col(num), col(den))


def floor_index(n: Column, p: Column | float) -> Column:
    """int(p * n) clamped to [0, n-1]: the index convention of the sample quantiles."""
    p = F.lit(p) if isinstance(p, float) else p
    return F.greatest(F.lit(0), F.least(n - 1, F.floor(p * n))).cast("int")


def order_stat(values: Column, p: Column | float) -> Column:
    """sorted[int(p*n)] (clamped) of a *sorted* array column."""
    return F.element_at(values, floor_index(F.size(values), p) + 1)
