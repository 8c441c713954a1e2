"""US equity full-day closures from rules, as date columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _date(y: Column, month: int, day: int) -> Column:
    return F.make_date(y, F.lit(month), F.lit(day))


def _nth(y: Column, month: int, weekday: str, n: int) -> Column:
    return F.date_add(F.next_day(F.date_sub(_date(y, month, 1), 1), weekday), 7 * (n - 1))


def _last(y: Column, month: int, weekday: str) -> Column:
    return F.next_day(F.date_sub(F.last_day(_date(y, month, 1)), 7), weekday)


def _observed(y: Column, month: int, day: int) -> Column:
    d = _date(y, month, day)
    return F.when(F.weekday(d) == 5, F.date_sub(d, 1)).when(F.weekday(d) == 6, F.date_add(d, 1)).otherwise(d)


def _idiv(a: Column, b: int) -> Column:
    return F.floor(a / b)


def easter_sunday(y: Column) -> Column:
    """Gregorian Easter by integer arithmetic (anonymous computus)."""
    golden, century = y % 19, _idiv(y, 100)
    years = y % 100
    skew = _idiv(century - _idiv(century + 8, 25) + 1, 3)
    moon = (19 * golden + century - _idiv(century, 4) - skew + 15) % 30
    week = (32 + 2 * (century % 4) + 2 * _idiv(years, 4) - moon - years % 4) % 7
    fix = _idiv(golden + 11 * moon + 22 * week, 451)
    total = moon + week - 7 * fix + 114
    return F.make_date(y, _idiv(total, 31).cast("int"), (total % 31 + 1).cast("int"))


def closure(day: Column) -> Column:
    """Name of the closure on a date, NULL when the exchange is open.

    New Year's Day on a Saturday is not moved to the Friday before.
    """
    y = F.year(day)
    jan1 = _date(y, 1, 1)
    new_year = F.when(F.weekday(jan1) < 5, jan1).when(F.weekday(jan1) == 6, F.date_add(jan1, 1))
    rules = [
        ("new year", new_year),
        ("king day", _nth(y, 1, "Mon", 3)),
        ("presidents day", _nth(y, 2, "Mon", 3)),
        ("good friday", F.date_sub(easter_sunday(y), 2)),
        ("memorial day", _last(y, 5, "Mon")),
        ("juneteenth", _observed(y, 6, 19)),
        ("independence day", _observed(y, 7, 4)),
        ("labor day", _nth(y, 9, "Mon", 1)),
        ("thanksgiving", _nth(y, 11, "Thu", 4)),
        ("christmas", _observed(y, 12, 25)),
    ]
    named = F.when(F.weekday(day) >= 5, F.lit("weekend"))
    for label, when in rules:
        named = named.when(day == when, F.lit(label))
    return named


def calendar(days: DataFrame, column: str = "date") -> DataFrame:
    """Add `closure` and `closed` to a table of dates."""
    name = closure(F.col(column))
    return days.withColumns({"closure": name, "closed": name.isNotNull()})
