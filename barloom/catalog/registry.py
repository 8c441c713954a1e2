"""Query registry and the shared SQL building blocks of the oracles."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import tune
from ..sources.panels import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register `fn(tables) -> DataFrame` under an operator id."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(tune(spark), sf_dir))

        run.__name__ = f"q_{name}"
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, text: str, *deps: str) -> None:
    """Name a common table expression so oracles can list it as a dependency."""
    CTES[name] = (deps, text)


def clone(names: list[str], prefix: str, sources: dict[str, str]) -> None:
    """Register copies of CTEs under a prefix, reading `sources` in place of the originals' inputs."""
    renamed = sources | {n: f"{prefix}{n}" for n in names}
    for name in names:
        deps, text = CTES[name]
        for old, new in renamed.items():
            text = re.sub(rf"\b{old}\b", new, text)
        cte(f"{prefix}{name}", text, *[renamed.get(dep, dep) for dep in deps])


def sql(body: str, *deps: str, recursive: bool = False) -> str:
    """Assemble a SELECT with the transitive closure of its named CTEs."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for dep in CTES[name][0]:
            visit(dep)
        ordered.append(name)

    for dep in deps:
        visit(dep)
    if not ordered:
        return body
    parts = ",\n".join(f"{name} AS MATERIALIZED ({CTES[name][1]})" for name in ordered)
    head = "WITH RECURSIVE " if recursive or any("UNION ALL -- recursive" in CTES[n][1] for n in ordered) else "WITH "
    body = body.strip()
    if body.upper().startswith("WITH "):
        return f"{head}{parts},\n{body[5:]}"
    return f"{head}{parts}\n{body}"


def r(expr: str, name: str | None = None, digits: int = 6) -> str:
    """Rounded double without a negative zero."""
    text = f"round({expr}, {digits}) + 0.0"
    return f"{text} AS {name}" if name else f"({text})"


def _bars(source: str) -> str:
    return f"""
      SELECT symbol, open_time, open, greatest(open, close) * 1.002::DOUBLE AS high,
             least(open, close) * 0.998::DOUBLE AS low, close, volume, quote_volume
      FROM (SELECT *, coalesce(lag(close) OVER (PARTITION BY symbol ORDER BY open_time)
                 * (1.0::DOUBLE + ((n % 7) - 3)::DOUBLE / 1000.0::DOUBLE), close) AS open
            FROM (SELECT *, round(avg(price) OVER (PARTITION BY symbol ORDER BY open_time
                         ROWS BETWEEN 59 PRECEDING AND CURRENT ROW), 6) AS close FROM {source}))"""


cte(
    "brand_daily",
    """SELECT *, quote_volume / volume AS price FROM (
         SELECT p_brand AS symbol, epoch_ms(date_trunc('day', l_shipdate)::TIMESTAMP) AS open_time,
                round(sum(l_quantity), 2) AS volume, round(sum(l_extendedprice), 2) AS quote_volume, count(*) AS n
         FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)""",
)
cte("bars", _bars("brand_daily"), "brand_daily")
cte(
    "segment_daily",
    """SELECT *, quote_volume / volume AS price FROM (
         SELECT c_mktsegment AS symbol, epoch_ms(date_trunc('day', o_orderdate)::TIMESTAMP) AS open_time,
                count(*)::DOUBLE AS volume, round(sum(o_totalprice), 2) AS quote_volume, count(*) AS n
         FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)""",
)
cte("segbars", _bars("segment_daily"), "segment_daily")
cte(
    "region_daily",
    """SELECT *, quote_volume / volume AS price FROM (
         SELECT 'R' || n_regionkey::VARCHAR AS symbol, epoch_ms(date_trunc('day', o_orderdate)::TIMESTAMP) AS open_time,
                count(*)::DOUBLE AS volume, round(sum(o_totalprice), 2) AS quote_volume, count(*) AS n
         FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)""",
)
cte("regbars", _bars("region_daily"), "region_daily")
cte(
    "ticks",
    """SELECT event_type AS symbol, event_id AS seq, (epoch_us(ts) // 1000) AS ts_ms, ts, value AS price,
              CAST(json_extract_string(props, '$.k') AS DOUBLE) AS size FROM events""",
)
cte("idx", "SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY open_time) - 1 AS bar_idx FROM bars", "bars")
