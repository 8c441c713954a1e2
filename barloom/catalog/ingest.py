"""Sources, sinks, cleaning, gaps and alignment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import r as rd
from ..functions.ordered import seq_chunk
from ..operators import cleaning as cl
from ..sources import market, panels, sinks, tapes
from ..sources.panels import DAY_MS, Tables
from .registry import cte, query, r, sql

BAR = ["open", "high", "low", "close", "volume", "quote_volume"]
BAR_ROWS = "symbol, open_time, open, high, low, close, volume, quote_volume"


def day_number(name: str = "open_time"):
    return F.floor(F.col(name) / DAY_MS).cast("bigint")


# ---------------------------------------------------------------- sources


def as_files(t: Tables, pages: DataFrame, label: str) -> DataFrame:
    """Write every payload to a file of its own below symbol=..., and read the files back."""
    path = sinks.scratch(t.spark, label)
    pages.select("symbol", "payload").write.option("maxRecordsPerFile", 1).partitionBy("symbol").text(path)
    return market.read_payloads(t.spark, path)


def kline_pages(t: Tables) -> DataFrame:
    """Brand bars as exchange payloads, one page per symbol and year."""
    quoted = [F.concat(F.lit('"'), F.col(c).cast("string"), F.lit('"')) for c in ("open", "high", "low", "close", "volume")]
    tail = F.when(day_number() % 7 != 0, F.concat(F.lit(',0,"'), F.col("quote_volume").cast("string"), F.lit('"'))).otherwise("")
    k = F.concat(F.lit("["), F.concat_ws(",", F.col("open_time").cast("string"), *quoted), tail, F.lit("]"))
    year = F.year(F.timestamp_millis("open_time"))
    rows = panels.brand_bars(t).select("symbol", year.alias("page"), "open_time", k.alias("k"))
    arr = F.transform(F.array_sort(F.collect_list(F.struct("open_time", "k"))), lambda x: x["k"])
    return rows.groupBy("symbol", "page").agg(F.concat(F.lit("["), F.array_join(arr, ","), F.lit("]")).alias("payload"))


@query(
    "src_klines_json",
    sql(
        """SELECT symbol, open_time, open, high, low, close, volume,
           CASE WHEN (open_time // 86400000) % 7 <> 0 THEN quote_volume END AS quote_volume FROM bars""",
        "bars",
    ),
)
def _(t: Tables) -> DataFrame:
    return market.parse_klines(as_files(t, kline_pages(t), "klines"), ["symbol"])


def chart_pages(t: Tables, rows: DataFrame) -> DataFrame:
    """Bars as chart payloads with parallel arrays, one page per symbol and year; some closes are null or zero."""
    d = day_number()
    close = F.when(d % 11 == 0, F.lit(None)).when(d % 11 == 1, F.lit(0.0)).otherwise(F.col("close"))
    year = F.year(F.timestamp_millis("open_time"))
    item = F.struct(F.expr("open_time div 1000").alias("ts"), F.col("open").alias("o"), close.alias("c"), F.col("volume").alias("v"))
    grouped = rows.groupBy("symbol", year.alias("page")).agg(F.array_sort(F.collect_list(item)).alias("z"))
    quote = F.struct(
        F.transform("z", lambda x: x["o"]).alias("open"),
        F.transform("z", lambda x: x["c"]).alias("close"),
        F.transform("z", lambda x: x["v"]).alias("volume"),
    )
    result = F.struct(
        F.transform("z", lambda x: x["ts"]).alias("timestamp"), F.struct(F.array(quote).alias("quote")).alias("indicators")
    )
    doc = F.struct(F.struct(F.array(result).alias("result")).alias("chart"))
    return grouped.select("symbol", "page", F.to_json(doc).alias("payload"))


@query(
    "src_chart_json",
    sql(
        """SELECT symbol, open_time, open, close, volume FROM bars
           WHERE (open_time // 86400000) % 11 NOT IN (0, 1)""",
        "bars",
    ),
)
def _(t: Tables) -> DataFrame:
    return market.parse_chart(as_files(t, chart_pages(t, panels.brand_bars(t)), "charts"), ["symbol"])


@query(
    "src_index_csv",
    sql(
        """SELECT symbol, strftime(make_timestamp(open_time * 1000), '%Y-%m-%d') AS date, close FROM segbars
           WHERE (open_time // 86400000) % 9 NOT IN (0, 1)""",
        "segbars",
    ),
)
def _(t: Tables) -> DataFrame:
    d = day_number()
    value = F.when(d % 9 == 0, ".").when(d % 9 == 1, "").otherwise(F.col("close").cast("string"))
    date = F.date_format(F.timestamp_millis("open_time"), "yyyy-MM-dd")
    path = sinks.scratch(t.spark, "index-csv")
    panels.segment_bars(t).select("symbol", date.alias("observation_date"), value.alias("close")).write.partitionBy("symbol").csv(path, header=True, emptyValue="")
    return market.read_index_csv(t.spark, path).select("symbol", F.col("date").cast("string").alias("date"), "close")


@query(
    "src_index_json",
    sql(
        """SELECT symbol, strftime(make_timestamp(open_time * 1000), '%Y-%m-%d') AS date,
                  CASE WHEN (open_time // 86400000) % 11 = 1 THEN 0.0 ELSE close END AS close FROM segbars
           WHERE (open_time // 86400000) % 11 <> 0""",
        "segbars",
    ),
)
def _(t: Tables) -> DataFrame:
    pages = as_files(t, chart_pages(t, panels.segment_bars(t)), "index-charts")
    return market.parse_index_json(pages, ["symbol"]).withColumn("date", F.col("date").cast("string"))


HISTORY_ROWS = 4000  # most recent bars kept of a paged history


@query(
    "src_paged_history",
    sql("SELECT symbol, open_time, close, volume FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY open_time) AS rn FROM bars) WHERE rn <= 4000", "bars"),
)
def _(t: Tables) -> DataFrame:
    i = F.row_number().over(cl.by_time()) - 1
    bars = panels.brand_bars(t).select("symbol", "open_time", "close", "volume", i.alias("i"))
    page = F.floor(F.col("i") / 100).cast("int")
    paged = bars.withColumn("page", page)
    overlap = bars.where(F.col("i") % 100 == 99).withColumn("page", page + 1)  # next page repeats the joint bar
    return market.stitch_pages(paged.unionByName(overlap).drop("i"), HISTORY_ROWS)


cte(
    "tape_lines",
    """SELECT strftime(o_orderdate, '%Y-%m') AS tape, o_orderkey AS seq,
              (o_orderkey % 97 = 0 AND o_custkey % 3 = 0) OR is_last AS corrupt
       FROM (SELECT *, row_number() OVER (PARTITION BY strftime(o_orderdate, '%Y-%m') ORDER BY o_orderkey DESC) = 1
             AND month(o_orderdate) % 2 = 0 AS is_last FROM orders)""",
)


def tape_lines(t: Tables) -> DataFrame:
    """Orders as monthly JSONL tapes; some interior lines are torn, even months end in a torn line."""
    month = F.date_format("o_orderdate", "yyyy-MM")
    rows = t.orders.select(month.alias("tape"), F.col("o_orderkey").alias("seq"), "o_custkey", "o_totalprice", "o_orderdate")
    last = rows.groupBy("tape").agg(F.max("seq").alias("last_seq"))
    joined = rows.join(last, "tape")
    torn = ((F.col("seq") % 97 == 0) & (F.col("o_custkey") % 3 == 0)) | (
        (F.col("seq") == F.col("last_seq")) & (F.month("o_orderdate") % 2 == 0)
    )
    line = F.to_json(F.struct(F.col("seq"), F.col("o_custkey").alias("cust"), F.col("o_totalprice").alias("price")))
    return joined.select("tape", "seq", F.when(torn, F.substring(line, 1, 17)).otherwise(line).alias("value"))


# evidence tapes: one entry per day and order priority and year, with faults in odd years; low-priority tapes end in a torn line
TAPE_FAULTS = {97: "not_json", 101: "no_date", 103: "invalid_date", 107: "repeated_date", 109: "invalid_return", 113: "impossible_return", 127: "no_assets"}
cte(
    "evidence_days",
    """SELECT *, d = max(d) OVER (PARTITION BY tape) AND tape LIKE '%5-LOW' AS torn, y % 2 = 1 AS odd FROM (
         SELECT year(o_orderdate) || '/' || o_orderpriority AS tape, year(o_orderdate) AS y, date_diff('day', DATE '1970-01-01', o_orderdate::DATE) AS d FROM orders GROUP BY ALL)""",
)


def fault_sql() -> str:
    cases = " ".join(f"WHEN odd AND d % {m} = 0 THEN '{name}'" for m, name in TAPE_FAULTS.items())
    return f"CASE WHEN torn THEN 'torn_tail' {cases} ELSE 'ok' END"


cte("evidence_faults", f"SELECT *, {fault_sql()} AS fault FROM evidence_days", "evidence_days")
# a repeated line carries the date of the dated line before it; without one, its own
cte(
    "evidence_dated",
    """SELECT *, CASE WHEN fault = 'repeated_date' THEN coalesce(prev, d) ELSE d END AS shown FROM (
         SELECT *, lag(d) OVER (PARTITION BY tape ORDER BY d) AS prev FROM evidence_faults)""",
    "evidence_faults",
)
cte(
    "evidence_checked",
    """SELECT tape, CASE WHEN fault IN ('torn_tail', 'not_json', 'no_date', 'invalid_date') THEN fault WHEN count(*) OVER seen > 0 THEN 'repeated_date' WHEN shown <= lag(shown) OVER line THEN 'not_increasing'
              WHEN fault = 'repeated_date' THEN 'ok' ELSE fault END AS reason
       FROM (SELECT *, fault IN ('torn_tail', 'not_json', 'no_date', 'invalid_date') AS undated FROM evidence_dated)
       WINDOW seen AS (PARTITION BY tape, undated, shown ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), line AS (PARTITION BY tape, undated ORDER BY d)""",
    "evidence_dated",
)


def write_evidence(t: Tables) -> str:
    """The evidence tapes as JSONL files, a file per tape, oldest day first."""
    d = F.datediff("day", F.lit("1970-01-01").cast("date"))
    days = t.orders.select(F.concat(F.year("o_orderdate").cast("string"), F.lit("/"), "o_orderpriority").alias("tape"), F.year("o_orderdate").alias("y"), F.col("o_orderdate").cast("date").alias("day"), "o_orderstatus")
    lines = days.groupBy("tape", "y", "day").agg(F.count(F.lit(1)).alias("orders"), F.min("o_orderstatus").alias("asset")).withColumn("d", d)
    tape = Window.partitionBy("tape")
    torn = (F.col("day") == F.max("day").over(tape)) & F.col("tape").endswith("5-LOW")
    staged = lines.withColumns({"torn": torn, "prev": F.lag("day").over(tape.orderBy("day"))})
    fault = F.when(F.col("torn"), "torn_tail")
    for m, name in TAPE_FAULTS.items():
        fault = fault.when((F.col("y") % 2 == 1) & (F.col("d") % m == 0), name)
    f = fault.otherwise("ok")
    shown = F.when(f == "invalid_date", "1995-13-45").when(f == "repeated_date", F.coalesce("prev", "day").cast("string")).when(f != "no_date", F.col("day").cast("string"))
    ret = F.when(f == "invalid_return", F.lit('"x"')).when(f == "impossible_return", F.lit("-1.5")).otherwise(F.format_string("%.4f", (F.col("orders") % 7 - 3) / 1000))
    assets = F.when(f == "no_assets", F.lit("{}")).otherwise(F.concat(F.lit('{"'), "asset", F.lit('": '), F.col("orders").cast("string"), F.lit("}")))
    date = F.coalesce(F.concat(F.lit('"date": "'), shown, F.lit('", ')), F.lit(""))
    line = F.concat(F.lit("{"), date, F.lit('"port_ret": '), ret, F.lit(', "assets": '), assets, F.lit("}"))
    value = F.when(f.isin("torn_tail", "not_json"), F.substring(line, 1, 19)).otherwise(line)
    path = sinks.scratch(t.spark, "evidence")
    name = F.replace(F.col("tape"), F.lit("/"), F.lit("_"))
    sinks.write_lines(staged.select(name.alias("tape"), "day", value.alias("value")), "tape", "day", path)
    return path


@query("src_tape_strict", sql("SELECT replace(tape, '/', '_') AS tape, reason, count(*) AS n, bool_or(bool_or(reason NOT IN ('ok', 'torn_tail'))) OVER (PARTITION BY tape) AS voided FROM evidence_checked GROUP BY tape, reason", "evidence_checked"))
def _(t: Tables) -> DataFrame:
    """Tapes written as files and read back under the rules; the reasons are counted."""
    entries = tapes.read_tape(t.spark, write_evidence(t))
    return tapes.tape_reasons(entries, F.url_decode(F.regexp_extract("file", r"tape=([^/]*)/", 1)))


def snapshot_lines(t: Tables) -> DataFrame:
    """Daily universe lines: every 5th day logged twice (re-ranked), every 11th day with one symbol missing."""
    day = F.date_format(F.timestamp_millis("open_time"), "yyyy-MM-dd")
    members = panels.brand_bars(t).groupBy("open_time", day.alias("date")).agg(
        F.array_sort(F.collect_list(F.struct("symbol", F.col("quote_volume").alias("quote_volume_usd")))).alias("universe")
    )
    d = day_number()

    def line(universe):
        return F.to_json(F.struct("date", universe.alias("universe")))

    u = F.col("universe")
    first = members.select("open_time", F.lit(0).alias("k"), line(u).alias("value"))
    twice = members.where(d % 5 == 0).select("open_time", F.lit(1).alias("k"), line(F.concat(F.reverse(u), u)).alias("value"))
    less = members.where(d % 11 == 0).select("open_time", F.lit(2).alias("k"), line(F.slice(u, F.lit(2), F.size(u))).alias("value"))
    torn = members.where(d % 17 == 0).select("open_time", F.lit(3).alias("k"), F.substring(line(u), 1, 20).alias("value"))
    out = first.unionByName(twice).unionByName(less).unionByName(torn)
    return out.select((F.col("open_time") * 10 + F.col("k")).alias("line_id"), "value")


@query(
    "src_snapshot_log",
    sql(
        """SELECT strftime(make_timestamp(open_time * 1000), '%Y-%m-%d') AS date,
                  1 + (d % 5 = 0)::BIGINT + (d % 11 = 0)::BIGINT AS n_lines, n AS n_symbols, d % 11 = 0 AS conflict
           FROM (SELECT open_time, open_time // 86400000 AS d, count(*) AS n FROM bars GROUP BY 1, 2)""",
        "bars",
    ),
)
def _(t: Tables) -> DataFrame:
    """The log as a file, one line per snapshot in the order they were taken."""
    path = sinks.scratch(t.spark, "snapshots")
    snapshot_lines(t).repartitionByRange("line_id").sortWithinPartitions("line_id").select("value").write.text(path)
    lines = tapes.numbered_lines(t.spark, path).withColumn("line_id", F.struct("file", "block", "at"))
    parsed = tapes.parse_tape(lines, tapes.SNAPSHOT_SCHEMA, ["line_id"])
    return tapes.snapshot_conflicts(tapes.snapshot_members(parsed))


# ---------------------------------------------------------------- sinks


@query(
    "sink_tape_append",
    sql("SELECT symbol, count(*) AS n_rows, count(DISTINCT open_time) AS n_days, round(sum(close), 4) + 0.0 AS total FROM bars GROUP BY 1", "bars"),
)
def _(t: Tables) -> DataFrame:
    bars = panels.brand_bars(t).select("symbol", "open_time", "close")
    path = sinks.scratch(t.spark, "tape")
    year = F.year(F.timestamp_millis("open_time"))
    sinks.append_rows(bars.where(year <= 1999), path, ["symbol", "open_time"])
    late = bars.where(year >= 1998).withColumn("close", F.when(year <= 1999, F.col("close") * 2).otherwise(F.col("close")))
    sinks.append_rows(late, path, ["symbol", "open_time"])  # the overlap must not change stored rows
    return t.spark.read.parquet(path).groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("open_time").alias("n_days"), rd(F.sum("close"), 4).alias("total")
    )


@query(
    "sink_quarantine",
    sql(
        """SELECT 'archive' AS output, count(DISTINCT tape) AS files, 0::BIGINT AS changed, count(*) AS n FROM tape_lines
           UNION ALL SELECT 'annotated', 0, 0, count(*) FROM tape_lines
           UNION ALL SELECT 'verified', 0, 0, count(*) FROM tape_lines WHERE NOT corrupt""",
        "tape_lines",
    ),
)
def _(t: Tables) -> DataFrame:
    """Monthly tapes written as files; the archive is checked file by file against what was read."""
    source, path = sinks.scratch(t.spark, "mixed"), sinks.scratch(t.spark, "quarantine")
    sinks.write_lines(tape_lines(t), "tape", "seq", source)
    lines = tapes.numbered_lines(t.spark, source).withColumn("tape", F.regexp_extract("file", r"tape=([^/]*)/", 1))
    parsed = tapes.parse_tape(lines, "seq bigint, cust bigint, price double", ["tape"])
    classified = parsed.select("tape", F.col("row.seq"), F.col("row.cust"), F.col("row.price"), F.when(F.col("corrupt"), "malformed").otherwise("verified").alias("verdict"))
    sinks.write_quarantine(t.spark, source, classified, path)
    archive = t.spark.read.parquet(f"{path}/archive")
    now = sinks.file_bytes(t.spark, source).select("path", F.sha2("content", 256).alias("now"))
    same = archive.join(now, "path", "full").agg(
        F.count("path").alias("files"), F.count_if(~F.sha2("content", 256).eqNullSafe(F.col("now")) | (F.col("sha256") != F.col("now"))).alias("changed"),
        F.sum(F.regexp_count(F.col("content").cast("string"), F.lit("\n"))).alias("n"),
    )
    zero = F.lit(0).cast("bigint")
    counts = [t.spark.read.parquet(f"{path}/{part}").agg(F.count(F.lit(1)).alias("n")).select(F.lit(part).alias("output"), zero.alias("files"), zero.alias("changed"), "n") for part in ("annotated", "verified")]
    return same.select(F.lit("archive").alias("output"), "files", "changed", "n").unionByName(counts[0]).unionByName(counts[1])


@query(
    "sink_report",
    sql(
        f"SELECT 'bars-v1' AS run_id, symbol, count(*) AS n_bars, {r('max(close) / min(close)', 'range_ratio')} FROM bars GROUP BY symbol",
        "bars",
    ),
)
def _(t: Tables) -> DataFrame:
    metrics = panels.brand_bars(t).groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_bars"), rd(F.max("close") / F.min("close")).alias("range_ratio")
    )
    path = sinks.scratch(t.spark, "report")
    sinks.write_report(metrics.withColumn("run_id", F.lit("bars-v1")), path)
    return t.spark.read.parquet(path).withColumn("run_id", F.col("run_id").cast("string"))


# ---------------------------------------------------------------- cleaning

cte(
    "dirty",
    """SELECT symbol, open_time, open, high, low, close, volume, quote_volume, 0 AS ingest_seq FROM bars
       UNION ALL
       SELECT symbol, CASE WHEN k = 10 THEN -open_time - 1 ELSE open_time END, open, CASE WHEN k = 8 THEN -1.0 ELSE high END, low,
              CASE WHEN k = 0 THEN NULL WHEN k = 1 THEN 0.0 WHEN k = 2 THEN -1.0 WHEN k = 3 THEN 'nan'::DOUBLE
                   WHEN k = 4 THEN 'inf'::DOUBLE WHEN k = 5 THEN close * 1.5 ELSE close * 1.01 END,
              CASE WHEN k <= 4 OR k IN (8, 9) THEN volume * 2 WHEN k = 5 THEN volume / 2 WHEN k = 6 THEN volume
                   WHEN k = 7 THEN NULL WHEN k = 11 THEN 'nan'::DOUBLE ELSE volume * 3 END,
              CASE WHEN k = 9 THEN -5.0 ELSE quote_volume END, 1
       FROM (SELECT *, (open_time // 86400000) % 13 AS k FROM bars) WHERE k < 12""",
    "bars",
)
cte(
    "clean",
    """SELECT symbol, open_time, CASE WHEN isfinite(open) AND open > 0 THEN open END AS open,
              CASE WHEN isfinite(high) AND high > 0 THEN high END AS high,
              CASE WHEN isfinite(low) AND low > 0 THEN low END AS low, close,
              CASE WHEN isfinite(volume) AND volume >= 0 THEN volume END AS volume,
              CASE WHEN isfinite(quote_volume) AND quote_volume >= 0 THEN quote_volume END AS quote_volume
       FROM (SELECT *, row_number() OVER (PARTITION BY symbol, open_time ORDER BY
                 CASE WHEN isfinite(volume) AND volume >= 0 THEN volume ELSE 0 END DESC, ingest_seq DESC) AS rn
             FROM dirty WHERE open_time >= 0 AND isfinite(close) AND close > 0) WHERE rn = 1""",
    "dirty",
)


def dirty_bars(t: Tables) -> DataFrame:
    """Brand bars plus injected bad and duplicate rows (twelve kinds, by day number)."""
    bars = panels.brand_bars(t)
    k = day_number() % 13
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    close, volume = F.col("close"), F.col("volume")
    bad = bars.where(k < 12).select(
        "symbol",
        F.when(k == 10, -F.col("open_time") - 1).otherwise(F.col("open_time")).alias("open_time"),
        "open",
        F.when(k == 8, -1.0).otherwise(F.col("high")).alias("high"),
        "low",
        F.when(k == 0, F.lit(None)).when(k == 1, 0.0).when(k == 2, -1.0).when(k == 3, nan).when(k == 4, inf)
        .when(k == 5, close * 1.5).otherwise(close * 1.01).alias("close"),
        F.when((k <= 4) | k.isin(8, 9), volume * 2).when(k == 5, volume / 2).when(k == 6, volume).when(k == 7, F.lit(None))
        .when(k == 11, nan).otherwise(volume * 3).alias("volume"),
        F.when(k == 9, -5.0).otherwise(F.col("quote_volume")).alias("quote_volume"),
        F.lit(1).alias("ingest_seq"),
    )
    return bars.withColumn("ingest_seq", F.lit(0)).unionByName(bad)


@query(
    "clean_bars",
    sql(
        """SELECT symbol, open_time, open, high, low, round(close, 8) + 0.0 AS close, volume, quote_volume FROM clean""",
        "clean",
    ),
)
def _(t: Tables) -> DataFrame:
    return cl.clean_bars(dirty_bars(t)).withColumn("close", rd("close", 8))


@query("recent_window", sql(f"SELECT {BAR_ROWS} FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY open_time DESC) AS rn FROM bars) WHERE rn <= 250", "bars"))
def _(t: Tables) -> DataFrame:
    return cl.recent_window(panels.brand_bars(t), 250)


@query(
    "stale_symbols",
    sql(
        """SELECT symbol, last_open_time, round(age_days, 6) + 0.0 AS age_days,
             CASE WHEN last_open_time IS NULL THEN 'empty' WHEN age_days < -0.05 THEN 'future'
                  WHEN age_days > 45 THEN 'stale' ELSE 'fresh' END AS status
           FROM (SELECT s.symbol, m.last_open_time, (epoch_ms(TIMESTAMP '2001-11-01') - m.last_open_time) / 86400000.0 AS age_days
                 FROM (SELECT DISTINCT p_brand AS symbol FROM part UNION ALL SELECT DISTINCT 'X' || p_type FROM part) s
                 LEFT JOIN (SELECT symbol, max(open_time) AS last_open_time FROM bars
                     WHERE NOT (ascii(right(symbol, 1)) % 3 = 0 AND open_time > epoch_ms(TIMESTAMP '2001-06-01')) GROUP BY 1) m USING (symbol))""",
        "bars",
    ),
)
def _(t: Tables) -> DataFrame:
    brand = t.part.select(F.col("p_brand").alias("symbol")).distinct()
    types = t.part.select(F.concat(F.lit("X"), F.col("p_type")).alias("symbol")).distinct()
    bars = panels.brand_bars(t)
    dead = (F.ascii(F.substring("symbol", -1, 1)) % 3 == 0) & (F.col("open_time") > 991353600000)
    out = cl.stale_symbols(bars.where(~dead), brand.unionByName(types), F.lit(1004572800000), 45.0)
    return out.withColumn("age_days", rd("age_days"))


@query(
    "gap_report",
    sql(
        """SELECT symbol, start, "end", days FROM (SELECT symbol, lag(open_time) OVER (PARTITION BY symbol ORDER BY open_time) AS start,
             open_time AS "end", (open_time - lag(open_time) OVER (PARTITION BY symbol ORDER BY open_time)) / 86400000.0::DOUBLE AS days FROM bars)
           WHERE days > 1.5""",
        "bars",
    ),
)
def _(t: Tables) -> DataFrame:
    return cl.gap_report(panels.brand_bars(t))


@query(
    "fill_small_gaps",
    sql(
        """SELECT symbol, open_time, open, high, low, close, volume, quote_volume, false AS filled FROM bars
           UNION ALL
           SELECT symbol, open_time - (n + 1 - k) * 86400000::BIGINT, pc, pc, pc, pc, 0.0, NULL, true
           FROM (SELECT *, (gap // 86400000) - 1 AS n FROM (SELECT symbol, open_time, open_time - lag(open_time) OVER w AS gap,
                        lag(close) OVER w AS pc FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY open_time)))
             , unnest(range(1, n + 1)) AS u(k)
           WHERE gap > 1.5 * 86400000::BIGINT AND n BETWEEN 1 AND 3""",
        "bars",
    ),
)
def _(t: Tables) -> DataFrame:
    return cl.fill_small_gaps(panels.brand_bars(t), 3)


cte(
    "rets",
    """SELECT symbol, open_time AS day, close / prev - 1 AS ret FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY open_time) AS prev FROM bars)
       WHERE prev IS NOT NULL""",
    "bars",
)
cte("timeline", "SELECT DISTINCT open_time AS day FROM bars", "bars")
cte(
    "aligned",
    """SELECT symbol, day, coalesce(ret, 0.0) AS ret FROM (SELECT s.symbol, t.day FROM timeline t
         JOIN (SELECT symbol, min(day) AS f, max(day) AS l FROM rets GROUP BY 1) s ON t.day BETWEEN s.f AND s.l)
       LEFT JOIN rets USING (symbol, day)""",
    "rets",
    "timeline",
)


def close_returns(bars: DataFrame) -> DataFrame:
    """Close-to-close returns (symbol, day, ret)."""
    prev = F.lag("close").over(cl.by_time())
    return bars.select("symbol", F.col("open_time").alias("day"), (F.col("close") / prev - 1.0).alias("ret")).where("ret is not null")


def timeline_of(bars: DataFrame) -> DataFrame:
    return bars.select(F.col("open_time").alias("day")).distinct()


@query("align_to_timeline", sql(f"SELECT symbol, day, {r('ret', 'ret', 9)} FROM aligned", "aligned"))
def _(t: Tables) -> DataFrame:
    bars = panels.stored_brand_bars(t)
    return cl.align_to_timeline(close_returns(bars), timeline_of(bars), ["symbol"]).withColumn("ret", rd("ret", 9))


@query(
    "delist_markdown",
    sql(
        """SELECT symbol, open_time, round(CASE WHEN hit THEN close * (1.0::DOUBLE - 10.0::DOUBLE / 10000.0::DOUBLE) ELSE close END, 9) + 0.0 AS close,
                  round(CASE WHEN hit THEN open * (1.0::DOUBLE - 10.0::DOUBLE / 10000.0::DOUBLE) ELSE open END, 9) + 0.0 AS open, volume,
                  CASE WHEN hit THEN 'simulated delisting' END AS note
           FROM (SELECT *, cut IS NOT NULL AND open_time = max(open_time) OVER (PARTITION BY symbol) AS hit
                 FROM (SELECT *, CASE WHEN symbol LIKE '%1%' THEN epoch_ms(TIMESTAMP '2000-06-15') END AS cut FROM bars)
                 WHERE cut IS NULL OR open_time <= cut)""",
        "bars",
    ),
)
def _(t: Tables) -> DataFrame:
    bars = panels.brand_bars(t)
    listed = t.part.select(F.col("p_brand").alias("symbol")).where(F.col("symbol").contains("1")).distinct()
    out = cl.delist_markdown(bars, listed.withColumn("delist_at", F.lit(961027200000)))
    return out.select("symbol", "open_time", rd("close", 9).alias("close"), rd("open", 9).alias("open"), "volume", "note")


@query(
    "bar_sanity",
    sql(
        """SELECT symbol, coalesce(reason, 'ok') AS reason, count(*) AS n FROM (SELECT symbol, CASE
             WHEN close IS NULL OR NOT isfinite(close) OR close <= 0 THEN 'invalid close'
             WHEN open IS NOT NULL AND NOT (isfinite(open) AND open > 0) THEN 'non-finite/zero open'
             WHEN (high IS NULL) <> (low IS NULL) THEN 'partial high/low'
             WHEN high IS NOT NULL AND NOT (isfinite(high) AND high > 0 AND isfinite(low) AND low > 0) THEN 'non-finite/zero high/low'
             WHEN high < low THEN 'high<low'
             WHEN close < low / 1.001 OR close > high * 1.001 THEN 'close outside range'
             WHEN abs(close / open - 1) > 0.5 THEN 'open-close move' END AS reason
           FROM (SELECT symbol, CASE WHEN k = 1 THEN 0.0 WHEN k = 8 THEN close * 3 ELSE open END AS open,
                   CASE WHEN k = 2 THEN NULL WHEN k = 3 THEN -1.0 WHEN k = 4 THEN low / 2 WHEN k = 8 THEN close * 4 ELSE high END AS high, low,
                   CASE WHEN k = 5 THEN close * 1.2 WHEN k = 6 THEN 'nan'::DOUBLE ELSE close END AS close
                 FROM (SELECT *, (open_time // 86400000) % 17 AS k FROM bars))) GROUP BY 1, 2""",
        "bars",
    ),
)
def _(t: Tables) -> DataFrame:
    k = day_number() % 17
    bars = panels.brand_bars(t).select(
        "symbol",
        F.when(k == 1, 0.0).when(k == 8, F.col("close") * 3).otherwise(F.col("open")).alias("open"),
        F.when(k == 2, F.lit(None)).when(k == 3, -1.0).when(k == 4, F.col("low") / 2).when(k == 8, F.col("close") * 4)
        .otherwise(F.col("high")).alias("high"),
        "low",
        F.when(k == 5, F.col("close") * 1.2).when(k == 6, F.lit(float("nan"))).otherwise(F.col("close")).alias("close"),
    )
    return bars.groupBy("symbol", F.coalesce(cl.bar_problem(), F.lit("ok")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "feed_sanity",
    sql(
        """SELECT symbol, count(*) AS n_rows, min_by(reason, CASE WHEN reason IS NOT NULL THEN seq END) AS problem, count(reason) AS n_problems
           FROM (SELECT symbol, seq, CASE WHEN ts_ms < 0 THEN 'invalid timestamp' WHEN NOT isfinite(price) OR price <= 0 THEN 'invalid close'
                   WHEN ts_ms <= lag(ts_ms) OVER (PARTITION BY symbol ORDER BY seq) THEN 'not strictly increasing' END AS reason
                 FROM (SELECT 'U' || user_id::VARCHAR AS symbol, event_id AS seq,
                         CASE WHEN event_id % 211 = 7 THEN (epoch_us(ts) // 1000) - 259200000 WHEN event_id % 1009 = 5 THEN -1 ELSE (epoch_us(ts) // 1000) END AS ts_ms,
                         CASE WHEN event_id % 307 = 3 THEN 'nan'::DOUBLE ELSE value END AS price FROM events)) GROUP BY 1""",
    ),
)
def _(t: Tables) -> DataFrame:
    seq, ms = F.col("event_id"), F.unix_millis(F.col("ts").cast("timestamp"))
    feed = t.events.select(
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("symbol"),
        seq.alias("seq"),
        F.when(seq % 211 == 7, ms - 259200000).when(seq % 1009 == 5, F.lit(-1)).otherwise(ms).alias("ts_ms"),
        F.when(seq % 307 == 3, F.lit(float("nan"))).otherwise(F.col("value")).alias("price"),
    )
    return cl.feed_problems(feed, seq_chunk("seq"))


TICK_BARS = """SELECT symbol, epoch_ms(time_bucket(INTERVAL '{w}', ts)::TIMESTAMP) AS open_time, min_by(price, seq) AS open, max(price) AS high,
  min(price) AS low, max_by(price, seq) AS close, sum(size) AS volume, round(sum(price * size), 4) + 0.0 AS quote_volume FROM ticks GROUP BY 1, 2"""


@query("resample_bars", sql(TICK_BARS.format(w="1 day"), "ticks"))
def _(t: Tables) -> DataFrame:
    out = cl.resample(panels.ticks(t), "1 day")
    return out.withColumn("quote_volume", rd("quote_volume", 4))


@query(
    "dataset_fingerprint",
    sql(
        """SELECT symbol, sha256(string_agg(h, ',' ORDER BY month)) AS fingerprint FROM (
             SELECT symbol, strftime(make_timestamp(open_time * 1000), '%Y-%m') AS month,
                    sha256(string_agg(open_time::VARCHAR || '|' || round(close * 1000000)::BIGINT::VARCHAR, ',' ORDER BY open_time)) AS h
             FROM bars GROUP BY 1, 2) GROUP BY 1""",
        "bars",
    ),
)
def _(t: Tables) -> DataFrame:
    return cl.fingerprint(panels.brand_bars(t))
