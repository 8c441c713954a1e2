"""Tapes, ledgers, fills, audits, merges and grades."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import r as rd
from ..functions.ordered import running_sum_split, seq_chunk
from ..operators import audits as au
from ..operators import calendar as cal
from ..operators import grades as gr
from ..operators import tape_stats as ts
from ..sources import panels
from ..sources.panels import Tables
from .ingest import day_number
from .metrics import return_summary
from .registry import cte, query, r, sql
from .signals import observations, rule_weights

# ---------------------------------------------------------------- calendar


def nth_sql(m: int, dow: int, n: int) -> str:
    first = f"make_date(y, {m}, 1)"
    return f"({first} + (({dow} - isodow({first}) + 7) % 7 + {7 * (n - 1)})::INT)"


def observed_sql(m: int, d: int) -> str:
    x = f"make_date(y, {m}, {d})"
    return f"CASE isodow({x}) WHEN 6 THEN {x} - 1 WHEN 7 THEN {x} + 1 ELSE {x} END"


# Easter through the table of the nineteen-year cycle: Paschal full moon for 1900-2099, then the next Sunday.
EASTER = """(SELECT y, (pfm + (7 - (isodow(pfm) % 7))::INT) AS easter FROM (SELECT y, CASE y % 19 WHEN 0 THEN make_date(y, 4, 14) WHEN 1 THEN make_date(y, 4, 3) WHEN 2 THEN make_date(y, 3, 23) WHEN 3 THEN make_date(y, 4, 11)
   WHEN 4 THEN make_date(y, 3, 31) WHEN 5 THEN make_date(y, 4, 18) WHEN 6 THEN make_date(y, 4, 8) WHEN 7 THEN make_date(y, 3, 28) WHEN 8 THEN make_date(y, 4, 16) WHEN 9 THEN make_date(y, 4, 5) WHEN 10 THEN make_date(y, 3, 25)
   WHEN 11 THEN make_date(y, 4, 13) WHEN 12 THEN make_date(y, 4, 2) WHEN 13 THEN make_date(y, 3, 22) WHEN 14 THEN make_date(y, 4, 10) WHEN 15 THEN make_date(y, 3, 30) WHEN 16 THEN make_date(y, 4, 17) WHEN 17 THEN make_date(y, 4, 7)
   ELSE make_date(y, 3, 27) END AS pfm FROM (SELECT DISTINCT year(d) AS y FROM tape_days)))"""
cte("tape_days", "SELECT DISTINCT make_timestamp(open_time * 1000)::DATE AS d, open_time AS day FROM bars", "bars")
cte(
    "cal",
    f"""SELECT day, d, CASE WHEN isodow(d) >= 6 THEN 'weekend' WHEN d = CASE isodow(make_date(y, 1, 1)) WHEN 6 THEN NULL WHEN 7 THEN make_date(y, 1, 2) ELSE make_date(y, 1, 1) END THEN 'new year'
          WHEN d = {nth_sql(1, 1, 3)} THEN 'king day' WHEN d = {nth_sql(2, 1, 3)} THEN 'presidents day' WHEN d = easter - 2 THEN 'good friday'
          WHEN d = make_date(y, 5, 31) - (isodow(make_date(y, 5, 31)) - 1)::INT THEN 'memorial day' WHEN d = {observed_sql(6, 19)} THEN 'juneteenth' WHEN d = {observed_sql(7, 4)} THEN 'independence day'
          WHEN d = {nth_sql(9, 1, 1)} THEN 'labor day' WHEN d = {nth_sql(11, 4, 4)} THEN 'thanksgiving' WHEN d = {observed_sql(12, 25)} THEN 'christmas' END AS closure
        FROM (SELECT t.*, e.y, e.easter FROM tape_days t JOIN {EASTER} e ON year(t.d) = e.y)""",
    "tape_days",
)


@query("st_calendar", sql("SELECT d::VARCHAR AS date, closure, closure IS NOT NULL AS closed FROM cal", "cal"))
def _(t: Tables) -> DataFrame:
    days = panels.brand_bars(t).select(F.to_date(F.timestamp_millis("open_time")).alias("date")).distinct()
    return cal.calendar(days).withColumn("date", F.col("date").cast("string"))


# ---------------------------------------------------------------- forward tape fixture

cte(
    "flat",
    """SELECT symbol, open_time AS day, make_timestamp(open_time * 1000)::DATE AS d, dayno, k, w, w_prev, close, prev_close, prev_time, close / prev_close - 1 AS ret, note,
              CASE WHEN note IS NULL AND w <> w_prev THEN (open / prev_close - 1) * 10000 END AS slip, abs(w - w_prev) > 1e-9 AND note IS NULL AS ordered
       FROM (SELECT *, CASE WHEN dayno % 10 = 0 AND k % 2 = 0 THEN 'session_closed' WHEN dayno % 10 = 1 THEN 'session_pending' WHEN k % 11 = 0 AND (dayno // 30) % 3 = 0 THEN 'outage' END AS note
             FROM (SELECT *, open_time // 86400000 AS dayno, (open_time // 86400000) + ascii(right(symbol, 1)) * 7 AS k FROM rule_pw))""",
    "rule_pw",
)
cte(
    "days",
    """SELECT *, CASE WHEN live = n THEN 'full' WHEN closed_n = n - live AND outages = 0 THEN 'closed' WHEN pending_n = n - live AND outages = 0 AND (status = 'market_closed' OR closure IS NOT NULL) THEN 'closed'
              WHEN live > 0 THEN 'partial' ELSE 'dark' END AS kind
       FROM (SELECT f.day, any_value(f.d) AS d, count(*) AS n, count(*) FILTER (note IS NULL) AS live, count(*) FILTER (note = 'session_closed') AS closed_n, count(*) FILTER (note = 'session_pending') AS pending_n,
               count(*) FILTER (note = 'outage') AS outages, sum(CASE WHEN note IS NULL THEN ret ELSE 0 END) / (SELECT count(DISTINCT p_brand) FROM part) AS port_ret, CASE WHEN any_value(dayno) % 30 = 1 THEN 'market_closed' ELSE 'traded' END AS status,
               count(*) FILTER (k % 23 = 0) AS alerts, count(*) FILTER (abs(w - w_prev) > 0.05 AND day - prev_time > 1.5 * 86400000) AS missed FROM flat f GROUP BY 1) JOIN (SELECT day, closure FROM cal) USING (day)""",
    "flat",
    "cal",
)


def tape_flat(t: Tables) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy("open_time")
    rows = rule_weights(t).withColumn("w", F.when(F.col("bar_idx") >= 1, F.col("weight")).otherwise(0.0))
    rows = rows.withColumn("w_prev", F.lag("w", 1, 0.0).over(w)).where("bar_idx >= 1").withColumns(
        {"dayno": day_number(), "k": day_number() + F.ascii(F.substring("symbol", -1, 1)) * 7}
    )
    note = (
        F.when((F.col("dayno") % 10 == 0) & (F.col("k") % 2 == 0), "session_closed").when(F.col("dayno") % 10 == 1, "session_pending")
        .when((F.col("k") % 11 == 0) & (F.floor(F.col("dayno") / 30) % 3 == 0), "outage")
    )
    return rows.withColumn("note", note).withColumn("date", F.to_date(F.timestamp_millis("open_time")))


def forward_tape(t: Tables) -> DataFrame:
    """Session rows with nested assets, orders, outages, alerts and missed fills, built from the panel."""
    rows = tape_flat(t)
    n_assets = t.part.select("p_brand").distinct().count()
    live = F.col("note").isNull()
    moved = F.col("w") != F.col("w_prev")
    slip = F.when(live & moved, (F.col("open") / F.col("prev_close") - 1) * 10000)
    asset = F.struct(F.col("w").alias("weight"), F.col("close").alias("price"), F.col("note").alias("note"), slip.alias("slippage_bps"))
    day, k = F.col("date").cast("string"), F.col("k")
    order = F.struct(
        F.col("symbol").alias("symbol"),
        F.when(F.col("w") > F.col("w_prev"), "BUY").otherwise("SELL").alias("side"),
        F.when(k % 47 == 0, "garbage").otherwise(F.concat(F.date_sub("date", 1).cast("string"), F.lit("T21:00:00+00:00"))).alias("signal_generated_ts"),
        F.when(k % 53 == 0, F.lit(None)).when(k % 43 == 0, "2055-01-01T00:00:00Z").otherwise(F.concat(day, F.lit("T00:30:00Z"))).alias("intent_ts"),
        F.concat(day, F.when(k % 37 == 0, "T00:31:00").otherwise("T00:31:00Z")).alias("submitted_ts"),
        F.concat(day, F.when(k % 41 == 0, "T00:10:00Z").otherwise("T00:32:00Z")).alias("fill_ts"),
        (F.col("w") - F.col("w_prev")).alias("qty_weight_delta"),
    )
    ordered = live & (F.abs(F.col("w") - F.col("w_prev")) > 1e-9)
    late = (F.abs(F.col("w") - F.col("w_prev")) > 0.05) & (F.col("open_time") - F.col("prev_time") > 1.5 * 86_400_000)
    version = F.when(F.max("dayno") % 20 == 1, "v2").otherwise("v3")
    stamp = F.when(F.max("dayno") % 20 != 0, F.struct(version.alias("experiment_version"), F.when(F.max("dayno") % 40 != 2, "self-financing").otherwise("legacy").alias("accounting_model")))
    return rows.groupBy("date").agg(
        F.map_from_entries(F.collect_list(F.struct("symbol", asset.alias("a")))).alias("assets"),
        F.collect_list(F.when(ordered, order)).alias("orders"),
        F.collect_list(F.when(F.col("note") == "outage", F.struct("symbol", F.lit("no bar").alias("problem")))).alias("outages"),
        F.collect_list(F.when(k % 23 == 0, F.struct("symbol", F.when(k % 2 == 0, "stale").otherwise("warning").alias("level")))).alias("alerts"),
        F.collect_list(F.when(late, F.struct("symbol", F.floor((F.col("open_time") - F.col("prev_time")) / 86_400_000).alias("delayed_days")))).alias("missed_fills"),
        (F.sum(F.when(live, F.col("close") / F.col("prev_close") - 1).otherwise(0.0)) / F.lit(float(n_assets))).alias("port_ret"),
        F.when(F.max("dayno") % 30 == 1, "market_closed").otherwise("traded").alias("day_status"),
        stamp.alias("experiment"),
    )


def month_of(c):
    return F.date_format(c, "yyyy-MM")


@query("agg_day_quality", sql("SELECT strftime(d, '%Y-%m') AS month, kind, count(*) AS n FROM days GROUP BY 1, 2", "days"))
def _(t: Tables) -> DataFrame:
    tape = forward_tape(t)
    return tape.select(month_of("date").alias("month"), ts.day_kind(F.col("date")).alias("kind")).groupBy("month", "kind").agg(F.count(F.lit(1)).alias("n"))


cte("fdays", "SELECT strftime(d, '%Y-%m') AS month, d AS day, port_ret AS ret, kind, date_trunc('month', d)::DATE - 1 AS anchor FROM days", "days")


def _fp_sql() -> str:
    from .signals import summary_sql

    core = summary_sql("fdays", "month", 365, 0.0, "count(ret)", "day", ", count(*) FILTER (kind = 'dark') AS dark, count(*) FILTER (kind IN ('partial', 'dark')) AS bad, max(day) AS last, min(anchor) AS anchor")
    return f"SELECT *, CASE WHEN n > 0 AND last > anchor THEN 365.2425::DOUBLE * n / (last - anchor) END AS ppy FROM ({core})"


cte("fp", _fp_sql(), "fdays")
cte(
    "fperf",
    """SELECT month, n, CASE WHEN dark < n THEN final - 1 END AS ret, CASE WHEN dark < n THEN max_drawdown END AS max_drawdown, CASE WHEN dark < n THEN ppy END AS periods_per_year,
         CASE WHEN dark = n THEN 'unmeasured' WHEN n < 2 THEN 'fewer than two rows' WHEN bad > 0 THEN 'degraded' WHEN ppy IS NULL THEN 'unknown cadence' END AS sharpe_reason,
         CASE WHEN dark < n AND n >= 2 AND bad = 0 THEN CASE WHEN sd_ = 0 THEN 0 ELSE mean_ / sd_ * sqrt(greatest(1, round_even(ppy, 0))) END END AS sharpe FROM fp""",
    "fp",
)
PERF = ["ret", "max_drawdown", "periods_per_year", "sharpe"]


def monthly_performance(t: Tables) -> DataFrame:
    tape = forward_tape(t)
    days = tape.select(month_of("date").alias("month"), "date", "port_ret", ts.day_kind(F.col("date")).alias("kind"), F.date_sub(F.trunc("date", "month"), 1).alias("frozen"))
    return ts.forward_performance(days, ["month"], "frozen")


@query("agg_forward_performance", sql(f"SELECT month, n, sharpe_reason, {', '.join(r(c, c, 5) for c in PERF)} FROM fperf", "fperf"))
def _(t: Tables) -> DataFrame:
    return monthly_performance(t).select("month", "n", "sharpe_reason", *[rd(c, 5).alias(c) for c in PERF])


@query("agg_outages", sql("SELECT strftime(d, '%Y-%m') AS month, count(*) FILTER (outages > 0) AS outage_days, sum(outages)::BIGINT AS outage_events, sum(missed)::BIGINT AS missed_fills FROM days GROUP BY 1", "days"))
def _(t: Tables) -> DataFrame:
    return forward_tape(t).groupBy(month_of("date").alias("month")).agg(
        F.count(F.when(F.size("outages") > 0, 1)).alias("outage_days"), F.sum(F.size("outages")).alias("outage_events"), F.sum(F.size("missed_fills")).alias("missed_fills")
    )


@query("agg_alerts", sql("SELECT CASE WHEN k % 2 = 0 THEN 'stale' ELSE 'warning' END AS level, count(*) AS total, count(DISTINCT symbol) AS symbols FROM flat WHERE k % 23 = 0 GROUP BY 1", "flat"))
def _(t: Tables) -> DataFrame:
    rows = forward_tape(t).select(F.explode("alerts").alias("a"))
    return rows.groupBy(F.col("a.level").alias("level")).agg(F.count(F.lit(1)).alias("total"), F.countDistinct("a.symbol").alias("symbols"))


cte(
    "orders_flat",
    """SELECT *, list_filter([CASE WHEN k % 47 <> 0 THEN d::TIMESTAMP - INTERVAL 3 HOUR END, CASE WHEN k % 53 = 0 THEN NULL WHEN k % 43 = 0 THEN TIMESTAMP '2055-01-01' ELSE d::TIMESTAMP + INTERVAL 30 MINUTE END,
              CASE WHEN k % 37 <> 0 THEN d::TIMESTAMP + INTERVAL 31 MINUTE END, CASE WHEN k % 41 = 0 THEN d::TIMESTAMP + INTERVAL 10 MINUTE ELSE d::TIMESTAMP + INTERVAL 32 MINUTE END], lambda x: x IS NOT NULL) AS stamps,
              k % 43 = 0 AND k % 53 <> 0 AS far FROM flat WHERE ordered""",
    "flat",
)
cte("order_problems", "SELECT *, list_filter([CASE WHEN k % 37 = 0 THEN 'naive timezone' END, CASE WHEN k % 47 = 0 THEN 'unparseable' END, CASE WHEN list_sort(stamps) <> stamps THEN 'out of order' END, CASE WHEN far THEN 'intent far from session' END], lambda x: x IS NOT NULL) AS problems FROM orders_flat", "orders_flat")


@query("au_lifecycle", sql("SELECT reason, count(*) AS n, array_to_string(list_sort(list(DISTINCT d::VARCHAR || ':' || symbol))[1:5], ',') AS examples FROM (SELECT d, symbol, unnest(problems) AS reason FROM order_problems) GROUP BY 1", "order_problems"))
def _(t: Tables) -> DataFrame:
    return ts.lifecycle_audit(forward_tape(t)).withColumn("examples", F.array_join("examples", ","))


@query("au_trusted_orders", sql("SELECT symbol, count(*) AS n_orders, count(*) FILTER (len(problems) = 0) AS n_trusted FROM order_problems GROUP BY 1", "order_problems"))
def _(t: Tables) -> DataFrame:
    rows = ts.exploded_orders(forward_tape(t))
    return rows.groupBy(F.col("order.symbol").alias("symbol")).agg(F.count(F.lit(1)).alias("n_orders"), F.count(F.when(F.size("problems") == 0, 1)).alias("n_trusted"))


cte("slips", "SELECT * FROM flat WHERE slip IS NOT NULL AND d NOT IN (SELECT d FROM order_problems WHERE len(problems) > 0)", "flat", "order_problems")


@query("agg_slippage", sql(f"SELECT symbol, count(*) AS n, {r('avg(abs(slip))', 'mean_abs_bps')} FROM slips GROUP BY 1", "slips"))
def _(t: Tables) -> DataFrame:
    return ts.usable_observations(forward_tape(t)).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), rd(F.avg(F.abs("slippage_bps"))).alias("mean_abs_bps"))


BUCKET_SQL = "CASE WHEN slip IS NULL THEN 'unknown' WHEN abs(slip) < 1 THEN '0-1bps' WHEN abs(slip) < 5 THEN '1-5bps' WHEN abs(slip) < 10 THEN '5-10bps' WHEN abs(slip) < 25 THEN '10-25bps' ELSE '25bps+' END"


@query(
    "agg_gap_distribution",
    sql(
        f"""SELECT b.bucket, coalesce(g.n, 0) AS n, s.* FROM (VALUES ('0-1bps'), ('1-5bps'), ('5-10bps'), ('10-25bps'), ('25bps+'), ('unknown')) b(bucket)
            LEFT JOIN (SELECT {BUCKET_SQL} AS bucket, count(*) AS n FROM flat GROUP BY 1) g USING (bucket),
            (SELECT {r('avg(abs(slip))', 'mean_abs')}, {r('quantile_cont(slip, 0.5)', 'p50', 3)}, {r('quantile_cont(slip, 0.9)', 'p90', 3)}, {r('max(abs(slip))', 'largest', 3)} FROM flat WHERE slip IS NOT NULL) s""",
        "flat",
    ),
)
def _(t: Tables) -> DataFrame:
    rows = forward_tape(t).select(F.explode("assets").alias("symbol", "a")).select(F.col("a.slippage_bps").alias("slip"))
    names = [*[b for _, b in ts.BUCKETS], ts.LAST_BUCKET, ts.UNKNOWN]
    dim = t.spark.createDataFrame([(b,) for b in names], "bucket string")
    counts = rows.groupBy(ts.bucket(F.col("slip")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    stats = rows.where("slip is not null").agg(
        rd(F.avg(F.abs("slip"))).alias("mean_abs"), rd(F.percentile("slip", F.lit(0.5)), 3).alias("p50"), rd(F.percentile("slip", F.lit(0.9)), 3).alias("p90"), rd(F.max(F.abs("slip")), 3).alias("largest"),
    )
    return dim.join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n")).crossJoin(F.broadcast(stats))  # one statistics row


cte(
    "stamped",
    """SELECT d, CASE WHEN any_value(dayno) % 20 <> 0 THEN CASE WHEN any_value(dayno) % 20 = 1 THEN 'v2' ELSE 'v3' END END AS version, CASE WHEN any_value(dayno) % 20 <> 0 THEN CASE WHEN any_value(dayno) % 40 <> 2 THEN 'self-financing' ELSE 'legacy' END END AS model
       FROM flat GROUP BY 1""",
    "flat",
)


@query(
    "au_scope_rows",
    sql(
        """SELECT coalesce(CASE WHEN d <= DATE '1997-01-01' THEN 'on or before the freeze date' WHEN version IS NULL THEN 'no experiment stamp' WHEN version <> 'v3' THEN 'experiment_version differs'
             WHEN model <> 'self-financing' THEN 'accounting_model differs' END, 'kept') AS reason, count(*) AS n FROM stamped GROUP BY 1""",
        "stamped",
    ),
)
def _(t: Tables) -> DataFrame:
    tape = forward_tape(t).withColumn("date", F.col("date").cast("string"))
    reason = au.scope_reason({"experiment_version": "v3", "accounting_model": "self-financing"}, "1997-01-01")
    return tape.groupBy(F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "au_same_experiment",
    sql(
        """SELECT month, versions, models, versions > 1 OR models > 1 AS mixed FROM (SELECT strftime(d, '%Y-%m') AS month, count(DISTINCT version) AS versions, count(DISTINCT model) AS models FROM stamped GROUP BY 1)""",
        "stamped",
    ),
)
def _(t: Tables) -> DataFrame:
    e = F.col("experiment")
    out = forward_tape(t).groupBy(month_of("date").alias("month")).agg(F.countDistinct(e["experiment_version"]).alias("versions"), F.countDistinct(e["accounting_model"]).alias("models"))
    return out.withColumn("mixed", (F.col("versions") > 1) | (F.col("models") > 1))


@query(
    "au_accounting_model",
    sql("SELECT coalesce(CASE WHEN version = 'v3' THEN model END, CASE WHEN version IN ('v2', 'v3') THEN 'self-financing' ELSE 'legacy' END) AS model, version, count(*) AS n FROM stamped GROUP BY 1, 2", "stamped"),
)
def _(t: Tables) -> DataFrame:
    e = F.col("experiment")
    version = e["experiment_version"]
    model = au.accounting_model(version, F.when(version == "v3", e["accounting_model"]))  # only v3 rows carry the stamp
    return forward_tape(t).groupBy(model.alias("model"), version.alias("version")).agg(F.count(F.lit(1)).alias("n"))


cte("doubled", "SELECT d, n, kind, outages, day FROM days UNION ALL SELECT d, n, kind, outages, day + 1 FROM days WHERE (day // 86400000) % 50 = 0", "days")


def doubled_tape(t: Tables) -> DataFrame:
    """The tape with every 50th session recorded twice."""
    tape = forward_tape(t)
    seq = F.unix_date("date").cast("bigint") * 86_400_000
    again = tape.where(F.unix_date("date") % 50 == 0).withColumn("seq", seq + 1)
    return tape.withColumn("seq", seq).unionByName(again)


@query(
    "agg_log_profile",
    sql(
        """SELECT year, count(*) AS n_rows, count(DISTINCT d) AS n_dates, count(*) - count(DISTINCT d) AS duplicates, true AS sorted, min(d)::VARCHAR AS first_date, max(d)::VARCHAR AS last_date FROM (SELECT *, year(d) AS year FROM doubled) GROUP BY 1""",
        "doubled",
    ),
)
def _(t: Tables) -> DataFrame:
    rows = doubled_tape(t).select(F.year("date").cast("bigint").alias("year"), F.col("date").cast("string").alias("date"), "seq")
    return au.log_profile(rows, ["year"], "seq", "date", F.floor(F.col("seq") / (366 * 86_400_000)).cast("bigint"))


@query(
    "agg_quality_score",
    sql(
        """SELECT month, partial, outage_days, duplicates, malformed, missing_snapshots, greatest(0.0, least(100.0, 100.0 - 5 * partial - 10 * outage_days - 5 * duplicates - 10 * malformed - 5 * missing_snapshots))::DOUBLE AS score,
             list_filter([CASE WHEN malformed > 0 THEN 'malformed_rows' END, CASE WHEN duplicates > 0 THEN 'duplicate_timestamps' END, CASE WHEN missing_snapshots > 0 THEN 'missing_universe_snapshots' END], lambda x: x IS NOT NULL)::VARCHAR AS problems
           FROM (SELECT strftime(d, '%Y-%m') AS month, count(*) FILTER (kind = 'partial') AS partial, count(*) FILTER (outages > 0) AS outage_days, count(*) - count(DISTINCT d) AS duplicates, count(*) FILTER (n < 5) AS malformed,
                   count(DISTINCT d) - count(DISTINCT s.day) AS missing_snapshots FROM doubled LEFT JOIN (SELECT DISTINCT day FROM snap_members) s ON epoch_ms(d::TIMESTAMP) = s.day GROUP BY 1)""",
        "doubled",
        "snap_members",
    ),
)
def _(t: Tables) -> DataFrame:
    from .universe import snapshot_table

    snaps = snapshot_table(t).select("day").distinct().withColumn("seen", F.lit(1))
    tape = doubled_tape(t).withColumns({"kind": ts.day_kind(F.col("date")), "day": F.unix_date("date").cast("bigint") * 86_400_000})
    joined = tape.join(snaps, "day", "left")
    agg = joined.groupBy(month_of("date").alias("month")).agg(
        F.count(F.when(F.col("kind") == "partial", 1)).alias("partial"), F.count(F.when(F.size("outages") > 0, 1)).alias("outage_days"),
        (F.count(F.lit(1)) - F.countDistinct("date")).alias("duplicates"), F.count(F.when(F.size("assets") < 5, 1)).alias("malformed"),
        (F.countDistinct("date") - F.countDistinct(F.when(F.col("seen") == 1, F.col("day")))).alias("missing_snapshots"),
    )
    score = ts.quality_score(*[F.col(c) for c in ("partial", "outage_days", "duplicates", "malformed", "missing_snapshots")], F.lit(False), F.lit(False))
    problems = F.array_compact(
        F.array(F.when(F.col("malformed") > 0, "malformed_rows"), F.when(F.col("duplicates") > 0, "duplicate_timestamps"), F.when(F.col("missing_snapshots") > 0, "missing_universe_snapshots"))
    )
    return agg.withColumns({"score": score, "problems": F.concat(F.lit("["), F.array_join(problems, ", "), F.lit("]"))})


@query(
    "agg_forward_summary",
    sql(
        f"""SELECT strftime(d, '%Y') AS year, count(*) FILTER (kind = 'full') AS full_days, count(*) FILTER (kind = 'partial') AS partial_days, count(*) FILTER (kind = 'dark') AS dark_days, count(*) FILTER (kind = 'closed') AS closed_days,
              count(*) FILTER (outages > 0) AS outage_days, sum(outages)::BIGINT AS outage_events, {r('product(1 + port_ret) - 1', 'ret')}, min(d)::VARCHAR AS first_date, max(d)::VARCHAR AS last_date, any_value(bad) AS flagged_orders
            FROM days LEFT JOIN (SELECT strftime(d, '%Y') AS y, count(*) FILTER (len(problems) > 0) AS bad FROM order_problems GROUP BY 1) o ON strftime(d, '%Y') = o.y GROUP BY 1""",
        "days",
        "order_problems",
    ),
)
def _(t: Tables) -> DataFrame:
    tape = forward_tape(t)
    year = F.date_format("date", "yyyy")
    days = tape.withColumn("kind", ts.day_kind(F.col("date")))

    def kind(name: str):
        return F.count(F.when(F.col("kind") == name, 1)).alias(f"{name}_days")

    agg = days.groupBy(year.alias("year")).agg(
        kind("full"), kind("partial"), kind("dark"), kind("closed"), F.count(F.when(F.size("outages") > 0, 1)).alias("outage_days"), F.sum(F.size("outages")).alias("outage_events"),
        rd(F.product(F.col("port_ret") + 1.0) - 1.0).alias("ret"), F.min("date").cast("string").alias("first_date"), F.max("date").cast("string").alias("last_date"),
    )
    flagged = ts.exploded_orders(tape).groupBy(year.alias("year")).agg(F.count(F.when(F.size("problems") > 0, 1)).alias("flagged_orders"))
    return agg.join(flagged, "year", "left")


@query(
    "st_order_events",
    sql(f"SELECT symbol, day, CASE WHEN w > w_prev THEN 'BUY' ELSE 'SELL' END AS side, {r('w - w_prev', 'delta')} FROM flat WHERE ordered", "flat"),
)
def _(t: Tables) -> DataFrame:
    o = forward_tape(t).select("date", F.explode("orders").alias("o"))
    return o.select(F.col("o.symbol").alias("symbol"), (F.unix_date("date").cast("bigint") * 86_400_000).alias("day"), F.col("o.side").alias("side"), rd("o.qty_weight_delta").alias("delta"))


@query(
    "st_missed_fill",
    sql("SELECT symbol, day, (day - prev_time) // 86400000 AS delayed_days FROM flat WHERE abs(w - w_prev) > 0.05 AND day - prev_time > 1.5 * 86400000", "flat"),
)
def _(t: Tables) -> DataFrame:
    m = forward_tape(t).select("date", F.explode("missed_fills").alias("m"))
    return m.select(F.col("m.symbol").alias("symbol"), (F.unix_date("date").cast("bigint") * 86_400_000).alias("day"), F.col("m.delayed_days").alias("delayed_days"))


@query("st_liveness", sql("SELECT symbol, max(d)::VARCHAR AS last_date, DATE '2001-11-10' - max(d) AS age_days, DATE '2001-11-10' - max(d) > 7 AS stalled FROM flat WHERE note IS NULL GROUP BY 1", "flat"))
def _(t: Tables) -> DataFrame:
    rows = forward_tape(t).select("date", F.explode("assets").alias("symbol", "a")).where("a.note is null")
    age = F.datediff(F.lit("2001-11-10").cast("date"), F.max("date")).cast("bigint")
    return rows.groupBy("symbol").agg(F.max("date").cast("string").alias("last_date"), age.alias("age_days"), (age > 7).alias("stalled"))


# ---------------------------------------------------------------- cost evidence

cte(
    "ev",
    """SELECT *, seq0 * 10 + copy AS seq, (seq0 * 10 + copy) AS row_id FROM (SELECT CASE WHEN k % 17 = 0 THEN NULL WHEN k % 29 = 0 THEN 'FAKE' ELSE symbol END AS symbol, CASE WHEN k % 19 = 0 THEN 'HOLD' ELSE side END AS side,
         make_timestamp(open_time * 1000)::DATE AS d, open_time, k, turnover, CASE WHEN k % 23 = 0 THEN -1.0 ELSE decision_close END AS decision_close, exec_price, (open_time // 86400000) * 1000 + substr(symbol, 7)::BIGINT AS seq0
       FROM (SELECT *, (open_time // 86400000) + ascii(right(symbol, 1)) * 7 AS k FROM obs)), (VALUES (0), (1)) c(copy) WHERE copy = 0 OR k % 13 = 0""",
    "obs",
)
EV_REASON = """CASE WHEN symbol IS NULL OR side = 'HOLD' THEN 'missing_data' WHEN decision_close <= 0 THEN 'invalid_numeric' WHEN symbol = 'FAKE' THEN 'fixture_test' WHEN k % 31 <> 0 AND d < DATE '1997-01-01' THEN 'wrong_freeze'
   WHEN k % 31 = 0 OR k % 37 = 0 OR d >= DATE '2001-06-01' THEN 'bad_timestamps' END"""
cte("ev_early", f"SELECT *, {EV_REASON} AS early FROM ev", "ev")
cte("ev_class", "SELECT *, coalesce(early, CASE WHEN row_number() OVER (PARTITION BY early IS NULL, d, symbol, side, turnover, decision_close, exec_price ORDER BY seq) > 1 THEN 'replay' END, '') AS reason FROM ev_early", "ev_early")


def evidence_rows(t: Tables) -> DataFrame:
    """Cost observations as tape rows with stamps; several kinds of damage and exact copies by day number."""
    day = F.to_date(F.timestamp_millis("open_time"))
    k = day_number() + F.ascii(F.substring("symbol", -1, 1)) * 7
    rows = observations(t).withColumns({"k": k, "d": day, "num": F.substring("symbol", 7, 5).cast("bigint")})
    text = F.col("d").cast("string")
    base = rows.select(
        F.when(F.col("k") % 17 == 0, F.lit(None)).when(F.col("k") % 29 == 0, "FAKE").otherwise(F.col("symbol")).alias("symbol"),
        F.when(F.col("k") % 19 == 0, "HOLD").otherwise(F.col("side")).alias("side"),
        F.concat(text, F.when(F.col("k") % 31 == 0, "T00:32:00").otherwise("T00:32:00Z")).alias("ts"),
        F.concat(F.when(F.col("k") % 37 == 0, F.date_add("d", 2).cast("string")).otherwise(text), F.lit("T00:00:00Z")).alias("signal_ts"),
        "turnover", "target_weight", "previous_weight", F.when(F.col("k") % 23 == 0, -1.0).otherwise(F.col("decision_close")).alias("decision_close"), "exec_price",
        F.lit(20.0).alias("predicted_cost_bps"), "observed_cost_proxy_bps", "k", "d",
        (day_number() * 10_000 + F.col("num") * 10).alias("seq"),
        F.when(F.col("k") % 5 == 0, "fixture").when(F.col("k") % 7 == 0, F.lit(None)).otherwise("forward-paper").alias("evidence_class"),
        F.when(F.col("k") % 3 == 0, "freeze/old").otherwise("freeze/1997-01-01").alias("freeze_id"),
        F.lit("c0ffee").alias("commit"), F.lit("f00d").alias("code"), F.when(F.col("k") % 11 != 0, "run-1").alias("run_id"), F.lit("forward-runner").alias("source"),
    )
    copies = F.explode(F.sequence(F.lit(0), F.when(F.col("k") % 13 == 0, 1).otherwise(0)))
    return base.withColumn("copy", copies).withColumn("seq", F.col("seq") + F.col("copy")).drop("copy")


def utc(text: str):
    return F.to_timestamp(F.lit(text))


NOW, FROZEN = "2001-06-01 00:00:00", "1997-01-01 00:00:00"


def brand_universe(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_brand").alias("symbol")).distinct()


CLASS_SQL = "CASE reason WHEN '' THEN 'forward-paper' WHEN 'replay' THEN 'replay' WHEN 'fixture_test' THEN 'fixture' WHEN 'wrong_freeze' THEN 'historical-sim' ELSE 'invalid' END"


@query("au_classify_evidence", sql(f"SELECT {CLASS_SQL} AS class, reason, count(*) AS n, sum(seq)::BIGINT AS seq_sum FROM ev_class GROUP BY 1, 2", "ev_class"))
def _(t: Tables) -> DataFrame:
    out = au.classify(evidence_rows(t), brand_universe(t), utc(FROZEN), utc(NOW))
    return out.groupBy("class", "reason").agg(F.count(F.lit(1)).alias("n"), F.sum("seq").alias("seq_sum"))


@query(
    "au_missing_fields",
    sql("SELECT problem, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN symbol IS NULL THEN 'symbol' END, CASE WHEN side = 'HOLD' THEN 'side' END], lambda x: x IS NOT NULL)) AS problem FROM ev) GROUP BY 1", "ev"),
)
def _(t: Tables) -> DataFrame:
    return evidence_rows(t).select(F.explode(au.missing_problems()).alias("problem")).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


@query("au_numeric", sql("SELECT 'invalid decision_close' AS problem, count(*) AS n FROM ev WHERE decision_close <= 0", "ev"))
def _(t: Tables) -> DataFrame:
    return evidence_rows(t).select(F.explode(au.numeric_problems()).alias("problem")).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


@query(
    "au_temporal",
    sql(
        """SELECT problem, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN k % 31 = 0 THEN 'unparseable ts' END, CASE WHEN k % 31 <> 0 AND d >= DATE '2001-06-01' THEN 'future ts' END,
             CASE WHEN k % 31 <> 0 AND k % 37 = 0 THEN 'signal after execution' END], lambda x: x IS NOT NULL)) AS problem FROM ev) GROUP BY 1""",
        "ev",
    ),
)
def _(t: Tables) -> DataFrame:
    return evidence_rows(t).select(F.explode(au.temporal_problems(utc(NOW))).alias("problem")).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


cte(
    "ver_early",
    """SELECT *, CASE WHEN k % 5 = 0 THEN 'fixture_test' WHEN k % 7 = 0 THEN 'other_class' WHEN symbol IS NULL OR symbol = 'FAKE' THEN 'fixture_test' WHEN k % 3 = 0 THEN 'wrong_freeze' WHEN k % 11 = 0 THEN 'missing_data'
              WHEN k % 31 = 0 OR (CASE WHEN k % 37 = 0 THEN d + 2 ELSE d END) <= DATE '1997-01-01' OR d <= DATE '1997-01-01' THEN 'wrong_freeze' END AS early FROM ev""",
    "ev",
)
cte(
    "ver",
    """SELECT coalesce(early, CASE WHEN rn > 1 THEN 'replay' WHEN side = 'HOLD' THEN 'missing_data' WHEN decision_close <= 0 THEN 'invalid_numeric' WHEN k % 37 = 0 OR d >= DATE '2001-06-01' THEN 'bad_timestamps' WHEN turnover <= 1e-9 THEN 'no_turnover' END, 'verified') AS exclusion
       FROM (SELECT *, row_number() OVER (PARTITION BY early IS NULL, d, symbol, side, turnover, decision_close, exec_price ORDER BY seq) AS rn FROM ver_early)""",
    "ver_early",
)


@query("au_verified_rows", sql("SELECT exclusion, count(*) AS n FROM ver GROUP BY 1", "ver"))
def _(t: Tables) -> DataFrame:
    out = au.verified(evidence_rows(t), brand_universe(t), "freeze/1997-01-01", "c0ffee", "f00d", utc(FROZEN), "1997-01-01", utc(NOW))
    return out.groupBy(F.coalesce("exclusion", F.lit("verified")).alias("exclusion")).agg(F.count(F.lit(1)).alias("n"))


cte(
    "calib",
    """SELECT symbol, count(*) AS n, avg(proxy) AS obs, avg(drift) AS drift, avg(abs(drift)) AS abs_drift, avg(quoted_spread_bps) AS spread FROM obs WHERE turnover > 1e-9 AND proxy IS NOT NULL GROUP BY 1""",
    "obs",
)


@query(
    "agg_cost_calibration",
    sql(
        f"""SELECT symbol, n, n >= 30 AS sufficient, 20.0::DOUBLE AS predicted_bps, {r('10 + obs', 'observed_total_bps', 4)}, {r('10 + obs - 20', 'error_bp', 4)}, {r('(10 + obs) / 20', 'ratio', 5)}, {r('abs_drift', 'mean_abs_drift', 4)},
              {r('spread', 'mean_spread', 4)}, CASE WHEN n >= 30 THEN 'proposed' ELSE 'insufficient_data' END AS status FROM calib""",
        "calib",
    ),
)
def _(t: Tables) -> DataFrame:
    rows = observations(t).where((F.col("turnover") > 1e-9) & F.col("observed_cost_proxy_bps").isNotNull())
    return cost_calibration(rows, ["symbol"], 10.0, 5.0, 5.0)


def cost_calibration(rows: DataFrame, keys: list[str], fee_bps: float, spread_bps: float, slip_bps: float, minimum: int = 30) -> DataFrame:
    """Predicted against observed friction per key; the proposal is deferred below `minimum` events."""
    predicted = fee_bps + spread_bps + slip_bps
    agg = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg("observed_cost_proxy_bps").alias("obs"), F.avg(F.abs("decision_to_exec_drift_bps")).alias("absd"), F.avg("quoted_spread_bps").alias("spread")
    )
    total = F.lit(fee_bps) + F.col("obs")
    return agg.select(
        *keys, "n", (F.col("n") >= minimum).alias("sufficient"), F.lit(predicted).alias("predicted_bps"), rd(total, 4).alias("observed_total_bps"), rd(total - predicted, 4).alias("error_bp"),
        rd(total / predicted, 5).alias("ratio"), rd("absd", 4).alias("mean_abs_drift"), rd("spread", 4).alias("mean_spread"), F.when(F.col("n") >= minimum, "proposed").otherwise("insufficient_data").alias("status"),
    )


# ---------------------------------------------------------------- ledger

CATEGORY = "CASE event_type WHEN 'purchase' THEN 'strategy' WHEN 'click' THEN 'portfolio' WHEN 'signup' THEN 'execution' WHEN 'view' THEN 'universe' ELSE 'methodology' END"
cte("led0", f"SELECT event_id + 1 AS id, event_id, (epoch_us(ts) // 1000)::VARCHAR AS timestamp, {CATEGORY} AS category, round(value * 100)::BIGINT AS cents, event_id % 4 = 0 AS accepted FROM events")
SEGMENT = 64  # entries of one chain of the fixture; the first has no link


def body_sql(link: str) -> str:
    """The whole entry but its hash as JSON, fields sorted, NULLs kept."""
    return f"""'{{"accepted":' || accepted || ',"category":"' || category || '","cents":' || cents || ',"id":' || id || ',"prev_hash":' || coalesce('"' || {link} || '"', 'null') || ',"timestamp":"' || timestamp || '"}}'"""


cte(
    "led1",
    f"""SELECT *, NULL::VARCHAR AS link, sha256({body_sql('NULL')}) AS hash FROM led0 WHERE (id - 1) % {SEGMENT} = 0 UNION ALL -- recursive
        SELECT *, sha256({body_sql('link')}) AS hash FROM (SELECT l.*, c.hash AS link FROM led1 c JOIN led0 l ON l.id = c.id + 1 WHERE (l.id - 1) % {SEGMENT} <> 0)""",
    "led0",
)
cte(
    "ledger",
    """SELECT id, timestamp, category, CASE WHEN event_id % 997 = 5 THEN cents + 1 ELSE cents END AS cents, accepted, hash, CASE WHEN event_id % 1009 = 7 THEN 'x' WHEN event_id % 1013 = 9 THEN NULL ELSE link END AS prev_hash, event_id FROM led1""",
    "led1",
)
cte("ledger_cut", "SELECT * FROM ledger WHERE event_id % 1511 <> 3", "ledger")


def body(entry=None, link=None):
    """The whole entry but its hash as JSON, fields sorted, NULLs kept; of a row or of a struct and a given link."""
    fields = {c: F.col(c) if entry is None else entry[c] for c in ("accepted", "category", "cents", "id", "timestamp")}
    fields["prev_hash"] = F.col("prev_hash") if entry is None else link
    return F.to_json(F.struct(*[fields[c].alias(c) for c in sorted(fields)]), {"ignoreNullFields": "false"})


def ledger_base(t: Tables) -> DataFrame:
    category = (
        F.when(F.col("event_type") == "purchase", "strategy").when(F.col("event_type") == "click", "portfolio").when(F.col("event_type") == "signup", "execution")
        .when(F.col("event_type") == "view", "universe").otherwise("methodology")
    )
    return t.events.select(
        (F.col("event_id") + 1).alias("id"), "event_id", F.unix_millis(F.col("ts").cast("timestamp")).cast("string").alias("timestamp"), category.alias("category"),
        F.round(F.col("value") * 100).cast("bigint").alias("cents"), (F.col("event_id") % 4 == 0).alias("accepted"), "value",
    )


def ledger(t: Tables) -> DataFrame:
    """Events as hash chains of SEGMENT entries, then edited rows, broken and blanked links and removed rows by id."""
    base = ledger_base(t)
    segment = base.groupBy(F.floor((F.col("id") - 1) / SEGMENT).alias("segment")).agg(F.array_sort(F.collect_list(F.struct("id", *[c for c in base.columns if c != "id"]))).alias("entries"))

    def step(acc, e):
        digest = F.sha2(body(e, acc["link"]), 256)
        return F.struct(digest.alias("link"), F.concat(acc["out"], F.array(F.struct(acc["link"].alias("link"), digest.alias("hash")))).alias("out"))

    none = F.struct(F.lit(None).cast("string").alias("link"), F.array().cast("array<struct<link:string,hash:string>>").alias("out"))
    chained = segment.withColumn("chain", F.aggregate("entries", none, step)["out"]).select(F.explode(F.arrays_zip("entries", "chain")).alias("z"))
    linked = chained.select("z.entries.*", "z.chain.link", "z.chain.hash")
    e = F.col("event_id")
    prev = F.when(e % 1009 == 7, "x").when(e % 1013 == 9, F.lit(None)).otherwise(F.col("link"))
    edited = F.when(e % 997 == 5, F.col("cents") + 1).otherwise(F.col("cents"))
    return linked.withColumns({"prev_hash": prev, "cents": edited}).where(e % 1511 != 3).drop("link")


CHAIN = """SELECT id, category, id <> coalesce(lag(id) OVER w, 0) + 1 AS gap, coalesce(timestamp < lag(timestamp) OVER w, false) AS regression, hash <> sha256(""" + body_sql("prev_hash") + """) AS edited,
   prev_hash IS NOT NULL AND prev_hash IS DISTINCT FROM lag(hash) OVER w AS broken_link FROM ledger_cut WINDOW w AS (ORDER BY id)"""


@query("au_hash_chain", sql(f"SELECT * FROM ({CHAIN}) WHERE gap OR regression OR edited OR broken_link", "ledger_cut"))
def _(t: Tables) -> DataFrame:
    out = au.hash_chain(ledger(t), seq_chunk("id"), body())
    return out.where("gap or regression or edited or broken_link").select("id", "category", "gap", "regression", "edited", "broken_link")


SEARCH = ["strategy", "portfolio", "execution", "universe"]


@query(
    "agg_rollup_category",
    sql("SELECT coalesce(category, 'ALL') AS category, coalesce(accepted::VARCHAR, 'any') AS accepted, count(*) AS n, count(*) FILTER (category IN ('strategy', 'portfolio', 'execution', 'universe')) AS search_n FROM led0 GROUP BY ROLLUP (category, accepted)", "led0"),
)
def _(t: Tables) -> DataFrame:
    rows = ledger_base(t).withColumn("search", F.col("category").isin(SEARCH).cast("int"))
    out = rows.rollup("category", "accepted").agg(F.count(F.lit(1)).alias("n"), F.sum("search").alias("search_n"))
    return out.select(F.coalesce("category", F.lit("ALL")).alias("category"), F.coalesce(F.col("accepted").cast("string"), F.lit("any")).alias("accepted"), "n", "search_n")


@query(
    "agg_recommended_trials",
    sql("SELECT substr(strftime(make_timestamp(timestamp::BIGINT * 1000), '%Y-%m-%d'), 1, 10) AS day, greatest(1, count(*) FILTER (category <> 'methodology')) AS trials FROM led0 GROUP BY 1", "led0"),
)
def _(t: Tables) -> DataFrame:
    day = F.date_format(F.timestamp_millis(F.col("timestamp").cast("bigint")), "yyyy-MM-dd")
    return ledger_base(t).groupBy(day.alias("day")).agg(F.greatest(F.lit(1), F.count(F.when(F.col("category").isin(SEARCH), 1))).alias("trials"))


@query(
    "agg_breadth",
    sql("SELECT count(*) AS dimensions, max(n) AS effective_trials, round(log10(product(n)), 6) + 0.0 AS log10_naive_product FROM (SELECT category, count(*) AS n FROM led0 WHERE category <> 'methodology' GROUP BY 1)", "led0"),
)
def _(t: Tables) -> DataFrame:
    dims = ledger_base(t).where(F.col("category").isin(SEARCH)).groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    return dims.agg(F.count(F.lit(1)).alias("dimensions"), F.max("n").alias("effective_trials"), rd(F.log10(F.product("n"))).alias("log10_naive_product"))


@query(
    "au_ledger_fields",
    sql(
        """SELECT problem, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN event_id % 503 = 1 THEN 'unknown category' END, CASE WHEN event_id % 521 = 3 THEN 'accepted not boolean' END, CASE WHEN event_id % 509 = 2 THEN 'result not finite' END],
             lambda x: x IS NOT NULL)) AS problem FROM events) GROUP BY 1""",
    ),
)
def _(t: Tables) -> DataFrame:
    e = F.col("event_id")
    rows = ledger_base(t).select(
        F.when(e % 503 == 1, "bogus").otherwise(F.col("category")).alias("category"), F.when(e % 521 != 3, F.col("accepted")).alias("accepted"),
        F.when(e % 509 == 2, F.lit(float("nan"))).otherwise(F.col("value")).alias("result"),
    )
    from ..functions.numeric import finite

    problems = F.array_compact(
        F.array(
            F.when(~F.col("category").isin([*SEARCH, "methodology"]), "unknown category"), F.when(F.col("accepted").isNull(), "accepted not boolean"), F.when(finite("result").isNull(), "result not finite")
        )
    )
    return rows.select(F.explode(problems).alias("problem")).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- fills

cte(
    "fill0",
    """SELECT o_custkey AS account, o_orderkey AS seq, o_orderpriority AS symbol, CASE WHEN o_orderstatus = 'F' THEN 'SELL' ELSE 'BUY' END AS side, CASE WHEN o_orderstatus = 'F' THEN -1 ELSE 1 END * (1 + o_orderkey % 3)::DOUBLE AS qty, o_totalprice AS price FROM orders""",
)
cte(
    "fill1",
    """SELECT *, round(abs(qty) * price, 2) AS notional, round(abs(qty) * price * 0.001::DOUBLE, 2) AS fee FROM fill0""",
    "fill0",
)
cte(
    "fill2",
    """SELECT *, round(1e9::DOUBLE + sum(flow) OVER (PARTITION BY account ORDER BY seq), 2) AS cash_after, sum(qty) OVER (PARTITION BY account, symbol ORDER BY seq) AS position_after FROM (SELECT *, round(CASE WHEN side = 'BUY' THEN -notional ELSE notional END - fee, 2) AS flow FROM fill1)""",
    "fill1",
)
cte(
    "fills",
    """SELECT account, seq, symbol, CASE WHEN seq % 107 = 5 THEN CASE side WHEN 'BUY' THEN 'SELL' ELSE 'BUY' END ELSE side END AS side, qty, price, CASE WHEN seq % 103 = 4 THEN notional * 1.1::DOUBLE ELSE notional END AS notional, fee,
              CASE WHEN seq % 101 = 3 THEN cash_after - flow + 1 ELSE cash_after - flow END AS cash_before, cash_after, CASE WHEN seq % 109 = 6 THEN position_after + 0.5 ELSE position_after END AS position_after,
              'K' || (CASE WHEN seq % 113 = 7 THEN seq - 1 ELSE seq END)::VARCHAR AS idem_key FROM fill2""",
    "fill2",
)
BALANCE = """SELECT symbol, unnest(list_filter([CASE WHEN seq > first_ THEN 'duplicate key' END, CASE WHEN (qty > 1e-12 AND side <> 'BUY') OR (qty < -1e-12 AND side <> 'SELL') THEN 'side' END,
     CASE WHEN abs(cash_before - p_cash) > 2e-5 THEN 'cash continuity' END, CASE WHEN abs(notional - abs(qty) * price) > greatest(2e-5, 1e-9 * greatest(abs(notional), abs(qty) * price)) THEN 'notional' END,
     CASE WHEN abs(cash_after - cash_before - (CASE side WHEN 'BUY' THEN -notional ELSE notional END - fee)) > 2e-5 THEN 'cash arithmetic' END, CASE WHEN abs(position_after - position) > 2e-5 THEN 'position continuity' END], lambda x: x IS NOT NULL)) AS problem
   FROM (SELECT *, lag(cash_after) OVER (PARTITION BY account ORDER BY seq) AS p_cash, sum(qty) OVER (PARTITION BY account, symbol ORDER BY seq) AS position, min(seq) OVER (PARTITION BY idem_key) AS first_ FROM fills)"""


def fills(t: Tables) -> DataFrame:
    """Orders as fills of one account per customer, with damage by order key."""
    sell = F.col("o_orderstatus") == "F"
    base = t.orders.select(
        F.col("o_custkey").alias("account"), F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("symbol"), F.when(sell, "SELL").otherwise("BUY").alias("side"),
        (F.when(sell, -1.0).otherwise(1.0) * (1 + F.col("o_orderkey") % 3)).alias("qty"), F.col("o_totalprice").alias("price"),
    )
    base = base.withColumns({"notional": F.round(F.abs("qty") * F.col("price"), 2), "fee": F.round(F.abs("qty") * F.col("price") * 0.001, 2)})
    base = base.withColumn("flow", F.round(F.when(F.col("side") == "BUY", -F.col("notional")).otherwise(F.col("notional")) - F.col("fee"), 2))
    cash = running_sum_split(base, ["account"], ["seq"], {"cash": "flow"}, seq_chunk("seq"))
    both = running_sum_split(cash, ["account", "symbol"], ["seq"], {"position_after": "qty"}, seq_chunk("seq"), base)
    s = F.col("seq")
    after = F.round(F.lit(1e9) + F.col("cash"), 2)
    return both.select(
        "account", "seq", "symbol", F.when(s % 107 == 5, F.when(F.col("side") == "BUY", "SELL").otherwise("BUY")).otherwise(F.col("side")).alias("side"), "qty", "price",
        F.when(s % 103 == 4, F.col("notional") * 1.1).otherwise(F.col("notional")).alias("notional"), "fee",
        F.when(s % 101 == 3, after - F.col("flow") + 1).otherwise(after - F.col("flow")).alias("cash_before"), after.alias("cash_after"),
        F.when(s % 109 == 6, F.col("position_after") + 0.5).otherwise(F.col("position_after")).alias("position_after"),
        F.concat(F.lit("K"), F.when(s % 113 == 7, s - 1).otherwise(s).cast("string")).alias("idem_key"),
    )


@query("au_running_balance", sql(f"SELECT symbol, problem, count(*) AS n FROM ({BALANCE}) GROUP BY 1, 2", "fills"))
def _(t: Tables) -> DataFrame:
    out = au.running_balance(t.keep("fills", lambda: fills(t)), seq_chunk("seq"))
    return out.select("symbol", F.explode("problems").alias("problem")).groupBy("symbol", "problem").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- plans and reads

cte("plan_events", "SELECT 'Brand#' || (user_id % 25 + 1)::VARCHAR AS plan_id, event_id AS seq, CASE WHEN event_type = 'purchase' THEN 'read' ELSE 'note' END AS kind, CASE WHEN value > 60 THEN 'CONFIRMED' WHEN value > 20 THEN 'NOT_CONFIRMED' ELSE 'INCONCLUSIVE' END AS state FROM events")


def plan_events(t: Tables) -> DataFrame:
    return t.events.select(
        F.concat(F.lit("Brand#"), (F.col("user_id") % 25 + 1).cast("string")).alias("plan_id"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "purchase", "read").otherwise("note").alias("kind"),
        F.when(F.col("value") > 60, "CONFIRMED").when(F.col("value") > 20, "NOT_CONFIRMED").otherwise("INCONCLUSIVE").alias("state"),
    )


@query("au_already_read", sql("SELECT plan_id, seq, state FROM (SELECT *, min(seq) OVER (PARTITION BY plan_id) AS f FROM plan_events WHERE kind = 'read') WHERE seq > f", "plan_events"))
def _(t: Tables) -> DataFrame:
    return au.already_read(plan_events(t)).select("plan_id", "seq", "state")


cte(
    "facts",
    """SELECT symbol, num, n, sharpe, psr, CASE WHEN num % 5 <> 0 THEN psr * 0.97::DOUBLE END AS dsr, num * 4 AS pool, CASE WHEN num % 7 <> 0 THEN num * 2 END AS ledger_n, CASE WHEN num % 6 = 0 THEN 0.96::DOUBLE END AS ledger_dsr, 14 AS assets, num % 15 AS positive, num % 7 AS folds,
         num * 3 AS events, sharpe * 20 AS error_bp, num * 3 >= 30 AS sufficient, n % 200 AS days, num % 50 AS outages, num % 11 <> 0 AS intact, num % 13 <> 0 AS code_ok, (num % 17 = 0)::INT AS changes, num % 4 <> 0 AS current, num % 3 AS n_valid, num % 2 = 0 AS any_read,
         CASE num % 4 WHEN 0 THEN 'CONFIRMED' WHEN 2 THEN 'NOT_CONFIRMED' ELSE 'INCONCLUSIVE' END AS state
       FROM (SELECT symbol, substr(symbol, 7)::BIGINT AS num, n, round(sharpe, 6) AS sharpe, 0.5::DOUBLE + least(0.5::DOUBLE, abs(round(sharpe, 6))) AS psr FROM ret_sum)""",
    "ret_sum",
)
GRADES_SQL = {
    "selection_risk": "CASE WHEN pool <= 1 AND coalesce(ledger_n, 0) = 0 THEN 'Low' WHEN ledger_dsr >= 0.95 THEN 'Moderate' WHEN coalesce(ledger_n, 0) >= 25 OR pool >= 50 THEN 'High' ELSE 'Moderate' END",
    "robust": "CASE WHEN positive / assets::DOUBLE >= 0.9 AND folds >= 4 THEN 'Strong' WHEN positive / assets::DOUBLE >= 0.65 THEN 'Moderate' WHEN positive / assets::DOUBLE >= 0.5 THEN 'Weak' ELSE 'Insufficient' END",
    "cost": "CASE WHEN events = 0 OR NOT sufficient OR error_bp IS NULL THEN 'Insufficient' WHEN abs(error_bp) <= 5 THEN 'Strong' WHEN abs(error_bp) <= 15 THEN 'Moderate' ELSE 'Weak' END",
    "fwd": "CASE WHEN NOT intact OR NOT code_ok OR changes <> 0 THEN 'COMPROMISED' WHEN NOT current THEN 'Insufficient' WHEN days >= 90 AND outages / days::DOUBLE > 0.2 THEN 'Weak' WHEN days < 30 THEN 'Insufficient' WHEN days < 90 THEN 'Weak' WHEN days < 180 THEN 'Moderate' ELSE 'Strong' END",
    "reg": "CASE WHEN n_valid <= 0 THEN 'Weak' WHEN NOT any_read THEN 'Moderate' WHEN state = 'CONFIRMED' THEN 'Strong' WHEN state = 'NOT_CONFIRMED' THEN 'Weak' ELSE 'Moderate' END",
}
cte("graded0", f"SELECT *, {', '.join(f'{v} AS {k}' for k, v in GRADES_SQL.items())} FROM facts", "facts")
HIST = """CASE WHEN dsr IS NULL THEN CASE WHEN psr >= 0.95 THEN 'Weak' ELSE 'Insufficient' END WHEN dsr >= 0.95 AND psr >= 0.99 THEN CASE WHEN selection_risk = 'High' THEN 'Moderate' ELSE 'Strong' END WHEN dsr >= 0.9 OR psr >= 0.95 THEN 'Moderate'
   WHEN dsr >= 0.8 THEN 'Weak' ELSE 'Insufficient' END"""
cte("graded", f"SELECT *, {HIST} AS hist FROM graded0", "graded0")


def facts(t: Tables) -> DataFrame:
    """One row per symbol with the facts the grades look at (taken from its return summary and its number)."""
    base = return_summary(t).select("symbol", F.substring("symbol", 7, 5).cast("bigint").alias("num"), "n", F.round("sharpe", 6).alias("sharpe"))
    num, psr = F.col("num"), F.lit(0.5) + F.least(F.lit(0.5), F.abs("sharpe"))
    return base.withColumns(
        {
            "psr": psr, "dsr": F.when(num % 5 != 0, psr * 0.97), "pool": num * 4, "ledger_n": F.when(num % 7 != 0, num * 2), "ledger_dsr": F.when(num % 6 == 0, 0.96), "assets": F.lit(14), "positive": num % 15,
            "folds": num % 7, "events": num * 3, "error_bp": F.col("sharpe") * 20, "sufficient": num * 3 >= 30, "days": F.col("n") % 200, "outages": num % 50, "intact": num % 11 != 0, "code_ok": num % 13 != 0,
            "changes": (num % 17 == 0).cast("int"), "current": num % 4 != 0, "n_valid": num % 3, "any_read": num % 2 == 0,
            "state": F.when(num % 4 == 0, "CONFIRMED").when(num % 4 == 2, "NOT_CONFIRMED").otherwise("INCONCLUSIVE"),
        }
    )


def graded(t: Tables) -> DataFrame:
    f = facts(t)
    c = F.col
    g = f.withColumns(
        {
            "selection_risk": gr.selection(c("pool"), c("ledger_n"), c("ledger_dsr")), "robust": gr.robustness(c("assets"), c("positive"), c("folds")), "cost": gr.costs(c("events"), c("error_bp"), c("sufficient")),
            "fwd": gr.forward(c("days"), c("outages"), c("intact"), c("code_ok"), c("changes"), c("current")), "reg": gr.registration(c("n_valid"), c("any_read"), c("state")),
        }
    )
    return g.withColumn("hist", gr.historical(c("psr"), c("dsr"), c("selection_risk")))


def grade_query(op: str, column: str) -> None:
    @query(op, sql(f"SELECT symbol, {column} AS grade FROM graded", "graded"))
    def _(t: Tables) -> DataFrame:
        return graded(t).select("symbol", F.col(column).alias("grade"))


grade_query("grade_historical", "hist")
grade_query("grade_robustness", "robust")
grade_query("grade_selection", "selection_risk")
grade_query("grade_costs", "cost")
grade_query("grade_forward", "fwd")
grade_query("grade_registration", "reg")

OK = "IN ('Moderate', 'Strong')"


@query(
    "grade_overall",
    sql(
        f"""SELECT symbol, CASE WHEN fwd = 'COMPROMISED' THEN 'INVALIDATED' WHEN fwd = 'Insufficient' THEN CASE WHEN hist {OK} AND robust {OK} THEN 'promising, not validated' ELSE 'not established' END WHEN reg NOT {OK} THEN 'promising, not validated'
              WHEN hist {OK} AND robust {OK} AND cost {OK} AND fwd = 'Strong' AND selection_risk <> 'High' THEN 'validated (provisional)' ELSE 'partially supported' END AS verdict FROM graded""",
        "graded",
    ),
)
def _(t: Tables) -> DataFrame:
    c = F.col
    return graded(t).select("symbol", gr.overall(c("hist"), c("robust"), c("selection_risk"), c("cost"), c("fwd"), c("reg")).alias("verdict"))


@query(
    "agg_state",
    sql(
        """SELECT symbol, CASE WHEN any_read AND NOT intact THEN 'INVALIDATED' WHEN any_read AND NOT current THEN 'SUPERSEDED' WHEN n_valid = 0 THEN 'RESEARCH_ONLY' WHEN NOT any_read THEN 'CANONICAL_READY' WHEN days >= 30 THEN 'FORWARD_MEANINGFUL' ELSE 'FORWARD_PRELIMINARY' END AS state FROM facts""",
        "facts",
    ),
)
def _(t: Tables) -> DataFrame:
    c = F.col
    return facts(t).select("symbol", gr.state(c("n_valid") != 0, c("any_read"), c("intact"), c("current"), c("days")).alias("state"))


@query(
    "mt_plan_read",
    sql(
        """SELECT symbol, CASE WHEN num % 9 = 0 THEN 'UNREGISTERED' WHEN num % 8 = 0 THEN 'DRIFTED' WHEN num % 7 = 0 THEN 'ALREADY_READ' WHEN num % 10 = 1 OR n < 200 THEN 'INCONCLUSIVE' WHEN num % 3 <> 0 AND NOT sharpe > 0.2 THEN 'NOT_CONFIRMED'
             WHEN CASE WHEN num % 2 = 0 THEN sharpe > 0.1 ELSE sharpe < 0.1 END THEN 'CONFIRMED' ELSE 'NOT_CONFIRMED' END AS state FROM facts""",
        "facts",
    ),
)
def _(t: Tables) -> DataFrame:
    num = F.col("num")
    value = F.when(num % 10 != 1, F.col("sharpe"))
    state = gr.plan_read(
        num % 9 != 0, num % 8 != 0, num % 7 == 0, F.col("n"), F.lit(200), value, F.when(num % 2 == 0, "gt").otherwise("lt"), F.lit(0.1), F.when(num % 3 != 0, F.col("sharpe") > 0.2)
    )
    return facts(t).select("symbol", state.alias("state"))


@query(
    "agg_plan_status",
    sql(
        """SELECT count(*) FILTER (intact) AS n_valid, count(*) FILTER (NOT intact) AS n_drifted, count(*) FILTER (n_reads > 0) AS n_read, min(symbol) FILTER (intact) AS first_valid, max_by(last_state, last_seq) AS latest_read_state
           FROM facts LEFT JOIN (SELECT plan_id, count(*) AS n_reads, max(seq) AS last_seq, max_by(state, seq) AS last_state FROM plan_events WHERE kind = 'read' GROUP BY 1) e ON facts.symbol = e.plan_id""",
        "facts",
        "plan_events",
    ),
)
def _(t: Tables) -> DataFrame:
    reads = plan_events(t).where("kind = 'read'").groupBy(F.col("plan_id").alias("symbol")).agg(F.count(F.lit(1)).alias("n_reads"), F.max("seq").alias("last_seq"), F.max_by("state", "seq").alias("last_state"))
    joined = facts(t).join(reads, "symbol", "left")
    return joined.agg(
        F.count(F.when(F.col("intact"), 1)).alias("n_valid"), F.count(F.when(~F.col("intact"), 1)).alias("n_drifted"), F.count(F.when(F.col("n_reads") > 0, 1)).alias("n_read"),
        F.min(F.when(F.col("intact"), F.col("symbol"))).alias("first_valid"), F.max_by("last_state", "last_seq").alias("latest_read_state"),
    )


CHECKPOINTS = [("1 month", 30), ("3 months", 91), ("6 months", 182), ("12 months", 365)]  # fixed values


@query(
    "agg_checkpoints",
    sql(
        "SELECT symbol, label, due_days, n_days >= due_days AS due, due_days = min(CASE WHEN n_days < due_days THEN due_days END) OVER (PARTITION BY symbol) AS next FROM (SELECT symbol, count(*) AS n_days FROM flat WHERE note IS NULL AND d > DATE '2001-01-01' GROUP BY 1), "
        "(VALUES ('1 month', 30), ('3 months', 91), ('6 months', 182), ('12 months', 365)) c(label, due_days)",
        "flat",
    ),
)
def _(t: Tables) -> DataFrame:
    days = tape_flat(t).where(F.col("note").isNull() & (F.col("date") > F.lit("2001-01-01").cast("date"))).groupBy("symbol").agg(F.count(F.lit(1)).alias("n_days"))
    marks = t.spark.createDataFrame(CHECKPOINTS, "label string, due_days int")
    grid = days.join(F.broadcast(marks))  # four checkpoint rows
    pending = F.min(F.when(F.col("n_days") < F.col("due_days"), F.col("due_days"))).over(Window.partitionBy("symbol"))
    return grid.select("symbol", "label", "due_days", (F.col("n_days") >= F.col("due_days")).alias("due"), (F.col("due_days") == pending).alias("next"))


@query(
    "agg_beats",
    sql(
        f"""SELECT b.symbol, b.cagr > i.cagr AS beats_cagr, b.sharpe > i.sharpe AS beats_sharpe, b.max_drawdown > i.max_drawdown AS beats_max_drawdown, {r('b.cagr - i.cagr', 'cagr_delta')}, {r('b.sharpe - i.sharpe', 'sharpe_delta')},
              {r('b.max_drawdown - i.max_drawdown', 'max_drawdown_delta')}, CASE WHEN b.cagr > i.cagr AND b.sharpe > i.sharpe THEN 'beats_on_cagr_and_sharpe' ELSE 'does_not_beat' END AS verdict
            FROM ret_sum b, (SELECT * FROM index_sum WHERE symbol = 'BUILDING') i""",
        "ret_sum",
        "index_sum",
    ),
)
def _(t: Tables) -> DataFrame:
    from ..functions import performance as pf

    bars = panels.segment_bars(t).where("symbol = 'BUILDING'")
    w = Window.partitionBy("symbol").orderBy("open_time")
    rows = bars.select("symbol", F.col("open_time").alias("day"), (F.col("close") / F.lag("close").over(w) - 1).alias("ret"), F.lag("open_time").over(w).alias("t0")).where("ret is not null")
    from .signals import RF

    index = pf.summary(rows, ["symbol"], 252, RF, (F.max("day") - F.min("t0")) / F.lit(86_400_000.0)).select(*[F.col(c).alias(f"i_{c}") for c in ("cagr", "sharpe", "max_drawdown")])
    joined = return_summary(t).crossJoin(F.broadcast(index))  # one benchmark row
    flags = {f"beats_{c}": F.col(c) > F.col(f"i_{c}") for c in ("cagr", "sharpe", "max_drawdown")}
    out = joined.withColumns(flags)
    verdict = F.when(F.col("beats_cagr") & F.col("beats_sharpe"), "beats_on_cagr_and_sharpe").otherwise("does_not_beat")
    return out.select("symbol", *flags, *[rd(F.col(c) - F.col(f"i_{c}")).alias(f"{c}_delta") for c in ("cagr", "sharpe", "max_drawdown")], verdict.alias("verdict"))


@query(
    "agg_newest_stamp",
    sql("SELECT max(ms) AS newest, max_by(source, ms) AS source FROM (SELECT max((epoch_us(ts) // 1000)) AS ms, 'events' AS source FROM events UNION ALL SELECT max(epoch_ms(o_orderdate)), 'orders' FROM orders UNION ALL SELECT max(epoch_ms(l_shipdate)), 'lineitem' FROM lineitem)"),
)
def _(t: Tables) -> DataFrame:
    def newest(df: DataFrame, c: str, label: str) -> DataFrame:
        return df.agg(F.max(F.unix_millis(F.col(c).cast("timestamp"))).alias("ms")).withColumn("source", F.lit(label))

    both = newest(t.events, "ts", "events").unionByName(newest(t.orders, "o_orderdate", "orders")).unionByName(newest(t.lineitem, "l_shipdate", "lineitem"))
    return both.agg(F.max("ms").alias("newest"), F.max_by("source", "ms").alias("source"))


# ---------------------------------------------------------------- set operations on tapes

cte("inc", "SELECT d, day FROM days WHERE d >= DATE '1999-01-01' OR d < DATE '1996-01-01' UNION ALL SELECT d, day + 1 FROM days WHERE (day // 86400000) % 50 = 0 AND d >= DATE '1999-01-01'", "days")
cte(
    "merged",
    """SELECT 'kept' AS status, d FROM days WHERE d BETWEEN DATE '1996-01-01' AND DATE '1999-06-30' UNION ALL
       SELECT CASE WHEN e.d IS NOT NULL THEN 'duplicate' WHEN i.d <= DATE '1995-06-30' THEN 'dropped' WHEN row_number() OVER (PARTITION BY i.d ORDER BY i.day) > 1 THEN 'duplicate' ELSE 'added' END, i.d
       FROM inc i LEFT JOIN (SELECT DISTINCT d FROM days WHERE d BETWEEN DATE '1996-01-01' AND DATE '1999-06-30') e ON i.d = e.d""",
    "days",
    "inc",
)


@query("set_union_append", sql("SELECT strftime(d, '%Y') AS year, status, count(*) AS n FROM merged GROUP BY 1, 2", "merged"))
def _(t: Tables) -> DataFrame:
    tape = doubled_tape(t).select(F.col("date").cast("string").alias("date"), "seq", F.col("seq").alias("k"))
    once = tape.where(F.col("seq") % 86_400_000 == 0)
    existing = once.where(F.col("date").between("1996-01-01", "1999-06-30"))
    incoming = once.where(F.col("date") < "1996-01-01").unionByName(tape.where(F.col("date") >= "1999-01-01"))
    out = au.merge_tape(existing, incoming, "1995-06-30")
    return out.groupBy(F.substring("date", 1, 4).alias("year"), "status").agg(F.count(F.lit(1)).alias("n"))


@query(
    "set_union_conflict",
    sql(
        """SELECT strftime(make_timestamp(day * 1000), '%Y-%m-%d') AS date, CASE WHEN dn % 3 = 2 THEN 'added' WHEN dn % 4 = 2 THEN 'kept' WHEN dn % 11 = 0 THEN 'conflict' ELSE 'duplicate' END AS status FROM (SELECT DISTINCT open_time AS day, open_time // 86400000 AS dn FROM bars) WHERE NOT (dn % 3 = 2 AND dn % 4 = 2)""",
        "bars",
    ),
)
def _(t: Tables) -> DataFrame:
    day = F.date_format(F.timestamp_millis("open_time"), "yyyy-MM-dd")
    body_ = F.array_join(F.array_sort(F.collect_list("symbol")), ",")  # one entry per symbol of the day
    full = panels.brand_bars(t).groupBy(day.alias("date"), "open_time").agg(body_.alias("body"))
    existing = full.where(day_number() % 3 != 2)
    incoming = full.where(day_number() % 4 != 2).withColumn("body", F.when(day_number() % 11 == 0, F.concat("body", F.lit(",X"))).otherwise(F.col("body")))
    return au.merge_snapshots(existing, incoming)


@query(
    "set_dedupe_content",
    sql("SELECT l_returnflag, count(*) AS n_distinct FROM (SELECT DISTINCT l_returnflag, concat_ws('|', l_orderkey, l_linenumber, l_returnflag) AS line FROM lineitem) GROUP BY 1"),
)
def _(t: Tables) -> DataFrame:
    line = F.concat_ws("|", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), "l_returnflag")
    return t.lineitem.select("l_returnflag", line.alias("line")).dropDuplicates(["line"]).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n_distinct"))


@query("set_intersect", sql("SELECT open_time AS day FROM segbars GROUP BY 1 INTERSECT SELECT open_time FROM regbars GROUP BY 1", "segbars", "regbars"))
def _(t: Tables) -> DataFrame:
    day = F.col("open_time").alias("day")
    return panels.segment_bars(t).select(day).intersect(panels.region_bars(t).select(day))


@query("set_except", sql("SELECT DISTINCT open_time AS day FROM bars EXCEPT SELECT open_time FROM segbars", "bars", "segbars"))
def _(t: Tables) -> DataFrame:
    day = F.col("open_time").alias("day")
    return panels.brand_bars(t).select(day).distinct().subtract(panels.segment_bars(t).select(day))


DIFF = ["cagr", "sharpe", "max_drawdown"]


@query(
    "diff_metrics",
    sql(
        f"""SELECT * FROM (SELECT symbol, metric, {r('CASE WHEN gone THEN NULL ELSE v END', 'stored')}, {r('CASE WHEN num % 4 = 1 AND metric = $$sharpe$$ THEN v + 0.01 ELSE v END', 'fresh')} FROM (
              SELECT symbol, substr(symbol, 7)::BIGINT AS num, unnest(['cagr', 'sharpe', 'max_drawdown']) AS metric, unnest([round(cagr, 6), round(sharpe, 6), round(max_drawdown, 6)]) AS v, substr(symbol, 7)::BIGINT % 6 = 0 AND unnest(['cagr', 'sharpe', 'max_drawdown']) = 'cagr' AS gone FROM ret_sum))
            WHERE (stored IS NULL) <> (fresh IS NULL) OR abs(stored - fresh) > 1e-9""",
        "ret_sum",
    ),
)
def _(t: Tables) -> DataFrame:
    fresh = return_summary(t).select("symbol", *[rd(c).alias(c) for c in DIFF])
    num = F.substring("symbol", 7, 5).cast("bigint")
    stored = fresh.withColumn("cagr", F.when(num % 6 != 0, F.col("cagr")))
    moved = fresh.withColumn("sharpe", F.when(num % 4 == 1, rd(F.col("sharpe") + 0.01)).otherwise(F.col("sharpe")))
    return au.diff_metrics(stored, moved, ["symbol"], DIFF, 1e-9)


@query(
    "diff_experiments",
    sql(
        """SELECT a.symbol AS a, b.symbol AS b, (a.pool IS DISTINCT FROM b.pool)::INT + (a.ledger_n IS DISTINCT FROM b.ledger_n)::INT + (a.folds <> b.folds)::INT + (a.n_valid <> b.n_valid)::INT AS n_diff,
             (a.pool IS DISTINCT FROM b.pool)::INT + (a.ledger_n IS DISTINCT FROM b.ledger_n)::INT + (a.folds <> b.folds)::INT + (a.n_valid <> b.n_valid)::INT > 1 AS confounded FROM facts a JOIN facts b ON a.num + 1 = b.num""",
        "facts",
    ),
)
def _(t: Tables) -> DataFrame:
    f = facts(t)
    a, b = f.alias("a"), f.alias("b")
    joined = a.join(b, F.col("a.num") + 1 == F.col("b.num"))  # each run against its successor
    n = sum((~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))).cast("int") for c in ("pool", "ledger_n", "folds", "n_valid"))
    return joined.select(F.col("a.symbol").alias("a"), F.col("b.symbol").alias("b"), n.alias("n_diff"), (n > 1).alias("confounded"))
