"""Batch and stream give the same rows."""

import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from barloom.operators import portfolio as pt
from barloom.sources import sinks
from barloom.streaming import runner, sleeves, ticks

DAY = 86_400_000


def test_sleeves_replayed_in_three_batches(spark):
    rnd = random.Random(1)
    rows = [(s, d * DAY, rnd.random(), 100 + rnd.random(), 100 + rnd.random(), "outage" if rnd.random() < 0.1 else "") for s in "abc" for d in range(60)]
    df = spark.createDataFrame(rows, "symbol string, day bigint, target double, open double, close double, note string")
    source = sinks.scratch(spark, "sleeve-test")
    for lo in (0, 20, 40):
        df.where((F.col("day") >= lo * DAY) & (F.col("day") < (lo + 20) * DAY)).coalesce(1).write.mode("append").parquet(source)
    states = sleeves.sleeve_states(runner.table_stream(spark, source, 1))
    got = spark.read.parquet(runner.drain_to_parquet(states, "sleeve-test-out")).orderBy("symbol", "day").collect()
    want = sleeves.sleeve_batch(df).orderBy("symbol", "day").collect()
    assert len(got) == 180
    for a, b in zip(got, want):
        assert (a["symbol"], a["day"]) == (b["symbol"], b["day"])
        assert a["ret"] == pytest.approx(b["ret"]) and a["held"] == pytest.approx(b["held"])


def test_portfolio_days_equal_the_batch_rule(spark):
    rnd = random.Random(2)
    rows = [(s, d * DAY, rnd.gauss(0, 0.01)) for s in "abcd" for d in range(150)]
    df = spark.createDataFrame(rows, "symbol string, day bigint, ret double")
    source = sinks.scratch(spark, "portfolio-test")
    for lo, hi in ((0, 110), (110, 130), (130, 150)):
        df.where((F.col("day") >= lo * DAY) & (F.col("day") < hi * DAY)).coalesce(1).write.mode("append").parquet(source)
    out = sleeves.portfolio_days(runner.table_stream(spark, source, 1), spark, 4)
    got = {r["day"]: r["ret"] for r in spark.read.parquet(out).collect()}
    want = {r["day"]: r["ret"] for r in pt.rule(df, pt.denominators(df.select("day").distinct(), None, 4)).collect()}
    assert set(got) == {d * DAY for d in range(150)}  # the newest date closes when the source ends
    for day, ret in got.items():
        assert ret == pytest.approx(want[day], abs=1e-12)


def test_append_is_idempotent(spark):
    path = sinks.scratch(spark, "append-test")
    first = spark.createDataFrame([("a", 1, 1.0), ("b", 1, 2.0)], "symbol string, day int, x double")
    again = spark.createDataFrame([("a", 1, 9.0), ("a", 2, 3.0)], "symbol string, day int, x double")
    sinks.append_rows(first, path, ["symbol", "day"])
    sinks.append_rows(again, path, ["symbol", "day"])
    sinks.append_rows(again, path, ["symbol", "day"])
    assert sorted(tuple(r) for r in spark.read.parquet(path).collect()) == [("a", 1, 1.0), ("a", 2, 3.0), ("b", 1, 2.0)]


START = datetime(2024, 1, 1)
TICK = "symbol string, seq long, ts timestamp, price double, size double"


def tick_rows(minutes, symbol="a", seed=0):
    rnd = random.Random(seed)
    return [(symbol, k, START + timedelta(minutes=m), rnd.uniform(10, 20), 1.0) for k, m in enumerate(minutes)]


def folder_of(spark, label, *parts):
    """A stream that reads one file per batch, in the order given."""
    source = sinks.scratch(spark, label)
    for part in parts:
        spark.createDataFrame(part, TICK).coalesce(1).write.mode("append").parquet(source)
    return source, runner.table_stream(spark, source, 1)


def hourly(rows):
    return ticks.ohlc(rows.withWatermark("ts", "1 hour"), "1 hour")


def test_windows_are_appended_once_over_restarts_and_late_rows_counted(spark):
    first, second = tick_rows(range(0, 300, 7)), tick_rows(range(301, 600, 7))
    source, stream = folder_of(spark, "restart", first)
    job = runner.Clocked(stream, hourly, "restart-out").run()
    early = job.rows().count()
    assert 0 < early < 5  # only windows the watermark has passed
    too_late = [("a", 900, START + timedelta(minutes=5), 99.0, 1.0)]
    for part in (second, too_late):
        spark.createDataFrame(part, TICK).coalesce(1).write.mode("append").parquet(source)
        job.run()  # a new start on the same checkpoint
    got = {tuple(r) for r in job.closed().collect()}
    want = {tuple(r) for r in ticks.ohlc(spark.createDataFrame(first + second, TICK), "1 hour").collect()}
    assert got == want and job.late == 1
    assert job.run().rows().count() == len(want)  # nothing more to do


def test_a_batch_that_runs_again_replaces_its_own_rows(spark):
    out = sinks.scratch(spark, "again")
    write = runner.batch_sink(out)
    for k in (0, 1, 1):
        write(spark.range(k, k + 2), k)
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [0, 1, 1, 2]


def test_silence_raises_an_alert_without_a_row(spark):
    a, b = tick_rows(range(0, 50, 10), "a"), tick_rows(range(0, 120, 10), "b")
    _, stream = folder_of(spark, "silence", a + b)
    job = runner.Clocked(stream, lambda rows: ticks.silence_alerts(rows, 1_800_000), "silence-out", "update").run()
    seen = [(r.symbol, r.n, r.status) for r in job.rows().orderBy("batch", "symbol").collect()]
    assert seen == [("a", 5, "fresh"), ("b", 12, "fresh"), ("a", 5, "stale")]  # b's newest row is the clock here
    job.tick("2024-01-01 02:20:00")
    assert [r.symbol for r in job.rows().where("status = 'stale'").collect()] == ["a"]
    job.tick("2024-01-01 02:21:00")  # 31 minutes after b's newest row
    assert sorted(r.symbol for r in job.rows().where("status = 'stale'").collect()) == ["a", "b"]


def test_spells_of_a_hot_symbol_merge_across_buckets(spark):
    rnd = random.Random(3)
    minutes = sorted(rnd.choice(range(0, 40)) + 200 * rnd.choice(range(0, 30)) for _ in range(400)) + [6_119, 6_120 + 119]
    rows = tick_rows(minutes) + tick_rows([5, 6], "b")
    _, stream = folder_of(spark, "spells", rows)
    parts = runner.Clocked(stream, lambda r: ticks.partial_bursts(r.withWatermark("ts", "1 day"), "2 hours"), "spells-out").closed()
    got = sorted((r.symbol, r.start_ms, r.end_ms, r.n, round(r.total, 6)) for r in ticks.bursts(parts).collect())
    want, base = [], int((START - datetime(1970, 1, 1)).total_seconds() * 1000)
    for symbol in "ab":
        spell = []
        for _, _, ts, price, _ in [*sorted((r for r in rows if r[0] == symbol), key=lambda r: r[2]), (None, None, datetime(2030, 1, 1), 0, 0)]:
            if spell and ts >= spell[-1][0] + timedelta(hours=2):
                ends = [base + int((x - START).total_seconds() * 1000) for x in (spell[0][0], spell[-1][0] + timedelta(hours=2))]
                want.append((symbol, *ends, len(spell), round(sum(p for _, p in spell), 6)))
                spell = []
            spell.append((ts, price))
    assert got == sorted(want) and parts.count() > len(want)


def test_trailing_windows_from_panes(spark):
    rnd = random.Random(8)
    minutes = sorted(rnd.sample(range(0, 600), 60) + rnd.sample(range(3_000, 6_000), 40))
    rows = [(s, k, ts, 1e6 + p, v) for s, k, ts, p, v in tick_rows(minutes)]  # a mean far above the spread
    _, stream = folder_of(spark, "panes", rows)
    parts = runner.Clocked(stream, lambda r: ticks.panes(r.withWatermark("ts", "1 day")), "panes-out").closed()
    got = {r.end_ms: r for r in ticks.trailing_stats(parts).collect()}
    base, hour = int((START - datetime(1970, 1, 1)).total_seconds() * 1000), 3_600_000
    want = {}
    for k in range(0, 200):
        end = base + k * hour
        xs = [p for (_, _, ts, p, _), m in zip(rows, minutes) if end - 24 * hour <= base + m * 60_000 < end]
        if xs:
            want[end] = xs
    assert set(got) == set(want)
    for end, xs in want.items():
        mean = sum(xs) / len(xs)
        assert got[end].n == len(xs) and got[end].mean == pytest.approx(mean, abs=1e-8) and got[end].volume == len(xs)
        sd = math.sqrt(sum((x - mean) ** 2 for x in xs) / (len(xs) - 1)) if len(xs) > 1 else None
        assert got[end].sd is None if sd is None else got[end].sd == pytest.approx(sd, rel=1e-6)


def test_tapes_only_go_forward(spark):
    out, state = (sinks.scratch(spark, f"order{k}") for k in "ab")
    handle = ticks.order_policy("2024-01-02", out, state, rows_per_chunk=3)
    days = [[1, 3, 4, 3, 5, 5, 2, 4, 6], [5, 6, 7, 1]]
    batches = [[("a", k, START + timedelta(days=d - 1), 1.0, 1.0) for k, d in enumerate(part)] for part in days]
    frames = [spark.createDataFrame(b, TICK).withColumn("arrive", F.col("seq")) for b in batches]
    for batch_id in (0, 1, 1, 0):  # batches that run again give the same rows
        handle(frames[batch_id], batch_id)
    got = {(r.batch, r.seq): r.status for r in spark.read.parquet(out).collect()}
    newest, want = 0, {}
    for batch_id, part in enumerate(days):
        for k, d in enumerate(part):
            want[batch_id, k] = "refused" if d <= 2 else "out_of_order" if d < newest else "kept"
            newest = max(newest, d if d > 2 else 0)
    assert got == want
