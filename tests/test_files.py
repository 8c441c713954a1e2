"""Tapes read from files, and the archive of files."""

import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from barloom.sources import sinks, tapes


def entry(day, ret=0.01, assets=None):
    return json.dumps({"date": day, "port_ret": ret, "assets": {"A": 1} if assets is None else assets})


CASES = [
    (entry("2024-01-01"), "ok"),
    ("   ", None),  # blank lines are no entries
    ('{"date": "2024-01-02", "port_', "not_json"),
    ("[1, 2]", "not_an_object"),
    ('{"port_ret": 0.0, "assets": {"A": 1}}', "no_date"),
    ('{"date": 20240103, "port_ret": 0.0, "assets": {"A": 1}}', "no_date"),
    (entry("2024-13-03"), "invalid_date"),
    (entry("2024-01-05"), "ok"),
    (entry("2024-01-05"), "repeated_date"),
    (entry("2024-01-04"), "not_increasing"),
    (entry("2024-01-06", "0.1"), "invalid_return"),
    (entry("2024-01-07", True), "invalid_return"),
    (entry("2024-01-08", -1.01), "impossible_return"),
    (entry("2024-01-09", -1), "ok"),
    (entry("2024-01-10", 0.0, {}), "no_assets"),
    (entry("2024-01-11", 0.0, [1]), "no_assets"),
    (entry("2024-01-12", 2), "ok"),
    ('{"date": "2024-01-13", "po', "torn_tail"),
]


def written(tmp_path, name, lines):
    (tmp_path / f"{name}.jsonl").write_text("\n".join(lines), encoding="utf-8")


def test_each_rule_gives_its_reason(spark, tmp_path):
    written(tmp_path, "faulty", [line for line, _ in CASES])
    written(tmp_path, "clean", [entry("2024-02-01"), entry("2024-02-02"), '{"date"'])
    rows = tapes.read_tape(spark, str(tmp_path)).orderBy("file", "block", "at").collect()
    assert [r.reason for r in rows if "faulty" in r.file] == [reason for _, reason in CASES if reason]
    assert [r.reason for r in rows if "clean" in r.file] == ["ok", "ok", "torn_tail"]
    told = tapes.tape_reasons(tapes.read_tape(spark, str(tmp_path)), F.regexp_extract("file", r"(\w+)\.jsonl", 1)).collect()
    assert {(r.tape, r.voided) for r in told} == {("clean", False), ("faulty", True)}


def test_lines_keep_their_order_over_the_blocks_of_a_file(spark, tmp_path):
    days = [f"{1900 + k // 336}-{k // 28 % 12 + 1:02d}-{k % 28 + 1:02d}" for k in range(20_000)]
    written(tmp_path, "long", [entry(d) for d in days])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        rows = tapes.read_tape(spark, str(tmp_path))
        assert rows.select("block").distinct().count() > 5
        assert {r.reason for r in rows.select("reason").distinct().collect()} == {"ok"}
        assert [str(r.date) for r in rows.orderBy("block", "at").collect()] == days
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_archive_holds_the_bytes(spark, tmp_path):
    source, path = tmp_path / "in", sinks.scratch(spark, "archive-test")
    (source / "deep").mkdir(parents=True)
    for name, raw in (("a.jsonl", b"\xff\x00{\r\n}\n\n"), ("deep/b.jsonl", os.urandom(5000)), ("empty.jsonl", b"")):
        (source / name).write_bytes(raw)
    sinks.write_quarantine(spark, str(source), spark.createDataFrame([(1, "verified"), (2, "bad")], "x int, verdict string"), path)
    for r in spark.read.parquet(f"{path}/archive").collect():
        raw = open(r.path.removeprefix("file:"), "rb").read()
        assert bytes(r.content) == raw and r.sha256 == hashlib.sha256(raw).hexdigest()
    assert spark.read.parquet(f"{path}/archive").count() == 2  # an empty file has nothing to keep
    assert [r.x for r in spark.read.parquet(f"{path}/verified").collect()] == [1]
    assert spark.read.parquet(f"{path}/annotated").count() == 2


def test_a_tape_of_nothing(spark, tmp_path):
    written(tmp_path, "void", [])
    assert tapes.read_tape(spark, str(tmp_path)).collect() == []
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        tapes.read_tape(spark, str(tmp_path / "nowhere")).collect()


def test_one_file_per_value_when_a_join_turns_into_a_broadcast(spark, tmp_path):
    names = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "100k"}
    before = {name: spark.conf.get(name, None) for name in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    try:
        rows = spark.range(0, 400_000, numPartitions=4).select((F.col("id") % 7).cast("string").alias("tape"), F.col("id").alias("seq"))
        lines = rows.join(rows.groupBy("tape").agg(F.max("seq").alias("last")), "tape").withColumn("value", F.concat_ws("/", "seq", "last"))
        sinks.write_lines(lines, "tape", "seq", str(tmp_path / "out"))
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    for k in range(7):
        (file,) = (tmp_path / "out" / f"tape={k}").glob("*.txt")
        seqs = [int(line.split("/")[0]) for line in file.read_text().splitlines()]
        assert seqs == list(range(k, 400_000, 7))
