"""Streams give what the batch gives."""

import numpy as np
import pytest
from check import compare
from pyspark.sql import functions as F

from tidemark.operators.keepfirst import keep_first
from tidemark.session import fresh_path
from tidemark.sources.views import SCHEMAS, measurement_rows
from tidemark.streaming import ingest as I
from tidemark.streaming.suppress import keep_first_stream

SF = "/root/testdata/sf0.001"
NAMES = [
    "st1_ingest_routing", "st2_duplicate_suppression", "st4_alert_suppression", "st5_daily_tumbling", "st5_daily_median", "st6_device_sync_status",
    "st7_future_and_late_policy", "st8_followup_stream",
]


@pytest.mark.parametrize("name", NAMES)
def test_stream_equals_batch(name, spark, con):
    import __spark_entry__ as entry

    problem, _ = compare(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name])
    assert problem is None, problem


def replayed(t, cuts=("2024-01-11", "2024-01-21")):
    """The event table as a feed: a period per arrival, every seventh row a period late, many files per arrival.

    Files are cut by time range over all shuffle tasks; a micro-batch takes as many files as an arrival has.
    """
    path, files = fresh_path(t.spark, "feed"), int(t.spark.conf.get("spark.sql.shuffle.partitions"))
    period = sum(((F.col("ts") >= F.lit(c).cast("timestamp")).cast("int") for c in cuts), F.lit(0))
    late = F.when(F.pmod("event_id", F.lit(7)) == 0, 1).otherwise(0)
    events = t.events.withColumn("_arrival", F.coalesce(period + late, F.lit(0)))
    for arrival in range(len(cuts) + 2):
        events.filter(F.col("_arrival") == arrival).drop("_arrival").repartitionByRange(files, "ts", "event_id").write.mode("append").parquet(path)
    return measurement_rows(I.event_stream(t.spark, path, SCHEMAS["events"], files=files))


@pytest.mark.parametrize("name", ["st1_ingest_routing", "st5_daily_tumbling", "st5_daily_median", "st6_device_sync_status"])
def test_arrivals_with_late_rows_equal_batch(name, spark, con, monkeypatch):
    """The same queries on a feed of four arrivals in which every seventh row is a period late."""
    import __spark_entry__ as entry

    from tidemark.plans import streams

    monkeypatch.setattr(streams, "whole", replayed)
    problem, _ = compare(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name])
    assert problem is None, problem


def test_followup_stream_join(spark, tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    stamp = lambda c: F.col(c).cast("timestamp")
    spark.createDataFrame([(1, 10, "2024-01-01 00:00:00"), (2, 11, "2024-01-01 00:00:00")], "followup_id long, k long, due string").select("followup_id", "k", stamp("due").alias("due_ts")).write.parquet(a)
    spark.createDataFrame([(10, "2024-01-03 00:00:00"), (11, "2024-01-20 00:00:00")], "k long, t string").select("k", stamp("t").alias("ts")).write.parquet(b)
    due = I.event_stream(spark, a, "followup_id long, k long, due_ts timestamp")
    done = I.event_stream(spark, b, "k long, ts timestamp")
    out = str(tmp_path / "out")
    state = I.followup_stream(due, done, ["k"], 7, out, str(tmp_path / "cp"))
    assert sorted((r["followup_id"], r["status"], str(r["closed_day"])) for r in state.collect()) == [(1, "completed", "2024-01-03"), (2, "scheduled", "None")]
    log = spark.read.parquet(f"{out}/closed")
    assert sorted((r["followup_id"], r["status"]) for r in log.collect()) == [(1, "completed")]


def test_followups_are_released_when_their_time_has_passed(spark, tmp_path):
    """Results in three arrivals: a late one comes earlier than the one that closed; the watermark ends what nobody answered."""
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    due = spark.createDataFrame([(1, 10, "2024-01-01 12:00:00"), (2, 11, "2024-01-01 12:00:00"), (3, None, "2024-01-01 12:00:00")], "followup_id long, k long, due string")
    due.select("followup_id", "k", F.col("due").cast("timestamp").alias("due_ts")).write.parquet(a)
    for rows in ([(10, "2024-01-01 11:00:00"), (10, "2024-01-06 00:00:00")], [(10, "2024-01-04 09:00:00"), (11, "2024-01-09 00:00:01")], [(12, "2024-02-20 00:00:00")], [(12, "2024-02-21 00:00:00")]):
        spark.createDataFrame(rows, "k long, t string").select("k", F.col("t").cast("timestamp").alias("ts")).coalesce(1).write.mode("append").parquet(b)
    spark.createDataFrame([(9, 99, "2024-02-20 00:00:00")], "followup_id long, k long, due string").select("followup_id", "k", F.col("due").cast("timestamp").alias("due_ts")).coalesce(1).write.mode("append").parquet(a)
    read = lambda p, s: I.event_stream(spark, p, s, files=1)
    out = str(tmp_path / "out")
    state = I.followup_stream(read(a, "followup_id long, k long, due_ts timestamp"), read(b, "k long, ts timestamp"), ["k"], 7, out, str(tmp_path / "cp"), "10 days")
    got = {r["followup_id"]: (r["status"], str(r["closed_day"])) for r in state.collect()}
    assert got == {1: ("completed", "2024-01-04"), 2: ("scheduled", "None"), 3: ("scheduled", "None"), 9: ("scheduled", "None")}
    log = spark.read.parquet(f"{out}/closed").collect()
    assert {(r["followup_id"], r["status"]) for r in log} == {(1, "completed"), (2, "unanswered"), (3, "unanswered")}


def test_late_rows_reach_the_result(spark, tmp_path):
    """The second arrival is older than the first; a NULL key is a key."""
    feed = str(tmp_path / "feed")
    for rows in ([(1, "a", 100, 1.0), (2, None, 100, 1.0), (3, "a", 90000, 2.0)], [(4, "a", 50, 4.0), (5, None, 170, 8.0)], [(6, "a", 105, 16.0)]):
        made = spark.createDataFrame(rows, "measurement_id long, k string, s long, value double").withColumn("ts", F.timestamp_seconds("s")).drop("s")
        made.coalesce(1).write.mode("append").parquet(feed)
    read = lambda: I.event_stream(spark, feed, "measurement_id long, k string, value double, ts timestamp", files=1)
    kept = keep_first_stream(read(), ["k"], 60, 86400, str(tmp_path / "kept"), str(tmp_path / "cp"))
    assert sorted((r["measurement_id"], r["kept_us"] // 1_000_000) for r in kept.collect()) == [(2, 100), (3, 90000), (4, 50), (5, 170)]
    days = I.daily_stream(read(), ["k"], str(tmp_path / "days"), str(tmp_path / "cp2"))
    assert {(r["k"], str(r["day"])): (r["total"], r["n"]) for r in days.collect()} == {
        ("a", "1970-01-01"): (21.0, 3), ("a", "1970-01-02"): (2.0, 1), (None, "1970-01-01"): (9.0, 2)}


def test_suppression_in_any_order_equals_batch(spark, tmp_path):
    """Interleaved arrivals of dense series: chains run over many chunks, late rows retract and append; NULL keys, equal instants, a row without an instant."""
    rng = np.random.default_rng(4)
    rows = [(i, None if i % 11 == 0 else f"k{int(rng.integers(0, 3))}", None if i % 5 else i % 2, int(rng.integers(0, 12000))) for i in range(900)]
    rows += [(2000, "k0", None, None)]
    schema = "measurement_id long, k string, v long, ts timestamp"
    feed = str(tmp_path / "feed")
    for part in range(2):
        made = spark.createDataFrame([r for r in rows if r[0] * 7 % 2 == part], "measurement_id long, k string, v long, s long")
        made.withColumn("ts", F.timestamp_seconds("s")).drop("s").coalesce(1).write.mode("append").parquet(feed)
    stream = I.event_stream(spark, feed, schema, files=1)
    got = keep_first_stream(stream, ["k", "v"], 300, 900, str(tmp_path / "out"), str(tmp_path / "cp"))
    table = spark.read.schema(schema).parquet(feed).where("ts is not null")
    want = keep_first(table, ["k", "v"], 300, 900, "measurement_id").select("k", "v", "kept_us", "measurement_id")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    log = spark.read.parquet(str(tmp_path / "out"))
    assert log.where("change = -1").count() > 0 and log.where("batch = 0 and change = -1").count() == 0
