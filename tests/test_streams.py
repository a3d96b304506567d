"""Streams against their batch forms, and replays."""

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from rideloom.operators import late
from rideloom.sources import files
from rideloom.streaming import windows

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def stream(spark, rows, schema):
    path = files.new_path(spark, "in")
    spark.createDataFrame(rows, schema).write.parquet(path)
    return windows.stream_of(spark, path)


def test_tumbling_and_sessions(spark):
    rows = [("u", T0 + timedelta(seconds=s), v) for s, v in ((3, 1.0), (7, 2.0), (12, 3.0), (40, 4.0))]
    s = stream(spark, rows, "u string, t timestamp, v double")
    got = windows.run_windowed(s, "t", "10 seconds", [F.count(F.lit(1)).alias("n"), F.sum("v").alias("total")])
    base = int(T0.timestamp())
    assert {(r.start - base, r.n, r.total) for r in got.collect()} == {(0, 2, 3.0), (10, 1, 3.0), (40, 1, 4.0)}
    df = spark.createDataFrame(rows, "u string, t timestamp, v double")
    ses = windows.run_sessions(windows.stream_of_files(spark, windows.staged(df, "t", 2, close="1 DAY")), "t", "5 seconds", "u")
    assert {(r.start - base, r.end - base, r.n) for r in ses.collect()} == {(3, 12, 3), (40, 40, 1)}  # a pause of exactly the gap joins


def test_deduplication_lets_rows_without_key_pass(spark):
    rows = [("a", T0), ("a", T0), (None, T0), (None, T0), ("b", T0)]
    got = windows.run_deduplicated(stream(spark, rows, "k string, t timestamp"), "t", "k", "1 hour")
    assert sorted(str(r.k) for r in got.collect()) == ["None", "None", "a", "b"]


def test_late_rows_are_dropped_over_batches(spark):
    """The second file moves the watermark, which tells late rows from the batch after next on: an older row is then dropped, one within it is not."""
    path = files.new_path(spark, "late")
    at = lambda s: T0 + timedelta(seconds=s)
    for rows in ([(at(5), 1.0)], [(at(2000), 2.0)], [(at(2001), 32.0)], [(at(6), 4.0), (at(1990), 8.0)], [(at(4000), 16.0)]):
        spark.createDataFrame(rows, "t timestamp, v double").coalesce(1).write.mode("append").parquet(path)
    got = windows.run_windowed(windows.stream_of_files(spark, path), "t", "60 seconds", [F.sum("v").alias("total")], late="10 minutes")
    base = int(T0.timestamp())
    assert {(r.start - base, r.total) for r in got.collect()} == {(0, 1.0), (1980, 42.0), (3960, 16.0)}


def test_staged_files_hold_all_rows(spark, small):
    e = spark.read.parquet(f"{small}/events.parquet")
    path = windows.staged(e, "ts", 3, close="1 DAY")
    got = spark.read.parquet(path)
    assert got.count() == e.count() + 1 and got.where("event_id IS NULL").count() == 1
    assert windows.staged(e.limit(0), "ts", 2)


@pytest.mark.parametrize("size_s", [3600, 7200])
def test_stream_publishes_and_corrects_as_the_batch_form(spark, small, size_s):
    """Files by processing time, one a micro-batch; a clock that runs a month ahead moves nothing."""
    p = spark.read.parquet(f"{small}/processed_locations.parquet").select("event_id", "driver_id", "recorded_at", "processed_at")
    ahead = p.limit(1).select(F.lit("ahead").alias("event_id"), "driver_id", (F.col("recorded_at") + F.expr("INTERVAL 30 DAYS")).alias("recorded_at"), F.lit(p.agg(F.min("processed_at")).first()[0]).alias("processed_at"))
    p = p.unionByName(ahead)
    state = files.new_path(spark, "late")
    stream = windows.stream_of_files(spark, windows.staged(p, "processed_at", 4))
    late.stream_driver_hours(stream, state, size_s=size_s).option("checkpointLocation", f"{state}-c").trigger(availableNow=True).start().awaitTermination()
    want = {(r.driver_id, r.period_start): (r.n_published, r.n_corrected) for r in late.driver_hours(p, size_s=size_s).collect()}

    def counts(state):
        e = late.read_emissions(spark, state).where("emitted_s IS NOT NULL")
        e = e.groupBy("key", "window_start").agg(F.sum(F.when(F.col("revision") == 0, F.col("delta")).otherwise(0)).alias("first"), F.max("n").alias("n"))
        return {(r.key, r.window_start): (r.first, r.n) for r in e.collect()}

    assert counts(state) == {k: v for k, v in want.items() if v[1]}
    moved = files.new_path(spark, "compacted")
    late.compacted(spark, state, moved)
    assert counts(moved) == counts(state)


def test_backpressure(spark):
    a = spark.createDataFrame([(1, 10), (2, 30), (3, 0)], "tick long, n long")
    assert [tuple(r) for r in windows.backpressure(a, 15, 10).orderBy("tick").collect()] == [(1, 10, 0, 0), (2, 15, 10, 5), (3, 10, 0, 0)]
