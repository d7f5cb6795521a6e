"""Replayed clocks and counters that expire."""

import time

from pyspark.sql import functions as F

from tidegrid.streaming import timers


def test_a_replayed_clock(spark, tmp_path):
    ticks = str(tmp_path / "ticks")
    for at in ("00:10", "00:40", "03:30", "07:45"):
        rows = [("a", f"2024-01-01 {at}:00", 3_600_000, 0), ("b", f"2024-01-01 {at}:00", 1_800_000, 4 * 3_600_000)]
        spark.createDataFrame(rows, "source string, ts string, every_ms long, takes_ms long").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(ticks)
        time.sleep(0.01)
    runs = [sorted((r["source"], str(r["due"])[11:16], str(r["fired"])[11:16], r["skipped"]) for r in timers.triggers(spark, ticks).collect()) for _ in range(2)]
    # Late times coalesce; b's first run goes on until 04:40.
    assert runs[0] == runs[1] == [("a", "01:00", "03:30", False), ("a", "04:00", "07:45", False), ("b", "00:30", "00:40", False), ("b", "01:00", "03:30", True), ("b", "04:00", "07:45", False)]


def test_a_counter_expires(spark, tmp_path):
    calls = [("x", k, s) for k, s in enumerate([0, 10, 59, 60, 61, 200])] + [("y", 10, 59), (None, 11, 0)]
    df = spark.createDataFrame(calls, "caller string, call long, s long").select("caller", "call", F.timestamp_seconds("s").alias("ts"))
    df.write.parquet(str(tmp_path / "calls"))
    rows = timers.limited_calls(spark, str(tmp_path / "calls"), 2, 60_000).collect()
    assert sorted(((r["caller"] or "", r["call"], r["n"], r["allowed"]) for r in rows)) == [("", 11, 1, True), ("x", 0, 1, True), ("x", 1, 2, True), ("x", 2, 3, False), ("x", 3, 1, True), ("x", 4, 2, True), ("x", 5, 1, True), ("y", 10, 1, True)]
