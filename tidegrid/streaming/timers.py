"""Timers and counters that expire, as state of a stream: triggers of sources by a replayed clock, and limits of calls.

A clock is a stream of ticks; the latest tick so far is the time. What a source keeps is a few numbers, a row of a table that
each batch renews, so all sources are dealt over tasks and none is visited alone. A source's timer fires when the clock has passed it, once however many of its times have passed meanwhile (late
triggers coalesce), and not while its last run still goes on; the next timer is the first time after now. The same ticks give the same
triggers whenever they are replayed: nothing reads the machine's time.

Edge cases: a source without ticks has no timer; ticks and calls of one time and source are in any order; null sources are one source.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidegrid.sources.files import exists, scratch

_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Calls(StatefulProcessor):
    """Per caller: how many calls since the first one of its window, and when that ends."""

    def __init__(self, limit: int, window_ms: int):
        self.limit, self.window_ms = limit, window_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("window", "n long, ends long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        calls = pd.concat(list(rows)).sort_values(["ms", "call"])
        n, ends = self.state.get() if self.state.exists() else (0, -1)
        counts = []
        for now in calls["ms"].tolist():
            if now >= ends:  # the counter has expired
                n, ends = 0, now + self.window_ms
            n += 1
            counts.append(n)
        self.state.update((n, ends))
        yield pd.DataFrame({"caller": key[0], "call": calls["call"].to_numpy(), "n": counts, "allowed": [k <= self.limit for k in counts]})

    def close(self) -> None:
        pass


def _run(rows: DataFrame, name: str) -> DataFrame:
    """All that is there, batch by batch, into a table in the shared folder."""
    spark, base = rows.sparkSession, scratch(rows.sparkSession, name)
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, _STORE)
    try:
        query = rows.writeStream.format("parquet").option("path", f"{base}/rows").option("checkpointLocation", f"{base}/checkpoint").outputMode("append").trigger(availableNow=True)
        query.start().awaitTermination()
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    return spark.read.schema(rows.schema).parquet(f"{base}/rows")


def _after(held: DataFrame | None, ticks: DataFrame) -> DataFrame:
    """Per source what is kept after a batch of ticks: every, takes, due (its next time, a whole number of intervals), busy (when its last run ends), clock (the
    latest tick of all, the time now), and of the trigger that has come, if one has: set_for and skipped. Times are in milliseconds."""
    now = ticks.agg(F.max("ms").alias("_now"))  # one row
    if held is not None:
        last = held.agg(F.max("clock").alias("_last"))
        now = now.crossJoin(F.broadcast(last)).select(F.greatest("_now", "_last").alias("_now"))
        ticks = ticks.crossJoin(F.broadcast(last)).where("_last is null or ms > _last")  # later ones than the clock alone
    first = F.struct(F.col("ms"), F.col("every_ms").alias("every"), F.col("takes_ms").alias("takes"), (F.floor(F.col("ms") / F.col("every_ms")).cast("long") * F.col("every_ms") + F.col("every_ms")).alias("due"), F.lit(-1).cast("long").alias("busy"))
    rows = ticks.select("source", first.alias("s"))
    if held is not None:  # a source that is known goes before all ticks
        rows = rows.unionByName(held.select("source", F.struct(F.lit(-(2**63)).cast("long").alias("ms"), "every", "takes", "due", "busy").alias("s")))
    rows = rows.groupBy("source").agg(F.min("s").alias("s")).select("source", "s.every", "s.takes", "s.due", "s.busy").crossJoin(F.broadcast(now))
    fires, skipped = F.col("due") <= F.col("_now"), F.col("busy") > F.col("_now")
    following = F.floor(F.col("_now") / F.col("every")).cast("long") * F.col("every") + F.col("every")
    return rows.select(
        "source", "every", "takes", F.when(fires, following).otherwise(F.col("due")).alias("due"), F.when(fires & ~skipped, F.col("_now") + F.col("takes")).otherwise(F.col("busy")).alias("busy"),
        F.col("_now").alias("clock"), F.when(fires, F.col("due")).alias("set_for"), F.when(fires, skipped).alias("skipped"),
    )


def triggers(spark: SparkSession, ticks: str) -> DataFrame:
    """source, due (the time the timer was set for), fired (the clock's time) and skipped of each trigger.

    ``ticks``: a folder of files, each the ticks of one moment, in the order of their times: source, ts, every_ms and takes_ms. What sources keep is a table,
    which every batch joins with its ticks and writes anew under its number, so a batch that is run again gives the same."""
    base = scratch(spark, "triggers")
    kept = "source string, every long, takes long, due long, busy long, clock long, set_for long, skipped boolean"

    def step(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        held = own.read.schema(kept).parquet(f"{base}/kept/{number - 1}") if number else None
        _after(held, batch.select("source", F.unix_millis("ts").alias("ms"), "every_ms", "takes_ms")).write.mode("overwrite").parquet(f"{base}/kept/{number}")
        fired = own.read.schema(kept).parquet(f"{base}/kept/{number}").where("set_for is not null")
        fired.select("source", "set_for", "clock", "skipped").write.mode("overwrite").parquet(f"{base}/rows/batch={number}")

    stream = spark.readStream.schema("source string, ts timestamp, every_ms long, takes_ms long").option("maxFilesPerTrigger", 1).parquet(ticks)
    stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    found = spark.read.schema("source string, set_for long, clock long, skipped boolean, batch int").parquet(f"{base}/rows") if exists(spark, f"{base}/rows") else spark.createDataFrame([], "source string, set_for long, clock long, skipped boolean")
    return found.select("source", F.timestamp_millis("set_for").alias("due"), F.timestamp_millis("clock").alias("fired"), "skipped")


def limited_calls(spark: SparkSession, calls: str, limit: int, window_ms: int) -> DataFrame:
    """caller, call, n (its number in its caller's window) and allowed (n within the limit) of each call.

    A window begins with the first call after the last one has ended. ``calls``: Parquet files of caller, call and ts, in the order of time."""
    stream = spark.readStream.schema("caller string, call long, ts timestamp").parquet(calls).select("caller", "call", F.unix_millis("ts").alias("ms"))
    rows = stream.groupBy("caller").transformWithStateInPandas(_Calls(limit, window_ms), "caller string, call long, n long, allowed boolean", "Append", "None")
    return _run(rows, "calls")
