"""Structured Streaming over the events table: windowed counts and duplicates within a watermark.

Each query drains the files that are there (availableNow) into a table in the shared folder, with its own
checkpoint; the state is bounded by the watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidegrid.sources.files import scratch

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.readStream.schema(SCHEMA).parquet(f"{sf_dir.rstrip('/')}/event[s].parquet").withWatermark("ts", "31 days")


def _drained(spark: SparkSession, rows: DataFrame, mode: str) -> DataFrame:
    base = scratch(spark, "stream")
    if mode == "append":
        query = rows.writeStream.format("parquet").option("path", f"{base}/rows").option("checkpointLocation", f"{base}/checkpoint")
        query.outputMode("append").trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(rows.schema).parquet(f"{base}/rows")
    # Complete results replace the table at each batch; the last one stands.
    query = rows.writeStream.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{base}/rows")).option("checkpointLocation", f"{base}/checkpoint")
    query.outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{base}/rows")


def tumbling_counts(spark: SparkSession, sf_dir: str, width: str = "1 hour") -> DataFrame:
    counts = read_events(spark, sf_dir).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("total"))
    return _drained(spark, counts.select(F.col("window.start").alias("window_start"), "event_type", "n", "total"), "complete")


def deduplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = read_events(spark, sf_dir).withColumn("hour", F.date_trunc("hour", "ts"))
    return _drained(spark, keyed.dropDuplicatesWithinWatermark(["user_id", "event_type", "hour"]).select("user_id", "event_type", "hour"), "append")


def collect_new(spark: SparkSession, source: str, base: str, keys: list[str]) -> None:
    """One run over what is new in the folder ``source``: rows with an unknown key join the store in ``base``.

    The checkpoint stays in ``base``, so a run goes on where the last one ended, and the store is the memory of all
    keys. A batch that is repeated after a failure writes its own folder anew."""
    store = f"{base}/store"

    def merge(batch: DataFrame, number: int) -> None:
        fresh = batch.dropDuplicates(keys).select(*keys)
        known = spark.read.schema(StructType([*fresh.schema.fields, StructField("batch", LongType())])).parquet(store).where(F.col("batch") < number).select(*keys)
        fresh.join(known, keys, "left_anti").write.mode("overwrite").parquet(f"{store}/batch={number}")

    rows = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    query = rows.writeStream.foreachBatch(merge).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True)
    spark.createDataFrame([], rows.select(*keys).schema).write.mode("append").parquet(f"{store}/batch=-1")
    query.start().awaitTermination()


def repeated_runs(spark: SparkSession, events: DataFrame) -> DataFrame:
    """run and n_added of three runs: over even events, over all events that arrive later, and over nothing new."""
    base = scratch(spark, "runs")
    keyed = events.select("event_id", "user_id", "event_type", F.date_trunc("hour", "ts").alias("hour"))
    keys = ["user_id", "event_type", "hour"]
    keyed.where("event_id % 2 = 0").write.parquet(f"{base}/arrived")
    collect_new(spark, f"{base}/arrived", base, keys)
    keyed.write.mode("append").parquet(f"{base}/arrived")
    collect_new(spark, f"{base}/arrived", base, keys)
    collect_new(spark, f"{base}/arrived", base, keys)
    return spark.read.parquet(f"{base}/store").where("batch >= 0").groupBy((F.col("batch") + 1).alias("run")).agg(F.count(F.lit(1)).alias("n_added"))
