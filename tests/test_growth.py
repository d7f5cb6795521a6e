"""What grows with the input: how often a costly step is computed, and what a task holds."""

from pyspark.sql import functions as F

import __spark_entry__
from tidegrid.functions import headers
from tidegrid.operators import graph, knowledge
from tidegrid.streaming import timers

SF_DIR = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_bands_of_repeated_and_missing_rows_in_tasks_of_bounded_size(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(1, r) for r in (1, 1, 2, 9, 11, 11, None, 30, None)] + [(2, 5), (2, 5), (3, None)], "l_suppkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr("tidegrid.plans.ingest._ROWS_A_TASK", 2)
    df = __spark_entry__.queries()["gaps_islands"](spark, str(tmp_path))
    assert sorted(tuple(r) for r in df.select("sheet", "band", "first_row", "last_row", "n_rows").collect()) == [(1, 0, 1, 2, 2), (1, 1, 9, 11, 2), (1, 2, 30, 30, 2)]
    assert "RepartitionByExpression [sheet" in plan(df) and ", 7" in plan(df)


def test_events_are_judged_once(spark):
    rows = spark.createDataFrame([(1, "甲发布 新车。"), (2, "甲发布新车。"), (2, "乙。"), (3, None)], "k int, sentence string")
    df = knowledge.distinct_events(rows, "k")
    assert [(r["kind"], r["text"], r["n_sources"], r["first_source"]) for r in df.collect()] == [("产品发布", "甲发布新车。", 2, 1)]
    assert plan(df).count(knowledge.EVENTS[0][1]) == 1


def test_sources_are_not_visited_one_by_one(spark, tmp_path):
    rows = spark.range(3000).select(F.when(F.col("id") > 0, F.col("id").cast("string")).alias("source"), F.lit(1000).cast("long").alias("every_ms"), F.lit(0).cast("long").alias("takes_ms"))
    for s in (1, 2, 2):  # the last ones come too late to count
        rows.withColumn("ts", F.timestamp_seconds(F.lit(s))).coalesce(1).write.mode("append").parquet(str(tmp_path))
    found = timers.triggers(spark, str(tmp_path))
    assert found.count() == 3000 and found.where("source is null and not skipped and due = fired").count() == 1
    assert not hasattr(timers, "_Triggers")
def test_entities_are_looked_for_once(spark):
    rows = spark.createDataFrame([(1, 0, "x", None, "company", "X 甲。乙"), (2, 0, "y", "z, 甲", "company", "甲！")], "chunk int, place int, name string, aliases string, kind string, text string")
    df = graph.grounded(rows, "text", ["company"])
    assert sorted((r["chunk"], r["contexts"]) for r in df.collect()) == [(1, ["X 甲。"]), (2, ["甲！"])]
    assert plan(df).count("regexp_extract_all") == 1


def test_a_name_is_cleaned_once(spark):
    df = spark.createDataFrame([("国内 批发销量",)], "c string").select(headers.metric_named(F.col("c")).alias("m"))
    assert df.first()["m"] == "domestic_wholesale" and plan(df).count("regexp_replace") == 1


def test_edges_are_sorted_once_and_held_in_no_map(spark):
    text = __spark_entry__.queries()["edges_with_evidence"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" not in text and text.count("Sort [from_key") == 1
