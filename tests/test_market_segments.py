"""Segments, audits of mixes, overviews and gates by hand."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tidegrid.operators import market, panel, text


def flags(spark, labels, region, overrides=None):
    df = spark.createDataFrame([(x,) for x in labels], "market string")
    return {r["market"]: (r["is_passenger"], r["is_commercial"]) for r in market.market_segments(df, "market", region, overrides).collect()}


def test_segments_by_weight_only_where_all_weights_are_there(spark):
    us = ["Cars", " light trucks", "Medium Trucks", "Heavy Trucks", "Bus", None]
    assert flags(spark, us, " USA ") == {"Cars": (True, False), " light trucks": (True, False), "Medium Trucks": (False, True), "Heavy Trucks": (False, True), "Bus": (False, False), None: (False, False)}
    assert flags(spark, us[:3], "USA")[" light trucks"] == (False, False) and flags(spark, us, "EU")["Bus"] == (False, True)
    assert flags(spark, ["乘用车 SUV", "x"], "", {"X ": "commercial_vehicle", "乘用车 suv": "other"}) == {"乘用车 SUV": (False, False), "x": (False, True)}
    assert flags(spark, [], "us") == {}


def test_audit_of_a_mix(spark):
    df = spark.createDataFrame([("m", "a", 3.0), ("m", "b", 1.0), ("m", "合计", 9.0), ("n", "c", 0.0)], "p string, k string, v double")
    rows = market.mix_audit(df, "k", F.when(F.col("k") == "a", "known").otherwise("unclassified"), "v", "p").collect()
    assert {r["p"]: (r["total"], r["classified"], r["coverage"], r["unknown"]) for r in rows} == {"m": (4.0, 3.0, 0.75, ["b"]), "n": (0.0, None, None, ["c"])}


def test_overview(spark):
    df = spark.createDataFrame([("x", "2024-03", 6.0), ("x", "2023-03", 3.0), ("x", "2024-02", 0.0), ("y", "2024-03", 1.0)], "d string, time_period string, s double")
    rows = market.overview(df, "d", ["s"], "2024-03", "2023-03", "2024-02").collect()
    assert {r["d"]: (r["s"], r["yoy_s"], r["mom_s"]) for r in rows} == {"x": (6.0, 1.0, None), "y": (1.0, None, None)}


def test_contributions(spark):
    df = spark.createDataFrame([("a", 2001, 6.0), ("a", 2000, 2.0), ("b", 2001, 5.0), ("rest", 2001, 9.0), ("rest", 2000, 8.0)], "c string, year int, q double")
    rows = panel.top_with_rest(df, "c", "q", 2001, 2, ["rest"]).collect()
    assert [(r["rank"], r["c"], r["contribution"], r["share"]) for r in rows] == [(1, "a", 0.4, 0.3), (2, "b", 0.5, 0.25)]


def test_gates(spark):
    df = spark.createDataFrame([("The cat",), ("a DOG and the cat",), (None,)], "t string")
    gate = lambda mode, words: [(list(r[0]), r[1]) for r in df.select(*text.keyword_gate(F.col("t"), words, mode)).collect()]
    assert gate("any", ["dog", "CAT"]) == [(["CAT"], True), (["dog", "CAT"], True), ([], False)]
    assert [p for _, p in gate("all", ["dog", "CAT"])] == [False, True, False] and gate("off", ["dog"]) == [([], True)] * 3 and gate("any", []) == [([], True)] * 3
    with pytest.raises(ValueError, match="mode"):
        text.keyword_gate(F.col("t"), ["x"], "some")


def test_types_that_appear_at_once_share_their_number(spark, tmp_path):
    lines = [(1, 1, 1), (1, 1, 2), (2, 1, 3), (2, 1, 1)]
    rows = spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long").selectExpr("*", "1.0D AS l_quantity", "'N' AS l_returnflag", "timestamp'1996-01-02' AS l_shipdate")
    rows.write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, "SMALL"), (2, "LARGE"), (3, "PROMO")], "p_partkey long, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    got = {r["label"]: r["series"] for r in __spark_entry__.queries()["power_type_monthly"](spark, str(tmp_path)).collect()}
    assert got == {"SMALL": 1, "LARGE": 1, "PROMO": 2}
