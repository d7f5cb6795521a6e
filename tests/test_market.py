"""Semantics on tiny frames: nulls, ties, totals, gates."""

import pytest
from pyspark.sql import functions as F

from tidegrid.functions.periods import month_list, resolve_period
from tidegrid.operators import market as op

SCHEMA = "time_period string, market string, wholesale double, line long"


def test_total_row_goes_before_detail(spark):
    rows = spark.createDataFrame([("2024-01", "A", 1.0, 1), ("2024-01", " grand  TOTAL", 9.0, 2), ("2024-02", "Small all", 2.0, 3), ("2024-02", None, 5.0, 4), ("2024-03", " ", 4.0, 5)], SCHEMA)
    assert {r[0]: r[1] for r in op.preferred_total(rows, "market", "wholesale").collect()} == {"2024-01": 9.0, "2024-02": 2.0, "2024-03": 4.0}


def test_ranking_leaves_blank_and_total_labels_out_and_breaks_ties_by_name(spark):
    rows = spark.createDataFrame([("2024-01", "b", 2.0, 1), ("2024-01", "a", 2.0, 2), ("2024-01", None, 7.0, 3), ("2024-01", "合计", 7.0, 4), ("2024-01", "N/A", 1.0, 5)], SCHEMA)
    assert [tuple(r) for r in op.ranking(rows, "market", "wholesale").orderBy("rank").collect()] == [(1, "a", 2.0, 0.4), (2, "b", 2.0, 0.4), (3, "N/A", 1.0, 0.2)]
    shares = [r["share"] for r in op.ranking(rows, "market", "wholesale", total=F.lit(10.0)).orderBy("rank").collect()]
    assert shares == [0.2, 0.2, 0.1]


def test_change_without_a_base_is_null(spark):
    rows = spark.createDataFrame([(1.0, 0.0), (1.0, None), (3.0, 2.0)], "a double, b double")
    assert [r[0] for r in rows.select(op.change(F.col("a"), F.col("b"))).collect()] == [None, None, 0.5]


def test_power_groups_match_whole_labels(spark):
    rows = spark.createDataFrame([("EV",), (" phev ",), ("MHV/PHV",), ("N/A",), ("ICE",), (None,)], "p string")
    assert [r[0] for r in rows.select(op.power_group(F.col("p"))).collect()] == ["new_energy", "new_energy", "unclassified", "unclassified", "fuel", "unclassified"]
    assert rows.where("p = 'N/A'").select(op.power_group(F.col("p"), {"n/a": "fuel"})).first()[0] == "fuel"


def test_periods():
    months = month_list("2023-01", "2023-06") + month_list("2024-01", "2024-05")
    assert month_list("2023-11", "2024-02") == ["2023-11", "2023-12", "2024-01", "2024-02"]
    p = resolve_period(months, "range", "2024-01", "2024-06")
    assert not p.complete and p.comparable and p.stock == "2024-05" and p.warnings == ("missing months: 2024-06",)
    assert resolve_period(months).trend == tuple(months) and resolve_period([]).warnings
    with pytest.raises(ValueError):
        resolve_period(months, "single", "2022-01")
    with pytest.raises(ValueError):
        resolve_period(months, "range", "2024-02", "2024-01")


def test_reconcile_keeps_the_first_value_and_counts_conflicts(spark):
    rows = spark.createDataFrame(
        [("2024-01", None, 5.0, None, 1, "s1"), ("2024-01", None, 6.0, 2.0, 2, "s2"), ("2024-02", "x", None, 3.0, 1, "s1"), ("2024-02", "x", None, 3.0 + 1e-12, 2, "s2")],
        "time_period string, brand string, a double, b double, place int, sheet string",
    )
    got = {r["time_period"]: (r["a"], r["b"], r["conflicts"], r["a_sheets"], r["b_sheets"]) for r in op.first_value_reconcile(rows, ["time_period", "brand"], ["a", "b"], "place", "sheet").collect()}
    assert got == {"2024-01": (5.0, 2.0, 1, "s1 | s2", "s2"), "2024-02": (None, 3.0, 0, "", "s1 | s2")}


def test_all_errors_of_specs_are_told_together(spark):
    rows = spark.createDataFrame([("2024-01", "a", 1.0, 1)], SCHEMA)
    with pytest.raises(ValueError, match=r"x: no aggregation median; x: no column sold; y: no column nowhere"):
        op.indicators(rows, [op.Indicator("x", "sold", "median"), op.Indicator("y", "wholesale", "sum", {"nowhere": ["1"]})], ("2024-01",), ())


def test_shifted_join_matches_null_keys_and_missing_months(spark):
    rows = spark.createDataFrame([("2023-01", None, 2.0), ("2024-01", None, 3.0), ("2024-02", None, 4.0)], "time_period string, k string, v double")
    assert {r["time_period"]: r["v_before"] for r in op.with_shifted(rows, 12, ["v"], "before", ("k",)).collect()} == {"2023-01": None, "2024-01": 2.0, "2024-02": None}
