import pytest
from pyspark.sql import functions as F

from tidegrid.operators import merge, panel


def test_size_edges(spark):
    rows = spark.createDataFrame([(7.9,), (8.0,), (12.0,), (15.0,), (None,)], "s double")
    assert [r[0] for r in rows.select(panel.size_bucket(F.col("s"))).collect()] == ["<8", "8-12", "12-15", ">=15", None]


def test_all_row_holds_every_technology_but_shares_the_core(spark):
    rows = spark.createDataFrame([(2025, "M", "LTPS", 7.0, 80.0), (2025, "N", "a-Si", 9.0, 20.0), (2025, "M", "Oxide", 9.0, 50.0), (2024, "M", "LTPS", 7.0, 40.0)], "year int, maker string, technology string, size double, quantity double")
    got = {(r["technology"], r["bucket"]): r for r in panel.summary_matrix(rows, 2025, ["LTPS", "a-Si"], "M").collect()}
    last = got["All", "All"]
    assert last["market"] == 150.0 and last["maker"] == 80.0 and last["market_share"] == 1.0 and last["maker_market_share"] == 0.8
    assert got["LTPS", "<8"]["market_share"] == 0.8 and got["LTPS", "subtotal"]["growth_contribution"] == 1.0


def test_labels_of_the_current_year(spark):
    rows = spark.createDataFrame([(2024, 1), (2025, 3), (2025, 4), (2026, 1)], "year int, quarter int")
    assert sorted(r["period"] for r in panel.with_labels(rows, 2025).collect()) == ["Y24", "Y25F", "Y25F", "Y25Q1-Q3", "Y26Q1"]


def test_overlay_replaces_whole_quarters(spark):
    rows = spark.createDataFrame([(1, 2025, 1, "a"), (1, 2025, 1, "b"), (2, 2025, 1, "c"), (1, 2025, 2, "d")], "file int, year int, quarter int, id string")
    assert sorted(r["id"] for r in panel.overlay(rows, "file", "year", "quarter").collect()) == ["c", "d"]


def test_article_merge_sees_earlier_rows_of_its_batch(spark):
    stored = spark.createDataFrame([("u1", "h1"), ("u2", "h2"), ("u7", None)], "url string, content_hash string")
    rows = [
        ("u1", "h1", True, "duplicate_url"), ("u2", "h9", True, "update"), ("u3", "h1", True, "duplicate_content"), ("u4", "h4", True, "insert"),
        ("u4", "h5", True, "update"), ("u5", "h4", True, "insert"), ("u6", None, False, "skipped"), ("u4", "h5", True, "duplicate_url"),
        ("u4", "h6", True, "update"), ("u7", "h7", False, "update"), ("u8", "h9", True, "duplicate_content"), ("u8", "h8", False, "skipped"), ("u8", "h8", True, "insert"), ("u1", None, True, "update"),
    ]
    crawled = spark.createDataFrame([(u, h, i, c) for i, (u, h, c, _) in enumerate(rows)], "url string, content_hash string, place int, has_content boolean")
    got = {r["place"]: r["operation"] for r in merge.merge_articles(stored, crawled).collect()}
    assert got == {i: o for i, (*_, o) in enumerate(rows)}


def test_parents_in_a_circle_are_reported(spark):
    leaves = spark.createDataFrame([("x", "a", 1)], "node string, parent string, value long")
    parents = spark.createDataFrame([("a", "b"), ("b", "a")], "node string, parent string")
    with pytest.raises(ValueError):
        merge.with_children_totals(leaves, parents)


def test_pointers_move_to_newer_ready_versions_of_other_content(spark):
    current = spark.createDataFrame([(1, 5, "a"), (2, 5, "a"), (3, 5, "a")], "k int, version int, hash string")
    new = spark.createDataFrame([(1, 6, "b", True), (1, 7, "c", False), (2, 6, "a", True), (3, 4, "z", True), (4, 1, "n", True)], "k int, version int, hash string, ready boolean")
    assert {tuple(r) for r in merge.promoted(current, new, "k").collect()} == {(1, 6, "b", True), (2, 5, "a", False), (3, 5, "a", False), (4, 1, "n", True)}


def test_upsert_compares_null_safely(spark):
    schema = "k int, f string, first_seen int, last_seen int"
    old = spark.createDataFrame([(1, None, 1, 1), (2, "a", 1, 1), (3, "a", 1, 1)], schema)
    new = spark.createDataFrame([(1, None, 5, 5), (2, "b", 5, 5), (4, "c", 5, 5)], schema)
    got = {r["k"]: (r["f"], r["first_seen"], r["last_seen"], r["operation"]) for r in merge.upsert(old, new, ["k"], ["f"], "first_seen", "last_seen").collect()}
    assert got == {1: (None, 1, 5, "existing"), 2: ("b", 1, 5, "update"), 3: ("a", 1, 1, "kept"), 4: ("c", 5, 5, "insert")}


def test_no_scope_allows_nothing(spark):
    rows = spark.createDataFrame([(1, "0,7", 3)], "dept int, ancestors string, owner int")
    allowed = lambda scopes: rows.where(merge.data_scope(scopes, F.col("dept"), F.col("ancestors"), F.col("owner"))).count()
    assert allowed([]) == 0 and allowed([("all", None)]) == 1 and allowed([("dept_and_child", 7)]) == 1 and allowed([("self", 4)]) == 0


def test_open_and_listed_roles(spark):
    rows = spark.createDataFrame([(None,), ("",), ("1, 2",), ("3",)], "roles string")
    assert [r[0] for r in rows.where(merge.role_allows(F.col("roles"), ["2"])).collect()] == [None, "", "1, 2"]
    assert rows.where(merge.role_allows(F.col("roles"), [], admin=True)).count() == 4
