"""Sheets, dates, shipment records and datasets on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from tidegrid.functions import dates, headers, shipments
from tidegrid.operators import sheets as op
from tidegrid.sources import files


def cells(spark, rows, file="f", sheet="s"):
    made = [(file, sheet, r, c, None if v is None else str(v)) for r, row in enumerate(rows, 1) for c, v in enumerate(row, 1)]
    return spark.createDataFrame(made, "file string, sheet string, row int, col int, value string")


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "c string").select(make(F.col("c"))).first()[0]


def test_header_rows(spark):
    rows = [["title", None], [None, None], ["品牌", "车型", "202401", "202402"], ["A", "A1", 1, 2]]
    got = op.header_rows(cells(spark, rows)).collect()
    assert [(r["header_row"], r["score"]) for r in got] == [(3, 2 * 10 + 4 * 2 + 2 + 2 * 7 + 10)]
    assert op.header_rows(cells(spark, [["x"], [None, "1"]])).count() == 0


def test_headers_repeat_and_the_first_of_a_field_counts(spark):
    table = cells(spark, [["品牌", "brand", "备注", "备注", None]])
    rows = spark.createDataFrame([("f", "s", 1)], "file string, sheet string, header_row int")
    got = {r["col"]: (r["header"], r["field"]) for r in op.header_cells(table, rows).collect()}
    assert got == {1: ("品牌", "brand"), 2: ("brand", None), 3: ("备注", None), 4: ("备注_2", None), 5: ("未命名列", None)}


def test_fields_and_periods(spark):
    assert [one(spark, h, headers.field_of) for h in (" 整车厂/品牌 ", "Retail  Sales", "国内批发量", "nothing", None)] == ["brand", "retail_sales", "domestic_wholesale", None, None]
    assert [one(spark, h, headers.is_period_header) for h in ("202401", "202413", "2024年3月", "2024Q1", "2024", "3月")] == [True, False, True, True, True, False]
    assert [one(spark, t, headers.metric_named) for t in ("2024国内批发销量", "产量和库存", "汽车销量", "出口 零售销量")] == ["domestic_wholesale", None, "sales", None]


def test_blocks_carry_brands_down_but_not_across_blocks(spark):
    months = [f"{m}月" for m in range(1, 8)]
    rows = [["品牌", "动力类型", *months, "2024年"], ["A", "EV", 1, None, "-", 4], [None, "ICE", 2], ["A 合计", None, 9], ["品牌", "动力类型", *months, "2025"], [None, "EV", 7], ["B", None, "1,000"]]
    heads = spark.createDataFrame([("f", "s", [1, 5])], "file string, sheet string, header_rows array<int>")
    got = sorted((r["time_period"], r["brand"] or "", r["power_type"] or "", r["export"], r["source_cell"]) for r in op.annual_blocks(cells(spark, rows), heads, "export").collect())
    assert got == [("2024-01", "A", "EV", 1.0, "C2"), ("2024-01", "A", "ICE", 2.0, "C3"), ("2024-04", "A", "EV", 4.0, "F2"), ("2025-01", "", "EV", 7.0, "C6"), ("2025-01", "B", "", 1000.0, "C7")]


def test_merged_cells_and_regions(spark):
    table = cells(spark, [["a", None], [None, "x"]])
    merged = spark.createDataFrame([("f", "s", 1, 1, 2, 1)], "file string, sheet string, top int, left int, bottom int, right int")
    got = {(r["row"], r["col"]): r["value"] for r in op.filled_rectangles(table, merged).collect()}
    assert got == {(1, 1): "a", (1, 2): None, (2, 1): "a", (2, 2): "x"}
    wide = cells(spark, [["a", "b", None, None, "p", "q"], ["c", "d", None, None, "r", "s"], [None], [None], ["z", "z"]])
    assert sorted((r["first_col"], r["last_col"], r["last_row"]) for r in op.column_bands(wide).collect()) == [(1, 2, 2), (5, 6, 2)]


def test_letters(spark):
    got = spark.createDataFrame([(1,), (26,), (27,), (52,), (53,)], "c int").select(op.letters(F.col("c"))).collect()
    assert [r[0] for r in got] == ["A", "Z", "AA", "AZ", "BA"]


def test_publish_dates(spark):
    cases = {
        "2026年9月3日 发布": "2026-09-03", "202609030830": "2026-09-03", "20260231": None, "1700000000": "2023-11-14", "1700000000123": "2023-11-14", "11/07/26": "2026-07-11",
        "05/16/2025": "2025-05-16", "04/09/2026": None, "16/05/2025": None, "Wed Aug 26 00:01:00 CEST 2026": "2026-08-26", "Sept. 5, 2026": "2026-09-05", "26 August 2026": "2026-08-26",
        "Augustus 5, 2026": None, "3小时前": None, "": None, None: None, "2026-13-01": None,
    }
    for text, day in cases.items():
        got = one(spark, text, dates.parse_publish_date)
        assert (str(got) if got else None) == day, text


def test_publication_times(spark):
    cases = {"2026-09-03": "2026-09-03", "2026-09-03T08:30:00Z": "2026-09-03T08:30:00+00:00", "2026-09-03T08:30:00+08:00": "2026-09-03T00:30:00+00:00", "2026-09-03 08:30": "2026-09-03", "13/09/2026": "2026-09-13", "09/13/26": "2026-09-13", "09/10/2026": None, "1700000000123": "2023-11-14T22:13:20.123000+00:00", "yesterday": None}
    for text, stored in cases.items():
        assert one(spark, text, dates.published_at) == stored, text
    assert one(spark, "09/10/2026", lambda c: dates.published_at(c, "dd/MM/yyyy")) == "2026-10-09"


def test_shipment_names(spark):
    assert [one(spark, t, shipments.technology) for t in ("LTPS TFT", "A_SI", "asi", "Oxide", "OLED", None)] == ["LTPS", "a-Si", "a-Si", "Oxide", "", ""]
    assert [one(spark, t, shipments.maker) for t in (" China Star", "New", "", None)] == ["CSOT", "New", None, None]
    assert one(spark, "A/B - c", shipments.slug) == "a_b_c" and one(spark, "(A) b.", shipments.slug_each) == "a__b"
    labels = [tuple(r) for r in spark.createDataFrame([("X 1Q26",), ("26 1Q x",), ("A 4Q25 with 3Q25 Results",), ("with 4Q25 Results",), ("none",)], "c string").select(shipments.quarter_label(shipments.publication(F.col("c"))["publication"]), shipments.quarter_label(shipments.publication(F.col("c"))["data_through"])).collect()]
    assert labels == [("1Q26", "4Q25"), ("1Q26", "4Q25"), ("4Q25", "3Q25"), ("1Q26", "4Q25"), (None, None)]


def test_dialects():
    assert files.dialect("名称;值\n甲;1,5\n".encode("gb18030")) == ("GB18030", ";")
    assert files.dialect("﻿a\tb\n1\t2\n".encode()) == ("UTF-8", "\t")
    assert files.dialect("价格|数量\n1|2\n".encode()[:-1]) == ("UTF-8", "|") and files.dialect(b"") == ("UTF-8", ",")


def test_datasets_stay_in_their_folder(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "sheet string, v int")
    files.save_dataset(rows, str(tmp_path), "d", ["sheet"], {"title": "t"})
    assert files.describe_dataset(spark, str(tmp_path), "d") == {"title": "t", "columns": ["sheet", "v"]} and files.load_dataset(spark, str(tmp_path), "d").count() == 2
    for name in ("../d", "", "a/b", ".."):
        with pytest.raises(ValueError):
            files.delete_dataset(spark, str(tmp_path), name)
    assert files.delete_sheet(spark, str(tmp_path), "d", "sheet", "a") and files.load_dataset(spark, str(tmp_path), "d").count() == 1
    assert files.delete_dataset(spark, str(tmp_path), "d") and not (tmp_path / "d").exists()


def test_only_text_files_have_a_reader(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("名称,数量\n甲,\n".encode("gb18030"))
    assert [tuple(r) for r in files.read_table_file(spark, str(tmp_path / "a.csv")).collect()] == [("甲", None)]
    with pytest.raises(ValueError):
        files.read_table_file(spark, "x.xlsx")
