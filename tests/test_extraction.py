"""Places of entities and records by hand, and a graph table that is rebuilt."""

from pyspark.sql import functions as F

from tidegrid.operators import extraction as op

ITEM = "array<struct<kind:string,raw:string,evidence:string>>"
RECORD = f"array<struct<{','.join(f'{f}:string' for f in [*op.FIELDS, 'evidence'])}>>"


def test_entities(spark):
    text = "A sold 5. Then A sold 12 cm of mini led, B none."
    items = [("company", "A", "Then A"), ("COMPANY", " A ", "Then A sold"), ("COMPANY", "A", None), ("COMPANY", "B", "not there"), ("SIZE", "12 cm", ""), ("TECHNOLOGY", "Mini-LED", None), ("SALES", "1,500k", None), ("", "A", None), ("X", None, None)]
    df = spark.createDataFrame([(1, text, items), (2, None, items[:1]), (3, text, None)], f"id int, text string, items {ITEM}")
    got = {r["id"]: [(x["kind"], x["value"], x["first"], x["end"]) for x in r["e"]] for r in df.select("id", op.entities(F.col("text"), F.col("items")).alias("e")).collect()}
    assert got[1] == [("COMPANY", "A", 15, 16), ("COMPANY", "A", 0, 1), ("COMPANY", "B", 41, 42), ("SIZE", "4.7244 inch", 22, 27), ("TECHNOLOGY", "Mini LED", -1, -1), ("SALES", "1500000 unit", -1, -1)]
    assert got[2] == [("COMPANY", "A", -1, -1)] and got[3] == []
    evidence = df.where("id = 1").select(F.inline(op.entities("text" if False else F.col("text"), F.col("items")))).select("evidence").collect()
    assert evidence[0][0] == "Then A" and evidence[3 - 1][0].startswith("A sold 5")


def test_technologies(spark):
    names = {"micro_led panel": "Micro LED", "AMOLED": "OLED", "a-Si TFT": "a-Si", "bev": "BEV", "my bev": "my bev", "Plug-in hybrid": "PHEV", "plug": "plug"}
    df = spark.createDataFrame([(n,) for n in names], "n string").select("n", op.technology(F.col("n")).alias("t"))
    assert {r["n"]: r["t"] for r in df.collect()} == names


def test_records(spark):
    text = "S makes V for C. " + "x" * 400 + " 7 inch OLED, S again"
    rec = lambda **v: tuple(v.get(f) for f in [*op.FIELDS, "evidence"])
    items = [rec(supplier="S", vehicle="V", evidence="S makes V"), rec(supplier="S", vehicle=" V ", evidence="nothing"), rec(supplier="S", size="7 inch"), rec(supplier="S", size="7 inch", evidence="7 inch OLED, S"), rec(size="7 inch", technology="OLED"), rec(supplier="S", customer="not there")]
    df = spark.createDataFrame([(1, text, items), (2, None, items), (3, text, None)], f"id int, text string, items {RECORD}")
    got = {r["id"]: [(x["supplier"], x["vehicle"], x["size"], x["evidence"], x["first"], x["end"]) for x in r["e"]] for r in df.select("id", op.records(F.col("text"), F.col("items")).alias("e")).collect()}
    assert got == {1: [("S", "V", None, "S makes V", 0, 9), ("S", None, "7 inch", "7 inch OLED, S", 418, 432)], 2: [], 3: []}


def test_rebuilding_touches_no_other_version(spark, tmp_path):
    path, schema = str(tmp_path / "graph"), "v string, a string, n long"
    make = lambda *rows: spark.createDataFrame(list(rows), schema)
    versions = lambda *vs: spark.createDataFrame([(v,) for v in vs], "v string")
    rows = lambda: sorted(map(tuple, op.graph_at(spark, path, "a").select("v", "a", "n").collect()))
    op.rebuild(make(("x", "a", 1), ("y", "b", 2), ("z", "c", 3)), versions("x", "y", "z"), path, "v")
    assert rows() == [("x", "a", 1), ("y", "b", 2), ("z", "c", 3)]
    for _ in range(2):
        op.rebuild(make(("x", "new", 9), ("z", "ignored", 0)), versions("x", "y"), path, "v")
        assert rows() == [("x", "new", 9), ("z", "c", 3)]
