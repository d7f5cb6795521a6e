from pyspark.sql import functions as F

from tidegrid.functions import urls, values
from tidegrid.operators import text


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "c string").select(make(F.col("c"))).first()[0]


def test_numbers(spark):
    cells = {"353.2万（同比+2.8%）": 353.2, "同比-5%": -0.05, "12.5%": 0.125, "1,234": 1234.0, "--": None, "": None, None: None, "—": None, "销量": None, "5% 到 7%": 5.0}
    for cell, value in cells.items():
        assert one(spark, cell, values.parse_numeric) == value, cell
    assert one(spark, "353.2万（同比+2.8%）", values.extract_yoy) == 2.8 / 100 and one(spark, "2.8%", values.extract_yoy) is None


def test_periods(spark):
    cells = {"202401": "2024-01", "202401.0": "2024-01", "2025.11": "2025-11", "2025年3月": "2025-03", "2025Q3": "2025-Q3", "2025年3季度": "2025-Q3", "11月": "M11", "2025-13": "2025-13", "": None, "x" * 21: None}
    for cell, value in cells.items():
        assert one(spark, cell, values.parse_period) == value, cell
    assert [one(spark, c, values.quarter_of) for c in ("1", "q2", "3Q", "Quarter 4", "5")] == ["Q1", "Q2", "Q3", "Q4", None]


def test_urls(spark):
    cells = {"HTTP://A.com/x/?utm_source=1&b=2&ref=3#top": "http://a.com/x?b=2", "https://a.com": "https://a.com/", "ftp://a.com/x": None, "/x": None, "http://a.com/p;v=1?a&b=x%20y*&UTM_x=1&=z": "http://a.com/p?a=&b=x+y%2A&=z"}
    for cell, value in cells.items():
        assert one(spark, cell, urls.canonical_url) == value, cell
    assert one(spark, "http://m.a.com/x", lambda c: urls.is_allowed(c, [".a.com"])) and not one(spark, "http://ba.com/x", lambda c: urls.is_allowed(c, ["a.com"]))
    assert not one(spark, "http://a.com/x.PDF?q=1", urls.is_page)


def test_chunks_cover_the_text_and_prefer_line_ends(spark):
    body = ("word " * 190 + "\n") * 5
    cuts = text.cut_points(body, 1200, 120)
    assert cuts[0] == (0, 951) and cuts[-1][1] == len(body) and all(b - a <= 1201 for a, b in cuts)
    assert all(nxt[0] == max(a + 1, b - 120) for (a, b), nxt in zip(cuts, cuts[1:], strict=False))
    docs = spark.createDataFrame([(1, body), (2, None), (3, "  "), (4, "short")], "doc_id long, text string")
    got = text.fixed_chunks(docs).orderBy("doc_id", "chunk_no").collect()
    assert [(r["doc_id"], r["content"]) for r in got if r["doc_id"] != 1] == [(4, "short")]
    plain = body.replace(" \n", "\n").strip()
    assert [r["content"] for r in got if r["doc_id"] == 1] == [plain[a:b].strip() for a, b in text.cut_points(plain, 1200, 120)]


def test_ungrounded_numbers(spark):
    claims = spark.createDataFrame([(1, "1,200 of 5.5 and 7"), (2, None)], "k int, text string")
    evidence = spark.createDataFrame([(1, "1200 or 7")], "k int, text string")
    assert [tuple(r) for r in text.ungrounded(claims, evidence, "k").collect()] == [(1, "5.5")]


def test_seats(spark):
    hits = spark.createDataFrame([(i, "a" if i < 6 else "b") for i in range(8)], "i int, s string")
    assert [r["i"] for r in text.diversified(hits, "s", [F.col("i")], 5).orderBy("seat").collect()] == [0, 1, 6, 7, 2]


def test_rare_terms(spark):
    docs = spark.createDataFrame([("a", "common unique1"), ("b", "common"), ("c", None)], "s string, text string")
    assert [r[0] for r in text.rare_term_sources(docs, "s", ["unique1", "common"]).collect()] == ["a"]
    assert len(text.rare_term_sources(docs, "s", ["common"]).collect()) == 3
