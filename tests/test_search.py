"""Dictionaries in one block and in many, an index against brute force, and points by hand."""

import collections
import math
import random

from pyspark.sql import functions as F

from tidegrid.operators import search as op


def longest_first(text, terms):
    text, out, at = (text or "").lower(), [], 0
    while at < len(text):
        found = max((t for t in terms if text.startswith(t, at)), key=len, default=None)
        if found:
            out.append((at, at + len(found), found))
        at += len(found) if found else 1
    return out


def test_blocks_of_a_dictionary_find_the_same(spark):
    r = random.Random(2)
    terms = sorted({"".join(r.choice("abé") for _ in range(r.randint(1, 5))) for _ in range(40)})
    texts = [(k, "".join(r.choice("abéAB ,") for _ in range(r.randint(0, 60))), "x") for k in range(40)] + [(99, None, "y"), (98, "", None), (97, "ab" * 5000, "z")]
    df = spark.createDataFrame(texts, "id int, text string, term string").repartition(3)
    words = spark.createDataFrame([(t.upper(),) for t in terms] + [(None,), (" ",), (terms[0],)], "term string")
    want = {k: longest_first(t, terms) for k, t, _ in texts}
    for most in (op.MOST, 20):
        rows = op.terms_in(df, "text", words, most).collect()
        assert {x["id"]: [(m["place"], m["end"], m["term"]) for m in x["found_"]] for x in rows} == want and rows[0].asDict().keys() == {"id", "text", "term", "found_"}
    assert all(x["found_"] == [] for x in op.terms_in(df, "text", words.limit(0)).collect())


def test_index_against_brute_force(spark):
    r = random.Random(4)
    docs = [(k, " ".join("".join(r.choice("abC") for _ in range(r.randint(1, 4))) for _ in range(r.randint(0, 12)))) for k in range(50)] + [(50, None), (51, "")]
    index = op.index_of(spark.createDataFrame(docs, "id int, text string").repartition(3), "id", "text")
    tf = {k: collections.Counter(g for i in range(len(t or "") - 1) for g in [t.lower()[i : i + 2]] if " " not in g) for k, t in docs}
    df = collections.Counter(g for c in tf.values() for g in c)
    score = {k: round(sum(c[g] * math.log10(len(docs) / df[g]) ** 2 for g in ("ab", "bc", "ca") if df[g]), 6) for k, c in tf.items()}
    want = sorted(((-s, k) for k, s in score.items() if s > 0))[:7]
    assert [(-x["score"], x["id"]) for x in op.search(index, "id", "Abc zz ca", 7).collect()] == want
    assert op.search(index, "id", " ", 7).count() == 0
    plan = op.search(index, "id", "ab", 7)._jdf.queryExecution().toString()
    assert "In(gram" in plan or "EqualTo(gram" in plan  # the postings of other grams aren't read
    empty = op.index_of(spark.createDataFrame([], "id int, text string"), "id", "text")
    assert op.search(empty, "id", "ab", 7).count() == 0


def test_points_and_order(spark):
    rows = [
        (1, "2023年营收", 1, "营业收入合计", "report 2022"), (1, "2023年营收", 2, "none", "report 2023"), (1, "2023年营收", 3, "none", None), (1, "2023年营收", 4, None, ""),
        (2, "员工人数", 1, "万辆", "x"), (2, "员工人数", 2, "万辆 人员", "of 2019 and 2021"), (3, None, 1, "闪电配售", "2020"),
    ]
    found = op.reranked(spark.createDataFrame(rows, "q int, question string, rank int, content string, names string"), "q").collect()
    assert {(x["q"], x["rank"]): (x["points"], x["place"]) for x in found} == {(1, 1): (40, 2), (1, 2): (200, 1), (1, 3): (0, 3), (1, 4): (0, 4), (2, 1): (-40, 2), (2, 2): (21, 1), (3, 1): (20, 1)}


def test_domains_and_kinds(spark):
    asked = {"销售费用是多少": ("FINANCIAL", "FACT"), "销售量对比": ("VEHICLE_SALES", "COMPARISON"), "有哪些产品系列": ("PRODUCT", "FACT"), "": ("GENERAL", "GENERAL"), "研发项目如何": ("RESEARCH", "SUMMARY")}
    df = spark.createDataFrame([(q,) for q in asked], "q string").select("q", op.domain(F.col("q")).alias("d"), op.kind(F.col("q")).alias("k"))
    assert {x["q"]: (x["d"], x["k"]) for x in df.collect()} == asked


def test_tasks_of_an_index_follow_its_texts(spark, monkeypatch):
    docs = spark.createDataFrame([(k, "abc " * 10) for k in range(40)] + [(1, "abd")], "id int, text string")
    monkeypatch.setattr(op, "CHARACTERS", 100, raising=False)
    postings, grams = op.index_of(docs, "id", "text")
    assert len(postings.inputFiles()) > 4  # more than shuffle partitions that the session has
    assert {tuple(r) for r in postings.where("id = 1").collect()} == {("ab", 1, 11), ("bc", 1, 10), ("bd", 1, 1)} and postings.count() == 81 and grams.count() == 3
