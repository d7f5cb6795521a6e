"""In-row operators take time in proportion to a text's length; encodings by all lines; articles merged one by one."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tidegrid.functions import headers
from tidegrid.operators import evidence, graph, merge, text
from tidegrid.sources import files

ALIASES = {f"name{k}": f"entity{k}" for k in range(12)}
OPERATORS = {
    "clean_lines": lambda c: graph.clean_lines(c),
    "lines_near": lambda c: text.lines_near(c, "word 7"),
    "near_each_other": lambda c: evidence.near_each_other(c, F.array(F.lit("name1")), F.lit("no such target")),
    "pairs_of": lambda c: text.pairs_of(text.entities_of(c, ALIASES)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_twice_the_lines_take_about_twice_the_time(spark, name):
    def seconds(n):
        df = spark.createDataFrame([("\n".join(f"name{k % 12} in line {k} with word {k % 50}" for k in range(n)),)], "t string").coalesce(1)
        made = df.select(OPERATORS[name](F.col("t")).alias("x"))
        best = 1e9
        for _ in range(3):
            began = time.time()
            made.write.format("noop").mode("overwrite").save()
            best = min(best, time.time() - began)
        return best

    seconds(100)
    assert seconds(8000) <= 2.5 * seconds(4000) + 0.3


def test_values_stay(spark):
    row = spark.range(1).select(
        graph.clean_lines(F.lit("a\na\n\n b  c\nb c\na")).alias("lines"), text.lines_near(F.lit("x\ny\nz\nx"), "y").alias("near"), text.lines_near(F.lit(None).cast("string"), "y").alias("none"),
        evidence.near_each_other(F.lit("Acme sold it"), F.array(F.lit("acme")), F.lit("SOLD")).alias("is_near"),
        evidence.near_each_other(F.lit("Acme" + " " * 300 + "sold"), F.array(F.lit("acme")), F.lit("sold")).alias("is_far"),
        text.pairs_of(F.expr("array(struct(1 as place, 'b' as entity), struct(2 as place, 'a' as entity))")).alias("pairs"),
    ).first()
    assert row["lines"] == ["a", "b c", "a"] and row["near"] == [0, 1, 2] and row["none"] is None
    assert (row["is_near"], row["is_far"], [tuple(p) for p in row["pairs"]]) == (True, False, [("a", "b")])


def _file(tmp_path, data):
    path = tmp_path / "x.csv"
    path.write_bytes(data)
    return str(path)


def test_a_late_line_decides_the_encoding(spark, tmp_path):
    path = _file(tmp_path, b"a,b\n" + b"1,plain\n" * 30 + "2,销量\n".encode("gb18030"))
    before = spark.conf.get("spark.sql.legacy.javaCharsets", None)
    rows = files.read_csv(spark, path).collect()
    assert len(rows) == 31 and rows[-1]["b"] == "销量" and spark.conf.get("spark.sql.legacy.javaCharsets", None) == before


def test_utf8_with_quotes_over_lines(spark, tmp_path):
    path = _file(tmp_path, '﻿a;b\n1;"two\nlines"\n2;é\n3;\n'.encode())
    assert [(r["a"], r["b"]) for r in files.read_csv(spark, path).collect()] == [("1", "two\nlines"), ("2", "é"), ("3", None)]


def test_lines_of_no_encoding_are_an_error(spark, tmp_path):
    with pytest.raises(ValueError, match="utf-8"):
        files.read_csv(spark, _file(tmp_path, b"a,b\n1,\xff\xff\n"))


def test_an_empty_file(spark, tmp_path):
    assert files.read_csv(spark, _file(tmp_path, b"")).count() == 0


def test_headers_of_changes(spark):
    got = [spark.range(1).select(headers.field_of(F.lit(h))).first()[0] for h in ("销量同比", "零售同比", "Wholesale YoY", "同比产量", "出口销量同比", "库存同比")]
    assert got == ["yoy_sales", "yoy_retail_sales", "yoy_wholesale", "yoy_production", "yoy_export", None]
    assert not any(d.startswith("yoy_") or d in headers.METRICS for d in headers.dimensions())


def one_by_one(stored, crawled):
    store, out = dict(stored), []
    for url, content_hash, place, has_content in sorted(crawled, key=lambda r: r[2]):
        if url in store:
            operation = "duplicate_url" if store[url] == content_hash else "update"
            store[url] = content_hash
        elif content_hash is not None and content_hash in store.values():
            operation = "duplicate_content"
        elif has_content:
            operation, store[url] = "insert", content_hash
        else:
            operation = "skipped"
        out.append((place, operation))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_articles_one_by_one(spark, seed):
    r = random.Random(seed)
    stored = [(f"u{k}", r.choice(["h0", "h1", "h2", None, f"s{k}"])) for k in range(6)]
    crawled = [(f"u{r.randint(0, 14)}", r.choice([None, "h0", "h1", "h2", "h3", "h4"]), place * 3, r.random() < 0.8) for place in range(150)]
    s, c = spark.createDataFrame(stored, "url string, content_hash string"), spark.createDataFrame(crawled, "url string, content_hash string, place long, has_content boolean")
    got = sorted((x["place"], x["operation"]) for x in merge.merge_articles(s, c).collect())
    assert got == one_by_one(stored, crawled) and len({o for _, o in got}) >= 4


def test_a_replaced_hash_is_free_again(spark):
    stored = spark.createDataFrame([("a", "old")], "url string, content_hash string")
    crawled = spark.createDataFrame([("b", "old", 1, True), ("a", "new", 2, True), ("b", "old", 3, True), ("c", "old", 4, True)], "url string, content_hash string, place long, has_content boolean")
    assert [x["operation"] for x in merge.merge_articles(stored, crawled).orderBy("place").collect()] == ["duplicate_content", "update", "insert", "duplicate_content"]
    assert merge.merge_articles(stored, crawled.limit(0)).count() == 0
