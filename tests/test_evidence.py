"""Facts, claims, rankings and events on hand-made texts."""

from pyspark.sql import functions as F

from tidegrid.operators import discovery, evidence, graph, knowledge
from tidegrid.operators.text import containments


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "c string").select(make(F.col("c")).alias("x")).first()["x"]


def test_facts_of_tables_and_of_sentences(spark):
    table = "2024年报\n行: 货币资金 | 列: 2023年 | 值: 1,234\n行: column_1 | 列: x | 值: 5\n行: 销售费用 | 列: 同比增减 | 值: 12%"
    assert [tuple(r) for r in one(spark, table, evidence.facts)] == [("货币资金", "2023年", "货币资金", "1,234", "", 2023), ("销售费用", "同比增减", "销售费用", "12", "%", 2023)]
    text = "2022年营业收入合计 1,234.5 元，占总资产 5%，同比增减 -7.5%\n无关 12"
    assert [tuple(r) for r in one(spark, text, evidence.facts)] == [("年营业收入合计", "", "年营业收入合计", "1,234.5", "", 2022), ("年营业收入合计", "占比", "年营业收入合计占比", "5", "%", 2022), ("年营业收入合计", "同比", "年营业收入合计同比", "-7.5", "%", 2022)]
    assert one(spark, None, evidence.facts) is None or one(spark, None, evidence.facts) == []


def supported(spark, claim, content):
    return spark.createDataFrame([(claim, content)], "a string, b string").select(evidence.support(F.col("a"), F.col("b")).alias("s")).first()["s"] is not None


def test_claims_need_their_numbers_and_words(spark):
    source = "天马2025年前三季度出货量为1234.5千片，同比下降12.3%。京东方占比为0.253。"
    assert supported(spark, "2025年天马出货量为1,234.5千片，下降12.3%", source)
    assert not supported(spark, "2025年天马出货量为1,235.5千片", source) and not supported(spark, "2024年天马出货量为1234.5千片", source)
    assert supported(spark, "京东方占比为25.3%", source) and not supported(spark, "京东方占比为26.3%", source)
    assert supported(spark, "天马出货量约为1235千片", source) and not supported(spark, "天马出货量上升12.3%", source)
    assert supported(spark, "Y25天马出货量", source) and not supported(spark, "unrelated words", source)


def test_claims_of_an_answer(spark):
    answer = "# 核心结论\n核心结论\n1. 甲增长5%。[S1][S2] 乙下降；[S2]\n- 资料不足，无法判断\n以下是数据：\n丙持平"
    assert [(r["claim"], list(r["cited"])) for r in one(spark, answer, evidence.claims)] == [("甲增长5%。", [1, 2]), ("乙下降；", [2]), ("丙持平", [])]


def test_windows_of_long_sentences_overlap(spark):
    got = one(spark, "a" * 1000 + "。b", evidence.windows)
    assert [len(x) for x in got] == [500, 500, 201, 1] and got[-1] == "b"


def test_near_each_other(spark):
    near = lambda text: spark.createDataFrame([(text,)], "c string").select(evidence.near_each_other(F.col("c"), F.array(F.lit("A.B"), F.lit("甲")), F.lit("Car X"))).first()[0]
    assert near("a.b sells the car x") and not near("AxB") is None and near("nobody sells it") and not near("甲" + "y" * 300 + "car X") and near("甲" + "y" * 300 + "car X then 甲")


def test_units_and_sizes(spark):
    assert [one(spark, t, evidence.units_sold) for t in ("12万台", "1.2 billion", "3m", "30 mm", "none")] == [120000.0, 1.2e9, 3e6, 30.0, None]
    assert [one(spark, t, evidence.inches) for t in ("254mm", "10.5 cm", "12.3")] == [10.0, 4.1339, 12.3]


def test_paragraphs_and_fragments(spark):
    assert one(spark, "aaa\nbb\n\ncccc\n" + "d" * 12, lambda c: evidence.packed_paragraphs(c, 6)) == ["aaa\nbb", "cccc", "dddddd", "dddddd"]
    assert one(spark, None, evidence.packed_paragraphs) == []
    got = spark.createDataFrame([(["abcdef", "defgh", "", "hxyz", "none"],)], "c array<string>").select(evidence.coalesced(F.col("c"))).first()[0]
    assert got == "abcdefghxyznone"


def test_containments(spark):
    names = spark.createDataFrame([("alpha one",), ("one",), ("abcd",), ("",)], "name string")
    hints = spark.createDataFrame([("one",), ("xabcdx",), ("a",), ("alpha one more",)], "hint string")
    want = {(n, h) for n in ("alpha one", "one", "abcd") for h in ("one", "xabcdx", "a", "alpha one more") if h in n or (len(n) >= 4 and n in h)}
    assert {tuple(r) for r in containments(names, "name", hints, "hint").collect()} == want


def test_alignment_prefers_names(spark):
    rows = spark.createDataFrame([(1, "BYD 2024", "x"), (2, "Other", "about byd"), (3, "Other", "x")], "id int, name string, body string")
    keep = lambda s: sorted(r["id"] for r in knowledge.aligned(rows, "name", "body", [s]).collect())
    assert keep("byd") == [1] and keep("about") == [2] and keep("nothing") == []


def test_totals_of_one_year(spark):
    cases = [([(0, 10.0, 1), (1, 25.0, 9)], 0), ([(0, 10.0, 1), (1, 15.0, 9)], 1), ([(0, 10.0, 5), (1, 15.0, 5)], 0), ([(0, 0.0, 1), (1, 15.0, 5)], 1)]
    for rows, best in cases:
        got = spark.createDataFrame([(rows,)], "c array<struct<place:int,value:double,score:int>>").select(knowledge.one_total(F.col("c")).alias("o")).first()["o"]
        assert got["place"] == best


def test_paths_templates_and_feeds(spark):
    assert discovery.json_path("a.0.b") == discovery.json_path("a[0].b") == "$.a[0].b"
    rss = "<rss><channel><item><link>/a</link><title>T</title><pubDate>d</pubDate></item></channel></rss>"
    atom = '<feed><entry><link href="/b"/><title>U</title><updated>e</updated><id>9</id></entry></feed>'
    got = [one(spark, x, discovery.feed_items)[0] for x in (rss, atom)]
    assert [(r["link"], r["title"], r["pubDate"]) for r in got] == [("/a", "T", "d"), ("/b", "U", "e")]
    row = spark.createDataFrame([((1, None),)], "r struct<id:int,name:string>")
    assert row.select(discovery.formatted("/x/{id}.html", F.col("r")), discovery.formatted("/x/{name}", F.col("r"))).first()[:] == ("/x/1.html", None)


def test_names_entities_and_edges(spark):
    names = spark.createDataFrame([("Tianma Micro", "天马,TM"), ("TM", None), ("Boe", "tianma")], "canonical string, aliases string")
    index = {r["key"]: r["canonical"] for r in graph.alias_index(names).collect()}
    assert index == {"tianmamicro": "Tianma Micro", "天马": "Tianma Micro", "tm": "TM", "tianma": "Boe", "boe": "Boe"}
    edges = spark.createDataFrame([("A", "COMPANY", "x", "PRODUCT"), ("A", "COMPANY", "B", "COMPANY"), ("B", "COMPANY", "x", "PRODUCT")], "from_name string, from_type string, to_name string, to_type string")
    assert [(r["from_name"], r["to_name"]) for r in graph.focused(edges, ["a"]).collect()] == [("A", "x")] and graph.focused(edges, ["z"]).count() == 3


def test_lines_of_pages(spark):
    text = "A very long visual line of words\ngoes on\r\n\r\nEnds here with a full stop.\nEnds here with a full stop.\n图1 figure\n" + "长" * 18 + "\n接着\n" + "长" * 18 + "\n(2) 点"
    want = ["A very long visual line of words goes on Ends here with a full stop.", "图1 figure", "长" * 18 + "接着" + "长" * 18, "(2) 点"]
    assert one(spark, text, lambda c: graph.joined_lines(graph.clean_lines(c))) == want
    # Empty lines, where they are still there, end a paragraph.
    assert one(spark, "A very long visual line\n\nof words\n\n\nend", lambda c: graph.joined_lines(F.split(c, "\n"))) == ["A very long visual line", "of words", "end"]


def test_questions_and_years(spark):
    assert one(spark, "销量多少？不要编造？出口呢？", graph.sub_questions) == ["销量多少", "出口呢"] and one(spark, "只有一个？", graph.sub_questions) == ["只有一个？"]
    got = spark.createDataFrame([("2023与2024、12024", ["2024"])], "q string, f array<string>").select(graph.missing_years(F.col("q"), F.col("f"))).first()[0]
    assert got == ["2023"]


def test_lines_keep_the_digit_of_their_place(spark):
    text = "0 zero 0\n 1 one 1\u00a0\n2 two 2"
    assert one(spark, text, evidence.packed_paragraphs) == ["0 zero 0\n1 one 1\n2 two 2"]
    said = "0 甲 0。 1 乙 1；2丙2"
    assert one(spark, said, knowledge.sentences) == ["0 甲 0。", "1 乙 1；", "2丙2"] and one(spark, said, evidence.windows) == ["0 甲 0。", "1 乙 1；", "2丙2"]
    assert [r["claim"] for r in one(spark, "05 甲。 16 乙1", evidence.claims)] == ["05 甲。", "16 乙1"]
    assert one(spark, "0 lines 0\n1) 甲 one 1\n2) 乙 two 2", graph.sub_questions) == ["甲 one 1", "乙 two 2"]
    proposed = spark.createDataFrame([(1, 0, "x", None, "company", "0 x 0。1 x 1")], "chunk int, place int, name string, aliases string, kind string, text string")
    assert graph.grounded(proposed, "text", ["company"]).first()["contexts"] == ["0 x 0。", "1 x 1"]
