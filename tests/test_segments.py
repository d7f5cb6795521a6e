"""Segments of hand-made pages, nested headings and odd pages."""

import json

from tidegrid.operators import segments as op


def items(spark, pages):
    rows = [(doc, page, text, slide, tables, charts) for doc, page, text, slide, tables, charts in pages]
    return spark.createDataFrame(rows, op.ITEMS)


def test_outline_numbers():
    assert [op.outline_of(x) for x in ("十二、a", "二十、b", "三. c", "1.2. d", "1.2.3 e", "4．f", "12 apples", "2024 a", "x")] == [[12], [20], [3], [0, 1, 2], [0, 1, 2, 3], [0, 4], None, None, None]


def test_paths_of_nested_headings(spark):
    pages = [
        ("d", 1, "before any heading, long enough", False, None, None), ("d", 2, "一、Market", False, None, None), ("d", 3, "1. Sales", False, None, None), ("d", 4, "1.1. North\n7", False, None, None),
        ("d", 5, "text about the north, long enough", False, None, None), ("d", 6, "1.3. South", False, None, None), ("d", 7, "2. Exports", False, None, None), ("d", 8, "text about exports, long enough", False, None, None),
        ("d", 9, "二、Policy", False, None, None), ("d", 10, "text about policy, long enough", False, None, None), ("e", 1, "another document, long enough", False, None, None),
    ]
    found = op.segments(items(spark, pages))
    paths = {(r["doc"], r["page"]): r["section_path"] for r in op.with_paths(found).where("kind = 'narrative'").collect()}
    assert paths == {("d", 1): [], ("d", 5): ["一、Market", "1. Sales", "1.1. North"], ("d", 8): ["一、Market", "2. Exports"], ("d", 10): ["二、Policy"], ("e", 1): []}
    checks = {r["page"]: (r["expected"], r["follows"]) for r in op.outline_checks(found).collect()}
    assert checks == {2: ([1], True), 3: ([0, 1], True), 4: ([0, 1, 1], True), 6: ([0, 1, 2], False), 7: ([0, 2], True), 9: ([2], True)}


def kinds(spark, *pages):
    return [(r["kind"], r["title"], r["subject"], r["content"], r["indexable"]) for r in op.segments(items(spark, pages)).orderBy("page", "part").collect()]


def test_events_and_tables(spark):
    table = [("Slide 3", ["企业", "TOP5 份额", "销量(万)"], [["甲", "前五", "1,200"], ["乙", "前五", "5.5"], ["", "", "3"]])]
    got = kinds(spark, ("d", 1, "lost\n小米\n宣布降价\n细节\n理想\n交付增长", False, None, None), ("d", 2, "TOP3 排名\n甲 | 前五 | 1,200\n备注", True, table, None), ("d", 3, None, True, [("t", ["a", "b"], [["x"]])], None))
    assert got[0] == ("event", "宣布降价", "小米汽车", "小米\n宣布降价\n细节", False) and got[1][:3] == ("event", "交付增长", "理想汽车")
    assert got[2] == ("narrative", "TOP3 排名", None, "TOP3 排名\n备注", False)
    assert got[3] == ("table", "TOP3 排名", None, "标题: TOP3 排名\n行: 甲 | 列: 销量(万) | 值: 1,200\n行: 乙 | 列: 销量(万) | 值: 5.5万\n分组信息: 前五", True)
    assert got[4] == ("table", "t", None, "表标题: t", False)


def test_charts_and_contents(spark):
    chart = [("c", "line", ["a"], [("s", [1.0, None, 2.5]), ("e", [])])]
    got = kinds(spark, ("d", 1, "目录\n市场观察\n宏观政策\nx\ny", True, None, chart), ("d", 2, "目录\n市场观察\n宏观政策\nx\n销量同比", True, None, [("n", "bar", None, None)]))
    assert [g[0] for g in got] == ["section", "chart", "narrative", "chart"] and got[1][3] == "图表标题: c\n图表类型: line\n分类: a\n系列数据:\ns: a: 1 | 分类2:  | 分类3: 2.5\ne: a:"
    assert (got[1][4], got[3][4]) == (True, False)


def test_long_and_empty_texts(spark):
    got = kinds(spark, ("d", 1, "一句话很长。" * 1000, False, None, None), ("d", 2, "x" * 9000, False, None, None), ("d", 3, "", False, None, None), ("d", 4, None, False, [], []), ("d", 5, " 12 \n\n3", None, None, None))
    assert all(len(g[3].replace("\n", "")) <= 2000 and g[4] == (len(g[3]) >= 20) for g in got[:-1]) and "".join(g[3] for g in got[:-1]).replace("\n", "") == "一句话很长。" * 1000
    assert len(got[-1][3]) == 9000 and all(g[0] == "narrative" for g in got)
    assert op.segments(items(spark, [])).count() == 0 and json.dumps(op.lines_of(None)) == "[]"
