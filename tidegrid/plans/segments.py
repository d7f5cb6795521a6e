"""Queries over segmented documents; a document is a brand, its pages are written from its parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.operators import segments as op
from tidegrid.plans.registry import query
from tidegrid.sources.tables import table

#: Pages by p_partkey % 8: two kinds of headings, two events, contents, a table, a chart, a long narrative and a short one.
_ITEM_SQL = """i AS (SELECT p_brand AS doc, p_partkey AS page, p_partkey % 8 AS k, p_name AS name, p_size AS size, p_type AS type, CAST(p_partkey // 8 AS INT) AS n FROM part),
 head AS (SELECT doc, page, CASE k WHEN 0 THEN substr('一二三四五六七八九', n % 9 + 1, 1) || '、' || name ELSE (n % 3 + 1) || '.' || (n % 5 + 1) || '. ' || type END AS title, CASE k WHEN 0 THEN [n % 9 + 1] ELSE [0, n % 3 + 1, n % 5 + 1] END AS outline FROM i WHERE k < 2),
 long AS (SELECT *, 'line of ' || name || repeat(' x', size) AS line FROM i WHERE k = 6),
 s AS (SELECT doc, page, 0 AS part, 'section' AS kind, title, CAST(NULL AS VARCHAR) AS subject, title AS content, false AS indexable, outline FROM head
  UNION ALL SELECT doc, page, part, 'event', CASE part WHEN 0 THEN '发布 ' ELSE '宣布 ' END || name, CASE part WHEN 0 THEN '理想汽车' ELSE type END, CASE part WHEN 0 THEN '理想' || chr(10) || '发布 ' || name ELSE type || chr(10) || '宣布 ' || name || chr(10) || 'more about it' END, part = 1 OR length(name) >= 14, NULL FROM i, (VALUES (0), (1)) t(part) WHERE k = 2
  UNION ALL SELECT doc, page, 0, 'section', '目录', NULL, '目录' || chr(10) || 'CONTENTS' || chr(10) || name || chr(10) || type || chr(10) || '市场观察', false, NULL FROM i WHERE k = 3
  UNION ALL SELECT doc, page, 0, 'narrative', 'about the table', NULL, 'about the table', false, NULL FROM i WHERE k = 4
  UNION ALL SELECT doc, page, 1, 'table', name, NULL, '标题: ' || name || chr(10) || '行: ' || type || ' | 列: 销量（辆） | 值: ' || size || '辆' || chr(10) || '行: other | 列: 数值 | 值: 7.5%', true, NULL FROM i WHERE k = 4
  UNION ALL SELECT doc, page, 0, 'chart', type, NULL, '图表标题: ' || type || chr(10) || '图表类型: bar' || chr(10) || '分类: a | b' || chr(10) || '系列数据:' || chr(10) || name || ': a: ' || size || ' | b: 0.5', true, NULL FROM i WHERE k = 5
  UNION ALL SELECT doc, page, p, 'narrative', line, NULL, CASE WHEN length(line) * 60 + 59 <= 2000 THEN repeat(line || chr(10), 59) || line ELSE repeat(line || chr(10), least(60 - p * per, per) - 1) || line END, true, NULL
   FROM (SELECT *, CAST(floor(2000 / length(line)) AS INT) AS per FROM long), range(10) t(p) WHERE p = 0 OR (length(line) * 60 + 59 > 2000 AND p * per < 60)
  UNION ALL SELECT doc, page, 0, 'narrative', name, NULL, name, length(name) >= 20, NULL FROM i WHERE k = 7)"""


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, kind, size = F.col("p_name"), F.col("p_type"), F.col("p_size").cast("string")
    k, n = F.col("p_partkey") % 8, F.floor(F.col("p_partkey") / 8)
    lines = lambda *cs: F.concat_ws("\n", *(c if not isinstance(c, str) else F.lit(c) for c in cs))
    long = F.concat(F.lit("line of "), name, F.repeat(F.lit(" x"), F.col("p_size").cast("int")))
    text = (
        F.when(k == 0, F.concat(F.substr(F.lit("一二三四五六七八九"), n % 9 + 1, F.lit(1)), F.lit("、"), name))
        .when(k == 1, F.concat((n % 3 + 1).cast("string"), F.lit("."), (n % 5 + 1).cast("string"), F.lit(". "), kind))
        .when(k == 2, lines("理想", F.concat(F.lit("发布 "), name), kind, F.concat(F.lit("宣布 "), name), "more about it", "17"))
        .when(k == 3, lines("目录", "CONTENTS", name, kind, "市场观察"))
        .when(k == 4, lines("about the table", F.concat(kind, F.lit(" | "), size, F.lit(" | 无"))))
        .when(k == 6, F.concat(F.repeat(F.concat(long, F.lit("\n")), F.lit(59)), long))
        .when(k == 7, F.concat(F.lit("  "), name))
    )
    cells = lambda *cs: F.array(*(c if not isinstance(c, str) else F.lit(c) for c in cs))
    of = dict(p.split(" ", 1) for p in ("tables " + op.ITEMS.split("tables ")[1].split(", charts ")[0], "charts " + op.ITEMS.split("charts ")[1]))
    tables = F.array(F.struct(name.alias("title"), cells("企业", "销量（辆）", "column_3").alias("columns"), F.array(cells(kind, size, "无"), cells("other", "none", "7.5%")).alias("rows")))
    series = F.array(F.struct(name.alias("name"), F.array(F.col("p_size").cast("double"), F.lit(0.5)).alias("values")))
    charts = F.array(F.struct(kind.alias("title"), F.lit("bar").alias("chart_type"), cells("a", "b").alias("categories"), series.alias("series")))
    return table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("doc"), F.col("p_partkey").cast("long").alias("page"), text.alias("text"), F.lit(True).alias("is_slide"), F.when(k == 4, tables).cast(of["tables"]).alias("tables"), F.when(k == 5, charts).cast(of["charts"]).alias("charts"),
    )


@query(
    f"""WITH {_ITEM_SQL}, p AS (SELECT s.*, max(CASE WHEN len(outline) = 1 THEN page END) OVER w AS h1, max(CASE WHEN len(outline) = 3 THEN page END) OVER w AS h3 FROM s WINDOW w AS (PARTITION BY doc ORDER BY page, part ROWS UNBOUNDED PRECEDING))
    SELECT p.doc, p.page, p.part, kind, p.title, subject, content, array_to_string([x for x in [a.title, CASE WHEN h1 IS NULL OR h3 > h1 THEN b.title END] if x IS NOT NULL], ' > ') AS section_path FROM p LEFT JOIN head a ON a.page = h1 LEFT JOIN head b ON b.page = h3 WHERE indexable"""
)
def semantic_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segments of every page that can be searched, with the headings above them."""
    found = op.with_paths(op.segments(_items(spark, sf_dir))).where("indexable")
    return found.select("doc", "page", "part", "kind", "title", "subject", "content", F.concat_ws(" > ", "section_path").alias("section_path"))


@query(
    f"""WITH {_ITEM_SQL}, h AS (SELECT doc, page, title, outline, len(outline) AS level, outline[:-2] AS above, outline[-1] AS own, count(*) FILTER (len(outline) = 1) OVER (PARTITION BY doc ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS run FROM head),
    e AS (SELECT *, coalesce(lag(own) OVER (PARTITION BY doc, above, CASE level WHEN 1 THEN 0 ELSE run END ORDER BY page), 0) + 1 AS want FROM h)
    SELECT page, title, array_to_string(outline, '.') AS outline, array_to_string(above || [want], '.') AS expected, own = want AS follows FROM e"""
)
def outline_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each numbered heading follows the one before it on its level."""
    dotted = lambda c: F.concat_ws(".", F.col(c).cast("array<string>"))
    return op.outline_checks(op.segments(_items(spark, sf_dir))).select("page", "title", dotted("outline").alias("outline"), dotted("expected").alias("expected"), "follows")
