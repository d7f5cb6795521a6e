"""Queries over facts, claims and their evidence; the texts are written from sums of lineitem by brand and year."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.operators import evidence as op
from tidegrid.plans.registry import query
from tidegrid.sources.tables import table

_SUMS = "s AS (SELECT p_brand AS brand, CAST(year(l_shipdate) AS INT) AS y, CAST(sum(l_quantity) AS BIGINT) + 1000 AS v FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL)"


def _sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy(F.col("p_brand").alias("brand"), F.year("l_shipdate").alias("y")).agg((F.sum("l_quantity").cast("long") + 1000).alias("v"))


def _digits(c: str):
    return F.format_string("%,d", F.col(c))


_TABLE = _SUMS + ", c AS (SELECT brand, y, '年度' || y AS label, v, CAST(v % 100 AS VARCHAR) || '.5%' AS share FROM s)"


def _tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """brand and text: a table of its years, rendered a line a number."""
    cell = lambda header, value: F.struct(F.lit(header).alias("header"), value.alias("value"))
    y, v = F.col("y").cast("string"), F.col("v")
    row = F.array(cell("年度", F.concat(F.lit("年度"), y)), cell("销量（辆）", v.cast("string")), cell("column_3", F.concat((v % 100).cast("string"), F.lit(".5%"))), cell("说明", F.lit("无")))
    rows = _sums(spark, sf_dir).groupBy("brand").agg(F.array_sort(F.collect_list(F.struct("y", row.alias("row")))).alias("rows"))  # a few years a brand
    return rows.select("brand", op.table_text(F.concat(F.col("brand"), F.lit("销量")), F.transform("rows", lambda r: r["row"])).alias("text"))


@query(f"WITH {_TABLE} SELECT brand, '标题: ' || brand || '销量' || string_agg(chr(10) || '行: ' || label || ' | 列: 销量（辆） | 值: ' || v || '辆' || chr(10) || '行: ' || label || ' | 列: 数值 | 值: ' || share, '' ORDER BY y) AS text FROM c GROUP BY brand")
def table_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables as text: a line for each number with its row's label, its header and the header's unit."""
    return _tables(spark, sf_dir)


@query(f"WITH {_TABLE}, m AS (SELECT max(y) AS y, brand FROM s GROUP BY brand) SELECT c.brand, label AS row_label, k.h AS col_header, CASE k.h WHEN '数值' THEN replace(share, '%', '') ELSE v || '辆' END AS raw_value, CASE k.h WHEN '数值' THEN '%' ELSE '' END AS unit, m.y AS year FROM c JOIN m ON m.brand = c.brand, (VALUES ('销量（辆）'), ('数值')) k(h)")
def table_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts of those texts, read back; the year is the last one that the text names."""
    rows = _tables(spark, sf_dir).select("brand", F.inline(op.facts(F.col("text"))))
    return rows.select("brand", "row_label", "col_header", "raw_value", "unit", "year")


@query(
    f"""WITH {_SUMS}, r AS (SELECT brand, y, v FROM s WHERE y >= 2000) SELECT brand, '年销量合计为' AS metric, format('{{:,}}', v) AS raw_value, '' AS unit, y AS year FROM r
    UNION ALL SELECT brand, '年销量合计为同比', CAST(v % 30 AS VARCHAR) || '.5', '%', (SELECT max(y) FROM r q WHERE q.brand = r.brand) FROM r"""
)
def labelled_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers with the words before them, and the change that their line states."""
    line = F.concat(F.col("y").cast("string"), F.lit("年销量合计为"), _digits("v"), F.lit("辆，同比下降"), (F.col("v") % 30).cast("string"), F.lit(".5%。"))
    texts = _sums(spark, sf_dir).where("y >= 2000").groupBy("brand").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", line.alias("line")))), lambda r: r["line"]), "\n").alias("text"))
    return texts.select("brand", F.inline(op.facts(F.col("text")))).select("brand", "metric", "raw_value", "unit", "year")


def _claims(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """answers and evidence by brand: a source a year, an answer with a right and a wrong claim of each."""
    y, v = F.col("y").cast("string"), F.col("v")
    right = F.concat(F.lit("- "), y, F.lit("年"), F.col("brand"), F.lit("销量为"), _digits("v"), F.lit("辆，同比下降"), (v % 30).cast("string"), F.lit("%。"))
    wrong = F.concat(F.lit("2. "), F.col("brand"), F.lit("销量为"), v.cast("string"), F.lit(".3辆"))
    content = F.concat(F.lit("背景说明；"), F.col("brand"), F.lit("在"), y, F.lit("年销量达到"), v.cast("string"), F.lit("辆，比上年下降"), (v % 30).cast("string"), F.lit(".0%。其他内容见附录！"))
    rows = _sums(spark, sf_dir).where("y >= 1996")
    source = F.col("y") - 1995
    evidence = rows.select("brand", source.alias("source"), content.alias("content"))
    mark = F.concat(F.lit("[S"), source.cast("string"), F.lit("]"))
    lines = F.struct("y", F.concat(right, mark).alias("a"), F.concat(wrong, F.lit(" "), mark).alias("b"), right.alias("c"))
    answers = rows.groupBy("brand").agg(F.array_sort(F.collect_list(lines)).alias("l"))
    return answers, evidence


@query(f"WITH {_SUMS}, r AS (SELECT brand, y - 1995 AS source, row_number() OVER (PARTITION BY brand ORDER BY y) - 1 AS n FROM s WHERE y >= 1996) SELECT brand, CAST(2 * n + k AS INT) AS claim_no, CAST(source AS INT) AS source, k = 0 AS supported FROM r, (VALUES (0), (1)) t(k)")
def checked_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each claim with the source that it cites: whether a sentence there has all its numbers and enough of its words."""
    answers, evidence = _claims(spark, sf_dir)
    answer = F.concat(F.lit("# 标题\n核心结论\n"), F.array_join(F.transform("l", lambda r: F.concat(r["a"], F.lit("\n"), r["b"])), "\n"), F.lit("\n资料不足，无法判断。\n参考来源："))
    return op.checked_claims(answers.select("brand", answer.alias("answer")), evidence, "brand").select("brand", "claim_no", "source", "supported")


@query(f"WITH {_SUMS}, r AS (SELECT brand, y - 1995 AS source, row_number() OVER (PARTITION BY brand ORDER BY y) - 1 AS n FROM s WHERE y >= 1996) SELECT brand, CAST(n AS INT) AS claim_no, CAST(source AS INT) AS source FROM r")
def attached_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each claim without a citation the source that bears it best."""
    answers, evidence = _claims(spark, sf_dir)
    answer = F.array_join(F.transform("l", lambda r: r["c"]), "\n")
    return op.best_sources(answers.select("brand", answer.alias("answer")), evidence, "brand").select("brand", "claim_no", "source")


@query(
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size * 8 + 4 <= 220 WHEN 1 THEN true WHEN 2 THEN false ELSE p_size * 8 + 4 <= 220 END AS is_near FROM part"""
)
def near_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A target that stands near one of the names of a company in a text; a text without any of the names says nothing against it."""
    gap = F.repeat(F.lit("x"), F.col("p_size") * 8)
    k = F.col("p_partkey") % 4
    text = F.when(k == 0, F.concat(F.lit("Acme."), gap, F.lit("sold"))).when(k == 1, F.concat(gap, F.lit("sold"))).when(k == 2, F.concat(F.lit("acme. says no; "), gap)).otherwise(F.concat(F.lit("SOLD"), gap, F.lit("the Other name"), F.repeat(F.lit("y"), F.lit(300)), F.lit("Acme.")))
    near = op.near_each_other(text, F.array(F.lit("Acme."), F.lit("the other NAME"), F.lit("")), F.lit("Sold"))
    return table(spark, sf_dir, "part").select("p_partkey", near.alias("is_near"))


_COUNTS = [("1.5万辆", 15000.0), ("3亿", 300000000.0), ("2.5bn", 2500000000.0), ("7 million pcs", 7000000.0), ("1,200 k", 1200000.0), ("120 cars", 120.0), ("about", None), ("4 mm", 4.0)]


@query(
    "SELECT p_partkey, CASE p_partkey % 8 " + " ".join(f"WHEN {k} THEN {v}" for k, (_, v) in enumerate(_COUNTS) if v is not None) + """ END AS units,
    CAST(CASE p_partkey % 3 WHEN 0 THEN round(CAST(p_size AS DECIMAL(18,6)) / 25.4, 4) WHEN 1 THEN round(CAST(p_size AS DECIMAL(18,6)) / 2.54, 4) ELSE p_size END AS DOUBLE) AS inches, CASE p_partkey % 4 WHEN 0 THEN 'ZH' WHEN 1 THEN 'MIXED' WHEN 2 THEN 'EN' ELSE 'UNKNOWN' END AS language FROM part"""
)
def units_and_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts in units, sizes in inches, and the language of a text."""
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("p_partkey") % len(values) + 1).cast("int"))
    size = F.concat(F.col("p_size").cast("string"), pick([" mm", "厘米", ' "']))
    text = pick(["出货", "出货 growth", "growth 12", "12 x"])
    return table(spark, sf_dir, "part").select("p_partkey", op.units_sold(pick([c for c, _ in _COUNTS])).alias("units"), op.inches(size).alias("inches"), op.language(text).alias("language"))


@query(
    """WITH RECURSIVE d AS (SELECT doc_id, list_filter(list_transform(string_split(trim(regexp_replace(regexp_replace(coalesce(text, ''), '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')), chr(10)), lambda p: trim(p)), lambda p: p <> '') AS ps FROM documents),
    w(doc_id, i, now, done) AS (SELECT doc_id, 1, 0, CAST([] AS BIGINT[]) FROM d UNION ALL SELECT w.doc_id, i + 1, CASE WHEN now + n + 1 <= 1200 THEN CASE WHEN now = 0 THEN n ELSE now + 1 + n END WHEN n <= 1200 THEN n ELSE 0 END,
      CASE WHEN now + n + 1 <= 1200 THEN done ELSE list_concat(CASE WHEN now > 0 THEN list_append(done, CAST(now AS BIGINT)) ELSE done END, CASE WHEN n <= 1200 THEN [] ELSE list_transform(range(0, CAST((n + 1199) // 1200 AS BIGINT)), lambda k: least(1200, n - k * 1200)) END) END
      FROM (SELECT w.*, ps, length(ps[i]) AS n FROM w JOIN d ON d.doc_id = w.doc_id WHERE i <= len(ps)) w)
    SELECT w.doc_id, len(l) AS n_chunks, coalesce(list_max(l), 0) AS longest, coalesce(CAST(list_sum(l) AS BIGINT), 0) AS n_chars FROM (SELECT w.doc_id, CASE WHEN now > 0 THEN list_append(done, CAST(now AS BIGINT)) ELSE done END AS l FROM w JOIN d ON d.doc_id = w.doc_id AND w.i = len(ps) + 1) w"""
)
def packed_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' lines joined to chunks of up to 1,200 characters."""
    sizes = F.transform(op.packed_paragraphs(F.col("text")), lambda c: F.length(c).cast("long"))
    rows = table(spark, sf_dir, "documents").select("doc_id", sizes.alias("l"))
    total = F.aggregate("l", F.lit(0).cast("long"), lambda a, b: a + b)
    return rows.select("doc_id", F.size("l").cast("long").alias("n_chunks"), F.coalesce(F.array_max("l"), F.lit(0).cast("long")).alias("longest"), total.alias("n_chars"))


@query("SELECT o_custkey, sha256(string_agg('<' || o_orderkey || '>', '' ORDER BY o_orderkey)) AS digest FROM orders GROUP BY 1")
def coalesced_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts cut into overlapping fragments, put together again."""
    whole = F.array_join(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda k: F.concat(F.lit("<"), k.cast("string"), F.lit(">"))), "")
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(whole.alias("text"))  # the orders of one customer
    parts = F.transform(F.sequence(F.lit(0), F.floor(F.length("text") / 40).cast("int")), lambda k: F.substr(F.col("text"), k * 40 + 1, F.lit(60)))
    return rows.select("o_custkey", F.sha2(op.coalesced(parts), 256).alias("digest"))


@query(
    f"""WITH {_SUMS}, f AS (SELECT brand, y, CASE WHEN y % 3 = 0 THEN '销量' WHEN y % 3 = 1 THEN '国内销量合计' ELSE '销量同比' END AS metric, CASE WHEN y % 2 = 0 THEN '数值' ELSE '' END AS h, format('{{:,}}', v) AS raw FROM s),
    p AS (SELECT brand, y, metric, CASE WHEN metric = '销量' THEN 100 ELSE 80 END - CASE WHEN h = '数值' THEN 5 ELSE 0 END + CASE WHEN contains(raw, ',') THEN 3 ELSE 0 END + least(length(raw), 24) - CASE WHEN contains(metric, '同比') THEN 50 ELSE 0 END + CASE WHEN y = 2000 THEN 15 ELSE 0 END AS score FROM f)
    SELECT brand, metric, y AS year, CAST(score AS INT) AS score FROM p WHERE score >= 40 QUALIFY row_number() OVER (PARTITION BY brand ORDER BY score DESC, y) = 1"""
)
def best_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact of each brand that answers best to a question about its sales of 2000."""
    y = F.col("y")
    metric = F.when(y % 3 == 0, "销量").when(y % 3 == 1, "国内销量合计").otherwise("销量同比")
    found = _sums(spark, sf_dir).select("brand", metric.alias("metric"), metric.alias("row_label"), F.when(y % 2 == 0, "数值").otherwise("").alias("col_header"), _digits("v").alias("raw_value"), y.alias("year"), y.alias("place"))
    return op.best_facts(found, "brand", F.lit("销量"), F.lit(2000)).select("brand", "metric", "year", F.col("score").cast("int").alias("score"))
