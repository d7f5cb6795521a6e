"""Queries over a knowledge base's sources and chunks, and what a question makes of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegrid.functions.arrays import once
from tidegrid.operators import knowledge as op
from tidegrid.plans.registry import query
from tidegrid.sources.tables import table


def _part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part")


def _pick(values: list, by):
    return F.element_at(F.array(*map(F.lit, values)), (by % len(values) + 1).cast("int"))


_GROUPS = [op.TermGroup(8, ("blue", "red"), ("blue",)), op.TermGroup(5, ("promo",), ("promo", "large")), op.TermGroup(3, ("ring",), ("ring",)), op.TermGroup(6, ("widget",), ("widget",))]


@query(
    """WITH c AS (SELECT p_partkey AS id, CASE WHEN p_size = 7 THEN 'dataset ' ELSE '' END || p_brand || p_size AS metric_id, lower(replace(CASE WHEN p_size = 7 THEN 'dataset ' ELSE '' END || p_brand || p_size || ' ' || p_name || ' ' || p_type, ' ', '')) AS t, p_size FROM part),
    h AS (SELECT *, CAST(contains(t, 'blue') AS INT) AS a, CAST(contains(t, 'promo') OR contains(t, 'large') AS INT) AS b, CAST(contains(t, 'ring') AS INT) AS c FROM c),
    r AS (SELECT id, metric_id, CASE a WHEN 1 THEN 8 ELSE -4 END + CASE b WHEN 1 THEN 5 ELSE -2 END + CASE c WHEN 1 THEN 3 ELSE -1 END + 4 * CAST(contains(t, 'gear') AS INT) - CASE WHEN p_size = 7 THEN 12 ELSE 0 END AS score, a + b + c AS matched FROM h),
    f AS (SELECT * FROM r WHERE matched > 0 AND score > 0 QUALIFY row_number() OVER (PARTITION BY metric_id ORDER BY matched DESC, score DESC, id DESC) = 1)
    SELECT * FROM f ORDER BY matched DESC, score DESC, id DESC LIMIT 20"""
)
def metric_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty best chunks for a question, one a metric."""
    chunks = _part(spark, sf_dir).select(F.col("p_partkey").alias("id"), F.concat(F.when(F.col("p_size") == 7, "dataset ").otherwise(""), "p_brand", F.col("p_size").cast("string")).alias("metric_id"), F.concat_ws(" ", "p_name", "p_type").alias("content"))
    return op.metric_ranking(chunks, "Blue promo Ring share?", _GROUPS, ["gear"], 20)


_HITS = """t AS (SELECT doc_id, source, lang, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS rank FROM documents QUALIFY rank < 200),
 d AS (SELECT source AS document, min(rank) AS best, count(*) AS n, source || ' ' || (2000 + CAST(source[4:] AS INT)) || ' report' AS name, upper(arg_max(CASE WHEN lang = 'en' THEN 'pdf' ELSE 'news' END, rank)) AS type FROM t GROUP BY source)"""


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(200)
    rank = F.row_number().over(Window.orderBy(F.desc("n_chars"), "doc_id")) - 1  # a result list
    name = F.concat("source", F.lit(" "), (F.substring("source", 4, 9).cast("int") + 2000).cast("string"), F.lit(" report"))
    return rows.select("doc_id", F.col("source").alias("document"), rank.alias("rank"), name.alias("name"), F.when(F.col("lang") == "en", "pdf").otherwise("news").alias("type"))


@query(
    f"""WITH {_HITS}, q AS (SELECT 'plain' AS question, document, 40.0 / (best + 1) + least(n, 3) * 4.0 + CAST(regexp_extract(name, '20[0-9][0-9]') AS INT) - 2000 + CASE type WHEN 'PDF' THEN 8.0 ELSE 0 END AS score FROM d
      UNION ALL SELECT 'named', document, 40.0 / (best + 1) + least(n, 3) * 4.0 + 60 + CASE WHEN contains(name, '2003') THEN 20 ELSE -12 END + CASE type WHEN 'PDF' THEN 8.0 ELSE 0 END FROM d WHERE contains(name, 'src1'))
    SELECT question, document, CAST(score AS DOUBLE) AS score FROM q QUALIFY row_number() OVER (PARTITION BY question ORDER BY score DESC, document) <= 6"""
)
def candidate_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six sources to search within, for a question without names or years and for one with both."""
    hits = _hits(spark, sf_dir)
    plain, named = op.candidate_documents(hits, [], [], 6), op.candidate_documents(hits, ["SRC1"], ["2003"], 6)
    return plain.select(F.lit("plain").alias("question"), "document", F.col("score").cast("double").alias("score")).unionByName(named.select(F.lit("named").alias("question"), "document", F.col("score").cast("double").alias("score")))


@query("SELECT 'name' AS subject, doc_id FROM documents WHERE contains(source, 'src7') UNION ALL SELECT 'body', doc_id FROM documents WHERE contains(lower(text), 'einheit')")
def subject_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a source that the question names; for a subject that no source is named after, those that mention it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"))
    find = lambda label, subject: op.aligned(docs, "source", "text", [subject]).select(F.lit(label).alias("subject"), "doc_id")
    return find("name", "SRC7").unionByName(find("body", "Einheit"))


@query("SELECT p_partkey, (p_partkey % 4 = 0 AND p_size % 2 = 0) OR (p_partkey % 4 = 2 AND p_size % 2 = 0 AND p_size % 3 = 0) AS kept FROM part")
def sales_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that may answer for the sales of a brand in a year; JSON without figures may not."""
    year = F.when(F.col("p_size") % 2 == 0, "2024").otherwise("2023")
    k = F.col("p_partkey") % 4
    text = F.when(k == 0, F.concat(F.lit("Acme "), year, F.lit(" 销量 12 万辆"))).when(k == 1, F.concat(F.lit("Other "), year, F.lit(" 销量"))).when(
        k == 2, F.concat(F.lit('{"brand": "ACME", "source": "x", "wholesale": '), year, F.when(F.col("p_size") % 3 == 0, ', "value": 3}').otherwise("}"))).otherwise(F.concat(F.lit("acme "), year))
    return _part(spark, sf_dir).select("p_partkey", op.is_sales_evidence(text, ["Acme"], ["2024"]).alias("kept"))


@query(
    """WITH a AS (SELECT doc_id, 0 AS search, n_chars AS place FROM documents WHERE contains(lower(text), 'the')), b AS (SELECT doc_id, 1, n_chars FROM documents WHERE contains(lower(text), 'ein')), c AS (SELECT doc_id, 2, n_chars FROM documents WHERE source = 'src3')
    SELECT doc_id, search, place FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY search, place) = 1"""
)
def merged_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three searches' hits, each document once, by the first that found it."""
    docs = table(spark, sf_dir, "documents")
    low = F.lower("text")
    return op.first_of_searches([docs.where(F.contains(low, F.lit("the"))), docs.where(F.contains(low, F.lit("ein"))), docs.where("source = 'src3'")], "doc_id", "n_chars")


@query("SELECT conv_id, role, count(*) AS n FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE turn % 2 = 1 UNION ALL SELECT conv_id, turn, role, text FROM conversations WHERE turn % 2 = 0) GROUP BY ALL")
def append_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns joined to a store of half of them, those already there left out, sent twice or not."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    out = op.appended(turns.where("turn % 2 = 0"), turns.unionByName(turns), ["conv_id", "turn", "role", "text"])
    return out.groupBy("conv_id", "role").agg(F.count(F.lit(1)).alias("n"))


_SUMS = "SELECT p_brand AS brand, strftime(l_shipdate, '%Y-%m') AS time_period, sum(l_quantity) AS value FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL"


def _monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").join(_part(spark, sf_dir), F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy(F.col("p_brand").alias("brand"), F.date_format("l_shipdate", "yyyy-MM").alias("time_period")).agg(F.sum("l_quantity").alias("value"))


@query(f"WITH m AS ({_SUMS}), y AS (SELECT brand, time_period[1:4] AS year, sum(value) AS value, count(*) AS n_months FROM m GROUP BY ALL HAVING count(*) >= 2) SELECT *, year || CASE WHEN n_months >= 12 THEN '年1-12月' ELSE '年已有' || n_months || '个月' END AS scope FROM y")
def year_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years' totals of monthly figures with the months that they cover; a single month isn't told as a year."""
    return op.year_totals(_monthly(spark, sf_dir), ["brand"])


@query(
    """WITH t AS (SELECT p_brand AS brand, CAST(year(l_shipdate) AS INT) AS year, CASE p_type WHEN 'PROMO' THEN 0 WHEN 'LARGE' THEN 1 WHEN 'SMALL' THEN 2 WHEN 'ECONOMY' THEN 3 WHEN 'MEDIUM' THEN 4 ELSE 5 END AS place, sum(l_quantity) AS value, CAST(sum(l_quantity) AS BIGINT) % 7 AS score FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL),
    l AS (SELECT brand, year, list(struct_pack(place := place, value := value, score := score) ORDER BY place) AS c FROM t GROUP BY ALL),
    o AS (SELECT brand, year, list_reduce(c, lambda a, b: CASE WHEN a.value > 0 AND b.value > 0 AND a.value > b.value * 2 THEN b WHEN a.value > 0 AND b.value > 0 AND b.value > a.value * 2 THEN a WHEN a.score >= b.score THEN a ELSE b END) AS o FROM l)
    SELECT brand, year, o.place AS place, o.value AS value FROM o"""
)
def one_total_per_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a year's competing totals the one to tell."""
    rows = table(spark, sf_dir, "lineitem").join(_part(spark, sf_dir), F.col("l_partkey") == F.col("p_partkey"))
    place = F.array_position(F.array(*map(F.lit, ["PROMO", "LARGE", "SMALL", "ECONOMY", "MEDIUM", "STANDARD"])), F.col("p_type")).cast("int") - 1
    sums = rows.groupBy(F.col("p_brand").alias("brand"), F.year("l_shipdate").alias("year"), place.alias("place")).agg(F.sum("l_quantity").alias("value"))
    by = sums.groupBy("brand", "year").agg(F.array_sort(F.collect_list(F.struct("place", "value", (F.col("value").cast("long") % 7).alias("score")))).alias("c"))  # six types at most
    return by.withColumn("o", op.one_total(F.col("c"))).select("brand", "year", "o.place", "o.value")


@query(
    """WITH f AS (SELECT p_brand AS brand, p_type AS type, CAST(sum(l_quantity) AS BIGINT) AS v FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_shipdate >= TIMESTAMP '2001-06-01' GROUP BY ALL)
    SELECT brand, CASE WHEN count(DISTINCT type = 'PROMO') = 1 THEN CAST(sum(v) AS BIGINT) END AS total, CASE WHEN count(DISTINCT type = 'PROMO') = 1 THEN string_agg(v, ' + ' ORDER BY type) || ' = ' || sum(v) END AS formula FROM f GROUP BY brand HAVING count(*) >= 2"""
)
def summed_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of facts with their formula; facts of different families aren't added."""
    rows = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") >= F.lit("2001-06-01").cast("timestamp")).join(_part(spark, sf_dir), F.col("l_partkey") == F.col("p_partkey"))
    facts = rows.groupBy(F.col("p_brand").alias("brand"), F.col("p_type").alias("place")).agg(F.sum("l_quantity").cast("long").alias("value"))
    return op.summed_facts(facts.withColumns({"family": F.col("place") == "PROMO", "raw_value": F.col("value").cast("string")}), "brand")


_TEMPLATES = [
    ("甲公司起诉乙公司侵权", "诉讼/知识产权"), ("2024年3月5日张某出任总裁", "人事任命"), ("两家公司签署长期合作协议", "战略合作"), ("2025年Q2某厂入股电池企业，推动纯电车型量产", "投资并购"), ("欧盟加征进口汽车关税", "政策动态"), ("工厂年内投产", "产能/生产"),
    ("新车今日上市", "产品发布"), ("25年前三季度销量同比增长", "销量动态"), ("芯片获准出口", "技术动态"), ("该车进入德国市场", "市场动态"), ("天气很好", None), ("3月5日面板出货大幅下降", "销量动态"),
]


def _text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """o_orderkey, o_custkey and text: two sentences by the order's key."""
    first, second = _pick([t for t, _ in _TEMPLATES], F.col("o_orderkey")), _pick([t for t, _ in _TEMPLATES], F.floor(F.col("o_orderkey") / 7))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.concat(first, F.lit("。\n "), second, F.lit("！")).alias("text"))


_KINDS = "CASE k " + " ".join(f"WHEN {i} THEN '{k}'" for i, (_, k) in enumerate(_TEMPLATES) if k) + " END"
_EVENT_ROWS = f"s AS (SELECT o_orderkey, o_custkey, o_orderkey % 12 AS k, 0 AS n FROM orders UNION ALL SELECT o_orderkey, o_custkey, o_orderkey // 7 % 12, 1 FROM orders), e AS (SELECT *, {_KINDS} AS kind, CASE k WHEN 1 THEN '2024年3月5日' WHEN 3 THEN '2025年Q2' WHEN 7 THEN '25年前三季度' WHEN 11 THEN '3月5日' END AS time, CASE k WHEN 3 THEN '推动纯电车型量产' WHEN 11 THEN '下降' END AS effect, CASE k WHEN 3 THEN '纯电' WHEN 4 THEN '关税' WHEN 8 THEN '芯片' ELSE '' END AS keywords FROM s)"


@query(f"WITH {_EVENT_ROWS} SELECT kind, time, effect, keywords, count(*) AS n FROM e WHERE kind IS NOT NULL GROUP BY ALL")
def sentence_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences that tell of an event: its kind by ten ordered rules, its time, its effect and keywords."""
    rows = _text(spark, sf_dir).select(F.explode(op.sentences(F.col("text"))).alias("s")).select(op.event(F.col("s")).alias("e")).where("e is not null")
    effect = F.regexp_replace("e.effect", "[。！]$", "")
    return rows.groupBy(F.col("e.kind").alias("kind"), F.col("e.time").alias("time"), effect.alias("effect"), F.array_join("e.keywords", ",").alias("keywords")).agg(F.count(F.lit(1)).alias("n"))


_TEXTS = "CASE k " + " ".join(f"WHEN {i} THEN '{t}'" for i, (t, _) in enumerate(_TEMPLATES)) + " END || CASE n WHEN 0 THEN '。' ELSE '！' END"


@query(f"WITH {_EVENT_ROWS} SELECT kind, {_TEXTS} AS text, time, count(DISTINCT o_custkey) AS n_sources, min(o_custkey) AS first_source FROM e WHERE kind IS NOT NULL GROUP BY ALL")
def distinct_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events told in several places, each once with the number of its sources; white space makes no other event."""
    rows = once(_text(spark, sf_dir), "said", op.sentences(F.col("text"))).select("o_custkey", F.explode("said").alias("sentence"))
    spaced = rows.withColumn("sentence", F.regexp_replace("sentence", "(.)([。！])$", "$1  $2"))
    return op.distinct_events(spaced.unionByName(rows), "o_custkey")


_CATEGORY = [("1.2 宏观政策\n电池", "macro_policy"), ("工厂布局与电池", "strategy"), ("关税政策与芯片", "macro_policy"), ("x" * 200 + "专利诉讼", "competition"), ("nothing here", "other"), ("新任CEO与总裁谈芯片", "personnel"), ("2.2 战略 政策 政策", "strategy"), ("3.1 产业链观察", "industry_chain")]


@query(
    "SELECT p_partkey, CASE p_partkey % 8 " + " ".join(f"WHEN {i} THEN '{c}'" for i, (_, c) in enumerate(_CATEGORY)) + """ END AS category, ['risk','policy','technology','company_event','sales_analysis','market_trend'][p_partkey % 6 + 1] AS knowledge_type,
    ['financial','sales','market_share','other'][p_partkey % 4 + 1] AS kind, [NULL,'yoy','share','mom'][p_partkey % 4 + 1] AS change, ['12.5','-3','40','about 7'][p_partkey % 4 + 1] AS value, ['亿元','%','百分点',NULL][p_partkey % 4 + 1] AS unit FROM part"""
)
def text_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories of texts by heading or words, what they are about, and the kind, change and unit of metrics."""
    by = F.col("p_partkey")
    about = _pick(["政策风险", "电池补贴", "智能驾驶与销量", "推出新车，同比增长", "销量万辆", "天气"], by)
    m = op.metric_type(_pick(["营业收入", "销量同比", "市场份额", "指标环比"], by), _pick([" 12.5 亿元", "−3%", "40百分点", "about 7"], by))
    return _part(spark, sf_dir).select("p_partkey", op.category(_pick([t for t, _ in _CATEGORY], by)).alias("category"), op.knowledge_type(about).alias("knowledge_type"), m["kind"].alias("kind"), m["change"].alias("change"), m["value"].alias("value"), m["unit"].alias("unit"))


@query(
    """WITH q AS (SELECT p_partkey, ['BYD 2024 固态电池量产计划', '请问 特斯拉Model3 销量 多少', 'OLED面板 出货情况', '一个 年度 报告'][p_partkey % 4 + 1] || ' ' || p_name AS q, p_name FROM part),
    t AS (SELECT p_partkey, string_split(p_name, ' ') AS own, CASE p_partkey % 4 WHEN 0 THEN ['BYD', '固态电池量产计划', '固态电池', '态电池量', '电池量产', '池量产计', '量产计划', '固态电池量', '态电池量产', '电池量产计', '池量产计划', '固态电池量产', '态电池量产计', '电池量产计划'] WHEN 1 THEN ['特斯拉', 'Model3'] WHEN 2 THEN ['OLED', '面板', '出货情况'] ELSE [] END AS fixed FROM q)
    SELECT p_partkey, len(list_distinct(list_concat(own, fixed))) AS n_terms, sha256(array_to_string(list_sort(list_distinct(list_concat(own, fixed))), ',')) AS digest FROM t"""
)
def question_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of questions that may tell documents apart."""
    question = F.concat(_pick(["BYD 2024 固态电池量产计划", "请问 特斯拉Model3 销量 多少", "OLED面板 出货情况", "一个 年度 报告"], F.col("p_partkey")), F.lit(" "), "p_name")
    found = op.content_terms(question)
    return _part(spark, sf_dir).select("p_partkey", F.size(found).cast("long").alias("n_terms"), F.sha2(F.array_join(F.array_sort(found), ","), 256).alias("digest"))


@query(
    """WITH m AS (SELECT p_partkey, CASE WHEN p_size = 3 THEN NULL ELSE p_size * 1000.5 END AS v, CASE WHEN p_size % 4 = 0 THEN NULL ELSE (p_size - 25) / 50 END AS y FROM part), s AS (SELECT *, CASE WHEN v IS NULL THEN '缺失' WHEN v >= 10000 THEN format('{:,.0f}', v) ELSE format('{:.1f}', v) END AS n FROM m)
    SELECT p_partkey, n AS shown, CASE WHEN y IS NULL THEN '缺失' ELSE format('{:+.1f}%', y * 100) END AS percent, CASE WHEN v IS NULL OR y IS NULL THEN n ELSE n || chr(10) || '（同比' || format('{:+.1f}%', y * 100) || '）' END AS both FROM s"""
)
def shown_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures and changes as reports show them; what is missing is called so."""
    v, y = F.when(F.col("p_size") != 3, F.col("p_size") * 1000.5), F.when(F.col("p_size") % 4 != 0, (F.col("p_size") - 25) / 50)
    rows = _part(spark, sf_dir).select("p_partkey", v.alias("v"), y.alias("y"))
    return rows.select("p_partkey", op.shown_number(F.col("v")).alias("shown"), op.shown_percent(F.col("y")).alias("percent"), op.shown_with_change(F.col("v"), F.col("y")).alias("both"))
