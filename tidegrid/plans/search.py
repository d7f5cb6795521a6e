"""Queries that search: terms of a dictionary in texts, an inverted index, and evidence put in order for a question."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.operators import search as op
from tidegrid.plans.registry import query
from tidegrid.sources.tables import table


@query(
    """WITH p AS (SELECT p_brand AS brand, p_name AS name, length(p_name) % 2 = 1 AS whole, sum(length(p_name) + 2) OVER (PARTITION BY p_brand ORDER BY p_partkey) - length(p_name) - 2 AS begins FROM part),
    m AS (SELECT brand, begins AS place, lower(name) AS term FROM p WHERE whole UNION ALL SELECT brand, begins, lower(split_part(name, ' ', 1)) FROM p WHERE NOT whole UNION ALL SELECT brand, begins + length(split_part(name, ' ', 1)) + 1, lower(split_part(name, ' ', 2)) FROM p WHERE NOT whole)
    SELECT brand, CAST(place AS INT) AS place, term FROM m WHERE term <> ''"""
)
def detected_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct word of part names, and every second name as a whole, found in the list of a brand's parts; the longest term counts."""
    part = table(spark, sf_dir, "part")
    terms = part.select(F.explode(F.split("p_name", " ")).alias("term")).unionByName(part.where(F.length("p_name") % 2 == 1).select(F.col("p_name").alias("term")))
    lists = part.groupBy(F.col("p_brand").alias("brand")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name"))).alias("names"))
    texts = lists.select("brand", F.upper(F.array_join(F.transform("names", lambda n: n["p_name"]), ", ")).alias("text"))
    return op.terms_in(texts, "text", terms).select("brand", F.inline("found_")).select("brand", "place", "term")


@query(
    """WITH g AS (SELECT doc_id, unnest([substr(t, i, 2) for i in range(1, length(t))]) AS gram FROM (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents)),
    w AS (SELECT gram, doc_id, count(*) AS tf FROM g WHERE gram IN ('th', 'he', 'ti', 'io', 'on', 'qu') GROUP BY ALL), d AS (SELECT gram, log10((SELECT count(*) FROM documents) / count(*)) AS idf FROM w GROUP BY 1)
    SELECT doc_id, round(sum(tf * idf * idf), 6) AS score FROM w JOIN d ON d.gram = w.gram GROUP BY 1 HAVING round(sum(tf * idf * idf), 6) > 0 ORDER BY score DESC, doc_id LIMIT 50"""
)
def indexed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty documents (a report, hence the limit) that an inverted index over all of them ranks best."""
    index = op.index_of(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")
    return op.search(index, "doc_id", "The tion qu", 50)


#: A question, its plan, and by p_partkey % 4 what a chunk holds and its points for the question.
_ASKED = [
    ("2023年研发投入是多少，同比增减？", "FINANCIAL", "COMPARISON", [("研发投入金额 同比上升", 160), ("主要研发项目 担保", 40), ("研发投入金额 高新技术企业", 40), ("none", 0)]),
    ("列出全部主要研发项目和刀片电池", "RESEARCH", "COMPLETE_LIST", [("主要研发项目 项目进展", 170), ("第二代刀片 刀片电池", 50), ("担保", -80), ("none", 0)]),
    ("生产人员和销售人员一共多少？", "HUMAN_RESOURCES", "CALCULATION", [("母公司在职员工 生产人员 销售人员", 200), ("万辆", -40), ("万辆 人员", 0), ("none", 0)]),
    ("介绍王朝和海洋", "PRODUCT", "SUMMARY", [("共同构建 王朝 海洋", 230), ("王朝 海洋 经营范围", 20), ("龙颜美学", 40), ("none", 0)]),
    ("今年销量是多少万辆？", "VEHICLE_SALES", "GENERAL", [("信用减值", 0), ("王朝 海洋", 0), ("刀片电池", 0), ("none", 0)]),
    ("信用减值和动力电池", "FINANCIAL", "FACT", [("信用减值 资产减值", 200), ("动力电池领域 刀片电池", 180), ("销量 弗迪电池 刀片电池", -130), ("加计抵减", -50)]),
    ("闪电配售与出海的营收", "FINANCIAL", "FACT", [("闪电配售 56亿美元", 180), ("国家和地区 出海覆盖", 180), ("营业收入（元） 本年比上年增减", 180), ("none", 0)]),
]
_ASKED_SQL = "q(q, question, k, content, points) AS (VALUES " + ", ".join(f"({n}, '{a[0]}', {k}, '{c}', {p})" for n, a in enumerate(_ASKED) for k, (c, p) in enumerate(a[3])) + ")"


@query("SELECT * FROM (VALUES " + ", ".join(f"('{a[0]}', '{a[1]}', '{a[2]}')" for a in _ASKED) + ") t(question, domain, kind), (SELECT p_brand AS brand, count(*) AS n_parts FROM part GROUP BY 1)")
def question_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each brand's questions are about and of which kind they are."""
    brands = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("brand")).agg(F.count(F.lit(1)).alias("n_parts"))
    rows = brands.select("brand", "n_parts", F.explode(F.array(*(F.lit(a[0]) for a in _ASKED))).alias("question"))
    return rows.select("question", op.domain(F.col("question")).alias("domain"), op.kind(F.col("question")).alias("kind"), "brand", "n_parts")


@query(
    f"""WITH {_ASKED_SQL}, c AS (SELECT p_brand AS brand, q, p_partkey, row_number() OVER (PARTITION BY p_brand, q ORDER BY p_partkey DESC) AS rank, points + CASE WHEN q = 0 THEN CASE p_size % 3 WHEN 0 THEN 200 WHEN 1 THEN -80 ELSE 0 END ELSE CASE p_size % 3 WHEN 0 THEN 23 WHEN 1 THEN 21 ELSE 0 END END AS points
     FROM part JOIN q ON k = p_partkey % 4 AND q = p_size % {len(_ASKED)})
    SELECT brand, q, p_partkey, points, row_number() OVER (PARTITION BY brand, q ORDER BY points DESC, rank) AS place FROM c QUALIFY place <= 10"""
)
def reranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten chunks (a report, hence the limit) of each brand that fit a question best by its topic and the year in their document's name."""
    q, k = F.col("p_size") % len(_ASKED), F.col("p_partkey") % 4
    of = lambda values, at: F.get(F.array(*map(F.lit, values)), at.cast("int"))
    size = F.col("p_size") % 3
    chunks = table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("brand"), q.cast("int").alias("q"), "p_partkey", of([a[0] for a in _ASKED], q).alias("question"), of([c for a in _ASKED for c, _ in a[3]], q * 4 + k).alias("content"),
        F.when(size == 0, "report 2019 and 2023").when(size == 1, "2021年报").otherwise("news").alias("names"),
    )
    from pyspark.sql import Window

    found = chunks.withColumn("rank", F.row_number().over(Window.partitionBy("brand", "q").orderBy(F.desc("p_partkey"))))
    keyed = found.withColumn("key", F.concat_ws("/", "brand", "q"))
    return op.reranked(keyed, "key").where("place <= 10").select("brand", "q", "p_partkey", "points", "place")
