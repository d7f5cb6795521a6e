"""Queries over reports as JSON; a report of each brand is written from sums of lineitem by year."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.operators import reports as op
from tidegrid.plans.registry import query
from tidegrid.sources.tables import table

_SQL = """s AS (SELECT p_brand AS brand, CAST(year(l_shipdate) AS INT) AS y, CAST(sum(l_quantity) AS BIGINT) AS v FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL),
 r AS (SELECT CAST(substr(brand, 7) AS BIGINT) AS report_id, brand, y, v, row_number() OVER (PARTITION BY brand ORDER BY y) - 1 AS k FROM s)"""


def _json(**values: Column) -> Column:
    return F.to_json(F.struct(*(v.alias(k) for k, v in values.items())))


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """report_id, report_type, generation_mode and content: years nested in regions, with evidence, repeats and texts around them."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    rows = rows.groupBy(F.col("p_brand").alias("brand"), F.year("l_shipdate").alias("y")).agg(F.sum("l_quantity").cast("long").alias("v"))
    rows = rows.groupBy("brand").agg(F.array_sort(F.collect_list(F.struct("y", "v"))).alias("years"))  # a few years a brand
    name = lambda m: F.concat(F.lit("year."), m["y"].cast("string"))
    string = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    metric = lambda m: F.concat(F.lit('{"metric_id":'), string(name(m)), F.lit(',"value":'), m["v"].cast("string"), F.lit(',"deep":{"evidence":[1],"kept":"yes {\\"}"},"evidence":{"rows":'), m["v"].cast("string"), F.lit("}}"))
    short = lambda m: F.concat(F.lit('{"metric_id":'), string(name(m)), F.lit("}"))
    joined = lambda f: F.array_join(F.transform("years", f), ",")
    given = lambda m: F.concat(F.lit('{"metric_id":'), string(name(m)), F.lit(',"evidence":"row '), m["y"].cast("string"), F.lit('"}'))
    trace = lambda m: F.concat(F.lit('{"conclusion":"In '), m["y"].cast("string"), F.lit('  it was\\n'), m["v"].cast("string"), F.lit('","citation_label":"C'), m["y"].cast("string"), F.lit('","metric_ids":["year.'), m["y"].cast("string"), F.lit('"]}'))
    said = lambda m: F.concat(F.lit('{"text":"In '), m["y"].cast("string"), F.lit(" it was "), m["v"].cast("string"), F.lit('"}'))
    first = F.slice("years", 1, 1)
    content = F.concat(
        F.lit('{"computed_metrics":{"before":['), joined(short), F.lit('],"nested":{"a":[{"b":{"list":['), joined(metric), F.lit(']}}],"other":{"n":1,"none":null,"empty":[]}},"chart":{"points":[1,2]}},'),
        F.lit('"evidence":['), F.array_join(F.transform(first, given), ","), F.lit('],"executive_summary":{"parts":['), joined(said), F.lit(',"  only\\there "]},"title":"no conclusion","quality":{"conclusion":"not this"},'),
        F.lit('"narrative_sources":['), F.array_join(F.transform(first, trace), ","), F.lit(',{"conclusion":"traced alone","metric_ids":[]},{"conclusion":" "}]}'),
    )
    return rows.select(F.substring("brand", 7, 5).cast("long").alias("report_id"), F.lit("weekly").alias("report_type"), F.lit("rules").alias("generation_mode"), content.alias("content"))


@query(
    f"""WITH {_SQL} SELECT report_id, 'METRIC' AS kind, 'year.' || y AS key, '{{"metric_id":"year.' || y || '","value":' || v || ',"deep":{{"kept":"yes {{\\"}}"}}}}' AS content, '$.computed_metrics.before[' || k || ']' AS json_path,
     CASE WHEN k = 0 THEN '"row ' || y || '"' ELSE '{{"evidence":{{"rows":' || v || '}}}}' END AS evidence FROM r
    UNION ALL SELECT DISTINCT report_id, 'DATASET', key, content, '$.computed_metrics.' || substr(key, 9), NULL FROM r, (VALUES ('dataset.nested', '{{"other":{{"n":1}}}}'), ('dataset.chart', '{{"points":[1,2]}}')) t(key, content)"""
)
def projected_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metrics of every report, wherever they stand in it, and the data beside them."""
    return op.projected(_reports(spark, sf_dir)).where("kind in ('METRIC', 'DATASET')").select("report_id", "kind", "key", "content", "json_path", "evidence")


@query(
    f"""WITH {_SQL}, n AS (SELECT report_id, max(k) + 1 AS n FROM r GROUP BY 1), c AS (SELECT report_id, k + 1 AS nr, CASE k WHEN 0 THEN 'year.' || y ELSE '' END AS key, CASE k WHEN 0 THEN 'In ' || y || '  it was' || chr(10) || v ELSE 'In ' || y || ' it was ' || v END AS text,
      CASE k WHEN 0 THEN '{{"traceability":"METRIC_EVIDENCE","citation_label":"C' || y || '","source_file":null,"metric_ids":["year.' || y || '"],"metrics":null}}' ELSE '{{"traceability":"REPORT_ONLY"}}' END AS evidence FROM r
     UNION ALL SELECT report_id, n + 1, '', 'only here', '{{"traceability":"REPORT_ONLY"}}' FROM n UNION ALL SELECT report_id, n + 2, '', 'traced alone', '{{"traceability":"METRIC_EVIDENCE","citation_label":null,"source_file":null,"metric_ids":[],"metrics":null}}' FROM n)
    SELECT report_id, key, '结论 / ' || nr AS title, '结论：' || text AS content, evidence FROM c"""
)
def projected_conclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every report concludes, in reading order, with the trace of what is traced."""
    return op.projected(_reports(spark, sf_dir)).where("kind = 'CONCLUSION'").select("report_id", "key", "title", "content", "evidence")


@query(
    """WITH m AS (SELECT p_brand AS brand, p_partkey, p_name, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS nr FROM part)
    SELECT brand, CAST(nr AS INT) AS nr, p_name AS model, CAST(p_size AS DOUBLE) AS units, '2024年3月Brand车型' || p_name || '销量为' || p_size || '辆' AS fact FROM m WHERE nr <= 10 AND substr(brand, 7) NOT IN ('1', '2')"""
)
def model_ranking_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten models that a text about a brand ranks, cut out of the JSON inside it; braces in strings don't end it, and two texts are cut off."""
    entry = F.concat(F.lit('{"对象": "'), "p_name", F.lit('" ,"销量/数值": '), F.col("p_size").cast("string"), F.lit(', "note": "} \\" }"}'))
    rows = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("brand")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", entry.alias("entry")))).alias("models"))
    listed = F.array_join(F.transform("models", lambda m: m["entry"]), ",")
    short = F.substring("brand", 7, 5).isin("1", "2")
    content = F.concat(F.lit('The week: "latest_period": "2024-03". It ranks "rankings" : {"oem": {"对象": "Maker","销量/数值": 5}, "model": {"list": [{"对象": "Brand","销量/数值": 9},'), listed, F.when(short, "").otherwise("]}, \"x\": [1]} and so on {\"对象\": \"After\",\"销量/数值\": 7}"))
    chunks = rows.select("brand", F.lit("brand report").alias("names"), content.alias("content"))
    return op.model_rankings(chunks, "Brand").select("brand", "nr", "model", "units", "fact")
