"""Queries over findings placed in texts and over a rebuilt graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.operators import extraction as op
from tidegrid.operators.text import entities_of, pairs_of
from tidegrid.plans.documents import _MENTIONS, ALIASES
from tidegrid.plans.registry import query
from tidegrid.sources.files import scratch
from tidegrid.sources.tables import table

_TEXT_SQL = """t AS (SELECT *, 'Intro. ' || p_brand || ' delivers ' || p_name || ' panels to ' || p_type || CASE WHEN k = 2 THEN repeat('.', 400) ELSE '' END || ' of ' || p_size || ' cm, ' || p_partkey || '万 sold.' AS text FROM (SELECT *, p_partkey % 5 AS k FROM part))"""


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p_partkey, k, the fields as the text says them, and the text."""
    part = table(spark, sf_dir, "part").withColumn("k", F.col("p_partkey") % 5)
    size, sales = F.concat(F.col("p_size").cast("string"), F.lit(" cm")), F.concat(F.col("p_partkey").cast("string"), F.lit("万"))
    gap = F.when(F.col("k") == 2, F.repeat(F.lit("."), F.lit(400))).otherwise("")
    text = F.concat(F.lit("Intro. "), "p_brand", F.lit(" delivers "), "p_name", F.lit(" panels to "), "p_type", gap, F.lit(" of "), size, F.lit(", "), sales, F.lit(" sold."))
    return part.select("p_partkey", "k", "p_brand", "p_name", "p_type", size.alias("size"), sales.alias("sales"), text.alias("text"))


@query(
    f"""WITH {_TEXT_SQL}, r AS (SELECT p_partkey, p_brand AS supplier, CASE WHEN k = 0 THEN p_type END AS customer, CASE WHEN k IN (0, 1, 3) THEN p_name END AS vehicle, CASE WHEN k IN (1, 4) THEN p_size || ' cm' END AS size, text,
      CASE k WHEN 0 THEN p_brand || ' delivers ' || p_name || ' panels to ' || p_type WHEN 1 THEN substr(text, 8, instr(text, p_size || ' cm') + length(p_size || ' cm') - 8) WHEN 3 THEN p_brand || ' delivers ' || p_name ELSE substr(text, 8, instr(text, p_size || ' cm') + length(p_size || ' cm') - 8) END AS evidence FROM t WHERE k <> 2)
    SELECT p_partkey, supplier, customer, vehicle, size, evidence, CAST(instr(text, evidence) - 1 AS INT) AS first, CAST(instr(text, evidence) - 1 + length(evidence) AS INT) AS "end" FROM r"""
)
def extracted_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposed records that their text bears out: with a good evidence, with one made from the fields' places, with a field that the text lacks, and
    repeated; those whose fields stand too far apart are gone."""
    k, none = F.col("k"), F.lit(None).cast("string")
    record = lambda **v: F.struct(*((v[f] if f in v else none).alias(f) for f in [*op.FIELDS, "evidence"]))
    brand, name = F.col("p_brand"), F.concat(F.lit(" "), "p_name", F.lit("\t"))
    good = record(supplier=brand, customer=F.col("p_type"), vehicle=name, evidence=F.concat("p_brand", F.lit(" delivers "), "p_name", F.lit(" panels to "), "p_type"))
    sized = record(supplier=brand, size=F.col("size"), evidence=F.lit("not in the text"))
    items = (
        F.when(k == 0, F.array(good)).when(k == 1, F.array(record(supplier=brand, vehicle=name, size=F.col("size"), evidence=F.lit("Intro.")))).when(k == 2, F.array(record(supplier=brand, sales=F.col("sales"))))
        .when(k == 3, F.array(record(supplier=brand, technology=F.lit("OLED")), record(size=F.col("size"), sales=F.col("sales")), record(supplier=brand, vehicle=name, technology=F.lit("OLED")))).otherwise(F.array(sized, sized))
    )
    rows = _texts(spark, sf_dir).select("p_partkey", F.inline(op.records(F.col("text"), items)))
    return rows.select("p_partkey", "supplier", "customer", "vehicle", "size", "evidence", "first", "end")


@query(
    f"""WITH {_TEXT_SQL}, e AS (SELECT p_partkey, 'COMPANY' AS kind, p_brand AS value, instr(text, p_brand) - 1 AS first, length(p_brand) AS n FROM t UNION ALL SELECT p_partkey, 'TECHNOLOGY', 'Mini LED', -1, 0 FROM t
      UNION ALL SELECT p_partkey, 'SALES', (p_partkey * 10000) || ' unit', instr(text, p_partkey || '万') - 1, length(p_partkey || '万') FROM t)
    SELECT p_partkey, kind, value, CAST(first AS INT) AS first, CAST(CASE WHEN first < 0 THEN -1 ELSE first + n END AS INT) AS "end" FROM e"""
)
def extracted_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities with their places: repeats and blanks are gone, values that the text lacks have no place."""
    item = lambda kind, raw, evidence=None: F.struct(F.lit(kind).alias("kind"), raw.alias("raw"), F.lit(evidence).cast("string").alias("evidence"))
    brand = F.col("p_brand")
    items = F.array(item("company", brand), item("COMPANY", F.concat(brand, F.lit(" ")), "Intro."), item("technology", F.lit("mini-LED")), item("SALES", F.col("sales"), "sold"), item("", brand), item("X", F.lit(" ")))
    return _texts(spark, sf_dir).select("p_partkey", F.inline(op.entities(F.col("text"), items))).select("p_partkey", "kind", "value", "first", "end")


_EDGES_SQL = _MENTIONS + ", e AS (SELECT d.source AS version, a.entity AS from_entity, b.entity AS to_entity, count(*) AS n FROM m a JOIN m b ON a.doc_id = b.doc_id AND a.entity < b.entity JOIN documents d ON d.doc_id = a.doc_id {where} GROUP BY ALL)"


@query(
    f"WITH {_EDGES_SQL.format(where='')}, old AS (SELECT version, from_entity, to_entity, n FROM e), again AS (SELECT d.source AS version, a.entity AS from_entity, b.entity AS to_entity, count(*) AS n FROM m a JOIN m b ON a.doc_id = b.doc_id AND a.entity < b.entity JOIN documents d ON d.doc_id = a.doc_id WHERE d.doc_id % 2 = 0 AND d.source NOT LIKE '%3' GROUP BY ALL)"
    " SELECT * FROM old WHERE ascii(right(version, 1)) % 2 = 0 UNION ALL SELECT * FROM again WHERE ascii(right(version, 1)) % 2 = 1"
)
def rebuilt_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities that occur together, by source; then every second source is built anew from its even documents, twice, and one has nothing left."""
    path = scratch(spark, "graph")
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.col("source").alias("version"), "text")
    edges = lambda d: d.select("version", F.inline(pairs_of(entities_of(F.col("text"), ALIASES)))).groupBy("version", "from_entity", "to_entity").agg(F.count(F.lit(1)).alias("n"))
    op.rebuild(edges(docs), docs.select("version"), path, "version")
    odd = docs.where(F.ascii(F.right("version", F.lit(1))) % 2 == 1)
    for _ in range(2):
        op.rebuild(edges(odd.where("doc_id % 2 = 0 and version not like '%3'")), odd.select("version"), path, "version")
    return op.graph_at(spark, path, "from_entity").select("version", "from_entity", "to_entity", "n")
