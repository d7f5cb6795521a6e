"""Queries that shape sheets: wide to long, fill-down, islands, header rows, cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegrid.functions import values
from tidegrid.plans.registry import query
from tidegrid.sources.tables import market_facts, market_sql, months_between, table

_MONTHS = ["1996-01", "1996-02", "1996-03", "1996-04"]
#: Rows of bands that a task sorts, as far as sheets can be dealt apart.
_ROWS_A_TASK = 1_000_000


@query(f"WITH {market_sql('brand', 'market')} SELECT brand, market, time_period, sum(wholesale) AS wholesale FROM facts WHERE time_period BETWEEN '1996-01' AND '1996-04' GROUP BY ALL")
def unpivot_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sheet with a column a month, made by a pivot, back to a row a month; empty cells drop."""
    facts = market_facts(spark, sf_dir, "brand", "market", where=months_between(_MONTHS[0], _MONTHS[-1]))
    wide = facts.groupBy("brand", "market").pivot("time_period", _MONTHS).agg(F.sum("wholesale"))
    return wide.unpivot(["brand", "market"], _MONTHS, "time_period", "wholesale").where("wholesale is not null")


@query("SELECT p_partkey, p_brand AS brand FROM part")
def forward_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that stand in the first row of their block only, carried down; each block starts anew."""
    block = Window.partitionBy("p_brand").orderBy("p_partkey")
    sheet = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("block"), F.when(F.row_number().over(block) == 1, F.col("p_brand")).alias("label"))
    fill = F.last("label", ignorenulls=True).over(Window.partitionBy("block").orderBy("p_partkey").rowsBetween(Window.unboundedPreceding, 0))
    return sheet.select("p_partkey", fill.alias("brand"))


@query(
    """WITH r AS (SELECT DISTINCT l_suppkey AS sheet, l_partkey AS row FROM lineitem), g AS (SELECT *, CASE WHEN row - lag(row) OVER (PARTITION BY sheet ORDER BY row) > 2 THEN 1 ELSE 0 END AS new FROM r),
    b AS (SELECT *, sum(new) OVER (PARTITION BY sheet ORDER BY row) AS band FROM g) SELECT sheet, CAST(band AS BIGINT) AS band, min(row) AS first_row, max(row) AS last_row, count(*) AS n_rows FROM b GROUP BY ALL HAVING count(*) >= 2"""
)
def gaps_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bands of rows that are at most two apart, of two rows or more."""
    lines = table(spark, sf_dir, "lineitem")
    tasks = 1 + lines.count() // _ROWS_A_TASK  # from the files' footers; a number that is given isn't merged to fewer
    rows = lines.select(F.col("l_suppkey").alias("sheet"), F.col("l_partkey").alias("row")).repartition(tasks, "sheet")
    w = Window.partitionBy("sheet").orderBy(F.asc_nulls_last("row"))
    before = F.lag("row").over(w)
    rows = rows.withColumns({"new": F.coalesce((F.col("row") - before > 2).cast("long"), F.lit(0)), "other": (~F.col("row").eqNullSafe(before) | (F.row_number().over(w) == 1)).cast("long")})
    rows = rows.withColumn("band", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    bands = rows.groupBy("sheet", "band").agg(F.min("row").alias("first_row"), F.max("row").alias("last_row"), F.sum("other").alias("n_rows"))  # repeats in their order, so without a map of all rows
    return bands.where("n_rows >= 2")


@query(
    """WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS row, unnest(string_split(text, chr(10))) AS line FROM documents),
    s AS (SELECT doc_id, row, 10 * len(list_filter(string_split(lower(line), ' '), lambda x: x IN ('the', 'of', 'und', 'de', 'que'))) + 2 * len(regexp_extract_all(line, '[A-Z]')) + 5 * len(regexp_extract_all(line, '[0-9]+')) AS score FROM l WHERE row <= 100)
    SELECT doc_id, CAST(row AS INT) AS row, CAST(score AS INT) AS score FROM s WHERE score >= 6 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, row) = 1"""
)
def header_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line of each text that looks most like a header, if one scores 6 or more: keywords, capitals and numbers; the highest, then the first."""
    lines = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line")).where("at < 100")
    keys = F.size(F.filter(F.split(F.lower("line"), " "), lambda w: w.isin("the", "of", "und", "de", "que")))
    score = 10 * keys + 2 * F.regexp_count("line", F.lit("[A-Z]")) + 5 * F.regexp_count("line", F.lit("[0-9]+"))
    best = lines.select("doc_id", (F.col("at") + 1).alias("row"), score.cast("int").alias("score")).where("score >= 6").groupBy("doc_id").agg(F.max_by(F.struct("row", "score"), F.struct("score", -F.col("row"))).alias("b"))
    return best.select("doc_id", F.col("b.row").alias("row"), F.col("b.score").alias("score"))


_CELL = """CASE l_linenumber % 6 WHEN 0 THEN '--' WHEN 1 THEN ' 1,' || lpad(CAST(q AS STRING), 3, '0') || ' ' WHEN 2 THEN CAST(q AS STRING) || '.5%' WHEN 3 THEN CAST(q AS STRING) || '.2万（同比+2.8%）' WHEN 4 THEN '同比 -' || CAST(q AS STRING) || '%' ELSE '' END"""


@query(
    """SELECT l_orderkey, l_linenumber, CASE l_linenumber % 6 WHEN 1 THEN 1000.0 + l_quantity WHEN 2 THEN (l_quantity + 0.5) / 100 WHEN 3 THEN l_quantity + 0.2 WHEN 4 THEN -l_quantity / 100 END AS value,
    CASE l_linenumber % 6 WHEN 3 THEN 2.8 / 100 WHEN 4 THEN -l_quantity / 100 END AS yoy FROM lineitem"""
)
def parse_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers written in six ways, read back."""
    cells = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("int").alias("q")).withColumn("cell", F.expr(_CELL))
    return cells.select("l_orderkey", "l_linenumber", values.parse_numeric(F.col("cell")).alias("value"), values.extract_yoy(F.col("cell")).alias("yoy"))


@query(
    """SELECT o_orderkey, '20' || strftime(o_orderdate, '%y') || CASE o_orderkey % 6 WHEN 3 THEN '-Q' || quarter(o_orderdate) WHEN 4 THEN '-Q' || quarter(o_orderdate) ELSE '-' || strftime(o_orderdate, '%m') END AS period FROM orders WHERE o_orderkey % 6 <> 5
    UNION ALL SELECT o_orderkey, 'M' || strftime(o_orderdate, '%m') FROM orders WHERE o_orderkey % 6 = 5"""
)
def parse_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months and quarters written in six ways, read back (the tables' years moved to 20yy)."""
    y, m, q = F.concat(F.lit("20"), F.date_format("o_orderdate", "yy")), F.date_format("o_orderdate", "MM"), F.quarter("o_orderdate").cast("string")
    way = F.col("o_orderkey") % 6
    cell = F.when(way == 0, F.concat(y, m, F.lit(".0"))).when(way == 1, F.concat(y, F.lit("年"), m.cast("int").cast("string"), F.lit("月"))).when(way == 2, F.concat(F.lit("　"), y, F.lit("/"), m))
    cell = cell.when(way == 3, F.concat(y, F.lit("年"), q, F.lit("季度"))).when(way == 4, F.concat(y, F.lit("q"), q)).otherwise(F.concat(m.cast("int").cast("string"), F.lit(" 月")))
    return table(spark, sf_dir, "orders").select("o_orderkey", values.parse_period(cell).alias("period"))


@query(
    """WITH c AS (SELECT CASE l_linenumber % 6 WHEN 0 THEN '--' WHEN 5 THEN '' END AS p, l_linenumber % 6 IN (1, 2, 3, 4) AS ok FROM lineitem)
    SELECT count(*) AS n_cells, count(*) FILTER (ok) AS n_valid, count(*) FILTER (p = '--') AS n_placeholders, count(*) FILTER (p = '') AS n_blank FROM c"""
)
def period_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many cells hold numbers, placeholders or nothing."""
    cells = table(spark, sf_dir, "lineitem").select("l_linenumber", F.col("l_quantity").cast("int").alias("q")).select(F.expr(_CELL).alias("cell"))
    blank = values.normal_text(F.col("cell")) == ""
    good = values.parse_numeric(F.col("cell")).isNotNull()
    return cells.agg(F.count(F.lit(1)).alias("n_cells"), F.count_if(good).alias("n_valid"), F.count_if(~good & ~blank).alias("n_placeholders"), F.count_if(blank).alias("n_blank"))


@query(
    "SELECT l_orderkey AS sheet, "
    + ", ".join(f"CASE WHEN count(*) FILTER (l_linenumber = {k}) = 0 THEN 'NOT_PRESENT' WHEN max(l_discount) FILTER (l_linenumber = {k}) = 0 THEN 'EMPTY' ELSE 'PARSED' END AS field_{k}" for k in (1, 2, 3))
    + " FROM lineitem GROUP BY 1"
)
def comparison_transpose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column for each label of a comparison table, with the state of its cell; a discount of zero plays an empty cell."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sheet"), "l_linenumber", "l_discount")
    wide = rows.groupBy("sheet").pivot("l_linenumber", [1, 2, 3]).agg(F.max("l_discount"))
    state = lambda c: F.when(F.col(c).isNull(), "NOT_PRESENT").when(F.col(c) == 0, "EMPTY").otherwise("PARSED")
    return wide.select("sheet", *(state(str(k)).alias(f"field_{k}") for k in (1, 2, 3)))


@query("SELECT event_id, k.key AS field, CAST(k.value AS VARCHAR) AS value FROM events, json_each(props) k WHERE props IS NOT NULL")
def json_map_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each entry of a JSON map; broken JSON has none."""
    rows = table(spark, sf_dir, "events").select("event_id", F.from_json("props", "map<string,string>").alias("m"))
    return rows.select("event_id", F.explode("m").alias("field", "value"))


@query("SELECT source, sha256(text) AS digest, min(doc_id) AS first_version, count(*) AS n_seen FROM documents WHERE text IS NOT NULL GROUP BY ALL")
def hash_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A version of a source for each distinct content; repeats reuse the first."""
    rows = table(spark, sf_dir, "documents").where("text is not null").select("source", "doc_id", F.sha2("text", 256).alias("digest"))
    return rows.groupBy("source", "digest").agg(F.min("doc_id").alias("first_version"), F.count(F.lit(1)).alias("n_seen"))
