"""Queries over sheets as cells: headers, structures, wide tables and annual blocks, made from the market view.

``sales``: a sheet for each power type, a title, a header row of two dimensions and six months, a row a brand
(sums that seven divides are written as a dash) and a row of totals. ``export volume``: a sheet for each of three
groups of sizes, a block a year, a row a brand and power type whose brand stands in its first row only, totals
between brands.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegrid.functions import headers
from tidegrid.functions.values import parse_numeric
from tidegrid.operators import sheets as op
from tidegrid.plans.registry import query
from tidegrid.sources import files
from tidegrid.sources.tables import table

_HEAD = ["品牌", "备注", *(f"2000{m:02d}" for m in range(1, 7))]
_SALES_SQL = """f AS (SELECT p_type AS sheet, p_brand AS brand, CAST(month(l_shipdate) AS INT) AS m, CAST(sum(l_quantity) AS BIGINT) AS v FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_shipdate >= TIMESTAMP '2000-01-01' AND l_shipdate < TIMESTAMP '2000-07-01' GROUP BY ALL),
 b AS (SELECT sheet, brand, CAST(2 + row_number() OVER (PARTITION BY sheet ORDER BY brand) AS INT) AS row FROM (SELECT DISTINCT sheet, brand FROM f))"""
_SALES_CELLS = _SALES_SQL + ", cells AS (SELECT 'sales' AS file, sheet, 1 AS row, 1 AS col, 'Monthly figures' AS value FROM (SELECT DISTINCT sheet FROM f) UNION ALL SELECT 'sales', sheet, 2, k, v FROM (SELECT DISTINCT sheet FROM f), (VALUES " + ", ".join(f"({k}, '{h}')" for k, h in enumerate(_HEAD, 1)) + """) h(k, v)
 UNION ALL SELECT 'sales', sheet, row, 1, brand FROM b UNION ALL SELECT 'sales', sheet, row, 2, 'checked' FROM b WHERE row % 2 = 0
 UNION ALL SELECT 'sales', f.sheet, row, 2 + m, CASE WHEN v % 7 = 0 THEN '--' ELSE CAST(v AS VARCHAR) END FROM f JOIN b ON b.sheet = f.sheet AND b.brand = f.brand
 UNION ALL SELECT 'sales', sheet, max(row) + 1, 1, '总计' FROM b GROUP BY sheet UNION ALL SELECT 'sales', f.sheet, (SELECT max(row) FROM b WHERE b.sheet = f.sheet) + 1, 2 + m, CAST(sum(v) AS VARCHAR) FROM f GROUP BY f.sheet, m)"""


def _cell(d: DataFrame, row, col, value) -> DataFrame:
    return d.select("file", "sheet", row.cast("int").alias("row"), col.cast("int").alias("col"), value.cast("string").alias("value"))


def sales_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").where((F.col("l_shipdate") >= F.lit("2000-01-01").cast("timestamp")) & (F.col("l_shipdate") < F.lit("2000-07-01").cast("timestamp")))
    facts = lines.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy(F.lit("sales").alias("file"), F.col("p_type").alias("sheet"), F.col("p_brand").alias("brand"), F.month("l_shipdate").alias("m")).agg(F.sum("l_quantity").cast("long").alias("v"))
    by_brand = facts.groupBy("file", "sheet", "brand").agg(F.collect_list(F.struct("m", "v")).alias("months"))  # six at most
    by_brand = by_brand.withColumn("row", F.row_number().over(Window.partitionBy("sheet").orderBy("brand")) + 2)
    totals = facts.groupBy("file", "sheet", "m").agg(F.sum("v").alias("v")).groupBy("file", "sheet").agg(F.collect_list(F.struct("m", "v")).alias("months"))
    sheets = by_brand.groupBy("file", "sheet").agg((F.max("row") + 1).alias("last")).join(totals, ["file", "sheet"])
    title = F.array(F.struct(F.lit(1).alias("row"), F.lit(1).alias("col"), F.lit("Monthly figures").alias("value")), *(F.struct(F.lit(2).alias("row"), F.lit(k).alias("col"), F.lit(h).alias("value")) for k, h in enumerate(_HEAD, 1)))
    number = lambda m: F.when(m["v"] % 7 == 0, "--").otherwise(m["v"].cast("string"))
    body = F.concat(
        F.array(F.struct("row", F.lit(1).alias("col"), F.col("brand").alias("value"))),
        F.filter(F.array(F.struct("row", F.lit(2).alias("col"), F.lit("checked").alias("value"))), lambda c: c["row"] % 2 == 0),
        F.transform("months", lambda m: F.struct("row", (m["m"] + 2).alias("col"), number(m).alias("value"))),
    )
    sums = F.concat(F.array(F.struct(F.col("last").alias("row"), F.lit(1).alias("col"), F.lit("总计").alias("value"))), F.transform("months", lambda m: F.struct(F.col("last").alias("row"), (m["m"] + 2).alias("col"), m["v"].cast("string").alias("value"))))
    return by_brand.select("file", "sheet", F.inline(body)).unionByName(sheets.select("file", "sheet", F.inline(F.concat(title, sums))))


_MONTHS_CN = [f"{m}月" for m in range(1, 13)]
_BLOCK_SQL = """g AS (SELECT 'group ' || CAST(p_size % 3 AS VARCHAR) AS sheet, CAST(year(l_shipdate) AS INT) AS y, p_brand AS brand, p_type AS power, CAST(month(l_shipdate) AS INT) AS m, CAST(sum(l_quantity) AS BIGINT) AS v FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_shipdate >= TIMESTAMP '2000-01-01' GROUP BY ALL),
 k AS (SELECT sheet, y, brand, power, 0 AS kind FROM g GROUP BY ALL UNION ALL SELECT sheet, y, brand, '', 1 FROM g GROUP BY ALL UNION ALL SELECT sheet, y, '', '', -1 FROM g GROUP BY ALL),
 p AS (SELECT *, CAST(row_number() OVER (PARTITION BY sheet ORDER BY y, brand, kind, power) AS INT) AS row FROM k)"""


def export_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of the annual blocks, and of each line its kind: -1 header, 0 detail, 1 total."""
    lines = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") >= F.lit("2000-01-01").cast("timestamp"))
    by = ["sheet", "y", "brand", "power"]
    facts = lines.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy(F.concat(F.lit("group "), (F.col("p_size") % 3).cast("string")).alias("sheet"), F.year("l_shipdate").alias("y"), F.col("p_brand").alias("brand"), F.col("p_type").alias("power"), F.month("l_shipdate").alias("m")).agg(F.sum("l_quantity").cast("long").alias("v"))
    months = lambda d, *keys: d.groupBy(*keys, "m").agg(F.sum("v").alias("v")).groupBy(*keys).agg(F.collect_list(F.struct("m", "v")).alias("months"))
    none = F.lit(None).cast("array<struct<m:int,v:bigint>>")
    detail = months(facts, *by).withColumn("kind", F.lit(0))
    totals = months(facts, *by[:3]).withColumns({"power": F.lit(""), "kind": F.lit(1)})
    heads = facts.select("sheet", "y").distinct().withColumns({"brand": F.lit(""), "power": F.lit(""), "months": none, "kind": F.lit(-1)})
    rows = detail.unionByName(totals).unionByName(heads)
    rows = rows.withColumn("row", F.row_number().over(Window.partitionBy("sheet").orderBy("y", "brand", "kind", "power")))
    first = F.row_number().over(Window.partitionBy("sheet", "y", "brand", "kind").orderBy("power")) == 1
    rows = rows.withColumn("name", F.when(F.col("kind") == 1, F.concat("brand", F.lit(" Total"))).when(first, F.col("brand")))
    head = F.array(*(F.struct(F.lit(k).alias("col"), v.cast("string").alias("value")) for k, v in enumerate([F.lit("品牌"), F.lit("动力类型"), *map(F.lit, _MONTHS_CN), F.concat(F.col("y").cast("string"), F.lit("年"))], 1)))
    body = F.concat(F.array(F.struct(F.lit(1).alias("col"), F.col("name").alias("value")), F.struct(F.lit(2).alias("col"), F.when(F.col("kind") == 0, F.col("power")).alias("value"))), F.transform("months", lambda m: F.struct((m["m"] + 2).alias("col"), m["v"].cast("string").alias("value"))))
    cells = lambda kind, made: rows.where(kind).select(F.lit("export volume").alias("file"), "sheet", "row", "kind", "y", F.inline(made))
    cells = cells("kind = -1", head).unionByName(cells("kind >= 0", body))
    return cells.where("value is not null")


_FIELD_SQL = "CASE col WHEN 1 THEN 'brand' END"
_SCORE_SQL = """r AS (SELECT file, sheet, row, count(*) AS n, count(*) FILTER (value IN ('品牌')) AS names, count(*) FILTER (NOT regexp_matches(value, '^[0-9]+$')) AS texts, count(*) FILTER (regexp_matches(value, '^20[0-9]{2}(0[1-9]|1[0-2])$')) AS periods FROM cells GROUP BY ALL HAVING count(*) >= 2),
 q AS (SELECT file, sheet, row, col, col - row_number() OVER (PARTITION BY file, sheet, row ORDER BY col) AS run FROM cells), l AS (SELECT file, sheet, row, max(n) AS longest FROM (SELECT file, sheet, row, run, count(*) AS n FROM q GROUP BY ALL) GROUP BY ALL),
 s AS (SELECT r.*, names * 10 + longest * 2 + texts + periods * 7 + CASE WHEN periods >= 6 THEN 25 WHEN periods >= 2 THEN 10 ELSE 0 END - CASE WHEN n <= 2 AND names < 2 AND periods < 2 THEN 10 ELSE 0 END AS score FROM r JOIN l USING (file, sheet, row) WHERE row <= 100)"""


@query(f"WITH {_SALES_CELLS}, {_SCORE_SQL} SELECT file, sheet, row AS header_row, CAST(score AS BIGINT) AS score FROM s WHERE score >= 6 QUALIFY row_number() OVER (PARTITION BY file, sheet ORDER BY score DESC, row) = 1")
def header_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The header row of each sheet and its score."""
    return op.header_rows(sales_cells(spark, sf_dir))


@query(f"WITH {_SALES_CELLS} SELECT file, sheet, col, value AS header, {_FIELD_SQL} AS field, col > 2 AS is_period FROM cells WHERE row = 2")
def header_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each header names: a registered field, a period or nothing."""
    cells = sales_cells(spark, sf_dir)
    return op.header_cells(cells, op.header_rows(cells)).select("file", "sheet", "col", "header", "field", "is_period")


@query(
    f"""WITH {_SALES_CELLS} SELECT sheet AS source_sheet, (SELECT value FROM cells c WHERE c.sheet = d.sheet AND c.row = d.row AND c.col = 1) AS brand, '2000-0' || CAST(col - 2 AS VARCHAR) AS time_period, CAST(value AS DOUBLE) AS sales,
    row AS source_row, chr(64 + col) || CAST(row AS VARCHAR) AS source_cell FROM cells d WHERE row > 2 AND col > 2 AND value <> '--'"""
)
def wide_to_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide sheets as a row a number, each with the cell that it stands in; the totals' row stays one."""
    cells = sales_cells(spark, sf_dir)
    rows = op.long_table(cells, op.header_rows(cells), "sales")
    return rows.select("source_sheet", F.col("dims")["brand"].alias("brand"), "time_period", "sales", "source_row", "source_cell")


@query(f"WITH {_SALES_CELLS} SELECT value AS placeholder, count(*) AS n FROM cells WHERE row > 2 AND col > 2 AND TRY_CAST(value AS DOUBLE) IS NULL GROUP BY 1 ORDER BY n DESC, placeholder LIMIT 10")
def period_placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands in period cells instead of numbers, the ten most frequent."""
    cells = sales_cells(spark, sf_dir)
    heads = op.header_cells(cells, op.header_rows(cells)).where("is_period")
    body = cells.join(heads.select("file", "sheet", "col", "header_row"), ["file", "sheet", "col"]).where("row > header_row")
    return body.where(parse_numeric(F.col("value")).isNull()).groupBy(F.col("value").alias("placeholder")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "placeholder").limit(10)


@query(
    f"""WITH {_SALES_CELLS}, {_BLOCK_SQL} SELECT 'sales' AS file, sheet, 'yyyymm_wide' AS structure, '2' AS header_rows, 'sales' AS metric FROM (SELECT DISTINCT sheet FROM cells)
    UNION ALL SELECT 'export volume', sheet, 'annual_month_blocks', string_agg(CAST(row AS VARCHAR), ',' ORDER BY row), 'export' FROM p WHERE kind = -1 AND row <= 120 GROUP BY sheet"""
)
def sheet_structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each sheet is built, where its headers are, and the metric that its name or headers name."""
    cells = sales_cells(spark, sf_dir).unionByName(export_cells(spark, sf_dir).drop("kind", "y"))
    return op.structures(cells).withColumn("header_rows", F.array_join(F.transform("header_rows", lambda r: r.cast("string")), ","))


@query(f"WITH {_BLOCK_SQL} SELECT g.sheet AS source_sheet, g.brand, g.power AS power_type, CAST(g.y AS VARCHAR) || '-' || lpad(CAST(m AS VARCHAR), 2, '0') AS time_period, CAST(v AS DOUBLE) AS export, row AS source_row, chr(66 + m) || CAST(row AS VARCHAR) AS source_cell FROM g JOIN p ON p.sheet = g.sheet AND p.y = g.y AND p.brand = g.brand AND p.power = g.power AND kind = 0")
def annual_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stacked blocks of years: the brand is carried down to the rows that lack it, and totals drop."""
    cells = export_cells(spark, sf_dir)
    heads = cells.where("kind = -1").select("file", "sheet", "row").distinct().groupBy("file", "sheet").agg(F.collect_list("row").alias("header_rows"))
    return op.annual_blocks(cells.drop("kind", "y"), heads, "export").select("source_sheet", "brand", "power_type", "time_period", "export", "source_row", "source_cell")


@query(f"WITH {_BLOCK_SQL} SELECT sheet, row, brand AS value FROM p WHERE kind = 0")
def merged_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands that stand in the first cell of a merged range only, in each of its rows."""
    cells = export_cells(spark, sf_dir)
    brands = cells.where("kind = 0 and col = 1").select("file", "sheet", "row")
    rows = cells.where("kind = 0").select("file", "sheet", "row").distinct()
    # A range reaches from a brand's cell to the row before the next one's or the total.
    start = F.max(F.when(F.col("starts"), F.col("row"))).over(Window.partitionBy("file", "sheet").orderBy("row").rowsBetween(Window.unboundedPreceding, 0))
    ranges = rows.join(brands.withColumn("starts", F.lit(True)), ["file", "sheet", "row"], "left").withColumn("top", start).groupBy("file", "sheet", "top").agg(F.max("row").alias("bottom"))
    merged = ranges.select("file", "sheet", "top", F.lit(1).alias("left"), "bottom", F.lit(1).alias("right"))
    filled = op.filled_rectangles(cells.drop("kind", "y"), merged).where("col = 1")
    return filled.join(rows, ["file", "sheet", "row"], "left_semi").select("sheet", "row", "value")


@query(f"WITH {_SALES_CELLS} SELECT sheet, row, max(value) FILTER (col = 1) AS brand, 'A' || CAST(row AS VARCHAR) AS brand_cell, count(*) AS n_fields FROM cells WHERE row > 2 AND row < (SELECT max(row) FROM cells c WHERE c.sheet = cells.sheet) GROUP BY sheet, row")
def sheet_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record for each row of a sheet with the cell of each value; the row of totals closes the table."""
    cells = sales_cells(spark, sf_dir)
    rows = op.records(cells, op.header_rows(cells))
    brand = F.col("record")["品牌"]
    return rows.select("sheet", "row", brand["value"].alias("brand"), brand["source_cell"].alias("brand_cell"), F.size("record").cast("long").alias("n_fields"))


@query(f"WITH {_SALES_CELLS} SELECT sheet, 1 AS first_row, max(row) AS last_row, 1 AS first_col, 8 AS last_col, count(*) AS n_filled FROM cells GROUP BY sheet UNION ALL SELECT sheet, 21, 20 + max(row), 12, 19, count(*) FROM cells GROUP BY sheet")
def table_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables of a sheet, the second twenty rows down and eleven columns over, as regions of their own."""
    cells = sales_cells(spark, sf_dir)
    away = cells.withColumn("part", F.lit(2)).withColumns({"row": F.col("row") + 20, "col": F.col("col") + 11})
    # In one sheet they would overlap in rows, so columns divide them.
    both = cells.withColumn("part", F.lit(1)).unionByName(away).select("file", F.concat("sheet", F.lit("/"), F.col("part").cast("string")).alias("sheet"), "row", "col", "value")
    return op.column_bands(both).select(F.split("sheet", "/")[0].alias("sheet"), "first_row", "last_row", "first_col", "last_col", "n_filled")


_STANDARD = "f AS (SELECT p_brand AS brand, p_type AS kind, strftime(l_shipdate, '%Y-%m') AS time_period, CAST(sum(l_quantity) AS BIGINT) AS v FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_shipdate >= TIMESTAMP '2001-01-01' GROUP BY ALL)"


@query(
    f"""WITH {_STANDARD} SELECT brand, CASE kind WHEN 'PROMO' THEN '新能源 PROMO' ELSE kind END AS market, CASE kind WHEN 'PROMO' THEN '新能源 PROMO' END AS vehicle_type, time_period,
    CASE WHEN v % 5 = 0 THEN NULL ELSE CAST(v AS DOUBLE) END AS sales, CASE WHEN v % 5 = 0 OR v % 3 = 0 THEN NULL ELSE (v % 40 - 20) / 100 END AS yoy_sales FROM f"""
)
def standardise_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text cells as typed columns: a number and the change named beside it, periods written in several ways."""
    lines = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") >= F.lit("2001-01-01").cast("timestamp"))
    facts = lines.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_brand").alias("brand"), F.col("p_type").alias("kind"), F.date_format("l_shipdate", "yyyy-MM").alias("p")).agg(F.sum("l_quantity").cast("long").alias("v"))
    v, year, month = F.col("v"), F.substring("p", 1, 4), F.substring("p", 6, 2)
    text = F.when(v % 5 == 0, "--").when(v % 3 == 0, F.concat(v.cast("string"), F.lit("万"))).otherwise(F.concat(F.format_string("%,d", v), F.lit("（同比"), (v % 40 - 20).cast("string"), F.lit("%）")))
    period = F.when(v % 4 == 0, F.concat(year, month)).when(v % 4 == 1, F.concat(year, F.lit("."), month.cast("int").cast("string"))).when(v % 4 == 2, F.concat(year, F.lit("年"), month.cast("int").cast("string"), F.lit("月"))).otherwise(F.concat(year, F.lit("/"), month))
    cells = facts.select("brand", F.when(F.col("kind") == "PROMO", "新能源 PROMO").otherwise(F.col("kind")).alias("market"), period.alias("time_period"), text.alias("sales"))
    return op.standard_frame(cells, ["brand", "market", "time_period", "sales"]).select("brand", "market", "vehicle_type", "time_period", "sales", "yoy_sales")


@query("SELECT CAST(p_size % 4 AS VARCHAR) AS sheet, '名称' AS dimension_column, '数值' AS value_column FROM part GROUP BY 1")
def unique_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one column of a sheet that may be read as its dimension, and the one that may be read as its value."""
    part = table(spark, sf_dir, "part").select(F.lit("parts").alias("file"), (F.col("p_size") % 4).cast("string").alias("sheet"), (F.row_number().over(Window.partitionBy(F.col("p_size") % 4).orderBy("p_partkey")) + 1).alias("row"), F.array(F.col("p_partkey").cast("string"), "p_name", F.col("p_retailprice").cast("string"), F.lit("a note")).alias("cells"))
    body = part.select("file", "sheet", "row", F.posexplode("cells").alias("col", "value")).withColumn("col", F.col("col") + 1)
    head = part.select("file", "sheet").distinct().select("file", "sheet", F.lit(1).alias("row"), F.posexplode(F.array(*map(F.lit, ["编码", "名称", "数值", "品牌"]))).alias("col", "value")).withColumn("col", F.col("col") + 1)
    cells = head.unionByName(body)
    rows = cells.select("file", "sheet").distinct().withColumn("header_row", F.lit(1))
    return op.unique_columns(op.column_kinds(cells, rows)).select("sheet", "dimension_column", "value_column")


@query("SELECT p_partkey, p_name, p_retailprice, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_brand END AS brand FROM part")
def csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table written as text with semicolons in a Chinese encoding, read back by a guess of both; only an empty field is null."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("编号"), F.concat(F.lit("名称 "), "p_name").alias("名称"), F.col("p_retailprice").alias("价格"), F.when(F.col("p_size") % 5 != 0, F.col("p_brand")).alias("品牌"))
    path = files.scratch(spark, "csv")
    with files.encodings_allowed(spark):
        part.write.option("header", True).option("sep", ";").option("encoding", "GB18030").option("emptyValue", "").csv(path)
    rows = files.read_csv(spark, path)
    return rows.select(F.col("编号").cast("long").alias("p_partkey"), F.substring("名称", 4, 1000).alias("p_name"), F.col("价格").cast("double").alias("p_retailprice"), F.col("品牌").alias("brand"))


@query("WITH s AS (SELECT DISTINCT regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1) AS file, regexp_extract(url, '^[A-Za-z]+://[^/?#]+/?([^/?#]*)', 1) AS sheet FROM pages) SELECT file, sheet, CASE WHEN count(*) OVER (PARTITION BY sheet) > 1 THEN file || ' :: ' || sheet ELSE sheet END AS label FROM s")
def sheet_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sheet's name where it is the only one of that name, else with its file's."""
    url = F.col("url")
    rows = table(spark, sf_dir, "pages").select(F.regexp_extract(url, r"^[A-Za-z]+://([^/?#:]+)", 1).alias("file"), F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]+/?([^/?#]*)", 1).alias("sheet")).distinct()
    counts = rows.groupBy("sheet").agg((F.count(F.lit(1)) > 1).alias("shared"))
    return rows.join(counts, "sheet").select("file", "sheet", F.when(F.col("shared"), F.concat("file", F.lit(" :: "), "sheet")).otherwise(F.col("sheet")).alias("label"))


@query("SELECT source_sheet, count(*) AS n_rows, sum(v) AS total FROM (SELECT p_type AS source_sheet, l_quantity AS v FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_type <> 'PROMO') GROUP BY 1")
def dataset_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dataset saved by sheet with its description, read back after one of its sheets has been deleted."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_type").alias("source_sheet"), F.col("l_quantity").alias("v"))
    root = files.scratch(spark, "datasets")
    files.save_dataset(rows, root, "facts", ["source_sheet"], {"title": "quantities"})
    files.delete_sheet(spark, root, "facts", "source_sheet", "PROMO")
    return files.load_dataset(spark, root, "facts").groupBy("source_sheet").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("v").alias("total"))


_NAMES = ["国内批发销量 2024", "零售销量", "总批发销量", "汽车产量与库存", "期末库存", "出口销量", "销量", "nothing", "国内销量"]


@query("SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN 'domestic_wholesale' WHEN 1 THEN 'retail_sales' WHEN 2 THEN 'wholesale' WHEN 4 THEN 'inventory' WHEN 6 THEN 'sales' WHEN 8 THEN 'domestic_sales' END AS metric FROM part")
def metric_from_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one metric that a sheet's name names; a name that stands for two, or for none, gives nothing."""
    name = F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("p_partkey") % 9 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", headers.metric_named(name).alias("metric"))


@query(f"WITH {_SALES_CELLS} SELECT DISTINCT sheet, true AS metric_ok, true AS field_ok, true AS period_ok, sheet <> 'SMALL' AS value_ok, true AS dimension_ok, CASE sheet WHEN 'SMALL' THEN 'REVIEW' WHEN 'LARGE' THEN 'CORE_PASS_AUX_REVIEW' ELSE 'PASS' END AS status FROM cells")
def template_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five checks of each sheet: one holds a value that isn't a number, another values without a header."""
    cells = sales_cells(spark, sf_dir).withColumn("value", F.when(F.col("value") == "--", "-").otherwise(F.col("value")))
    extra = cells.where("sheet = 'SMALL'").select("file", "sheet").distinct().select("file", "sheet", F.lit(3).alias("row"), F.lit(3).alias("col"), F.lit("many").alias("value"))
    loose = cells.where("sheet = 'LARGE'").select("file", "sheet").distinct().select("file", "sheet", F.inline(F.array(F.struct(F.lit(2).alias("row"), F.lit(9).alias("col"), F.lit(" ").alias("value")), F.struct(F.lit(3).alias("row"), F.lit(9).alias("col"), F.lit("x").alias("value")))))
    all_cells = cells.where("not (sheet = 'SMALL' and row = 3 and col = 3)").unionByName(extra).unionByName(loose)
    return op.template_checks(all_cells, op.header_rows(all_cells)).drop("file")


@query(
    f"""WITH {_SALES_CELLS}, r AS (SELECT sheet, row, count(*) FILTER (NOT regexp_matches(value, '^[0-9]+$')) AS t, count(*) FILTER (regexp_matches(value, '^[0-9]+$')) AS n FROM cells GROUP BY ALL),
    p AS (SELECT a.sheet, a.row, a.t + coalesce(least(b.n, 3), 0) AS points FROM r a LEFT JOIN r b ON b.sheet = a.sheet AND b.row = a.row + 1 WHERE a.row <= 21)
    SELECT sheet, CAST(row AS INT) AS header_row FROM p QUALIFY row_number() OVER (PARTITION BY sheet ORDER BY points DESC, row) = 1"""
)
def region_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The header row of each sheet's table, judged by its texts and the numbers below them."""
    cells = sales_cells(spark, sf_dir)
    return op.region_headers(cells, op.column_bands(cells)).select("sheet", "header_row")
