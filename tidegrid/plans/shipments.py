"""Queries over shipment records as texts, period labels and file names, made from lineitem, part and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegrid.functions import shipments as fn
from tidegrid.plans.registry import query
from tidegrid.sources.tables import table

_TECH = {"PROMO": "LTPS TFT LCD", "LARGE": "a_si TFT", "ECONOMY": "Oxide TFT", "STANDARD": "aSi", "MEDIUM": "AMOLED", "SMALL": "LTPO / LTPS"}
_APP = ["Instrument Cluster", "center stack display", "Automobile Monitor (Others)", "Control Panel", "Something else"]


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as their sheets have them: years 27 later, all of it text."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    pick = lambda values, by: F.element_at(F.array(*map(F.lit, values)), (by % len(values) + 1).cast("int"))
    year, quarter = F.year("l_shipdate") + 27, F.quarter("l_shipdate").cast("string")
    return rows.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"),
        F.when(F.col("l_orderkey") % 3 == 0, F.concat(year.cast("string"), F.lit(".0"))).otherwise(year.cast("string")).alias("year"),
        F.when(F.col("l_orderkey") % 4 == 0, F.concat(F.lit("Quarter "), quarter)).when(F.col("l_orderkey") % 4 == 1, F.concat(quarter, F.lit("q"))).when(F.col("l_orderkey") % 4 == 2, quarter).otherwise(F.lit("H1")).alias("quarter"),
        pick(["China Star", " csot", "Other Maker", ""], F.col("p_partkey")).alias("maker"),
        F.coalesce(*(F.when(F.col("p_type") == k, v) for k, v in _TECH.items())).alias("technology"),
        pick(["Automobile Monitor ", "automobile monitor", "Notebook"], F.col("p_partkey")).alias("specification"),
        pick(_APP, F.col("p_partkey")).alias("application"), F.col("p_size").cast("string").alias("size"),
        F.when(F.col("l_orderkey") % 5 == 0, "n/a").otherwise(F.format_string("1,%03d.5", F.col("l_quantity").cast("int"))).alias("quantity"), F.col("l_extendedprice").cast("decimal(18,2)").cast("string").alias("display_area"),
    )


_TYPED_SQL = """r AS (SELECT l_orderkey * 10 + l_linenumber AS line, CAST(year(l_shipdate) + 27 AS INT) AS year, CASE WHEN l_orderkey % 4 <> 3 THEN CAST(quarter(l_shipdate) AS INT) END AS quarter,
 CASE p_partkey % 4 WHEN 0 THEN 'CSOT' WHEN 1 THEN 'CSOT' WHEN 2 THEN 'Other Maker' END AS maker, CASE p_type WHEN 'PROMO' THEN 'LTPS' WHEN 'LARGE' THEN 'a-Si' WHEN 'ECONOMY' THEN 'Oxide' WHEN 'STANDARD' THEN 'a-Si' WHEN 'SMALL' THEN 'LTPS' ELSE '' END AS technology,
 p_partkey % 3 < 2 AND p_partkey % 5 <> 2 AS spec, p_partkey % 5 AS app, CASE WHEN l_orderkey % 5 <> 0 THEN CAST(1000.5 + CAST(l_quantity AS INT) AS DECIMAL(38,6)) END AS quantity FROM lineitem JOIN part ON p_partkey = l_partkey)"""


@query(
    f"""WITH {_TYPED_SQL}, b AS (SELECT * FROM r WHERE year BETWEEN 2022 AND 2035 AND quarter IS NOT NULL AND spec)
    SELECT 'market' AS population, year, technology, count(*) AS n, sum(quantity)::DOUBLE AS quantity FROM b WHERE maker IS NOT NULL AND quantity IS NOT NULL AND technology IN ('LTPS', 'a-Si', 'Oxide') GROUP BY ALL
    UNION ALL SELECT 'history', year, technology, count(*), sum(quantity)::DOUBLE FROM b GROUP BY ALL UNION ALL SELECT 'product', year, technology, count(*), sum(quantity)::DOUBLE FROM b WHERE quantity IS NOT NULL AND technology IN ('LTPS', 'a-Si') GROUP BY ALL
    UNION ALL SELECT 'application', year, technology, count(*), sum(quantity)::DOUBLE FROM b WHERE quantity IS NOT NULL AND app IN (0, 1, 3) AND technology <> 'Oxide' GROUP BY ALL"""
)
def normalised_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of four reports by year and technology: each report has its own rule for what counts. One scan."""
    records = _records(spark, sf_dir)
    typed = records.select(*(c.alias(n) for n, c in fn.fact({c: F.col(c) for c in records.columns}).items()), "specification", F.col("technology").alias("technology_text"))
    kinds = F.filter(F.array(*(F.when(fn.counts(p, F.col("specification"), F.col("technology_text")), F.lit(p)) for p in ("market", "history", "product", "application"))), lambda p: p.isNotNull())
    return typed.withColumn("population", F.explode(kinds)).groupBy("population", "year", "technology").agg(F.count(F.lit(1)).alias("n"), F.sum("quantity").cast("double").alias("quantity"))


@query(
    f"""WITH {_TYPED_SQL}, b AS (SELECT * FROM r WHERE quarter IS NOT NULL AND spec AND year >= 2022), u AS (SELECT 'baseline' AS part, year, quantity FROM b WHERE year = 2022 UNION ALL SELECT 'current', year, quantity FROM b WHERE year <> 2022)
    SELECT part, year, count(*) AS n, sum(quantity)::DOUBLE AS quantity FROM u GROUP BY ALL"""
)
def baseline_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two files of the same records: the baseline's count for 2022 only, the current one's for all other years."""
    records = _records(spark, sf_dir)
    typed = lambda part: records.select(F.lit(part).alias("part"), *(c.alias(n) for n, c in fn.fact({c: F.col(c) for c in records.columns}).items()), "specification", F.col("technology").alias("technology_text")).where(fn.counts("history", F.col("specification"), F.col("technology_text")))
    rows = typed("current").where("year <> 2022").unionByName(typed("baseline").where("year = 2022"))
    return rows.groupBy("part", "year").agg(F.count(F.lit(1)).alias("n"), F.sum("quantity").cast("double").alias("quantity"))


@query(
    """SELECT p_partkey, replace(p_name, ' ', '_') || '_' || lower(p_brand[1:5]) || '#' || p_brand[7:] AS slug, replace(p_name, ' ', '_') || '___' || lower(p_brand[1:5]) || '_' || p_brand[7:] AS slug_each,
    CAST(round_even(CAST(p_size AS DECIMAL(18,9)) / 2000000, 6) AS DOUBLE) AS rounded FROM part"""
)
def names_and_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two ways to make an id of a name, and six decimals half to even."""
    label = F.concat("p_name", F.lit(" / "), "p_brand")
    return table(spark, sf_dir, "part").select("p_partkey", fn.slug(label).alias("slug"), fn.slug_each(label).alias("slug_each"), fn.rounded(F.col("p_size").cast("decimal(18,9)") / 2000000).cast("double").alias("rounded"))


@query(
    """WITH q AS (SELECT o_orderkey, o_orderkey % 5 AS k, CAST(year(o_orderdate) - 1980 AS INT) * 4 + CAST(quarter(o_orderdate) AS INT) - 1 AS n FROM orders),
    r AS (SELECT o_orderkey, CASE k WHEN 0 THEN n WHEN 1 THEN n WHEN 2 THEN n + 2 WHEN 3 THEN n + 1 END AS publication, CASE k WHEN 0 THEN n - 1 WHEN 1 THEN n - 1 WHEN 2 THEN n WHEN 3 THEN n END AS data_through FROM q)
    SELECT o_orderkey, (publication % 4 + 1) || 'Q' || lpad(CAST(publication // 4 AS VARCHAR), 2, '0') AS publication, (data_through % 4 + 1) || 'Q' || lpad(CAST(data_through // 4 AS VARCHAR), 2, '0') AS data_through FROM r"""
)
def publication_quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When a file came out and up to which quarter it has results, from its name alone."""
    at = (F.year("o_orderdate") - 1980) * 4 + F.quarter("o_orderdate") - 1
    label, later = fn.quarter_label(at), fn.quarter_label(at + 2)
    kind = F.col("o_orderkey") % 5
    swapped = F.concat(F.lpad(F.floor(at / 4).cast("string"), 2, "0"), F.lit(" "), (at % 4 + 1).cast("string"), F.lit("Q"))
    name = (
        F.when(kind == 0, F.concat(F.lit("Tracker "), label, F.lit(" final.xlsx"))).when(kind == 1, F.concat(F.lit("Tracker_"), F.lit(" "), swapped, F.lit(".xlsx")))
        .when(kind == 2, F.concat(F.lit("Tracker "), later, F.lit(" with "), label, F.lit(" Results"))).when(kind == 3, F.concat(F.lit("History with "), label, F.lit(" results.xlsx"))).otherwise(F.lit("Tracker.xlsx"))
    )
    found = fn.publication(name)
    return table(spark, sf_dir, "orders").select("o_orderkey", fn.quarter_label(found["publication"]).alias("publication"), fn.quarter_label(found["data_through"]).alias("data_through"))


@query(
    """WITH l AS (SELECT DISTINCT CAST(year(l_shipdate) - 1980 AS INT) AS y, CAST(quarter(l_shipdate) AS INT) AS q FROM lineitem), p AS (SELECT DISTINCT 'Y' || y AS label, y, 0 AS place, NULL AS peer, y <= 20 AS kept FROM l UNION SELECT 'Y' || y || 'F', y, 41, NULL, y <= 20 FROM l UNION SELECT 'Y' || y || 'Q1-Q3', y, 30, NULL, y <= 20 FROM l
    UNION SELECT 'Y' || y || 'Q' || q, y, q * 10 + 2, 'Y' || (y - 1) || 'Q' || q, y * 4 + q <= 20 * 4 + 2 FROM l)
    SELECT label, CAST(row_number() OVER (ORDER BY y, place) AS INT) AS place, peer, kept FROM p"""
)
def period_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All labels of the data's quarters in their order, each quarter's peer, and which lie within results up to the second quarter of 2020."""
    quarters = table(spark, sf_dir, "lineitem").select((F.year("l_shipdate") - 1980).alias("y"), F.quarter("l_shipdate").alias("q")).distinct()
    year = F.concat(F.lit("Y"), F.col("y").cast("string"))
    labels = quarters.select(F.explode(F.array(year, F.concat(year, F.lit("F")), F.concat(year, F.lit("Q1-Q3")), F.concat(year, F.lit("Q"), F.col("q").cast("string")))).alias("label")).distinct()
    place = F.row_number().over(Window.orderBy(fn.period_order(F.col("label"))))  # a few labels a year
    return labels.select("label", place.alias("place"), fn.year_peer(F.col("label")).alias("peer"), fn.within(F.col("label"), 2020, 2).alias("kept"))


@query(
    """WITH n AS (SELECT DISTINCT p_brand AS maker, replace(p_name, ' ', '_') AS slug FROM part), t AS (SELECT maker, CASE WHEN length(slug) % 3 = 0 THEN slug[1:2] || slug[2:2] || slug[3:] ELSE slug || 'x' END AS typo FROM n),
    o AS (SELECT s, array_to_string(list_filter(string_split(s, ''), lambda x, i: i = 1 OR x <> s[i - 1:i - 1]), '') AS single FROM (SELECT slug AS s FROM n UNION SELECT typo FROM t)),
    h AS (SELECT t.maker, t.typo, n.slug FROM t JOIN n ON n.maker = t.maker JOIN o a ON a.s = t.typo JOIN o b ON b.s = n.slug WHERE n.slug = a.single OR a.single = b.single OR levenshtein(n.slug, t.typo) <= 2)
    SELECT t.maker, t.typo, CASE WHEN count(DISTINCT h.slug) = 1 THEN min(h.slug) END AS resolved FROM t LEFT JOIN h ON h.maker = t.maker AND h.typo = t.typo GROUP BY ALL"""
)
def repaired_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mistyped ids of a maker's products by the one id that they can stand for; null where several could be meant.

    Ids meet within their maker only, so no more pairs are made than products of one maker."""
    ids = table(spark, sf_dir, "part").select(F.col("p_brand").alias("maker"), fn.slug(F.col("p_name")).alias("slug")).distinct()
    s = F.col("slug")
    typed = ids.select("maker", F.when(F.length(s) % 3 == 0, F.concat(F.substring(s, 1, 2), F.substring(s, 2, 1), F.substr(s, F.lit(3)))).otherwise(F.concat(s, F.lit("x"))).alias("typo"))
    once = lambda c: F.regexp_replace(c, r"(.)\1+", "$1")
    near = (F.col("slug") == once(F.col("typo"))) | (once(F.col("slug")) == once(F.col("typo"))) | (F.levenshtein("slug", "typo", 2) >= 0)
    hits = typed.join(ids, "maker", "left").where(near).groupBy("maker", "typo").agg(F.countDistinct("slug").alias("n"), F.min("slug").alias("slug"))
    return typed.join(hits, ["maker", "typo"], "left").select("maker", "typo", F.when(F.col("n") == 1, F.col("slug")).alias("resolved"))


_ORDERED = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query(
    """WITH r AS (SELECT o_orderpriority AS application, p_size AS size, sum(l_quantity) AS value FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey GROUP BY ALL)
    SELECT application, size, value, CAST(row_number() OVER (ORDER BY CASE application WHEN '5-LOW' THEN 0 WHEN '3-MEDIUM' THEN 1 WHEN '1-URGENT' THEN 2 ELSE 3 END, application, value DESC, size) AS INT) AS place FROM r"""
)
def report_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a report in the order of its applications, then by value, then by size."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    sums = rows.groupBy(F.col("o_orderpriority").alias("application"), F.col("p_size").alias("size")).agg(F.sum("l_quantity").alias("value"))
    wanted = ["5-LOW", "3-MEDIUM", "1-URGENT"]
    first = F.array_position(F.array(*map(F.lit, wanted)), F.col("application"))
    rank = F.when(first > 0, first).otherwise(len(wanted) + 1)
    return sums.withColumn("place", F.row_number().over(Window.orderBy(rank, "application", F.desc("value"), "size")))  # a row an application and size
