"""Queries over the panel view: data go through the third quarter of 2001."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegrid.operators import panel as op
from tidegrid.operators.market import change
from tidegrid.plans.registry import query
from tidegrid.sources.tables import months_between, panel_facts, panel_sql, table

YEAR, QUARTER = 2001, 3
#: The tables' part types and nations in the roles of technologies and clients.
MARKET_TECH, CORE = ["PROMO", "LARGE", "SMALL"], ["PROMO", "LARGE"]
MAKER, REST = "Brand#11", ["NATION_0", "NATION_1"]
_CORE, _MARKET = "technology IN ('PROMO', 'LARGE')", "technology IN ('PROMO', 'LARGE', 'SMALL')"
_BUCKET = "CASE WHEN size < 8 THEN '<8' WHEN size < 12 THEN '8-12' WHEN size < 15 THEN '12-15' WHEN size IS NOT NULL THEN '>=15' END"
_SUMMARY = "year IN (2000, 2001) AND quarter <= 3"
_LABELS = "CASE WHEN year < 2000 THEN ['Y' || (year % 100)] WHEN year = 2000 AND quarter <= 3 THEN ['Y00F', 'Y00Q1-Q3'] WHEN year = 2000 THEN ['Y00F'] ELSE ['Y01Q' || quarter] END"


def _summary(spark: SparkSession, sf_dir: str, *dims: str) -> DataFrame:
    return op.through(panel_facts(spark, sf_dir, *dims, where=months_between("2000-01", "2001-12")), YEAR, QUARTER)


@query(
    f"""WITH {panel_sql("maker", "technology")} SELECT concat_ws('+', CASE WHEN grouping(maker) = 0 THEN 'maker' END, CASE WHEN grouping(year) = 0 THEN 'year' END, CASE WHEN grouping(technology) = 0 THEN 'technology' END) AS grain,
    maker, year, technology, sum(quantity) AS value FROM facts WHERE {_SUMMARY} AND {_CORE} GROUP BY GROUPING SETS ((maker, year), (maker, year, technology), (year, technology), (year))"""
)
def panel_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _summary(spark, sf_dir, "maker", "technology").where(F.col("technology").isin(CORE))
    return op.grains(rows, [["maker", "year"], ["maker", "year", "technology"], ["year", "technology"], ["year"]], "quantity")


_GRAINS = {
    "market": (_SUMMARY + " AND " + _MARKET, ["year"]), "maker": (_SUMMARY + " AND " + _CORE, ["maker", "year"]), "technology": (_SUMMARY + " AND " + _CORE, ["maker", "year", "technology"]),
    "market_technology": (_SUMMARY + " AND " + _MARKET, ["year", "technology"]), "clients": (_SUMMARY + " AND " + _CORE, ["maker", "year", "client"]), "applications": (_SUMMARY + " AND " + _CORE, ["maker", "year", "application"]),
    "history": (_CORE, ["maker", "year"]), "sizes": (_SUMMARY + " AND " + _CORE + " AND size IS NOT NULL", ["maker", "year", "bucket"]),
    "technology_sizes": (_SUMMARY + " AND " + _CORE + " AND size IS NOT NULL", ["maker", "year", "technology", "bucket"]), "market_technology_sizes": (_SUMMARY + " AND " + _MARKET + " AND size IS NOT NULL", ["year", "technology", "bucket"]),
}


def _grain_sql(name: str, where: str, columns: list[str]) -> str:
    label = " || ',' || ".join(f"""'"{c}":"' || {c} || '"'""" for c in columns)
    return f"SELECT '{name}' AS grain, '{{' || {label} || '}}' AS key, quantity, line FROM f WHERE {where}"


@query(
    f"""WITH f AS (SELECT p_brand AS maker, p_type AS technology, p_size AS size, n_name AS client, o_orderpriority AS application, {_BUCKET.replace("size", "p_size")} AS bucket, year(l_shipdate) AS year, quarter(l_shipdate) AS quarter, l_quantity AS quantity, l_orderkey * 10 + l_linenumber AS line
      FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
    g AS ({" UNION ALL ".join(_grain_sql(n, w, c) for n, (w, c) in _GRAINS.items())}), r AS (SELECT *, row_number() OVER (PARTITION BY grain, key ORDER BY line) AS nth FROM g)
    SELECT grain, key, sum(quantity) AS value, count(*) AS n, string_agg(CAST(line AS VARCHAR), ',' ORDER BY line) FILTER (nth <= 12) AS refs FROM r GROUP BY ALL"""
)
def panel_populations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten grains over three populations (all technologies, the core ones, all quarters) with the first twelve lines of each group."""
    facts = panel_facts(spark, sf_dir, "maker", "technology", "size", "client", "application", line=True).withColumn("bucket", op.size_bucket(F.col("size")))
    sets = {name: (F.expr(where), {c: F.col(c) for c in columns}) for name, (where, columns) in _GRAINS.items()}
    rows = op.populations(facts, sets, "quantity", "line")
    return rows.withColumn("refs", F.array_join(F.transform("refs", lambda x: x.cast("string")), ","))


@query(
    f"""WITH {panel_sql("maker", "technology")} SELECT maker, count(*) AS n_rows, sum(quantity) FILTER (year = 2001) AS current, sum(quantity) FILTER (year = 2000) AS previous,
    sum(quantity) FILTER (year = 2001) / (SELECT sum(quantity) FROM facts WHERE year = 2001 AND quarter <= 3 AND {_MARKET}) AS market_share,
    array_to_string(list_sort(list(DISTINCT technology)), ',') AS technologies FROM facts WHERE {_SUMMARY} AND {_CORE} GROUP BY maker"""
)
def maker_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Makers by core technologies against a market of all technologies in scope."""
    rows = _summary(spark, sf_dir, "maker", "technology").where(F.col("technology").isin(MARKET_TECH))
    market = rows.agg(op.year_sum("quantity", YEAR).alias("market"))
    makers = rows.where(F.col("technology").isin(CORE)).groupBy("maker").agg(F.count(F.lit(1)).alias("n_rows"), op.year_sum("quantity", YEAR).alias("current"), op.year_sum("quantity", YEAR - 1).alias("previous"), F.array_join(F.array_sort(F.collect_set("technology")), ",").alias("technologies"))
    return makers.crossJoin(market).select("maker", "n_rows", "current", "previous", op.share(F.col("current"), F.col("market")).alias("market_share"), "technologies")


@query(f"WITH {panel_sql('maker', 'technology')} SELECT maker, " + ", ".join(f"sum(quantity) FILTER (year = {y}) AS y{y}" for y in range(1996, 2002)) + f" FROM facts WHERE {_CORE} GROUP BY maker")
def maker_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = panel_facts(spark, sf_dir, "maker", "technology").where(F.col("technology").isin(CORE))
    years = list(range(1996, 2002))
    return rows.groupBy("maker").pivot("year", years).agg(F.sum("quantity")).toDF("maker", *(f"y{y}" for y in years))


@query(
    f"""WITH {panel_sql("maker", "technology", "size")}, s AS (SELECT *, {_BUCKET} AS bucket FROM facts WHERE {_SUMMARY} AND {_MARKET}),
    r AS (SELECT technology, bucket, sum(quantity) FILTER (year = 2001) AS m, sum(quantity) FILTER (year = 2000) AS mb, sum(quantity) FILTER (year = 2001 AND maker = '{MAKER}') AS k, sum(quantity) FILTER (year = 2000 AND maker = '{MAKER}') AS kb FROM s WHERE {_CORE} GROUP BY ALL
      UNION ALL SELECT technology, 'subtotal', sum(quantity) FILTER (year = 2001), sum(quantity) FILTER (year = 2000), sum(quantity) FILTER (year = 2001 AND maker = '{MAKER}'), sum(quantity) FILTER (year = 2000 AND maker = '{MAKER}') FROM s WHERE {_CORE} GROUP BY technology
      UNION ALL SELECT 'All', 'All', sum(quantity) FILTER (year = 2001), sum(quantity) FILTER (year = 2000), sum(quantity) FILTER (year = 2001 AND maker = '{MAKER}' AND {_CORE}), sum(quantity) FILTER (year = 2000 AND maker = '{MAKER}' AND {_CORE}) FROM s),
    b AS (SELECT sum(quantity) FILTER (year = 2001) AS am, sum(quantity) FILTER (year = 2001 AND maker = '{MAKER}') AS ak, sum(quantity) FILTER (year = 2000 AND maker = '{MAKER}') AS akb FROM s WHERE {_CORE}),
    t AS (SELECT technology AS tt, sum(quantity) FILTER (year = 2001) AS tm FROM s WHERE {_CORE} GROUP BY 1)
    SELECT technology, bucket, m AS market, m / nullif(mb, 0) - 1 AS market_yoy, CASE WHEN technology = 'All' THEN 1.0 ELSE m / am END AS market_share, CASE WHEN technology = 'All' THEN 1.0 ELSE m / tm END AS technology_internal_share,
      k AS maker, k / nullif(kb, 0) - 1 AS maker_yoy, k / ak AS maker_internal_share, k / CASE WHEN technology = 'All' THEN am ELSE m END AS maker_market_share, (k - kb) / nullif(ak - akb, 0) AS growth_contribution
    FROM r CROSS JOIN b LEFT JOIN t ON tt = technology"""
)
def summary_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _summary(spark, sf_dir, "maker", "technology", "size").where(F.col("technology").isin(MARKET_TECH))
    return op.summary_matrix(rows, YEAR, CORE, MAKER)


@query(
    f"""WITH {panel_sql("technology", "size")}, s AS (SELECT technology, {_BUCKET} AS bucket, sum(quantity) AS value FROM facts WHERE year = 2001 AND quarter <= 3 AND {_MARKET} GROUP BY ALL)
    SELECT technology, bucket, value, value / sum(value) OVER () AS of_all, value / sum(value) OVER (PARTITION BY technology) AS of_technology, value / sum(value) OVER (PARTITION BY bucket) AS of_size,
      value / (SELECT sum(value) FROM s WHERE {_CORE}) AS of_core FROM s"""
)
def technology_size_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One value, four denominators."""
    rows = _summary(spark, sf_dir, "technology", "size").where((F.col("year") == YEAR) & F.col("technology").isin(MARKET_TECH))
    cells = rows.groupBy("technology", op.size_bucket(F.col("size")).alias("bucket")).agg(F.sum("quantity").alias("value"))  # twelve rows
    of = lambda *by: op.share(F.col("value"), F.sum("value").over(Window.partitionBy(*by)))
    core = F.sum(F.when(F.col("technology").isin(CORE), F.col("value"))).over(Window.partitionBy())
    return cells.select("technology", "bucket", "value", of().alias("of_all"), of("technology").alias("of_technology"), of("bucket").alias("of_size"), op.share(F.col("value"), core).alias("of_core"))


@query(
    f"""WITH {panel_sql("maker")}, r AS (SELECT maker, sum(quantity) FILTER (year = 2001) AS current, sum(quantity) FILTER (year = 2000) AS previous FROM facts WHERE {_SUMMARY} GROUP BY 1)
    SELECT maker, current, previous, current / nullif(previous, 0) - 1 AS yoy, (current - previous) / nullif(sum(coalesce(current, 0) - coalesce(previous, 0)) OVER (), 0) AS contribution FROM r"""
)
def growth_contribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.growth_contribution(_summary(spark, sf_dir, "maker"), "maker", "quantity", YEAR)


@query(f"WITH {panel_sql('technology')}, l AS (SELECT *, unnest({_LABELS}) AS period FROM facts) SELECT period, technology, sum(quantity) AS quantity, CAST(sum(display_area) AS DOUBLE) AS display_area FROM l GROUP BY ALL")
def period_label_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums by period label, 2000 as the current year; a row may count for two labels."""
    rows = op.with_labels(panel_facts(spark, sf_dir, "technology"), 2000)
    return rows.groupBy("period", "technology").agg(F.sum("quantity").alias("quantity"), F.sum("display_area").cast("double").alias("display_area"))


@query(
    f"""WITH {panel_sql("client")}, r AS (SELECT client, sum(quantity) FILTER (year = 2001) AS current, sum(quantity) FILTER (year = 2000) AS previous FROM facts WHERE {_SUMMARY} GROUP BY 1),
    s AS (SELECT *, current / sum(current) OVER () AS a, previous / sum(previous) OVER () AS b, sum(current) OVER () AS sum_now, sum(previous) OVER () AS sum_then FROM r)
    SELECT CAST(row_number() OVER (ORDER BY current DESC, client) AS INT) AS rank, client, current, previous, a AS share, current / nullif(previous, 0) - 1 AS yoy, (a - b) * 100 AS share_points, (current - coalesce(previous, 0)) / nullif(sum_now - sum_then, 0) AS contribution FROM s
    WHERE client NOT IN ('NATION_0', 'NATION_1') AND current IS NOT NULL QUALIFY row_number() OVER (ORDER BY current DESC, client) <= 6"""
)
def top6_clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six largest clients; rest groups don't rank but count in the denominator."""
    return op.top_with_rest(_summary(spark, sf_dir, "client"), "client", "quantity", YEAR, 6, REST)


_REGIONS = {"ATLANTIC": ["NATION_0", "NATION_1", "NATION_2", "NATION_3"], "PACIFIC": ["NATION_3", "NATION_10", "NATION_11"], "INLAND": ["NATION_20"]}


@query(
    f"""WITH {panel_sql("client", "technology")}, m AS (SELECT *, CASE WHEN client IN ('NATION_0', 'NATION_1', 'NATION_2', 'NATION_3') THEN 'ATLANTIC' WHEN client IN ('NATION_10', 'NATION_11') THEN 'PACIFIC' WHEN client = 'NATION_20' THEN 'INLAND' ELSE '其他' END AS region FROM facts)
    SELECT region, sum(quantity) FILTER (year = 2000) AS full_2000, sum(quantity) FILTER (year = 2001 AND quarter <= 3) AS q1_q3_2001, sum(quantity) FILTER (year = 2000 AND quarter <= 3) AS q1_q3_2000,
      sum(quantity) FILTER (year = 2001 AND quarter <= 3 AND technology = 'PROMO') AS promo, sum(quantity) FILTER (year = 2001 AND quarter <= 3 AND technology = 'LARGE') AS large FROM m GROUP BY 1"""
)
def region_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clients by the first region whose list names them, others together."""
    first: dict[str, str] = {}
    for region, clients in _REGIONS.items():
        for c in clients:
            first.setdefault(c, region)
    mapping = F.create_map(*(F.lit(x) for pair in first.items() for x in pair))
    facts = panel_facts(spark, sf_dir, "client", "technology").withColumn("region", F.coalesce(F.try_element_at(mapping, F.col("client")), F.lit("其他")))
    early, tech = F.col("quarter") <= 3, lambda t: (F.col("quarter") <= 3) & (F.col("technology") == t)
    return facts.groupBy("region").agg(
        op.year_sum("quantity", 2000).alias("full_2000"), op.year_sum("quantity", 2001, early).alias("q1_q3_2001"), op.year_sum("quantity", 2000, early).alias("q1_q3_2000"),
        op.year_sum("quantity", 2001, tech("PROMO")).alias("promo"), op.year_sum("quantity", 2001, tech("LARGE")).alias("large"),
    )


@query(
    f"""WITH {panel_sql("application", "size")}, r AS (SELECT application, size, sum(quantity) AS value FROM facts GROUP BY ALL), t AS (SELECT sum(value) / count(*) * 1.2 AS x FROM r)
    SELECT application, size, value FROM r, t QUALIFY value > x OR row_number() OVER (PARTITION BY application ORDER BY value DESC, size) = 1"""
)
def key_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes 20 % above the mean, and each application's largest."""
    sums = panel_facts(spark, sf_dir, "application", "size").groupBy("application", "size").agg(F.sum("quantity").alias("value"))
    return op.key_sizes(sums, F.avg("value").over(Window.partitionBy()) * 1.2)  # over the few sums


@query(f"WITH {panel_sql('size', 'technology')} SELECT size, sum(quantity) FILTER (technology = 'PROMO') AS promo, sum(quantity) FILTER (technology = 'LARGE') AS large, sum(quantity) FILTER (technology = 'SMALL') AS small FROM facts WHERE year = 2001 AND quarter <= 3 AND {_MARKET} GROUP BY size")
def size_distribution_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _summary(spark, sf_dir, "size", "technology").where((F.col("year") == YEAR) & F.col("technology").isin(MARKET_TECH))
    return rows.groupBy("size").pivot("technology", MARKET_TECH).agg(F.sum("quantity")).toDF("size", "promo", "large", "small")



@query(
    f"""WITH {panel_sql("technology")}, l AS (SELECT technology, year, quarter, sum(quantity) AS v FROM facts WHERE {_MARKET} GROUP BY ALL),
    p AS (SELECT technology, year, CASE WHEN year = 2001 THEN 'Y01Q1-Q3' ELSE 'Y' || lpad(CAST(year % 100 AS VARCHAR), 2, '0') END AS period, sum(v) FILTER (year < 2001 OR quarter <= 3) AS value FROM l GROUP BY ALL),
    q AS (SELECT technology, year, sum(v) FILTER (quarter <= 3) AS v3, sum(v) AS v4 FROM l GROUP BY ALL)
    SELECT p.technology, p.period, p.value, p.value / nullif(CASE WHEN p.year = 2001 THEN q.v3 ELSE q.v4 END, 0) - 1 AS yoy FROM p LEFT JOIN q ON q.technology = p.technology AND q.year = p.year - 1"""
)
def technology_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years, and the current one's first three quarters against the same quarters a year before."""
    cells = panel_facts(spark, sf_dir, "technology").where(F.col("technology").isin(MARKET_TECH)).groupBy("technology", "year").agg(
        F.sum("quantity").alias("v4"), F.sum(F.when(F.col("quarter") <= 3, F.col("quantity"))).alias("v3")
    )
    before = cells.select("technology", (F.col("year") + 1).alias("year"), F.col("v4").alias("b4"), F.col("v3").alias("b3"))
    open_ = F.col("year") == YEAR
    value, previous = F.when(open_, F.col("v3")).otherwise(F.col("v4")), F.when(open_, F.col("b3")).otherwise(F.col("b4"))
    period = F.when(open_, F.lit("Y01Q1-Q3")).otherwise(F.concat(F.lit("Y"), F.lpad((F.col("year") % 100).cast("string"), 2, "0")))
    return cells.join(before, ["technology", "year"], "left").select("technology", period.alias("period"), value.alias("value"), change(value, previous).alias("yoy"))


@query(f"WITH {panel_sql('application')}, l AS (SELECT *, unnest({_LABELS}) AS period FROM facts), a AS (SELECT application, period, sum(quantity) AS quantity, CAST(sum(display_area) AS DOUBLE) AS display_area FROM l GROUP BY ALL) SELECT *, quantity / sum(quantity) OVER (PARTITION BY period) AS share FROM a")
def application_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = op.with_labels(panel_facts(spark, sf_dir, "application"), 2000).groupBy("application", "period").agg(F.sum("quantity").alias("quantity"), F.sum("display_area").cast("double").alias("display_area"))
    return rows.withColumn("share", op.share(F.col("quantity"), F.sum("quantity").over(Window.partitionBy("period"))))


@query(
    f"""WITH {panel_sql("maker", "technology")} SELECT year, sum(quantity) FILTER (maker = '{MAKER}' AND {_CORE}) AS maker, sum(quantity) AS market, sum(quantity) FILTER (maker = '{MAKER}' AND {_CORE}) / sum(quantity) AS share,
    sum(quantity) FILTER (maker = '{MAKER}' AND {_CORE} AND quarter <= 3) / sum(quantity) FILTER (maker = '{MAKER}' AND {_CORE}) AS completion FROM facts GROUP BY year"""
)
def share_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A maker's core technologies over a market of all technologies, and how much of a year its first quarters are."""
    own = (F.col("maker") == MAKER) & F.col("technology").isin(CORE)
    rows = panel_facts(spark, sf_dir, "maker", "technology").groupBy("year").agg(F.sum(F.when(own, F.col("quantity"))).alias("maker"), F.sum("quantity").alias("market"), F.sum(F.when(own & (F.col("quarter") <= 3), F.col("quantity"))).alias("early"))
    return rows.select("year", "maker", "market", op.share(F.col("maker"), F.col("market")).alias("share"), op.share(F.col("early"), F.col("maker")).alias("completion"))


@query(f"WITH {panel_sql()} SELECT year, quarter, count(*) AS n_records FROM facts GROUP BY ALL")
def period_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel_facts(spark, sf_dir).groupBy("year", "quarter").agg(F.count(F.lit(1)).alias("n_records"))


@query(
    f"""WITH {panel_sql("maker")}, r AS (SELECT maker, sum(quantity) FILTER (year = 2001) AS current, sum(quantity) FILTER (year = 2000) AS previous FROM facts WHERE {_SUMMARY} GROUP BY 1)
    SELECT maker, current, previous, current / nullif(previous, 0) - 1 AS yoy FROM r ORDER BY current DESC, maker LIMIT 10"""
)
def top10_makers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _summary(spark, sf_dir, "maker").groupBy("maker").agg(op.year_sum("quantity", YEAR).alias("current"), op.year_sum("quantity", YEAR - 1).alias("previous"))
    return rows.withColumn("yoy", change(F.col("current"), F.col("previous"))).orderBy(F.desc("current"), "maker").limit(10)


@query(
    """WITH f AS (SELECT CAST(year(l_shipdate) AS INT) AS year, CAST(quarter(l_shipdate) AS INT) AS quarter, l_orderkey, l_linenumber, l_quantity FROM lineitem),
    files AS (SELECT 1 AS file, * FROM f WHERE year < 2000 UNION ALL SELECT 2, year, quarter, l_orderkey, l_linenumber, l_quantity + 1 FROM f WHERE year >= 1999 AND l_linenumber = 1),
    n AS (SELECT year AS y, quarter AS q, max(file) AS newest FROM files GROUP BY ALL)
    SELECT year, quarter, file, count(*) AS n_rows, sum(l_quantity) AS quantity FROM files JOIN n ON year = y AND quarter = q AND file = newest GROUP BY ALL"""
)
def overlay_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A newer file replaces the quarters that it holds as a whole, even by fewer rows."""
    f = table(spark, sf_dir, "lineitem").select(F.year("l_shipdate").alias("year"), F.quarter("l_shipdate").alias("quarter"), "l_linenumber", "l_quantity")
    old = f.where("year < 2000").select("year", "quarter", "l_quantity", F.lit(1).alias("file"))
    new = f.where("year >= 1999 and l_linenumber = 1").select("year", "quarter", (F.col("l_quantity") + 1).alias("l_quantity"), F.lit(2).alias("file"))
    merged = op.overlay(old.unionByName(new), "file", "year", "quarter")
    return merged.groupBy("year", "quarter", "file").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("l_quantity").alias("quantity"))


@query(
    f"""WITH {panel_sql("maker", "technology")}, r AS (SELECT maker, technology AS label, sum(quantity) FILTER (year = 2001) AS quantity, sum(quantity) FILTER (year = 2000) AS before FROM facts WHERE {_SUMMARY} GROUP BY ALL),
    s AS (SELECT maker, label, quantity, quantity / nullif(before, 0) - 1 AS yoy, (quantity - before) / nullif(sum(quantity) OVER (PARTITION BY maker) - sum(before) OVER (PARTITION BY maker), 0) AS contribution FROM r),
    k AS (SELECT * FROM s WHERE yoy IS NOT NULL AND contribution IS NOT NULL), u AS (SELECT *, row_number() OVER (PARTITION BY maker ORDER BY contribution DESC, label) AS n FROM k WHERE contribution > 0),
    d AS (SELECT *, row_number() OVER (PARTITION BY maker ORDER BY contribution, label) AS n FROM k WHERE contribution < 0), b AS (SELECT *, row_number() OVER (PARTITION BY maker ORDER BY quantity DESC, label) AS n FROM k)
    SELECT a.maker, a.maker || ' 01年前三季度增长主要于' || a.label || '产品增长所驱动，同比' || printf('%+.0f', round_even(a.yoy * 100, 0)) || '%，增长贡献' || printf('%.0f', round_even(a.contribution * 100, 0)) || '%'
      || coalesce('；其次是' || c.label || '产品，同比' || printf('%+.0f', round_even(c.yoy * 100, 0)) || '%，增长贡献' || printf('%.0f', round_even(c.contribution * 100, 0)) || '%', '')
      || coalesce('；' || d.label || '产品表现不佳，同比' || printf('%+.0f', round_even(d.yoy * 100, 0)) || '%，贡献' || printf('%+.0f', round_even(d.contribution * 100, 0)) || '%，拖累整体增速', '')
      || '。从产品结构看，' || a.maker || '前三季度' || b.label || '作为基本盘稳固地位，' || a.label || '发力作为核心引擎提拉增长。' AS text
    FROM u a LEFT JOIN u c ON c.maker = a.maker AND c.n = 2 LEFT JOIN d ON d.maker = a.maker AND d.n = 1 JOIN b ON b.maker = a.maker AND b.n = 1 WHERE a.n = 1"""
)
def product_narratives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What drove each maker's growth, in words."""
    rows = _summary(spark, sf_dir, "maker", "technology").groupBy("maker", F.col("technology").alias("label")).agg(op.year_sum("quantity", YEAR).alias("quantity"), op.year_sum("quantity", YEAR - 1).alias("before"))
    whole = rows.groupBy("maker").agg((F.sum("quantity") - F.sum("before")).alias("grown"))
    rows = rows.join(whole, "maker").withColumns({"yoy": change(F.col("quantity"), F.col("before")), "contribution": op.share(F.col("quantity") - F.col("before"), F.col("grown"))})
    return op.product_narratives(rows, "01年前三季度", "前三季度")
