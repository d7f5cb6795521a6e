"""The tables and the two fact views that most queries start from.

A view joins only the tables that its wanted dimensions live in, and a window of months becomes a range of
l_shipdate, which the Parquet reader prunes by. Dimension tables are joined by size: Spark broadcasts those
under its threshold and shuffles the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Dimension of the market view: its column and the tables on the way to it.
MARKET_DIMS = {
    "region": ("r_name", ("orders", "customer", "nation", "region")),
    "market": ("c_mktsegment", ("orders", "customer")),
    "oem": ("s_name", ("supplier",)),
    "brand": ("p_brand", ("part",)),
    "model": ("p_name", ("part",)),
    "power_type": ("p_type", ("part",)),
    "size_class": ("p_size", ("part",)),
}
#: The same for the panel view.
PANEL_DIMS = {
    "maker": ("p_brand", ("part",)),
    "technology": ("p_type", ("part",)),
    "size": ("p_size", ("part",)),
    "client": ("n_name", ("orders", "customer", "nation")),
    "application": ("o_orderpriority", ("orders",)),
}
_JOINS = {
    "orders": ("l_orderkey", "o_orderkey"),
    "customer": ("o_custkey", "c_custkey"),
    "nation": ("c_nationkey", "n_nationkey"),
    "region": ("n_regionkey", "r_regionkey"),
    "part": ("l_partkey", "p_partkey"),
    "supplier": ("l_suppkey", "s_suppkey"),
}


def _joined(spark: SparkSession, sf_dir: str, dims: dict, wanted: tuple[str, ...], where: Column | None) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    if where is not None:
        rows = rows.where(where)
    for name in dict.fromkeys(t for d in wanted for t in dims[d][1]):
        left, right = _JOINS[name]
        rows = rows.join(table(spark, sf_dir, name), F.col(left) == F.col(right))
    return rows


def _joins_sql(dims: dict, wanted: tuple[str, ...]) -> str:
    names = dict.fromkeys(t for d in wanted for t in dims[d][1])
    return "lineitem" + "".join(f" JOIN {t} ON {_JOINS[t][0]} = {_JOINS[t][1]}" for t in names)


def months_between(first: str, last: str) -> Column:
    """l_shipdate from the first day of ``first`` to before the month after ``last`` (YYYY-MM), as a pushable range."""
    return (F.col("l_shipdate") >= F.lit(f"{first}-01").cast("timestamp")) & (
        F.col("l_shipdate") < F.add_months(F.lit(f"{last}-01").cast("date"), 1).cast("timestamp")
    )


def market_facts(spark: SparkSession, sf_dir: str, *dims: str, where: Column | None = None) -> DataFrame:
    """time_period, the wanted dimensions, wholesale, export and retail_sales; export and retail are null where
    the row is of neither kind. ``line`` orders the rows: earlier lines of an order come first."""
    quantity, flag = F.col("l_quantity"), F.col("l_returnflag")
    return _joined(spark, sf_dir, MARKET_DIMS, dims, where).select(
        F.date_format("l_shipdate", "yyyy-MM").alias("time_period"),
        *(F.col(MARKET_DIMS[d][0]).alias(d) for d in dims),
        quantity.alias("wholesale"),
        F.when(flag == "R", quantity).alias("export"),
        F.when(flag == "A", quantity).alias("retail_sales"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"),
    )


def market_sql(*dims: str) -> str:
    """The market view as a DuckDB common table expression named facts."""
    columns = "".join(f", {MARKET_DIMS[d][0]} AS {d}" for d in dims)
    return (
        f"facts AS (SELECT strftime(l_shipdate, '%Y-%m') AS time_period{columns}, l_quantity AS wholesale, "
        "CASE WHEN l_returnflag = 'R' THEN l_quantity END AS export, CASE WHEN l_returnflag = 'A' THEN l_quantity END AS retail_sales, "
        f"l_orderkey * 10 + l_linenumber AS line FROM {_joins_sql(MARKET_DIMS, dims)})"
    )


def panel_facts(spark: SparkSession, sf_dir: str, *dims: str, where: Column | None = None, line: bool = False) -> DataFrame:
    """year, quarter (1 to 4), the wanted dimensions, quantity and display_area (exact decimals); ``line`` numbers the rows."""
    lines = [(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line")] if line else []
    return _joined(spark, sf_dir, PANEL_DIMS, dims, where).select(
        F.year("l_shipdate").alias("year"),
        F.quarter("l_shipdate").alias("quarter"),
        *(F.col(PANEL_DIMS[d][0]).alias(d) for d in dims),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("display_area"),
        *lines,
    )


def panel_sql(*dims: str) -> str:
    columns = "".join(f", {PANEL_DIMS[d][0]} AS {d}" for d in dims)
    return (
        f"facts AS (SELECT CAST(year(l_shipdate) AS INT) AS year, CAST(quarter(l_shipdate) AS INT) AS quarter{columns}, l_quantity AS quantity, "
        f"CAST(l_extendedprice AS DECIMAL(18,2)) AS display_area FROM {_joins_sql(PANEL_DIMS, dims)})"
    )


def unregistered(spark: SparkSession, known: DataFrame, database: str | None = None) -> DataFrame:
    """table and kind of the catalog's tables and views that ``known`` (a column ``table``; letters' case doesn't count) doesn't list."""
    there = [(t.name, t.tableType) for t in spark.catalog.listTables(database)]
    found = spark.createDataFrame(there, "table string, kind string")
    return found.join(known.select(F.lower("table").alias("_known")), F.lower("table") == F.col("_known"), "left_anti")
