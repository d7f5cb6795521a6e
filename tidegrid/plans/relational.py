"""Relational patterns over orders, customers, nations and regions; nations play departments and regions their parents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegrid.operators import merge as op
from tidegrid.plans.registry import query
from tidegrid.sources.tables import table
from tidegrid.streaming import events as stream


@query("SELECT c_custkey, o_orderkey AS current_order, o_orderstatus AS status FROM customer JOIN orders ON o_custkey = c_custkey QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_version_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer with its newest order, as one aggregate before the join."""
    newest = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by(F.struct("o_orderkey", "o_orderstatus"), F.struct("o_orderdate", "o_orderkey")).alias("o"))
    return table(spark, sf_dir, "customer").join(newest, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", F.col("o.o_orderkey").alias("current_order"), F.col("o.o_orderstatus").alias("status"))


@query("SELECT n_name, r_name, c_mktsegment, count(*) AS n_open FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_orderstatus = 'O' AND c_acctbal > 0 GROUP BY ALL")
def current_rows_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open orders of customers in credit with the two dimensions above them."""
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select("o_custkey")
    customers = table(spark, sf_dir, "customer").where("c_acctbal > 0").select("c_custkey", "c_nationkey", "c_mktsegment")
    rows = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy("n_name", "r_name", "c_mktsegment").agg(F.count(F.lit(1)).alias("n_open"))


@query("SELECT c_custkey, coalesce(n, 0) AS n_orders, coalesce(v, 0) AS n_events, o_custkey IS NOT NULL AS has_orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey LEFT JOIN (SELECT user_id, count(*) AS v FROM events GROUP BY 1) ON user_id = c_custkey")
def preagg_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with two counts that are aggregated before they are joined, and a presence flag."""
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    events = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("c_custkey")).agg(F.count(F.lit(1)).alias("v"))
    rows = table(spark, sf_dir, "customer").select("c_custkey").join(orders, "c_custkey", "left").join(events, "c_custkey", "left")
    return rows.select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"), F.coalesce("v", F.lit(0)).alias("n_events"), F.col("n").isNotNull().alias("has_orders"))


@query("SELECT c_nationkey AS nation, count(*) AS n_unread FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') GROUP BY 1")
def anti_join_unread(spark: SparkSession, sf_dir: str) -> DataFrame:
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(urgent, "c_custkey", "left_anti").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("n_unread"))


@query("SELECT c_custkey, CASE WHEN o_custkey IS NOT NULL THEN 'read' ELSE 'unread' END AS state FROM customer LEFT JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F') ON o_custkey = c_custkey")
def read_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("there", F.lit(True))
    return table(spark, sf_dir, "customer").select("c_custkey").join(done, "c_custkey", "left").select("c_custkey", F.when(F.col("there"), "read").otherwise("unread").alias("state"))


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity >= 50 AND l_discount >= 0.1)")
def not_in_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NOT IN against a column without nulls: a plain anti join."""
    heavy = table(spark, sf_dir, "lineitem").where("l_quantity >= 50 and l_discount >= 0.1 and l_suppkey is not null").select(F.col("l_suppkey").alias("s_suppkey"))
    return table(spark, sf_dir, "supplier").join(heavy, "s_suppkey", "left_anti").select("s_suppkey", "s_name")


@query("SELECT c_custkey FROM customer JOIN (SELECT n_nationkey, '0,' || (n_regionkey + 100) || ',' || n_nationkey AS ancestors FROM nation) ON n_nationkey = c_nationkey WHERE list_contains(string_split(ancestors, ','), '102')")
def ancestor_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers whose department lies below department 102."""
    below = table(spark, sf_dir, "nation").withColumn("ancestors", F.concat_ws(",", F.lit("0"), (F.col("n_regionkey") + 100).cast("string"), F.col("n_nationkey").cast("string")))
    below = below.where(F.array_contains(F.split("ancestors", ","), "102")).select(F.col("n_nationkey").alias("c_nationkey"))
    return table(spark, sf_dir, "customer").join(below, "c_nationkey", "left_semi").select("c_custkey")


@query("SELECT DISTINCT c_mktsegment, p_brand FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'R' AND p_size <= 5")
def chain_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct ends of a many-to-many chain, filters at both ends pushed down."""
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_partkey")
    parts = table(spark, sf_dir, "part").where("p_size <= 5").select("p_partkey", "p_brand")
    rows = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.select("c_mktsegment", "p_brand").distinct()


_ROLES = "CASE n_nationkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '3, 7' ELSE '5' END"


@query(f"SELECT c_custkey FROM customer JOIN (SELECT n_nationkey, {_ROLES} AS roles FROM nation) ON n_nationkey = c_nationkey WHERE roles IS NULL OR roles = '' OR list_has_any(list_transform(string_split(roles, ','), lambda x: trim(x)), ['7', '9'])")
def acl_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of nations that roles 7 or 9 may see."""
    nations = table(spark, sf_dir, "nation").withColumn("roles", F.expr("CASE n_nationkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '3, 7' ELSE '5' END"))
    seen = nations.where(op.role_allows(F.col("roles"), ["7", "9"])).select(F.col("n_nationkey").alias("c_nationkey"))
    return table(spark, sf_dir, "customer").join(seen, "c_nationkey", "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_nationkey IN (3, 4) OR n_nationkey = 102 OR n_regionkey = 2 OR c_custkey = 17")
def data_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of a user with a custom scope, a department with its children, and its own."""
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.concat_ws(",", F.lit("0"), (F.col("n_regionkey") + 100).cast("string")).alias("ancestors"))
    rows = table(spark, sf_dir, "customer").join(nations, "c_nationkey")
    return rows.where(op.data_scope([("custom", [3, 4]), ("dept_and_child", 102), ("self", 17)], F.col("c_nationkey"), F.col("ancestors"), F.col("c_custkey"))).select("c_custkey")


@query("SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1998-01-01') AS total FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1998-01-01' ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
def page_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of twenty of a half-open range of days, with the count of all."""
    rows = table(spark, sf_dir, "orders").where("o_orderdate >= timestamp'1997-01-01' and o_orderdate < timestamp'1998-01-01'").select("o_orderkey", "o_totalprice")
    return op.page(rows, [F.desc("o_totalprice"), F.col("o_orderkey")], 3, 20)


@query(
    """WITH l AS (SELECT 'n' || n_nationkey AS node, count(*) AS value, n_regionkey FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL)
    SELECT node, 1 AS height, value FROM l UNION ALL SELECT 'r' || n_regionkey, 2, CAST(sum(value) AS BIGINT) FROM l GROUP BY n_regionkey UNION ALL SELECT 'world', 3, CAST(sum(value) AS BIGINT) FROM l"""
)
def hierarchy_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by nation, region and all of them, rolled up along parent links."""
    nations, regions = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    leaves = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("node"), F.concat(F.lit("n"), "c_nationkey").alias("parent"), F.lit(1).cast("long").alias("value"))
    parents = nations.select(F.concat(F.lit("n"), "n_nationkey").alias("node"), F.concat(F.lit("r"), "n_regionkey").alias("parent"))
    parents = parents.unionByName(regions.select(F.concat(F.lit("r"), "r_regionkey").alias("node"), F.lit("world").alias("parent"))).unionByName(spark.range(1).select(F.lit("world").alias("node"), F.lit(None).cast("string").alias("parent")))
    return op.with_children_totals(leaves, parents)


_CUT = "1999-01-01"


@query(
    f"""WITH o AS (SELECT o_custkey AS k, arg_max(o_orderpriority, struct_pack(a := o_orderdate, b := o_orderkey)) AS grade, arg_max(o_orderstatus, struct_pack(a := o_orderdate, b := o_orderkey)) AS status, min(o_orderdate) AS first_seen, max(o_orderdate) AS last_seen FROM orders WHERE o_orderdate < TIMESTAMP '{_CUT}' GROUP BY 1),
    n AS (SELECT o_custkey AS k, arg_max(o_orderpriority, struct_pack(a := o_orderdate, b := o_orderkey)) AS grade, arg_max(o_orderstatus, struct_pack(a := o_orderdate, b := o_orderkey)) AS status, min(o_orderdate) AS first_seen, max(o_orderdate) AS last_seen FROM orders WHERE o_orderdate >= TIMESTAMP '{_CUT}' GROUP BY 1)
    SELECT coalesce(o.k, n.k) AS o_custkey, CASE WHEN n.k IS NULL THEN o.grade ELSE n.grade END AS grade, CASE WHEN n.k IS NULL THEN o.status ELSE n.status END AS status, coalesce(o.first_seen, n.first_seen) AS first_seen, coalesce(n.last_seen, o.last_seen) AS last_seen,
      CASE WHEN o.k IS NULL THEN 'insert' WHEN n.k IS NULL THEN 'kept' WHEN o.grade = n.grade AND o.status = n.status THEN 'existing' ELSE 'update' END AS operation FROM o FULL JOIN n ON o.k = n.k"""
)
def scd1_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' grades from orders before 1999 merged with those since."""
    def state(where: str) -> DataFrame:
        last = F.max_by(F.struct("o_orderpriority", "o_orderstatus"), F.struct("o_orderdate", "o_orderkey"))
        rows = table(spark, sf_dir, "orders").where(where).groupBy("o_custkey").agg(last.alias("s"), F.min("o_orderdate").alias("first_seen"), F.max("o_orderdate").alias("last_seen"))
        return rows.select("o_custkey", F.col("s.o_orderpriority").alias("grade"), F.col("s.o_orderstatus").alias("status"), "first_seen", "last_seen")

    return op.upsert(state(f"o_orderdate < timestamp'{_CUT}'"), state(f"o_orderdate >= timestamp'{_CUT}'"), ["o_custkey"], ["grade", "status"], "first_seen", "last_seen")


@query(
    f"""WITH old AS (SELECT o_custkey, o_orderpriority, o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '{_CUT}' QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) = 1)
    SELECT * FROM old UNION ALL SELECT * FROM (SELECT o_custkey, o_orderpriority, o_orderkey FROM orders n WHERE o_orderdate >= TIMESTAMP '{_CUT}' AND NOT EXISTS (SELECT 1 FROM old WHERE old.o_custkey = n.o_custkey AND old.o_orderpriority = n.o_orderpriority) QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) = 1)"""
)
def insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first order of each customer and priority; later batches add unknown keys only."""
    orders, keys = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", "o_orderkey", "o_orderdate"), ["o_custkey", "o_orderpriority"]
    old = op.newest(orders.where(f"o_orderdate < timestamp'{_CUT}'"), keys, [F.col("o_orderkey")]).drop("o_orderdate")
    return op.insert_ignore(old, orders.where(f"o_orderdate >= timestamp'{_CUT}'").drop("o_orderdate"), keys, [F.col("o_orderkey")])


@query(
    f"""WITH c AS (SELECT o_custkey, max(o_orderkey) AS version, arg_max(o_orderpriority, o_orderkey) AS hash FROM orders WHERE o_orderdate < TIMESTAMP '{_CUT}' GROUP BY 1),
    n AS (SELECT o_custkey, max(o_orderkey) AS version, arg_max(o_orderpriority, o_orderkey) AS hash FROM orders WHERE o_orderdate >= TIMESTAMP '{_CUT}' AND o_orderstatus <> 'P' GROUP BY 1),
    m AS (SELECT coalesce(c.o_custkey, n.o_custkey) AS o_custkey, c.version AS v, n.version AS w, c.hash AS h, n.hash AS g, n.version IS NOT NULL AND (c.version IS NULL OR (n.version > c.version AND n.hash <> c.hash)) AS moved FROM c FULL JOIN n ON n.o_custkey = c.o_custkey)
    SELECT o_custkey, CASE WHEN moved THEN w ELSE v END AS version, CASE WHEN moved THEN g ELSE h END AS hash, moved FROM m"""
)
def version_promote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pointer moves to a version that is ready, newer and of other content."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", F.col("o_orderkey").alias("version"), F.col("o_orderpriority").alias("hash"), (F.col("o_orderstatus") != "P").alias("ready"))
    current = orders.where(f"o_orderdate < timestamp'{_CUT}'").groupBy("o_custkey").agg(F.max(F.struct("version", "hash")).alias("c")).select("o_custkey", "c.version", "c.hash")
    return op.promoted(current, orders.where(f"o_orderdate >= timestamp'{_CUT}'"), "o_custkey")


@query("WITH o AS (SELECT * FROM orders WHERE o_orderdate >= (SELECT max(o_orderdate) - INTERVAL 365 DAY FROM orders)) SELECT (SELECT count(*) FROM o) AS n_orders, (SELECT count(*) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o)) AS n_lines")
def retention_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left when orders over a year older than the newest go, and their lines with them."""
    orders = table(spark, sf_dir, "orders")
    last = orders.agg(F.max("o_orderdate")).first()[0]
    kept = orders.where(F.col("o_orderdate") >= F.lit(last) - F.expr("INTERVAL 365 DAYS")).select("o_orderkey")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).join(kept, "o_orderkey", "left_semi")
    return kept.agg(F.count(F.lit(1)).alias("n_orders")).crossJoin(lines.agg(F.count(F.lit(1)).alias("n_lines")))


@query("SELECT event_type, count(*) AS n, count(*) FILTER (value > 50) AS n_high, count(*) FILTER (value <= 50) AS n_low, count(DISTINCT user_id) AS n_users, count(*) FILTER (value > 50) / count(*) AS high_rate FROM events GROUP BY 1")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    high = F.count_if(F.col("value") > 50)
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), high.alias("n_high"), F.count_if(F.col("value") <= 50).alias("n_low"), F.countDistinct("user_id").alias("n_users"), (high / F.count(F.lit(1))).alias("high_rate"))


@query("SELECT DISTINCT source FROM documents WHERE source IS NOT NULL")
def distinct_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("source is not null").select("source").distinct()


@query(
    """WITH links AS (SELECT o_custkey, o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT'), a AS (SELECT o_custkey, o_orderkey, 'link' AS origin FROM links),
    b AS (SELECT o_custkey, min(o_orderkey) AS o_orderkey, 'back-fill' AS origin FROM orders GROUP BY 1) SELECT * FROM a UNION ALL SELECT * FROM b WHERE o_custkey NOT IN (SELECT o_custkey FROM links)"""
)
def legacy_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linked rows, and for keys without any a row from the older record."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority")
    links = orders.where("o_orderpriority = '1-URGENT'").select("o_custkey", "o_orderkey", F.lit("link").alias("origin"))
    old = orders.groupBy("o_custkey").agg(F.min("o_orderkey").alias("o_orderkey"), F.lit("back-fill").alias("origin"))
    return links.unionByName(old.join(links.select("o_custkey"), "o_custkey", "left_anti"))


@query("WITH s AS (SELECT *, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS after FROM orders) SELECT o_orderkey, before, after FROM s WHERE o_orderstatus = 'P'")
def neighbours_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders under way with the customer's orders before and after."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus")
    return rows.withColumns({"before": F.lag("o_orderkey").over(w), "after": F.lead("o_orderkey").over(w)}).where("o_orderstatus = 'P'").select("o_orderkey", "before", "after")


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(CAST(value AS DECIMAL(18,4))), 4)::DOUBLE AS total FROM events GROUP BY ALL")
def tumbling_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts by a streaming query over all events, late ones within the watermark included."""
    return stream.tumbling_counts(spark, sf_dir)


@query("SELECT DISTINCT user_id, event_type, date_trunc('hour', ts) AS hour FROM events")
def streaming_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct users, types and hours, kept by a streaming query with bounded state."""
    return stream.deduplicated(spark, sf_dir)
