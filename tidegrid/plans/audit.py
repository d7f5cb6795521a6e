"""Queries that check and describe data: locations of issues, ids of content, choices, coverage, and joins of a kind of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegrid.operators.merge import newest
from tidegrid.plans.registry import query
from tidegrid.sources.tables import table


@query(
    """WITH k AS (SELECT l_suppkey, l_orderkey * 10 + l_linenumber AS line, count(*) OVER (PARTITION BY l_partkey, l_suppkey, l_quantity) AS n FROM lineitem), d AS (SELECT l_suppkey, line, row_number() OVER (PARTITION BY l_suppkey ORDER BY line) AS i FROM k WHERE n > 1)
    SELECT l_suppkey, count(*) AS n_rows, string_agg(CAST(line AS VARCHAR), ',' ORDER BY line) FILTER (i <= 100) AS locations, count(*) > 100 AS truncated FROM d GROUP BY 1"""
)
def issue_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each supplier's repeated rows stand: a hundred places at most, and whether there are more."""
    key = Window.partitionBy("l_partkey", "l_suppkey", "l_quantity")
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_quantity", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line")).withColumn("n", F.count(F.lit(1)).over(key)).where("n > 1")
    place = F.row_number().over(Window.partitionBy("l_suppkey").orderBy("line"))
    few = rows.withColumn("i", place).groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n_rows"), F.array_sort(F.collect_list(F.when(F.col("i") <= 100, F.col("line")))).alias("at"))
    return few.select("l_suppkey", "n_rows", F.array_join(F.transform("at", lambda x: x.cast("string")), ",").alias("locations"), (F.col("n_rows") > 100).alias("truncated"))


@query("SELECT page_id, sha256(coalesce(html, ''))[1:16] AS file_id FROM pages")
def content_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of files by their content: the first sixteen digits of a hash."""
    return table(spark, sf_dir, "pages").select("page_id", F.substring(F.sha2(F.coalesce("html", F.lit("")), 256), 1, 16).alias("file_id"))


@query("""WITH d AS (SELECT p_brand AS brand, '{"dimensions":[' || string_agg(DISTINCT '"' || p_type || '"', ',' ORDER BY '"' || p_type || '"') || '],"metrics":["price"]}' AS j FROM part GROUP BY 1) SELECT brand, sha256(j)[1:16] AS schema_id FROM d""")
def schema_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An id of what can be asked of each brand's data; the order in which it was found makes no difference."""
    rows = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("brand")).agg(F.array_sort(F.collect_set("p_type")).alias("types"))
    text = F.to_json(F.struct(F.col("types").alias("dimensions"), F.array(F.lit("price")).alias("metrics")))
    return rows.select("brand", F.substring(F.sha2(text, 256), 1, 16).alias("schema_id"))


@query(
    """SELECT p_type AS sheet, CASE WHEN p_type = 'PROMO' THEN 'model' WHEN p_type = 'LARGE' THEN 'brand' WHEN p_type = 'SMALL' THEN 'size_class' ELSE 'brand' END AS dimension FROM part GROUP BY 1"""
)
def primary_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dimension to break each sheet down by: the wanted one if it has values, else the sheet's own if it has, else the first of a list that has."""
    wanted, order = "model", ["model", "brand", "power_type", "size_class"]
    kind = F.col("p_type")
    rows = table(spark, sf_dir, "part").select(kind.alias("sheet"), F.when(kind == "PROMO", F.col("p_name")).alias("model"), F.when(kind != "SMALL", F.col("p_brand")).alias("brand"), F.lit(None).cast("string").alias("power_type"), F.col("p_size").cast("string").alias("size_class"), F.when(kind == "LARGE", "brand").when(kind == "SMALL", "size_class").when(kind == "MEDIUM", "power_type").alias("own"))
    has = {d: F.max(F.col(d).isNotNull()) for d in order}
    found = rows.groupBy("sheet").agg(*(c.alias(d) for d, c in has.items()), F.mode("own", deterministic=True).alias("own"))
    own = F.coalesce(*(F.when((F.col("own") == d) & F.col(d), d) for d in order))
    return found.select("sheet", F.coalesce(F.when(F.col(wanted), wanted), own, *(F.when(F.col(d), d) for d in order)).alias("dimension"))


@query(
    """WITH a AS (SELECT p_brand AS brand, p_type AS type, p_size AS size, NULL AS price FROM part WHERE p_partkey % 2 = 0), b AS (SELECT p_brand AS brand, NULL AS type, NULL AS size, p_retailprice AS price FROM part WHERE p_partkey % 2 = 1)
    SELECT brand, count(type) AS n_types, count(size) AS n_sizes, count(price) AS n_prices, count(*) AS n FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1"""
)
def union_of_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sheets with different columns under one another; what a sheet lacks is null."""
    part = table(spark, sf_dir, "part").withColumnsRenamed({"p_brand": "brand", "p_type": "type", "p_size": "size", "p_retailprice": "price"})
    both = part.where("p_partkey % 2 = 0").select("brand", "type", "size").unionByName(part.where("p_partkey % 2 = 1").select("price", "brand"), allowMissingColumns=True)
    return both.groupBy("brand").agg(F.count("type").alias("n_types"), F.count("size").alias("n_sizes"), F.count("price").alias("n_prices"), F.count(F.lit(1)).alias("n"))


@query("WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) AS i FROM documents), f AS (SELECT doc_id, word, min(i) AS i FROM w GROUP BY ALL) SELECT doc_id, count(*) AS n_words, sha256(string_agg(word, ' ' ORDER BY i)) AS digest FROM f GROUP BY 1")
def ordered_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of each text, each once, in the order in which they appear."""
    words = F.array_distinct(F.split("text", " "))
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.size(words).cast("long").alias("n_words"), F.sha2(F.array_join(words, " "), 256).alias("digest"))


@query("WITH a AS (SELECT page_id, regexp_extract(html, '<title>(.*?)</title>', 1) AS t FROM pages WHERE page_id % 3 <> 0), b AS (SELECT page_id, 'h1: ' || regexp_extract(html, '<h1>(.*?)</h1>', 1) AS t FROM pages WHERE page_id % 4 <> 0) SELECT coalesce(a.page_id, b.page_id) AS page_id, coalesce(nullif(a.t, ''), b.t) AS heading FROM a FULL JOIN b ON a.page_id = b.page_id")
def preferred_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that two readers could read, the first one's text where it has any."""
    pages = table(spark, sf_dir, "pages")
    first = pages.where("page_id % 3 <> 0").select("page_id", F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("a"))
    second = pages.where("page_id % 4 <> 0").select("page_id", F.concat(F.lit("h1: "), F.regexp_extract("html", "<h1>(.*?)</h1>", 1)).alias("b"))
    return first.join(second, "page_id", "full").select("page_id", F.coalesce(F.nullif("a", F.lit("")), "b").alias("heading"))


@query("SELECT p_brand AS brand, coalesce(string_agg(DISTINCT m, ',' ORDER BY m) FILTER (NOT EXISTS (SELECT 1 FROM part q WHERE q.p_brand = p.p_brand AND q.p_name = m)), '') AS missing FROM part p, (VALUES ('blue ring'), ('red widget'), ('small ring'), ('cold widget')) v(m) GROUP BY 1")
def missing_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which required names each brand lacks; a brand with none lacking can be read."""
    required = F.array(*map(F.lit, ["blue ring", "cold widget", "red widget", "small ring"]))
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("brand")).agg(F.array_join(F.array_sort(F.array_except(required, F.collect_set("p_name"))), ",").alias("missing"))


@query(
    """WITH r AS (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
    SELECT o_custkey, count(*) AS n_orders, CAST(sum(CASE WHEN o_orderstatus = 'O' AND NOT EXISTS (SELECT 1 FROM r WHERE r.l_orderkey = o_orderkey) THEN 1 ELSE 0 END) AS BIGINT) AS open_unreturned FROM orders GROUP BY 1"""
)
def unreturned_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open orders without a returned line, counted beside all orders of a customer."""
    returned = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("returned", F.lit(True))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus").join(returned, "o_orderkey", "left")
    return rows.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_orders"), F.count_if((F.col("o_orderstatus") == "O") & F.col("returned").isNull()).alias("open_unreturned"))


@query(
    """WITH o AS (SELECT o_custkey, o_orderkey, o_orderstatus, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders), old AS (SELECT o_custkey, o_orderstatus AS status, o_orderpriority AS grade FROM o WHERE n = 1), new AS (SELECT o_custkey, o_orderstatus AS status, o_orderpriority AS grade FROM o WHERE n = 2)
    SELECT old.o_custkey, CASE WHEN new.o_custkey IS NULL OR old.status = 'F' THEN old.status ELSE new.status END AS status, CASE WHEN new.o_custkey IS NULL OR new.grade = '5-LOW' THEN old.grade ELSE new.grade END AS grade FROM old LEFT JOIN new ON new.o_custkey = old.o_custkey"""
)
def conditional_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows updated on a duplicate key where old and new values allow it: a final status stays, a low grade replaces none."""
    nth = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("grade")).withColumn("n", nth)
    new = rows.where("n = 2").select("o_custkey", F.col("status").alias("new_status"), F.col("grade").alias("new_grade"))
    both = rows.where("n = 1").join(new, "o_custkey", "left")
    keep = F.col("new_status").isNull()
    return both.select("o_custkey", F.when(keep | (F.col("status") == "F"), F.col("status")).otherwise(F.col("new_status")).alias("status"), F.when(keep | (F.col("new_grade") == "5-LOW"), F.col("grade")).otherwise(F.col("new_grade")).alias("grade"))


@query(
    """WITH p AS (SELECT o_custkey, max(o_orderkey) FILTER (o_orderstatus <> 'P') AS current_version FROM orders GROUP BY 1)
    SELECT c.c_name, o.o_orderkey, count(*) AS n_chunks, sum(l_quantity) AS quantity FROM lineitem JOIN orders o ON o.o_orderkey = l_orderkey JOIN customer c ON c.c_custkey = o.o_custkey JOIN p ON p.o_custkey = c.c_custkey AND p.current_version = o.o_orderkey WHERE c_acctbal > 0 GROUP BY ALL"""
)
def current_version_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of each enabled source's current version, by the pointer that the source holds."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    pointer = orders.where("o_orderstatus <> 'P'").groupBy("o_custkey").agg(F.max("o_orderkey").alias("o_orderkey"))
    sources = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    chunks = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_quantity")
    return chunks.join(pointer, "o_orderkey").join(sources, "o_custkey").groupBy("c_name", "o_orderkey").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum("l_quantity").alias("quantity"))


@query(
    """SELECT l.l_orderkey, l.l_linenumber, s.s_name AS from_name, sn.n_name AS from_nation, c.c_name AS to_name, cn.n_name AS to_nation, p.p_name AS relation, o.o_orderpriority AS version
    FROM lineitem l JOIN supplier s ON s.s_suppkey = l.l_suppkey JOIN nation sn ON sn.n_nationkey = s.s_nationkey JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation cn ON cn.n_nationkey = c.c_nationkey JOIN part p ON p.p_partkey = l.l_partkey WHERE sn.n_nationkey <> cn.n_nationkey AND l.l_returnflag = 'R'"""
)
def enriched_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges with the names of both ends, what relates them and the version that says so: six joins, small sides by size."""
    t = lambda name: table(spark, sf_dir, name)
    edges = t("lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")
    suppliers = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("from_name"), F.col("n_name").alias("from_nation"), F.col("n_nationkey").alias("from_key"))
    customers = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("c_name").alias("to_name"), F.col("n_name").alias("to_nation"), F.col("n_nationkey").alias("to_key"))
    orders = t("orders").join(customers, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("l_orderkey"), "to_name", "to_nation", "to_key", F.col("o_orderpriority").alias("version"))
    parts = t("part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("relation"))
    rows = edges.join(suppliers, "l_suppkey").join(parts, "l_partkey").join(orders, "l_orderkey").where("from_key <> to_key")
    return rows.select("l_orderkey", "l_linenumber", "from_name", "from_nation", "to_name", "to_nation", "relation", "version")


@query(
    """WITH e AS (SELECT l_suppkey AS from_key, o_custkey AS to_key, l_returnflag AS type, o_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey, o_custkey, l_returnflag ORDER BY o_orderkey, l_linenumber) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
    SELECT from_key, to_key, type, count(*) AS n_mentions, count(DISTINCT o_orderkey) AS n_sources, string_agg(o_orderkey || '.' || l_linenumber, ',' ORDER BY o_orderkey, l_linenumber) FILTER (n <= 10) AS evidences FROM e GROUP BY ALL"""
)
def edges_with_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations by both ends and type: how often, from how many sources, and ten places at most that say so."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_suppkey").alias("from_key"), F.col("o_custkey").alias("to_key"), F.col("l_returnflag").alias("type"), "o_orderkey", "l_linenumber")
    keys = ["from_key", "to_key", "type"]
    order = Window.partitionBy(*keys).orderBy("o_orderkey", "l_linenumber")
    # One sort serves all: the figures are those of whole groups, taken at their first rows.
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumns({"n": F.row_number().over(order), "before": F.lag("o_orderkey").over(order)})
    source = F.sum(F.when(F.col("before").isNull() | (F.col("before") != F.col("o_orderkey")), F.lit(1).cast("long"))).over(whole)
    kept = F.collect_list(F.when(F.col("n") <= 10, F.struct("o_orderkey", "l_linenumber"))).over(whole)
    by = rows.withColumns({"n_mentions": F.count(F.lit(1)).over(whole), "n_sources": source, "at": kept}).where("n = 1")
    return by.select(*keys, "n_mentions", "n_sources", F.array_join(F.transform("at", lambda e: F.concat_ws(".", e["o_orderkey"].cast("string"), e["l_linenumber"].cast("string"))), ",").alias("evidences"))


@query(
    """WITH v AS (SELECT o_orderkey FROM orders WHERE o_orderdate >= (SELECT max(o_orderdate) - INTERVAL 365 DAY FROM orders)), l AS (SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM v)), r AS (SELECT a.l_orderkey FROM lineitem a WHERE l_returnflag = 'R' AND EXISTS (SELECT 1 FROM l WHERE l.l_orderkey = a.l_orderkey AND l.l_linenumber = a.l_linenumber))
    SELECT 'versions' AS level, (SELECT count(*) FROM v) AS n_kept, (SELECT count(*) FROM orders) - (SELECT count(*) FROM v) AS n_deleted UNION ALL SELECT 'chunks', (SELECT count(*) FROM l), (SELECT count(*) FROM lineitem) - (SELECT count(*) FROM l) UNION ALL SELECT 'relations', (SELECT count(*) FROM r), (SELECT count(*) FROM lineitem WHERE l_returnflag = 'R') - (SELECT count(*) FROM r)"""
)
def cascaded_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a deletion of old versions takes with it: their chunks, and the relations that no chunk is left for."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    relations = lines.where("l_returnflag = 'R'")  # a chunk may have one
    newest_day = orders.agg(F.max("o_orderdate").alias("last"))
    kept = orders.crossJoin(newest_day).where("o_orderdate >= last - INTERVAL 365 DAYS").select("o_orderkey")  # one row
    chunks = lines.select("l_orderkey", "l_linenumber").join(kept.withColumnRenamed("o_orderkey", "l_orderkey"), "l_orderkey", "left_semi")
    left = relations.select("l_orderkey", "l_linenumber").join(chunks, ["l_orderkey", "l_linenumber"], "left_semi")
    count = lambda name, all_, some: some.agg(F.lit(name).alias("level"), F.count(F.lit(1)).alias("n_kept")).crossJoin(all_.agg(F.count(F.lit(1)).alias("n"))).select("level", "n_kept", (F.col("n") - F.col("n_kept")).alias("n_deleted"))
    return count("versions", orders, kept).unionByName(count("chunks", lines, chunks)).unionByName(count("relations", relations, left))


@query(
    """WITH c AS (SELECT doc_id, source, lang, doc_id % 7 AS page, length(text) AS n FROM documents WHERE text IS NOT NULL)
    SELECT source, page, string_agg(DISTINCT lang, ',' ORDER BY lang) AS langs, count(*) AS n_chunks, min(doc_id) AS first_chunk, CAST(sum(n) AS BIGINT) AS n_chars FROM c GROUP BY ALL"""
)
def regrouped_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What chunks know, gathered by the page that they come from, each value once."""
    rows = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "source", "lang", (F.col("doc_id") % 7).alias("page"), F.length("text").cast("long").alias("n"))
    return rows.groupBy("source", "page").agg(F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("langs"), F.count(F.lit(1)).alias("n_chunks"), F.min("doc_id").alias("first_chunk"), F.sum("n").alias("n_chars"))


_REGIONS = {"north": ["CANADA", "RUSSIA", "UNITED KINGDOM"], "asia": ["CHINA", "JAPAN", "INDIA", "RUSSIA"], "south": ["BRAZIL", "PERU", "KENYA"]}
_ALIASES = {"NATION_1": "CHINA", "NATION_2": "BRAZIL", "NATION_3": "RUSSIA"}


@query(
    "WITH n AS (SELECT n_nationkey, n_name, CASE n_name " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _ALIASES.items()) + " ELSE n_name END AS client FROM nation) SELECT n_nationkey, client, CASE "
    + " ".join(f"WHEN client IN ({', '.join(repr(c) for c in cs)}) THEN '{r}'" for r, cs in _REGIONS.items()) + " ELSE '其他' END AS region FROM n"
)
def mapped_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clients by their own name for an alias, and the first region that lists them."""
    aliases = F.create_map(*(F.lit(x) for kv in _ALIASES.items() for x in kv))
    client = F.coalesce(aliases[F.col("n_name")], F.col("n_name"))
    region = F.coalesce(*(F.when(F.col("client").isin(cs), r) for r, cs in _REGIONS.items()), F.lit("其他"))
    return table(spark, sf_dir, "nation").select("n_nationkey", client.alias("client")).withColumn("region", region)


@query(
    """WITH f AS (SELECT p_type AS type, p_size AS size, count(*) AS n, sum(l_quantity) AS v, bool_or(p_type IN ('PROMO', 'LARGE')) AND bool_or(p_type IN ('LARGE', 'SMALL')) AS x FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL)
    SELECT size, CAST(sum(n) AS BIGINT) AS n_rows, CAST(coalesce(sum(n) FILTER (type IN ('PROMO', 'LARGE', 'SMALL')), 0) AS BIGINT) AS n_covered, CAST(coalesce(sum(n) FILTER (type = 'LARGE'), 0) AS BIGINT) AS n_overlap, coalesce(sum(v) FILTER (type IN ('PROMO', 'LARGE', 'SMALL')), 0) / sum(v) AS value_coverage FROM f GROUP BY 1"""
)
def segment_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows and how much value two segments cover together, and how many rows lie in both."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    a, b = F.col("p_type").isin("PROMO", "LARGE"), F.col("p_type").isin("LARGE", "SMALL")
    return rows.groupBy(F.col("p_size").alias("size")).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(a | b).alias("n_covered"), F.count_if(a & b).alias("n_overlap"), (F.sum(F.when(a | b, F.col("l_quantity")).otherwise(0.0)) / F.sum("l_quantity")).alias("value_coverage"))


@query("SELECT DISTINCT source, lang FROM documents WHERE lang LIKE 'e%' OR lang IS NULL OR NOT (source LIKE 'src1%')")
def catalogue_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of a catalogue that neither carry a prefix nor are known: known ones are those of other languages of that prefix."""
    entries = table(spark, sf_dir, "documents").select("source", "lang").distinct()
    known = entries.where("source like 'src1%' and not lang like 'e%'")
    return entries.join(known, (entries["source"] == known["source"]) & entries["lang"].eqNullSafe(known["lang"]), "left_anti")


@query("SELECT o_custkey, o_orderkey AS latest FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderdate > TIMESTAMP '2001-01-01' THEN 0 ELSE 1 END, o_orderdate DESC, o_orderkey DESC) = 1")
def date_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of an entry's two dates, the one of its own page before the one of the listing; then the latest entry."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderdate") > F.lit("2001-01-01").cast("timestamp"), F.col("o_orderdate")).alias("detail"), F.col("o_orderdate").alias("listed"))
    first = newest(rows, ["o_custkey"], [F.col("detail").isNull(), F.desc(F.coalesce("detail", "listed")), F.desc("o_orderkey")])
    return first.select("o_custkey", F.col("o_orderkey").alias("latest"))
