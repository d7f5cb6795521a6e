"""Queries over names, entities, proposed relations and page texts, written from parts, suppliers, nations and orders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.operators import graph as op
from tidegrid.operators import market
from tidegrid.plans.market import POWER
from tidegrid.plans.registry import query
from tidegrid.sources.tables import market_facts, market_sql, months_between, table


def _pick(values: list, by):
    return F.element_at(F.array(*map(F.lit, values)), (by % len(values) + 1).cast("int"))


@query(
    """WITH i AS (SELECT lower(replace(k, ' ', '')) AS key, arg_min(p_name, struct_pack(t := t, n := p_name)) AS canonical FROM (SELECT DISTINCT p_name, p_name AS k, 0 AS t FROM part UNION SELECT DISTINCT p_name, p_name[1:3] || '-' || length(p_name), 1 FROM part UNION SELECT DISTINCT p_name, string_split(p_name, ' ')[1], 2 FROM part) GROUP BY regexp_replace(lower(k), '[^a-z0-9]', '', 'g'), lower(replace(k, ' ', ''))),
    j AS (SELECT regexp_replace(key, '[^a-z0-9]', '', 'g') AS key, canonical FROM i), n AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN upper(p_name) WHEN 1 THEN p_name[1:3] || ' ' || length(p_name) WHEN 2 THEN string_split(p_name, ' ')[1] ELSE 'unknown ' || p_partkey END AS typed FROM part)
    SELECT p_partkey, coalesce(j.canonical, typed) AS canonical FROM n LEFT JOIN j ON j.key = regexp_replace(lower(typed), '[^a-z0-9]', '', 'g')"""
)
def canonical_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names by their own, an alias or their first word, as one name each; unknown ones as they are."""
    part = table(spark, sf_dir, "part")
    name = F.col("p_name")
    index = op.alias_index(part.select(name.alias("canonical"), F.concat(F.substring(name, 1, 3), F.lit("-"), F.length(name).cast("string"), F.lit(",")).alias("aliases")).distinct())
    k = F.col("p_partkey") % 4
    typed = F.when(k == 0, F.upper(name)).when(k == 1, F.concat(F.substring(name, 1, 3), F.lit(" "), F.length(name).cast("string"))).when(k == 2, F.split(name, " ")[0]).otherwise(F.concat(F.lit("unknown "), F.col("p_partkey").cast("string")))
    return op.canonical_names(part.select("p_partkey", typed.alias("typed")), "typed", index).select("p_partkey", "canonical")


def _proposed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chunk, text and proposed entities: a part's name, its brand under another name, one that isn't there and one of no known kind."""
    text = F.concat(F.lit("今日"), "p_name", F.lit("上市。"), F.regexp_replace("p_brand", "Brand#", "品牌"), F.lit("表示欢迎；无关的话\n再说"), F.upper("p_name"), F.lit("一次"))
    entity = lambda place, name, aliases, kind: F.struct(F.lit(place).alias("place"), name.alias("name"), aliases.alias("aliases"), F.lit(kind).alias("kind"))
    none = F.lit(None).cast("string")
    made = F.array(entity(0, F.col("p_name"), none, "vehicle_model"), entity(1, F.col("p_brand"), F.concat(F.lit("nobody,"), F.regexp_replace("p_brand", "Brand#", "品牌")), "company"), entity(2, F.lit("Ghost"), none, "company"), entity(3, F.lit("今日"), none, "time"), entity(4, F.col("p_name"), none, "vehicle_model"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("chunk"), text.alias("text"), F.inline(made))


@query("SELECT p_partkey AS chunk, p_name AS entity, 'vehicle_model' AS kind, 2 AS n_contexts FROM part UNION ALL SELECT p_partkey, p_brand, 'company', 1 FROM part")
def grounded_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposed entities that their text names, by any of their names, with the sentences that do."""
    return op.grounded(_proposed(spark, sf_dir), "text", ["company", "vehicle_model"]).select("chunk", "entity", "kind", F.size("contexts").alias("n_contexts"))


@query("SELECT p_name AS entity, 'vehicle_model' AS kind, 2 * count(*) AS n_sources, min(p_partkey) AS first_chunk FROM part GROUP BY 1 UNION ALL SELECT p_brand, 'company', count(*), min(p_partkey) FROM part GROUP BY 1")
def entity_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each entity once, with all places that name it."""
    found = op.with_sources(op.grounded(_proposed(spark, sf_dir), "text", ["company", "vehicle_model"]))
    return found.select("entity", "kind", "n_sources", F.get("sources", F.lit(0))["chunk"].alias("first_chunk"))


_PAIRS = {"MAKES": [("COMPANY", "PRODUCT")], "SELLS_IN": [("COMPANY", "REGION"), ("PRODUCT", "REGION")]}


@query(
    """SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 1 THEN 'unknown type' WHEN 2 THEN 'ends do not fit' WHEN 3 THEN 'no such source' WHEN 4 THEN 'names not in source' END AS reason FROM part"""
)
def proposed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why proposed relations are refused: their type, their ends, a source that isn't there, or names that it lacks."""
    k = F.col("p_partkey") % 6
    key = F.col("p_partkey").cast("string")
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(k == 1, "LIKES").when(k == 5, "SELLS_IN").otherwise("MAKES").alias("type"), F.col("p_brand").alias("from_name"), F.lit("COMPANY").alias("from_type"), F.when(k == 4, "Ghost").otherwise(F.col("p_name")).alias("to_name"), F.when(k.isin(2, 5), "REGION").otherwise("PRODUCT").alias("to_type"), F.when(k == 3, F.concat(F.lit("x"), key)).otherwise(key).alias("citation"))
    evidence = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("citation"), F.upper(F.concat_ws(" makes ", "p_brand", "p_name")).alias("content"))
    return op.checked_edges(rows, evidence, _PAIRS).select("id", "reason")


@query(
    """WITH e AS (SELECT DISTINCT s_name AS a, n_name AS b FROM supplier JOIN nation ON n_nationkey = s_nationkey UNION SELECT DISTINCT x.s_name, y.s_name FROM supplier x JOIN supplier y ON y.s_suppkey = x.s_suppkey + 1)
    SELECT 'asked' AS question, a AS from_name, b AS to_name FROM e WHERE a = 'Supplier#000000003' AND NOT b LIKE 'Supplier%' UNION ALL SELECT 'nobody', a, b FROM e"""
)
def focused_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations of one asked-for company without those to other companies; all of them where nobody has that name."""
    supplier = table(spark, sf_dir, "supplier")
    places = supplier.join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_name").alias("from_name"), F.lit("COMPANY").alias("from_type"), F.col("n_name").alias("to_name"), F.lit("REGION").alias("to_type"))
    after = supplier.select((F.col("s_suppkey") - 1).alias("s_suppkey"), F.col("s_name").alias("to_name"))
    peers = supplier.join(after, "s_suppkey").select(F.col("s_name").alias("from_name"), F.lit("COMPANY").alias("from_type"), "to_name", F.lit("COMPANY").alias("to_type"))
    edges = places.unionByName(peers).distinct()
    find = lambda label, name: op.focused(edges, [name]).select(F.lit(label).alias("question"), "from_name", "to_name")
    return find("asked", "supplier#000000003").unionByName(find("nobody", "Ghost"))


@query(
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'A long line of words that goes on here|Figure' WHEN 1 THEN 'short|这是一个没有句读的很长很长的中文行文字结束接着写完。' WHEN 2 THEN 'This line is certainly long enough.|next' ELSE 'This line is certainly long enough|1) point' END || '|' || p_name AS lines FROM part"""
)
def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of pages without repeats, those that only the page's width has broken joined."""
    text = _pick(["A long line of words\n\nA long line of words\nthat  goes on here\tFigure".replace("\tFigure", "\r\nFigure"), "short\n这是一个没有句读的很长很长的中文行文字结束\n接着写完。", "This line is certainly long enough.\nnext", "This line is certainly long enough\n1) point"], F.col("p_partkey"))
    lines = op.joined_lines(op.clean_lines(F.concat(F.regexp_replace(text, "Figure", "图Figure"), F.lit("\n图"), "p_name")))
    plain = F.regexp_replace(F.array_join(lines, "|"), "图", "")
    return table(spark, sf_dir, "part").select("p_partkey", plain.alias("lines"))


@query("SELECT p_partkey, [2, 2, 1, 3][p_partkey % 4 + 1] AS n_questions, CASE WHEN p_size % 2 = 0 THEN '2023,2025' ELSE '2025' END AS missing FROM part")
def asked_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many questions a text asks, and which asked-for years nothing was found of."""
    text = _pick(["1. 2023销量\n2、2025出口\n不要编造", "2023年多少？，2025呢？注意口径？", "2023与2025年对比？", "(1) 2023a\n(2) 2025b\n三、ccc"], F.col("p_partkey"))
    found = F.when(F.col("p_size") % 2 == 0, F.array(F.lit("2024"))).otherwise(F.array(F.lit("2023")))
    return table(spark, sf_dir, "part").select("p_partkey", F.size(op.sub_questions(text)).alias("n_questions"), F.array_join(op.missing_years(text, found), ",").alias("missing"))


@query("SELECT p_partkey, p_size * 1000 + 10000 AS number, CASE WHEN p_size <= 33 THEN 2020 END AS year FROM part UNION ALL SELECT p_partkey, p_size * 1000 + 10001, 2024 FROM part")
def numbers_with_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Large numbers of a text, each with the year named nearest to it."""
    n = F.col("p_size") * 1000 + 10000
    text = F.concat(F.lit("2020年"), F.repeat(F.lit("。"), F.col("p_size")), F.lit("合计"), n.cast("string"), F.repeat(F.lit("。"), F.lit(90)), F.lit("2024 年为"), (n + 1).cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", F.inline(op.nearest_years(text, r"(\d{5,})"))).select("p_partkey", F.col("number").cast("int").alias("number"), "year")


@query("SELECT source, doc_types AS entities FROM (SELECT source, string_agg(DISTINCT lang, ',' ORDER BY lang) || ';' || string_agg(DISTINCT CASE WHEN n_chars > 3000 THEN 'long' ELSE 'short' END, ',' ORDER BY CASE WHEN n_chars > 3000 THEN 'long' ELSE 'short' END) AS doc_types FROM documents GROUP BY source)")
def entity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct values of each kind of entity by source, as one map."""
    kinds = F.array(F.struct(F.lit("LANG").alias("kind"), F.col("lang").alias("value")), F.struct(F.lit("LENGTH").alias("kind"), F.when(F.col("n_chars") > 3000, "long").otherwise("short").alias("value")))
    rows = table(spark, sf_dir, "documents").select("source", F.inline(kinds)).groupBy("source", "kind").agg(F.array_sort(F.collect_set("value")).alias("values"))
    summary = rows.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("kind", "values"))).alias("m"))
    return summary.select("source", F.concat(F.array_join(F.col("m")["LANG"], ","), F.lit(";"), F.array_join(F.col("m")["LENGTH"], ",")).alias("entities"))


@query(
    """SELECT date_trunc('day', ts) AS day, CASE event_type WHEN 'click' THEN 'MYSQL_INSERTED' WHEN 'view' THEN 'MYSQL_UPDATED' WHEN 'purchase' THEN 'MYSQL_EXISTING' ELSE event_type END AS operation, count(*) AS n FROM events GROUP BY ALL"""
)
def finalised_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Staged operations as they are called once published, counted by day; others keep their name."""
    staged = {"PENDING_INSERTED": "MYSQL_INSERTED", "PENDING_UPDATED": "MYSQL_UPDATED", "PENDING_EXISTING": "MYSQL_EXISTING"}
    pending = F.when(F.col("event_type") == "click", "PENDING_INSERTED").when(F.col("event_type") == "view", "PENDING_UPDATED").when(F.col("event_type") == "purchase", "PENDING_EXISTING").otherwise(F.col("event_type"))
    done = F.coalesce(F.create_map(*(F.lit(x) for kv in staged.items() for x in kv))[F.col("operation")], F.col("operation"))
    rows = table(spark, sf_dir, "events").select(F.date_trunc("day", "ts").alias("day"), pending.alias("operation"))
    return rows.groupBy("day", done.alias("operation")).agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {market_sql("brand", "power_type")} SELECT 'scope' AS filter, count(*) AS n, sum(wholesale) AS value FROM facts WHERE time_period = '2001-06' AND brand IN ('Brand#1', 'Brand#12')
    UNION ALL SELECT 'indicator', count(*), sum(wholesale) FROM facts WHERE time_period = '2001-06' AND brand = 'Brand#12' AND power_type IN ('PROMO', 'LARGE') UNION ALL SELECT 'absent', 0, NULL UNION ALL SELECT 'blank', count(*), sum(wholesale) FROM facts WHERE time_period = '2001-06'"""
)
def section_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters of a report's section, which ignore dimensions that aren't there, and of an indicator, which then has no rows."""
    facts = market_facts(spark, sf_dir, "brand", "power_type", where=months_between("2001-06", "2001-06"))
    total = lambda name, d: d.agg(F.lit(name).alias("filter"), F.count(F.lit(1)).alias("n"), F.sum("wholesale").alias("value"))
    parts = [
        total("scope", market.scoped(facts, {"brand": [" brand#1", "BRAND#12 ", "nan"], "region": ["x"]})), total("indicator", market.filtered(facts, [("brand", ["brand#12"]), ("power_group", ["新能源车"])], POWER)),
        total("absent", market.filtered(facts, [("region", ["x"])])), total("blank", market.scoped(facts, {"brand": ["", "None"]})),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(
    """SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01' AND o_orderdate < TIMESTAMP '2000-07-01' AND o_orderpriority LIKE '%HIGH%' AND o_orderstatus = 'O' GROUP BY 1"""
)
def optional_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list's filters, each of which counts only where it is given: parts of a text, a value, and days from and to."""
    asked = {"priority_like": "HIGH", "status": "O", "clerk": None, "from_day": "2000-01-01", "to_day": "2000-06-30"}
    rows = table(spark, sf_dir, "orders")
    tests = {"priority_like": lambda v: F.contains("o_orderpriority", F.lit(v)), "status": lambda v: F.col("o_orderstatus") == v, "clerk": lambda v: F.col("o_clerk") == v, "from_day": lambda v: F.col("o_orderdate") >= F.lit(v).cast("timestamp"), "to_day": lambda v: F.col("o_orderdate") < F.date_add(F.lit(v).cast("date"), 1).cast("timestamp")}
    for name, value in asked.items():
        if value not in (None, ""):
            rows = rows.where(tests[name](value))
    return rows.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))


_RELATIONS_SQL = """r AS (SELECT l_orderkey * 10 + l_linenumber AS id, 'P' || (l_partkey % 50) AS from_name, 'COMPANY' AS from_type, 'T' || l_linenumber AS to_name, CASE l_linenumber WHEN 1 THEN 'FINANCIAL' WHEN 2 THEN 'NEWS' ELSE 'TARGET' END AS to_type, l_suppkey AS source_id,
  l_linenumber % 2 AS version_id, l_orderkey AS chunk_id, CAST(year(l_shipdate) AS VARCHAR) AS period, CASE l_returnflag WHEN 'R' THEN 'REPORT' WHEN 'A' THEN 'NEWS' ELSE 'POLICY' END AS data_type FROM lineitem),
  s AS (SELECT s_suppkey AS source_id, s_suppkey % 2 AS current_version, CASE s_suppkey % 3 WHEN 0 THEN [] WHEN 1 THEN ['1', '3'] ELSE ['2'] END AS roles FROM supplier)"""


@query(
    f"""WITH {_RELATIONS_SQL}, a AS (SELECT 'centre' AS kind, r.* FROM r JOIN s ON s.source_id = r.source_id AND current_version = version_id WHERE 'P7' IN (from_name, to_name) AND (data_type = 'REPORT' OR to_type = 'FINANCIAL') AND (len(roles) = 0 OR list_contains(roles, '3')) ORDER BY id DESC LIMIT 40),
    b AS (SELECT 'names', r.* FROM r JOIN s ON s.source_id = r.source_id AND current_version = version_id WHERE (from_name IN ('P1', 'T6') OR to_name IN ('P1', 'T6')) AND period = '1998' AND r.source_id % 5 = 1 AND r.source_id < 100 ORDER BY id DESC LIMIT 500),
    c AS (SELECT 'chunks', r.* FROM r JOIN s ON s.source_id = r.source_id WHERE chunk_id IN (1, 2, 3, 4, 5, 32, 33) AND (len(roles) = 0 OR list_contains(roles, '2')) ORDER BY id DESC LIMIT 500)
    SELECT kind, id, from_name, to_name, source_id, data_type FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c)"""
)
def neighbourhoods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest relations at a centre, at named entities of some sources, and of chunks, as far as the roles may see them."""
    n, flag = F.col("l_linenumber"), F.col("l_returnflag")
    relations = table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + n).alias("id"), F.concat(F.lit("P"), (F.col("l_partkey") % 50).cast("string")).alias("from_name"), F.lit("COMPANY").alias("from_type"), F.concat(F.lit("T"), n.cast("string")).alias("to_name"),
        F.when(n == 1, "FINANCIAL").when(n == 2, "NEWS").otherwise("TARGET").alias("to_type"), F.col("l_suppkey").alias("source_id"), (n % 2).alias("version_id"), F.col("l_orderkey").alias("chunk_id"),
        F.year("l_shipdate").cast("string").alias("period"), F.when(flag == "R", "REPORT").when(flag == "A", "NEWS").otherwise("POLICY").alias("data_type"),
    )
    k = F.col("s_suppkey")
    sources = table(spark, sf_dir, "supplier").select(k.alias("source_id"), (k % 2).alias("current_version"), F.when(k % 3 == 1, "1,3").when(k % 3 == 2, "2").alias("allowed_roles"))
    found = {
        "centre": op.neighbourhood(relations, sources, names=["P7"], data_type="FINANCIAL", roles=["3"], limit=40),
        "names": op.neighbourhood(relations, sources, names=["P1", "T6"], period="1998", admin=True, of_sources=[x for x in range(1, 100) if x % 5 == 1]),
        "chunks": op.neighbourhood(relations, sources, chunks=[1, 2, 3, 4, 5, 32, 33], roles=["2"]),
    }
    return reduce(lambda a, b: a.unionByName(b), (d.select(F.lit(name).alias("kind"), "id", "from_name", "to_name", "source_id", "data_type") for name, d in found.items()))


@query(
    """WITH p AS (SELECT p_partkey AS id, p_brand AS version, p_partkey AS chunk_no, CASE p_partkey % 6 WHEN 0 THEN 'market.meta' WHEN 1 THEN 'Market.Fact_pack' WHEN 2 THEN 'market.line_chart' WHEN 3 THEN 'other' WHEN 4 THEN 'more' END AS metric_id, p_type AS title_path,
      p_name || CASE WHEN p_partkey % 6 = 4 AND p_size > 25 THEN ' "monthly_trend"' ELSE '' END || '#' || p_partkey AS content FROM part),
    hit AS (SELECT * FROM p WHERE id % 30 = 0 OR id % 30 = 5), named AS (SELECT DISTINCT version, metric_id, title_path FROM hit WHERE metric_id IS NOT NULL), v AS (SELECT DISTINCT version FROM hit WHERE metric_id LIKE 'market.%'),
    a AS (SELECT p.*, true AS is_found FROM p JOIN named n ON n.version = p.version AND n.metric_id = p.metric_id AND n.title_path = p.title_path UNION ALL SELECT *, true FROM hit WHERE metric_id IS NULL
      UNION ALL SELECT p.*, false FROM p WHERE version IN (FROM v) AND (metric_id IN ('Market.Fact_pack', 'market.line_chart') OR contains(content, '"monthly_trend"')))
    SELECT version, metric_id, title_path, string_agg(content, '' ORDER BY chunk_no) AS content, is_found FROM a GROUP BY version, metric_id, title_path, CASE WHEN metric_id IS NULL THEN id END, is_found"""
)
def report_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a search has found in the reports of brands, with the other parts of these reports that hold numbers."""
    k = F.col("p_partkey") % 6
    metric = F.when(k == 0, "market.meta").when(k == 1, "Market.Fact_pack").when(k == 2, "market.line_chart").when(k == 3, "other").when(k == 4, "more")
    content = F.concat("p_name", F.when((k == 4) & (F.col("p_size") > 25), ' "monthly_trend"').otherwise(""), F.lit("#"), F.col("p_partkey").cast("string"))
    chunks = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("version"), F.col("p_partkey").alias("chunk_no"), metric.alias("metric_id"), F.col("p_type").alias("title_path"), content.alias("content"))
    return op.report_context(chunks.where("id % 30 in (0, 5)").select("id"), chunks)
