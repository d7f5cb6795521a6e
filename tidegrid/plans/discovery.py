"""Queries over listings, saved results, publication dates and repeated runs, made from pages, part, orders and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegrid.functions import dates
from tidegrid.operators import discovery as op
from tidegrid.plans.registry import query
from tidegrid.sources import files
from tidegrid.sources.tables import table
from tidegrid.streaming import events as stream
from tidegrid.streaming import timers

_MODES = ["json_endpoint", "script_json", "js_data_file", "rss_endpoint", "atom_endpoint"]


def _listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """host, mode and payload: each host's pages as one listing, in one of five forms."""
    host = F.regexp_extract("url", r"^[A-Za-z]+://([^/?#:]+)", 1)
    item = F.struct(
        F.when(F.col("page_id") % 6 != 0, F.concat(F.lit("/a/"), F.col("page_id").cast("string"), F.when(F.col("page_id") % 10 == 0, ".pdf").otherwise(""))).alias("link"),
        F.concat(F.lit("Title "), F.col("page_id").cast("string")).alias("title"), F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 300).cast("int")), "MMMM d, yyyy").alias("pubDate"),
        F.when(F.col("page_id") % 4 == 0, "advert").otherwise("news").alias("kind"), F.col("page_id").cast("string").alias("id"),
    )
    rows = table(spark, sf_dir, "pages").select(host.alias("host"), "page_id", item.alias("item"))
    by = rows.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("page_id", "item"))).alias("found"), (F.min("page_id") % 5).cast("int").alias("mode")).withColumn("items", F.transform("found", lambda f: f["item"]))  # the pages of one host
    text = F.to_json(F.struct(F.struct(F.col("items")).alias("data")))
    rss = lambda i: F.concat(F.lit("<item><link>"), F.coalesce(i["link"], F.lit("")), F.lit("</link><title>"), i["title"], F.lit("</title><pubDate>"), i["pubDate"], F.lit("</pubDate><kind>"), i["kind"], F.lit("</kind><id>"), i["id"], F.lit("</id></item>"))
    atom = lambda i: F.concat(F.lit('<entry><link href="'), F.coalesce(i["link"], F.lit("")), F.lit('"/><title>'), i["title"], F.lit("</title><updated>"), i["pubDate"], F.lit("</updated><id>"), i["id"], F.lit("</id></entry>"))
    joined = lambda make: F.array_join(F.transform("items", make), "")
    payload = (
        F.when(F.col("mode") == 0, text).when(F.col("mode") == 1, F.concat(F.lit('<html><script id="list" type="application/json">'), text, F.lit("</script></html>"))).when(F.col("mode") == 2, F.concat(F.lit("window.list = "), text, F.lit(";")))
        .when(F.col("mode") == 3, F.concat(F.lit("<rss><channel>"), joined(rss), F.lit("</channel></rss>"))).otherwise(F.concat(F.lit("<feed>"), joined(atom), F.lit("</feed>")))
    )
    return by.select("host", F.element_at(F.array(*map(F.lit, _MODES)), F.col("mode") + 1).alias("mode"), payload.alias("payload"))


def _read(listings: DataFrame) -> DataFrame:
    p = F.col("payload")
    parts = [
        listings.where("mode = 'json_endpoint'").withColumn("records", op.json_items(p, "data.items")), listings.where("mode = 'script_json'").withColumn("records", op.json_items(op.script_json(p, "list"), "data.items")),
        listings.where("mode = 'js_data_file'").withColumn("records", op.json_items(op.assigned_json(p, "window.list"), "data.items")), listings.where("mode in ('rss_endpoint', 'atom_endpoint')").withColumn("records", op.feed_items(p)),
    ]
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    return rows.select("host", "mode", F.posexplode("records").alias("place", "record"))


_LISTED = """h AS (SELECT page_id, regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1) AS host FROM pages), m AS (SELECT host, CAST(min(page_id) % 5 AS INT) AS mode FROM h GROUP BY 1),
 l AS (SELECT h.*, mode, CASE WHEN page_id % 6 <> 0 THEN '/a/' || page_id || CASE WHEN page_id % 10 = 0 THEN '.pdf' ELSE '' END END AS link, CASE WHEN page_id % 4 = 0 THEN 'advert' ELSE 'news' END AS kind, DATE '2024-01-01' + CAST(page_id % 300 AS INT) AS published_on FROM h JOIN m USING (host))"""


@query(f"WITH {_LISTED} SELECT host, ['json_endpoint','script_json','js_data_file','rss_endpoint','atom_endpoint'][mode + 1] AS mode, 'Title ' || page_id AS title, strftime(published_on, '%B %-d, %Y') AS published FROM l")
def structured_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of listings in five forms: JSON, JSON in a page's script, a script file's assignment, RSS and Atom."""
    return _read(_listings(spark, sf_dir)).select("host", "mode", F.col("record.title").alias("title"), F.col("record.pubDate").alias("published"))


@query(
    f"""WITH {_LISTED} SELECT host AS page, 'https://' || host || coalesce(link, '/made/' || page_id || '-' || kind) AS url, 'Title ' || page_id AS title, published_on FROM l
    WHERE mode < 4 AND kind = 'news' AND NOT (page_id % 10 = 0 AND page_id % 6 <> 0) AND NOT regexp_matches(coalesce(link, ''), '7$')"""
)
def listing_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of listed news: adverts, files and excluded addresses drop; where a record has no link one is made from its fields."""
    rows = _read(_listings(spark, sf_dir)).where("mode <> 'atom_endpoint'").select(F.col("host").alias("page"), "place", "record", F.concat(F.lit("https://"), "host", F.lit("/list")).alias("origin"))
    return op.listed_links(rows, "origin", ["example.com", "example.org", "example.net"], "/made/{id}-{kind}", include={"kind": "news"}, exclude={"id": "no such id"}, exclude_urls=["7$", r"\.pdf$"])


@query("WITH p AS (SELECT event_id, user_id, ts, CAST(event_id // 10 AS INT) AS page FROM events), d AS (SELECT *, max(ts) OVER (PARTITION BY page) AS latest FROM p), e AS (SELECT (999999 - page) AS n, ts FROM d) SELECT count(*) AS n_rows, min(ts) AS oldest FROM d WHERE page >= (SELECT max(page) FROM d WHERE latest < TIMESTAMP '2024-01-20')")
def descending_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events listed newest first, ten a page: reading stops with the first page that is older than the asked-for start."""
    rows = table(spark, sf_dir, "events").select("event_id", "ts", (-F.floor(F.col("event_id") / 10)).alias("page"), F.lit("events").alias("source"))
    kept = op.until_older(rows, "page", "ts", F.lit("2024-01-20").cast("timestamp"), ["source"])
    return kept.agg(F.count(F.lit(1)).alias("n_rows"), F.min("ts").alias("oldest"))


@query(
    """WITH p AS (SELECT p_partkey, p_brand, p_type, p_name FROM part), f AS (SELECT CAST(p_partkey // 50 AS INT) AS file, p_partkey % 97 AS car, p_partkey, p_brand, p_name FROM p), r AS (SELECT * FROM f WHERE file % 5 <> 3),
    u AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY car ORDER BY lpad(CAST(file AS VARCHAR), 6, '0'), p_partkey) = 1)
    SELECT CAST(car AS VARCHAR) AS car_id, p_brand AS manufacturer, 'series ' || file AS series_name, p_name AS model_name FROM u"""
)
def saved_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cars of saved JSON files, some of them broken, read from a folder; the first file that has a car keeps it."""
    part = table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 50).cast("int").alias("file"), "p_partkey", F.struct((F.col("p_partkey") % 97).cast("string").alias("car_id"), F.col("p_brand").alias("manufacturer"), F.col("p_name").alias("model_name")).alias("car"))
    by = part.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("p_partkey", "car"))).alias("cars"))  # fifty a file
    text = F.to_json(F.struct(F.lit(None).cast("string").alias("brand_name"), F.concat(F.lit("series "), F.col("file").cast("string")).alias("series_name"), F.transform("cars", lambda c: c["car"]).alias("cars")))
    broken = F.when(F.col("file") % 5 == 3, F.concat(F.lit("{"), F.substring(text, 1, 30))).otherwise(text)
    folder = files.scratch(spark, "saved")
    by.select(F.lpad(F.col("file").cast("string"), 6, "0").alias("series"), broken.alias("value")).write.partitionBy("series").text(folder)
    read = spark.read.text(folder, wholetext=True).select(F.concat(F.lit("series_"), F.lpad(F.col("series").cast("string"), 6, "0")).alias("path"), F.col("value").alias("text"))
    cars, _ = op.saved_cars(read)
    return cars


@query("SELECT p_type AS line, p_brand AS brand, p_name AS series, count(*) AS n FROM part WHERE p_brand IN ('Brand#1', 'Brand#2') GROUP BY ALL")
def nested_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The series of two brands, one of them asked for by another name, out of nested arrays of lines, brands and series."""
    part = table(spark, sf_dir, "part").groupBy("p_type", "p_brand", "p_name").agg(F.count(F.lit(1)).alias("n"))
    brands = part.groupBy("p_type", "p_brand").agg(F.collect_list(F.struct(F.col("p_name").alias("name"), "n")).alias("series"))
    documents = brands.groupBy("p_type").agg(F.to_json(F.struct(F.collect_list(F.struct(F.col("p_brand").alias("name"), "series")).alias("brands"))).alias("text"))
    names = F.create_map(F.lit("first brand"), F.lit("Brand#1"))
    asked = F.transform(F.array(F.lit("First  Brand"), F.lit("Brand#2")), lambda a: F.coalesce(names[F.lower(F.regexp_replace(F.trim(a), r"\s+", " "))], a))
    found = F.from_json(F.get_json_object("text", op.json_path("brands")), "array<struct<name:string,series:array<struct<name:string,n:bigint>>>>")
    kept = documents.select("p_type", F.explode(F.filter(found, lambda b: F.array_contains(asked, b["name"]))).alias("b"))
    return kept.select(F.col("p_type").alias("line"), F.col("b.name").alias("brand"), F.explode("b.series").alias("s")).select("line", "brand", F.col("s.name").alias("series"), F.col("s.n").alias("n"))


_FORMS = [
    ("yyyy-MM-dd", "%Y-%m-%d"), ("yyyyMMdd", "%Y%m%d"), ("yyyy'年'M'月'd'日'", "%Y年%-m月%-d日"), ("'Published 'MMMM d, yyyy", "Published %B %-d, %Y"), ("d MMM yyyy", "%-d %b %Y"),
    ("dd.MM.yy", "%d.%m.%y"), ("MM/dd/yyyy", "%m/%d/%Y"), ("'3 hours ago'", "3 hours ago"), ("'Wed 'MMM d' 00:01:00 CEST 'yyyy", ""), ("yyyy/M/d", "%Y/%-m/%-d"),
]


def _dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """o_orderkey, day and text: each order's date in one of ten ways."""
    day = F.to_date("o_orderdate")
    text = F.coalesce(*(F.when(F.col("o_orderkey") % 10 == k, F.date_format(day, form)) for k, (form, _) in enumerate(_FORMS)))
    return table(spark, sf_dir, "orders").select("o_orderkey", day.alias("day"), text.alias("text"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 7 OR (o_orderkey % 10 = 6 AND day(o_orderdate) <= 12) THEN NULL WHEN o_orderkey % 10 = 5 THEN CAST('20' || strftime(o_orderdate, '%y-%m-%d') AS DATE) ELSE CAST(o_orderdate AS DATE) END AS published_on FROM orders")
def publish_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The calendar date of each text; relative ones and ambiguous ones have none."""
    return _dated(spark, sf_dir).select("o_orderkey", dates.parse_publish_date(F.col("text")).alias("published_on"))


@query(
    """WITH o AS (SELECT o_orderkey, o_orderdate + INTERVAL 10 YEAR AS o_orderdate FROM orders) SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S+00:00') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.250000+00:00') WHEN 2 THEN strftime(o_orderdate - INTERVAL 8 HOUR, '%Y-%m-%dT%H:%M:%S+00:00')
    WHEN 3 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 4 THEN CASE WHEN day(o_orderdate) > 12 THEN strftime(o_orderdate, '%Y-%m-%d') END END AS published_at, strftime(o_orderdate, '%Y-%m-%d') AS hinted FROM o"""
)
def publish_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publication times as they are stored, of epochs, times with and without a zone, and numeric dates; and of numeric dates whose order is known."""
    at, kind = F.timestamp_add("YEAR", F.lit(10), F.col("o_orderdate")).cast("timestamp"), F.col("o_orderkey") % 6
    text = (
        F.when(kind == 0, F.unix_seconds(at).cast("string")).when(kind == 1, (F.unix_millis(at) + 250).cast("string")).when(kind == 2, F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+08:00")))
        .when(kind == 3, F.date_format(at, "yyyy-MM-dd HH:mm")).when(kind == 4, F.date_format(at, "dd/MM/yyyy")).otherwise("yesterday")
    )
    slashed = F.date_format(at, "dd/MM/yyyy")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text"), slashed.alias("slashed"))
    return rows.select("o_orderkey", dates.published_at(F.col("text")).alias("published_at"), dates.published_at(F.col("slashed"), "dd/MM/yyyy").alias("hinted"))


@query(
    """WITH l AS (SELECT user_id, event_type, max(ts) AS last_success FROM events WHERE event_id % 3 = 0 GROUP BY ALL), s AS (SELECT DISTINCT user_id, event_type FROM events)
    SELECT s.user_id, s.event_type, l.last_success IS NULL OR s.event_type = 'error' OR TIMESTAMP '2024-01-21' >= l.last_success + CASE s.event_type WHEN 'click' THEN INTERVAL 30 MINUTE WHEN 'view' THEN INTERVAL 6 HOUR ELSE INTERVAL 20 DAY END AS due FROM s LEFT JOIN l USING (user_id, event_type)"""
)
def due_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which sources are due: those without a success, and those whose frequency has passed since."""
    every = F.when(F.col("event_type") == "click", "30m").when(F.col("event_type") == "view", "6h").when(F.col("event_type") == "error", "sometimes").otherwise("20d")
    rows = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max(F.when(F.col("event_id") % 3 == 0, F.col("ts"))).alias("last_success"))
    return rows.select("user_id", "event_type", dates.is_due(F.col("last_success"), every, F.lit("2024-01-21").cast("timestamp")).alias("due"))


@query(
    """WITH k AS (SELECT user_id, event_type, date_trunc('hour', ts) AS hour, min(event_id) AS first_event FROM events WHERE event_id % 2 = 0 GROUP BY ALL), m AS (SELECT user_id, event_type, date_trunc('hour', ts) AS hour FROM events GROUP BY ALL)
    SELECT 1 AS run, count(*) AS n_added FROM k UNION ALL SELECT 2, (SELECT count(*) FROM m) - (SELECT count(*) FROM k)"""
)
def repeated_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of three runs of one stream has added to its store: the second sees old rows again, the third nothing new."""
    return stream.repeated_runs(spark, table(spark, sf_dir, "events"))


_TICKS = ["2024-01-01 00:10:00", "2024-01-01 02:40:00", "2024-01-01 03:50:00", "2024-01-01 11:20:00", "2024-01-01 12:30:00"]
_HOUR = 3_600_000


@query(
    "WITH RECURSIVE t(k, ms) AS (VALUES " + ", ".join(f"({k}, epoch_ms(TIMESTAMP '{t}'))" for k, t in enumerate(_TICKS)) + f"""), u AS (SELECT DISTINCT user_id, (user_id % 5 + 1) * {_HOUR} AS every, user_id % 3 * 4 * {_HOUR} AS takes FROM events),
    s(k, user_id, every, takes, now, set_for, due, busy, fires, skipped) AS (SELECT 0, user_id, every, takes, ms, 0::BIGINT, (ms // every + 1) * every, -1::BIGINT, false, false FROM u, t WHERE k = 0
      UNION ALL SELECT t.k, user_id, every, takes, t.ms, due, CASE WHEN due <= t.ms THEN (t.ms // every + 1) * every ELSE due END, CASE WHEN due <= t.ms AND busy <= t.ms THEN t.ms + takes ELSE busy END, due <= t.ms, busy > t.ms FROM s JOIN t ON t.k = s.k + 1)
    SELECT CAST(user_id AS VARCHAR) AS source, make_timestamp(set_for * 1000) AS due, make_timestamp(now * 1000) AS fired, skipped FROM s WHERE fires"""
)
def source_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The triggers of a source for each user by a replayed clock: late ones coalesce, and one that comes during a run is skipped."""
    path = files.scratch(spark, "ticks")
    users = files.written(table(spark, sf_dir, "events").select("user_id").distinct(), "users")  # found once, not for every moment
    for t in _TICKS:
        rows = users.select(F.col("user_id").cast("string").alias("source"), F.lit(t).cast("timestamp").alias("ts"), ((F.col("user_id") % 5 + 1) * _HOUR).alias("every_ms"), (F.col("user_id") % 3 * 4 * _HOUR).alias("takes_ms"))
        rows.coalesce(1).write.mode("append").parquet(path)  # a moment of the clock is one file
    return timers.triggers(spark, path)


@query(
    """WITH RECURSIVE w(user_id, starts) AS (SELECT user_id, min(ts) FROM events GROUP BY 1 UNION ALL SELECT w.user_id, min(e.ts) FROM w JOIN events e ON e.user_id = w.user_id AND e.ts >= w.starts + INTERVAL 6 HOUR GROUP BY w.user_id, w.starts)
    SELECT CAST(e.user_id AS VARCHAR) AS caller, event_id AS call, row_number() OVER (PARTITION BY e.user_id, starts ORDER BY ts, event_id) AS n, row_number() OVER (PARTITION BY e.user_id, starts ORDER BY ts, event_id) <= 3 AS allowed
    FROM events e JOIN w ON w.user_id = e.user_id AND e.ts >= starts AND e.ts < starts + INTERVAL 6 HOUR"""
)
def limited_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a call of its user, three allowed in six hours from the first one; then the counter expires."""
    path = files.scratch(spark, "calls")
    table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("caller"), F.col("event_id").alias("call"), "ts").write.parquet(path)
    return timers.limited_calls(spark, path, 3, 6 * _HOUR)
