"""Queries over pages and events: canonical URLs, links, content hashes, merges, run reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.functions import urls
from tidegrid.operators.merge import merge_articles, newest
from tidegrid.plans.registry import query
from tidegrid.sources import files
from tidegrid.sources.tables import table

_CANON = """lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) || '://' || lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]+)', 1))
  || CASE WHEN regexp_replace(regexp_extract(url, '^[A-Za-z]+://[^/?#]+([^?#]*)', 1), '/+$', '') = '' THEN '/' ELSE regexp_replace(regexp_extract(url, '^[A-Za-z]+://[^/?#]+([^?#]*)', 1), '/+$', '') END
  || CASE WHEN len(q) > 0 THEN '?' || array_to_string(list_transform(q, lambda x: CASE WHEN contains(x, '=') THEN x ELSE x || '=' END), '&') ELSE '' END"""
_PAGES = f"""p AS (SELECT page_id, {_CANON} AS url, html FROM (SELECT *, list_filter(string_split(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '&'),
  lambda x: x <> '' AND lower(string_split(x, '=')[1]) NOT IN ('spm','from','source','ref','referrer','gclid','fbclid') AND NOT starts_with(lower(x), 'utm_')) AS q FROM pages)),
  h AS (SELECT page_id, url, sha256(lower(trim(regexp_replace(regexp_extract(html, '<title>(.*?)</title>', 1) || chr(10) || regexp_extract(html, '<h1>(.*?)</h1>', 1), '\\s+', ' ', 'g')))) AS content_hash FROM p)"""


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, canonical url, title and content_hash (of title and headline)."""
    title, head = F.regexp_extract("html", r"<title>(.*?)</title>", 1), F.regexp_extract("html", r"<h1>(.*?)</h1>", 1)
    return table(spark, sf_dir, "pages").select("page_id", urls.canonical_url(F.col("url")).alias("url"), title.alias("title"), urls.content_hash(title, head).alias("content_hash"))


@query(f"WITH {_PAGES} SELECT page_id, url FROM p")
def url_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", "url")


@query(
    """WITH l AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS link FROM pages),
    a AS (SELECT page_id, CASE WHEN starts_with(link, '/') THEN regexp_extract(url, '^([A-Za-z]+://[^/?#]+)', 1) || link ELSE link END AS link FROM l)
    SELECT DISTINCT page_id, link FROM a WHERE regexp_matches(lower(regexp_extract(link, '^[A-Za-z]+://([^/?#:]+)', 1)), '(^|[.])example[.](com|org)$') AND NOT regexp_matches(lower(regexp_extract(link, '^[A-Za-z]+://[^/?#]+([^?#]*)', 1)), '[.](jpg|jpeg|png|gif|webp|svg|pdf|zip|rar|7z|doc|docx|xls|xlsx)$')"""
)
def link_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct links of each page that stay on two domains and lead to pages."""
    rows = table(spark, sf_dir, "pages").select("page_id", "url", F.explode(urls.links(F.col("html"))).alias("link"))
    rows = rows.select("page_id", urls.absolute(F.col("link"), F.col("url")).alias("link")).distinct()
    return rows.where(urls.is_allowed(F.col("link"), ["example.com", ".example.org"]) & urls.is_page(F.col("link")))


@query(f"WITH {_PAGES} SELECT content_hash, min(page_id) AS first_page, count(*) AS n_pages FROM h GROUP BY 1")
def content_hash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).groupBy("content_hash").agg(F.min("page_id").alias("first_page"), F.count(F.lit(1)).alias("n_pages"))


@query(
    f"""WITH RECURSIVE {_PAGES}, v AS (SELECT page_id * 3 + k AS place, url, CASE WHEN page_id % 7 = 0 AND k = 2 THEN NULL WHEN (page_id + k) % 4 = 1 THEN content_hash ELSE sha256(content_hash || CAST((page_id + k) % 4 AS VARCHAR)) END AS content_hash, (page_id + k) % 5 <> 0 AS has_content FROM h, (VALUES (0), (1), (2)) t(k)),
    s AS (SELECT url, content_hash FROM h WHERE page_id % 3 = 0 QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id) = 1),
    q AS (SELECT *, row_number() OVER (ORDER BY place) AS turn FROM v),
    m(turn, place, url, content_hash, operation, store) AS (
      SELECT CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), (SELECT map(list(url), list(content_hash)) FROM s)
      UNION ALL SELECT turn, place, url, content_hash, operation, CASE WHEN operation IN ('update', 'insert') THEN map_concat(store, map([url], [content_hash])) ELSE store END
      FROM (SELECT q.turn, q.place, q.url, q.content_hash, m.store, CASE WHEN list_contains(map_keys(m.store), q.url) THEN CASE WHEN m.store[q.url] IS NOT DISTINCT FROM q.content_hash THEN 'duplicate_url' ELSE 'update' END
        WHEN coalesce(list_contains(map_values(m.store), q.content_hash), false) THEN 'duplicate_content' WHEN q.has_content THEN 'insert' ELSE 'skipped' END AS operation FROM m JOIN q ON q.turn = m.turn + 1))
    SELECT place, url, content_hash, operation FROM m WHERE turn > 0"""
)
def news_merge_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three crawls of every page, their texts changing, merged into a store of a third of the pages."""
    pages, k = _pages(spark, sf_dir).select("page_id", "url", "content_hash"), F.col("page_id") + F.col("k")
    stored = newest(pages.where("page_id % 3 = 0"), ["url"], [F.col("page_id")]).select("url", "content_hash")
    versions = pages.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    changed = F.when((F.col("page_id") % 7 == 0) & (F.col("k") == 2), None).when(k % 4 == 1, F.col("content_hash")).otherwise(F.sha2(F.concat("content_hash", (k % 4).cast("string")), 256))
    crawled = versions.select((F.col("page_id") * 3 + F.col("k")).alias("place"), "url", changed.alias("content_hash"), (k % 5 != 0).alias("has_content"))
    return merge_articles(stored, crawled)


_STATUS = "CASE WHEN event_id % 41 = 0 THEN 'unknown_time' WHEN ts < TIMESTAMP '2024-01-03' THEN 'before_start' WHEN ts >= TIMESTAMP '2024-01-20' THEN 'after_end' WHEN event_type = 'error' THEN 'failed' WHEN event_id % 7 = 0 THEN 'duplicate' ELSE 'success' END"


def _statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts")
    status = (
        F.when(F.col("event_id") % 41 == 0, "unknown_time").when(ts < F.lit("2024-01-03").cast("timestamp"), "before_start").when(ts >= F.lit("2024-01-20").cast("timestamp"), "after_end")
        .when(F.col("event_type") == "error", "failed").when(F.col("event_id") % 7 == 0, "duplicate").otherwise("success")
    )
    return table(spark, sf_dir, "events").select(F.date_trunc("day", ts).alias("run"), "event_id", "event_type", status.alias("status"))


@query(
    f"""WITH e AS (SELECT date_trunc('day', ts) AS run, {_STATUS} AS status FROM events), c AS (SELECT run, count(*) FILTER (status <> 'duplicate') AS requested, count(*) FILTER (status = 'success') AS success, count(*) FILTER (status = 'duplicate') AS duplicates, count(*) FILTER (status = 'failed') AS failed,
      count(*) FILTER (status IN ('before_start', 'after_end')) AS out_of_range, count(*) FILTER (status = 'unknown_time') AS unknown_time FROM e GROUP BY 1)
    SELECT *, CASE WHEN requested + duplicates > 0 THEN round_even((success + duplicates) / (requested + duplicates), 6) ELSE 0 END AS coverage FROM c"""
)
def run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily runs: what came through, was known already, failed, or lies outside the asked-for time.

    Coverage counts duplicates as asked for and as covered, rounded half to even."""
    n = lambda *names: F.count_if(F.col("status").isin(*names))
    rows = _statuses(spark, sf_dir).groupBy("run").agg(F.count_if(F.col("status") != "duplicate").alias("requested"), n("success").alias("success"), n("duplicate").alias("duplicates"), n("failed").alias("failed"), n("before_start", "after_end").alias("out_of_range"), n("unknown_time").alias("unknown_time"))
    covered, asked = F.col("success") + F.col("duplicates"), F.col("requested") + F.col("duplicates")
    return rows.withColumn("coverage", F.when(asked > 0, F.bround(covered / asked, 6)).otherwise(0.0))


@query(f"SELECT CAST(date_trunc('day', ts) AS DATE) AS run, count(*) AS n_failures, min(event_id) AS first_failure, 'failed' AS reason FROM events WHERE ({_STATUS}) = 'failed' GROUP BY 1")
def run_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The failures of each run, written beside its report under the run's key and read back."""
    failures = _statuses(spark, sf_dir).where("status = 'failed'").select(F.col("run").cast("date").alias("run"), "event_id", F.col("status").alias("reason"))
    path = files.scratch(spark, "failures")
    failures.write.partitionBy("run").parquet(path)
    return spark.read.parquet(path).groupBy("run", "reason").agg(F.count(F.lit(1)).alias("n_failures"), F.min("event_id").alias("first_failure"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS INT) >= 90 AND event_type <> 'error'")
def json_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records chosen by a field inside their JSON; broken JSON has no field."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").where("event_type <> 'error'").select("event_id", k.alias("k")).where("k >= 90")


@query(
    """WITH m AS (SELECT doc_id, list_filter(['the', 'ein', 'que', 'est'], lambda k: contains(lower(text), k)) AS matched FROM documents)
    SELECT doc_id, array_to_string(matched, ',') AS matched, len(matched) = 4 AS matches_all FROM m WHERE list_contains(matched, 'ein') AND len(matched) > 0"""
)
def keyword_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keywords that each text holds, kept where a JSON list of them holds one in particular."""
    keys = F.array(*(F.lit(k) for k in ("the", "ein", "que", "est")))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("low"))
    rows = rows.select("doc_id", F.to_json(F.filter(keys, lambda k: F.contains(F.col("low"), k))).alias("stored"))
    matched = F.from_json("stored", "array<string>")
    return rows.where(F.array_contains(matched, "ein")).select("doc_id", F.array_join(matched, ",").alias("matched"), (F.size(matched) == 4).alias("matches_all"))


@query(
    """WITH f AS (SELECT page_id, regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1) AS host, regexp_extract(url, '^[A-Za-z]+://[^/?#]+([^?#]*)', 1) AS path FROM pages)
    SELECT path, page_id, host FROM f QUALIFY row_number() OVER (PARTITION BY path ORDER BY page_id % 5, page_id) = 1"""
)
def feed_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five feeds one after another; the first that lists a path keeps it."""
    path = F.regexp_extract("url", r"^[A-Za-z]+://[^/?#]+([^?#]*)", 1)
    rows = table(spark, sf_dir, "pages").select("page_id", urls.host(F.col("url")).alias("host"), path.alias("path"))
    return newest(rows, ["path"], [F.col("page_id") % 5, F.col("page_id")]).select("path", "page_id", "host")


@query(
    "WITH m AS (SELECT doc_id, list_filter(['The', 'ein', 'que', 'est'], lambda k: contains(lower(coalesce(text, '')), lower(k))) AS matched FROM documents)"
    " SELECT doc_id, nullif(array_to_string(matched, ','), '') AS matched, len(matched) > 0 AS any_of, len(matched) = 4 AS all_of, true AS off FROM m"
)
def keyword_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keywords of each text, and whether it passes a gate of each mode."""
    from tidegrid.operators.text import keyword_gate as gate

    words = ["The", "ein", "que", "est"]
    (matched, some), (_, every), (_, off) = (gate(F.col("text"), words, mode) for mode in ("any", "all", "off"))
    return table(spark, sf_dir, "documents").select("doc_id", F.when(F.size(matched) > 0, F.array_join(matched, ",")).alias("matched"), some.alias("any_of"), every.alias("all_of"), off.alias("off"))
