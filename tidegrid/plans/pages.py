"""The parts of crawled pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.operators import pages as op
from tidegrid.plans.registry import query
from tidegrid.sources.tables import table

_PLAIN = "regexp_replace({}, '<[^>]*>', ' ', 'g')"
for _entity, _char in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&#x27;", "''"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
    _PLAIN = f"replace({_PLAIN}, '{_entity}', '{_char}')"
_PLAIN = f"trim(regexp_replace({_PLAIN}, '\\s+', ' ', 'g'))"


@query(
    f"""WITH a AS (SELECT page_id, html, regexp_extract(html, '(?s)<article>(.*?)</article>', 1) AS article FROM pages), p AS (SELECT page_id, html, [x for x in [{_PLAIN.format("y")} for y in regexp_split_to_array(article, '</?p>')[2:]] if x <> ''] AS texts FROM a)
    SELECT page_id, {_PLAIN.format("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")} AS title, len(texts) AS n_paragraphs, sha256(array_to_string(texts, chr(10))) AS content_sha256, CASE WHEN page_id % 4 = 1 AND len(list_distinct(texts)) < 2 THEN 'VIDEO' END AS kind,
    CASE page_id % 3 WHEN 0 THEN DATE '2024-03-01' + CAST(page_id % 20 AS INT) WHEN 1 THEN DATE '2024-05-07' END AS published FROM p"""
)
def page_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title, paragraphs, kind and date of every page; a third names its date in its head, a third in its text, a quarter shows a video."""
    day = F.date_format(F.date_add(F.lit("2024-03-01").cast("date"), (F.col("page_id") % 20).cast("int")), "yyyy-MM-dd")
    named = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit('<meta name="source" content="x"><META NAME=pubdate content="'), day, F.lit('">'))).otherwise("")
    said = F.when(F.col("page_id") % 3 == 1, "<div>Published on 7 May 2024 by us</DIV>").otherwise("")
    video = F.when(F.col("page_id") % 4 == 1, '<div class="main-video"><p></div>').otherwise("")
    html = F.replace(F.replace(F.col("html"), F.lit("<title>"), F.concat(named, F.lit("<title>"))), F.lit("<body>"), F.concat(F.lit("<body>"), said, video))
    parts = op.page_parts(table(spark, sf_dir, "pages").select("page_id", html.alias("html")), "page_id", "html")
    texts = F.filter(F.split("content", "\n"), lambda x: x != "")
    return parts.select("page_id", "title", F.size(texts).cast("long").alias("n_paragraphs"), F.sha2("content", 256).alias("content_sha256"), "kind", op.published_on(F.col("dates")).alias("published"))
