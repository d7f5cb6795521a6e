"""Listings of articles as publishers offer them: JSON, JSON in scripts, assignments in script files, feeds, saved results."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.functions import urls
from tidegrid.functions.dates import parse_publish_date

ITEM = "struct<link:string,title:string,pubDate:string,kind:string,id:string>"
_RSS = f"struct<channel:struct<item:array<{ITEM}>>>"
_ATOM = "struct<entry:array<struct<link:struct<_href:string>,title:string,published:string,updated:string,id:string>>>"


def json_path(path: str) -> str:
    """a.0.b and a[0].b as a JSON path; only names and places, no expressions."""
    parts = re.sub(r"\[(\d+)\]", r".\1", path).split(".")
    if not all(re.fullmatch(r"\w+", p) for p in parts):
        raise ValueError(f"not a plain path: {path}")
    return "$" + "".join(f"[{p}]" if p.isdigit() else f".{p}" for p in parts)


def script_json(html: Column, element_id: str) -> Column:
    """The JSON text of a page's script element."""
    return F.nullif(F.regexp_extract(html, rf'(?s)<script[^>]*\bid="{re.escape(element_id)}"[^>]*>(.*?)</script>', 1), F.lit(""))


def assigned_json(script: Column, name: str) -> Column:
    """The JSON text that a script file assigns to a name."""
    return F.nullif(F.regexp_extract(script, rf"(?s)^\s*{re.escape(name)}\s*=\s*(.*?)\s*;?\s*$", 1), F.lit(""))


def json_items(text: Column, path: str, schema: str = ITEM) -> Column:
    """The records of the array at a path; null where there is none or the text isn't JSON."""
    return F.from_json(F.get_json_object(text, json_path(path)), f"array<{schema}>")


def feed_items(xml: Column) -> Column:
    """The items of an RSS feed or, without any, the entries of an Atom feed, as records of link, title, pubDate and id."""
    options = {"mode": "PERMISSIVE"}
    rss = F.from_xml(xml, _RSS, options)["channel"]["item"]
    atom = F.transform(F.from_xml(xml, _ATOM, options)["entry"], lambda e: F.struct(e["link"]["_href"].alias("link"), e["title"].alias("title"), F.coalesce(e["published"], e["updated"]).alias("pubDate"), F.lit(None).cast("string").alias("kind"), e["id"].alias("id")))
    return F.coalesce(F.when(F.size(rss) > 0, rss), atom)


def formatted(template: str, record: Column) -> Column:
    """A template with the fields of a record (a struct) at its {names}; null where one is missing."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*(record[p].cast("string") if i % 2 else F.lit(p) for i, p in enumerate(parts) if p))


def listed_links(records: DataFrame, base: str, domains: list[str], template: str | None = None, include: dict[str, str] | None = None, exclude: dict[str, str] | None = None, exclude_urls: list[str] | None = None) -> DataFrame:
    """url, title and published_on of each record (columns ``page``, ``place``, ``record`` and the page's address ``base``) that passes; of one url of a page the first.

    A record passes with all fields of ``include`` and none of ``exclude``, a link (or all fields of ``template``) that
    no pattern excludes, on one of the domains, and not to a file."""
    r = F.col("record")
    keep = F.lit(True)
    for name, value in (include or {}).items():
        keep = keep & (r[name].cast("string") == value)
    for name, value in (exclude or {}).items():
        keep = keep & ~r[name].cast("string").eqNullSafe(F.lit(value))
    link = F.nullif(F.trim(r["link"]), F.lit(""))
    link = F.coalesce(link, formatted(template, r)) if template else link
    rows = records.where(F.coalesce(keep, F.lit(False))).select("page", "place", base, link.alias("link"), r["title"].alias("title"), r["pubDate"].alias("pubDate")).where("link is not null")
    for pattern in exclude_urls or []:
        rows = rows.where(~F.col("link").rlike(pattern))
    rows = rows.withColumn("url", urls.canonical_url(urls.absolute(F.col("link"), F.col(base))))
    rows = rows.where(F.col("url").isNotNull() & urls.is_allowed(F.col("url"), domains) & urls.is_page(F.col("url")))
    first = F.row_number().over(Window.partitionBy("page", "url").orderBy("place"))
    return rows.withColumn("nth", first).where("nth = 1").select("page", "url", "title", parse_publish_date(F.col("pubDate")).alias("published_on"))


def saved_cars(files: DataFrame, brand: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The cars of saved result files (path, text), and how many files were read and skipped.

    A file without JSON or without cars is skipped. Of one car_id the first file's record counts; a file of another
    brand gives nothing."""
    car = "struct<car_id:string,manufacturer:string,model_name:string>"
    parsed = files.select("path", F.from_json("text", f"brand_name string, series_name string, cars array<{car}>", {"mode": "PERMISSIVE"}).alias("p"))
    counts = parsed.agg(F.count_if(F.col("p.cars").isNotNull()).alias("n_read"), F.count_if(F.col("p.cars").isNull()).alias("n_skipped"))
    rows = parsed.where(F.col("p.cars").isNotNull())
    if brand is not None:
        rows = rows.where(F.col("p.brand_name").isNull() | (F.col("p.brand_name") == brand))
    rows = rows.select("path", "p.series_name", F.posexplode("p.cars").alias("place", "car")).where("trim(coalesce(car.car_id, '')) <> ''")
    first = F.row_number().over(Window.partitionBy("car.car_id").orderBy("path", "place"))
    return rows.withColumn("nth", first).where("nth = 1").select("car.car_id", "car.manufacturer", "series_name", "car.model_name"), counts


def until_older(rows: DataFrame, page: str, when: str, start: Column, by: list[str]) -> DataFrame:
    """The rows of a listing in falling order up to the first page that lies before ``start`` as a whole, with it.

    Pages without a date don't end it."""
    pages = rows.groupBy(*by, page).agg(F.max(when).alias("_latest"), F.count_if(F.col(when).isNull()).alias("_undated"))
    ends = pages.where((F.col("_latest") < start) & (F.col("_undated") == 0)).groupBy(*by).agg(F.min(page).alias("_last"))
    return rows.join(ends, by, "left").where(F.col("_last").isNull() | (F.col(page) <= F.col("_last"))).drop("_last")
