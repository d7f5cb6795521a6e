"""Keyed merges, latest rows, access rules and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.sources.files import written


def newest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by ``order``."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_place", place).where("_place = 1").drop("_place")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], fields: list[str], first_seen: str, last_seen: str) -> DataFrame:
    """A type-1 merge with ``operation``: insert, update, existing (equal fields, null-safely) or kept.

    The first sight of a key stays, its last one moves on; one row a key on either side."""
    o = old.select(*keys, *(F.col(c).alias(f"o_{c}") for c in (*fields, first_seen, last_seen)), F.lit(True).alias("in_old"))
    n = new.select(*keys, *(F.col(c).alias(f"n_{c}") for c in (*fields, first_seen, last_seen)), F.lit(True).alias("in_new"))
    joined = o.join(n, keys, "full")
    same = F.lit(True)
    for c in fields:
        same = same & F.col(f"o_{c}").eqNullSafe(F.col(f"n_{c}"))
    operation = F.when(F.col("in_old").isNull(), "insert").when(F.col("in_new").isNull(), "kept").when(same, "existing").otherwise("update")
    pick = lambda c: F.when(F.col("in_new").isNull(), F.col(f"o_{c}")).otherwise(F.col(f"n_{c}"))
    return joined.select(
        *keys, *(pick(c).alias(c) for c in fields), F.coalesce(f"o_{first_seen}", f"n_{first_seen}").alias(first_seen), F.coalesce(f"n_{last_seen}", f"o_{last_seen}").alias(last_seen), operation.alias("operation")
    )


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The old rows, and of the new ones with an unknown key the first each."""
    return old.unionByName(newest(new.join(old.select(*keys), keys, "left_anti"), keys, order))


def role_allows(roles: Column, mine: list[str], admin: bool = False) -> Column:
    """Open when the comma-separated list is null or empty, or shares a role."""
    if admin:
        return F.lit(True)
    listed = F.transform(F.split(roles, ","), lambda r: F.trim(r))
    return roles.isNull() | (F.trim(roles) == "") | F.arrays_overlap(listed, F.array(*(F.lit(m) for m in mine)))


def data_scope(scopes: list[tuple[str, object]], dept: Column, ancestors: Column, owner: Column) -> Column:
    """The OR of a user's scopes: all; custom (departments); dept; dept_and_child; self. None at all allows nothing."""
    out = F.lit(False)
    for kind, value in scopes:
        if kind == "all":
            return F.lit(True)
        if kind == "custom":
            out = out | dept.isin(list(value))
        elif kind == "dept":
            out = out | (dept == value)
        elif kind == "dept_and_child":
            out = out | (dept == value) | F.array_contains(F.split(ancestors, ","), str(value))
        elif kind == "self":
            out = out | (owner == value)
    return out


def page(rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """A page of the ordered rows with the count of all."""
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return rows.orderBy(*order).offset((number - 1) * size).limit(size).crossJoin(total)  # a page and one row


#: Ranges of places that the rows of one hash are divided into.
RANGES = 64


def _held(events: DataFrame) -> DataFrame:
    """The asking events (place, content_hash, delta, ask) with ``held``: whether the deltas of their hash before them sum up to more than none.

    A hash may be that of any share of the rows: sums run within ranges of places, and over the ranges' sums."""
    ends = events.agg(F.min("place").alias("low"), F.max("place").alias("high")).first()
    low, width = ends["low"] or 0, max(1, -(-((ends["high"] or 0) - (ends["low"] or 0) + 1) // RANGES))
    events = events.withColumn("range", F.floor((F.col("place") - low) / width).cast("int"))
    ranges = events.groupBy("content_hash", "range").agg(F.sum("delta").alias("sum"))  # at most ``RANGES`` rows a hash
    before = F.sum("sum").over(Window.partitionBy("content_hash").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    ranges = ranges.select("content_hash", "range", F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.sum("delta").over(Window.partitionBy("content_hash", "range").orderBy("place", F.desc("ask")).rowsBetween(Window.unboundedPreceding, -1))
    rows = events.withColumn("inside", F.coalesce(inside, F.lit(0))).where("ask").join(ranges, ["content_hash", "range"])
    return rows.select("place", (F.col("before") + F.col("inside") > 0).alias("held"))


def merge_articles(stored: DataFrame, crawled: DataFrame) -> DataFrame:
    """url, content_hash, place and operation of crawled rows (url, content_hash, place, has_content) against stored
    (url, content_hash), as if they came one by one in the order of ``place`` (distinct whole numbers).

    A url that is stored, or that an earlier row has inserted, is known: a row of it is duplicate_url where its hash is that
    of the url's last row (nulls equal), else an update, and its hash replaces the url's. Another row is duplicate_content
    where a known url has its hash at that time; else it is an insert, or skipped without content.

    Which urls are known depends on the hashes held before, and these on the urls known before. Both are computed for all
    rows from what the round before says of the inserts, until that stays as it is; each round settles the rows that depend
    on the ones that are settled, so there are few rounds. Rows without a hash take no part in sums by hash."""
    urls = stored.select("url", F.col("content_hash").alias("old_hash"), F.lit(True).alias("in_store"))
    by_url = Window.partitionBy("url").orderBy("place")
    rows = crawled.join(urls, "url", "left").withColumns({
        "first_of_url": F.row_number().over(by_url) == 1, "last_hash": F.lag("content_hash").over(by_url), "next_place": F.lead("place").over(by_url),
    })
    rows = written(rows.withColumn("in_store", F.col("in_store").isNotNull()), "crawled")
    first = crawled.agg(F.min("place")).first()[0] or 0
    starts = rows.where("in_store and first_of_url").select(F.col("place").alias("until"), F.col("old_hash").alias("content_hash"))
    alone = stored.join(crawled.select("url").distinct(), "url", "left_anti").select(F.lit(None).cast("long").alias("until"), "content_hash")
    event = lambda d, place, delta, ask=False: d.select(place.cast("long").alias("place"), "content_hash", F.lit(delta).alias("delta"), F.lit(ask).alias("ask"))
    old = starts.unionByName(alone).where("content_hash is not null")
    fixed = event(old, F.lit(first - 1), 1).unionByName(event(old.where("until is not null"), F.col("until"), -1)).unionByName(event(rows.where("not in_store and content_hash is not null"), F.col("place"), 0, True))
    inserts = written(rows.where("not in_store and has_content").groupBy("url").agg(F.min("place").alias("inserted")), "inserts")
    while True:
        known = rows.join(inserts, "url", "left").where("content_hash is not null and (in_store or place >= inserted)")
        events = fixed.unionByName(event(known, F.col("place"), 1)).unionByName(event(known.where("next_place is not null"), F.col("next_place"), -1))
        asked = written(_held(events), "held")
        fresh = rows.where("not in_store and has_content").join(asked, "place", "left").where("not coalesce(held, false)")
        new = written(fresh.groupBy("url").agg(F.min("place").alias("inserted")), "inserts")
        same = new.join(inserts, ["url", "inserted"], "left_semi").count() == new.count() == inserts.count()
        inserts = new
        if same:
            break
    rows = rows.join(inserts, "url", "left").join(asked, "place", "left")
    url_known = F.col("in_store") | F.coalesce(F.col("place") > F.col("inserted"), F.lit(False))
    last = F.when(F.col("first_of_url"), F.col("old_hash")).otherwise(F.col("last_hash"))
    operation = (
        F.when(url_known & F.col("content_hash").eqNullSafe(last), "duplicate_url").when(url_known, "update")
        .when(F.coalesce("held", F.lit(False)), "duplicate_content").when(F.col("has_content"), "insert").otherwise("skipped")
    )
    return rows.select("url", "content_hash", "place", operation.alias("operation"))


def with_children_totals(leaves: DataFrame, parents: DataFrame) -> DataFrame:
    """node, height and value of a tree: leaves (node, parent, value) and inner nodes (node, parent); a value is the sum of what lies below.

    One join and one aggregate a level, up from the leaves, each level a written table. A path can't be longer
    than there are inner nodes: parents that form a circle are reported by an error."""
    level = leaves.groupBy("parent").agg(F.sum("value").alias("value")).withColumnRenamed("parent", "node")
    level = written(level, "level")
    out, height, most = level.select("node", "value", F.lit(1).alias("height")), 1, parents.count()
    while True:
        up = written(level.join(parents, "node").where("parent is not null").groupBy("parent").agg(F.sum("value").alias("value")).withColumnRenamed("parent", "node"), "level")
        if up.isEmpty():
            return out
        height += 1
        if height > most + 1:
            raise ValueError("the parents form a circle")
        out, level = out.unionByName(up.select("node", "value", F.lit(height).alias("height"))), up


def promoted(current: DataFrame, candidates: DataFrame, key: str) -> DataFrame:
    """``current`` (key, version, hash) with each pointer moved to its newest candidate, where that one is ready, newer
    than what the pointer names and of other content: key, version, hash, moved. Keys without a pointer get one."""
    ready = candidates.where("ready").groupBy(key).agg(F.max(F.struct("version", "hash")).alias("new"))
    both = current.select(key, F.col("version").alias("old_version"), F.col("hash").alias("old_hash")).join(ready, key, "full")
    moves = F.col("new").isNotNull() & (F.col("old_version").isNull() | ((F.col("new.version") > F.col("old_version")) & ~F.col("new.hash").eqNullSafe(F.col("old_hash"))))
    pick = lambda new, old: F.when(F.col("moved"), F.col(new)).otherwise(F.col(old))
    return both.withColumn("moved", moves).select(key, pick("new.version", "old_version").alias("version"), pick("new.hash", "old_hash").alias("hash"), "moved")
