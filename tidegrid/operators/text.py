"""Chunks, searches, facts, entities and evidence over documents."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.functions.arrays import holding


def cut_points(text: str, size: int, overlap: int) -> list[tuple[int, int]]:
    """Windows of a text: each ``size`` long, shortened (or lengthened by one) to the last line or sentence end past
    its half if there is one, and starting ``overlap`` before the end of the one before.

    Where lines and sentences end is looked up in one sorted list."""
    ends = [m.end() for m in re.finditer("[\n。]", text)]
    out: list[tuple[int, int]] = []
    at = 0
    while not out or out[-1][1] < len(text):
        stop = at + size
        if stop < len(text):
            k = bisect_right(ends, stop + 1) - 1
            stop = ends[k] if k >= 0 and ends[k] > at + size // 2 + 1 else stop
        out.append((at, min(stop, len(text))))
        at = max(at + 1, out[-1][1] - overlap)
    return out


def plain_lines(text: Column) -> Column:
    """Runs of tabs and carriage returns and null characters as one space, no spaces around line ends, two line ends
    in a row at most, single spaces, trimmed; null as empty."""
    out = F.coalesce(text, F.lit(""))
    for pattern, by in (("\u0000", " "), (r"[\t\x0B\f\r]+", " "), (r" *\n *", "\n"), (r"\n{3,}", "\n\n"), (" {2,}", " "), (r"^[\x00-\x20]+|[\x00-\x20]+$", "")):
        out = F.regexp_replace(out, pattern, by)
    return out


def fixed_chunks(docs: DataFrame, size: int = 1200, overlap: int = 120) -> DataFrame:
    """doc_id, chunk_no, start and content (trimmed, blank ones left out) of every text.

    Each cut depends on the one before, so a Python function finds them; it sees batches and shuffles nothing."""
    docs = docs.select("doc_id", plain_lines(F.col("text")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                kept = [(a, text[a:b].strip()) for a, b in cut_points(text or "", size, overlap)]
                rows += [(doc, k, a, c) for k, (a, c) in enumerate(x for x in kept if x[1])]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.string()), strict=True)], names=["doc_id", "chunk_no", "start", "content"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, chunk_no int, start int, content string")


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, line_no (from 0) and line of every text."""
    return docs.where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def bigram_score(text: Column, question: str) -> Column:
    """How many of the question's character pairs a text holds, 100 more for the whole of it, 30 for its first word.

    A full-text engine's own score isn't reproducible; this one is."""
    q = question.lower()
    pairs = sorted({q[i : i + 2] for i in range(len(q) - 1) if " " not in q[i : i + 2]})
    low = F.lower(text)
    score = sum((F.contains(low, F.lit(p)).cast("int") for p in pairs), F.lit(0))
    return score + F.contains(low, F.lit(q)).cast("int") * 100 + F.contains(low, F.lit(q.split()[0])).cast("int") * 30


def rare_term_sources(docs: DataFrame, source: str, terms: list[str]) -> DataFrame:
    """Sources whose text holds a term of four characters or more that no other source holds; all of them if
    there is no such term, or every source or none would stay."""
    low = F.lower(F.coalesce("text", F.lit("")))
    flags = docs.groupBy(source).agg(*(F.max(F.contains(low, F.lit(t)).cast("int")).alias(f"t{i}") for i, t in enumerate(terms)))
    every = Window.partitionBy()  # a row a source
    rare = F.lit(0)
    for i, t in enumerate(terms):
        if len(t) >= 4:
            rare = F.greatest(rare, F.when(F.sum(f"t{i}").over(every) == 1, F.col(f"t{i}")).otherwise(0))
    rows = flags.withColumn("rare", rare).withColumn("n_rare", F.sum("rare").over(every)).withColumn("n", F.count(F.lit(1)).over(every))
    return rows.where((F.col("n_rare") == 0) | (F.col("n_rare") == F.col("n")) | (F.col("rare") == 1)).select(source)


def diversified(ranked: DataFrame, source: str, order: list[Column], k: int) -> DataFrame:
    """The top k with up to two seats a source first (one if sources are many), the rest by rank alone.

    ``ranked`` is a result list, not a corpus: seats need its global order."""
    everything = Window.partitionBy()
    rows = ranked.withColumn("_rank", F.row_number().over(Window.orderBy(*order)))
    rows = rows.withColumn("_in_source", F.row_number().over(Window.partitionBy(source).orderBy("_rank")))
    rows = rows.withColumn("_first", F.min("_rank").over(Window.partitionBy(source)))
    rows = rows.withColumn("_sources", F.size(F.collect_set(source).over(everything)))
    seats = F.greatest(F.lit(1), F.least(F.lit(2), F.floor(F.lit(k) / F.col("_sources"))))
    seated = (F.col("_in_source") <= seats) & (F.col("_sources") > 1)
    rows = rows.withColumn("_seated", seated.cast("int"))
    pick = Window.orderBy(F.desc("_seated"), F.when(F.col("_seated") == 1, F.col("_first")).otherwise(0), "_rank")
    return rows.withColumn("seat", F.row_number().over(pick)).where(F.col("seat") <= k).drop("_rank", "_in_source", "_first", "_sources", "_seated")


def lines_near(text: Column, word: str, radius: int = 1) -> Column:
    """The numbers of a text's lines that hold the word or lie within ``radius`` lines of one that does, in order.

    All lines of a text are in one row, so nothing is shuffled."""
    hits = F.transform(F.split(text, "\n"), lambda line: F.contains(line, F.lit(word)))
    near = lambda h, i: F.exists(F.slice(h, F.greatest(i - radius, F.lit(0)) + 1, i + radius + 1 - F.greatest(i - radius, F.lit(0))), lambda x: x)
    return holding(hits, lambda h: F.filter(F.transform(h, lambda _, i: F.when(near(h, i), i)), lambda i: i.isNotNull()))


def numbers(text: Column) -> Column:
    """The distinct numbers of a text as they are written, thousands separators left out."""
    return F.array_distinct(F.regexp_extract_all(F.regexp_replace(F.coalesce(text, F.lit("")), r"(\d),(\d)", "$1$2"), F.lit(r"\d+(?:\.\d+)?"), F.lit(0)))


def ungrounded(claims: DataFrame, evidence: DataFrame, key: str) -> DataFrame:
    """key and number of every number of a claim that its evidence lacks."""
    said = claims.select(key, F.explode(numbers(F.col("text"))).alias("number"))
    known = evidence.select(key, F.explode(numbers(F.col("text"))).alias("number"))
    return said.join(known, [key, "number"], "left_anti").distinct()


def entities_of(text: Column, aliases: dict[str, str]) -> Column:
    """entity and place of the first occurrence of each entity by any of its aliases, in the order of places.

    The dictionary is part of the plan, so texts are scanned where they lie; nothing is shuffled."""
    low = F.lower(F.coalesce(text, F.lit("")))
    first = lambda e: F.array_min(F.filter(F.array(*(F.instr(low, a.lower()) for a, of in aliases.items() if of == e)), lambda p: p > 0))
    found = F.array(*(F.struct(first(e).alias("place"), F.lit(e).alias("entity")) for e in dict.fromkeys(aliases.values())))
    return F.sort_array(F.filter(found, lambda m: m["place"].isNotNull()))


def mentions(docs: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """doc_id, entity and place of each entity that a text mentions."""
    return docs.select("doc_id", F.inline(entities_of(F.col("text"), aliases))).select("doc_id", "entity", "place")


def pairs_of(found: Column, most: int = 12) -> Column:
    """from_entity and to_entity of the first ``most`` entities of a text, each pair once, by name."""
    names = F.array_sort(F.transform(F.slice(found, 1, most), lambda m: m["entity"]))
    return holding(names, lambda ns: F.flatten(F.transform(ns, lambda a, i: F.transform(F.slice(ns, i + 2, F.lit(most)), lambda b: F.struct(a.alias("from_entity"), b.alias("to_entity"))))))


def edges(docs: DataFrame, aliases: dict[str, str], most: int = 12) -> DataFrame:
    """from_entity, to_entity, mentions and the first document of entities that occur together: one aggregate."""
    rows = docs.select("doc_id", F.inline(pairs_of(entities_of(F.col("text"), aliases), most)))
    return rows.groupBy("from_entity", "to_entity").agg(F.count(F.lit(1)).alias("n_mentions"), F.min("doc_id").alias("first_doc"))


def containments(names: DataFrame, name: str, hints: DataFrame, hint: str, least: int = 4, gram: int = 3) -> DataFrame:
    """The distinct pairs of a name and a hint of which one holds the other: the name holds the hint, or the hint
    holds a name of ``least`` characters or more.

    A text that holds another holds each of its n-grams, so both meet by an equi-join: the one that is held by its
    rarest n-gram among the other side's, the one that holds by all of its n-grams. Texts shorter than an n-gram
    meet by their own length's grams."""
    names, hints = names.distinct(), hints.distinct()

    def held_by(held: DataFrame, h: str, holders: DataFrame, g: str) -> DataFrame:
        size = lambda c: F.least(F.length(c), F.lit(gram))
        grams = lambda c, n: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substr(c, i, F.lit(n))))
        long = holders.where(F.length(g) > 0)
        parts = [long.where(F.length(g) >= n).select(F.col(g), F.explode(grams(F.col(g), n)).alias("gram")) for n in range(1, gram + 1)]
        all_grams = parts[0].unionByName(parts[1]).unionByName(parts[2]) if gram == 3 else parts[-1]
        counts = all_grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
        own = held.where(F.length(h) > 0)
        own = own.select(F.col(h), F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(h) - size(h) + 1), lambda i: F.substr(F.col(h), i, size(h))))).alias("gram"))
        rarest = own.join(counts, "gram", "left").groupBy(h).agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("rare"))
        return rarest.where("rare.n > 0").select(h, F.col("rare.gram").alias("gram")).join(all_grams, "gram").where(F.contains(F.col(g), F.col(h))).select(name, hint)

    return held_by(hints, hint, names, name).unionByName(held_by(names.where(F.length(name) >= least), name, hints, hint)).distinct()


def keyword_gate(text: Column, keywords: list[str], mode: str = "any") -> tuple[Column, Column]:
    """The keywords that a text holds, in their order, and whether it passes: with any of them, with all, or whatever it holds (off; none counts then).
    Without keywords every text passes."""
    if mode not in ("any", "all", "off"):
        raise ValueError(f"no mode {mode!r} of a gate")
    low = F.lower(F.coalesce(text, F.lit("")))
    matched = F.array_compact(F.array(*(F.when(F.contains(low, F.lit(k.lower())), k) for k in keywords))) if keywords and mode != "off" else F.array().cast("array<string>")
    return matched, F.lit(True) if mode == "off" or not keywords else F.size(matched) == len(keywords) if mode == "all" else F.size(matched) > 0
