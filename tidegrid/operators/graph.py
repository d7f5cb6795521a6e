"""Names, entities and relations: aliases, what a text grounds, proposed edges, neighbourhoods, and texts of pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.functions.arrays import holding, once, trimmed


def name_key(name: Column) -> Column:
    """What names are compared by: lower case letters and digits."""
    return F.lower(F.regexp_replace(F.coalesce(name, F.lit("")), r"[^\p{L}\p{N}]", ""))


def alias_index(names: DataFrame) -> DataFrame:
    """key and canonical of names (canonical, aliases: comma-separated): the name itself, its aliases and its first
    word; of one key the name that comes first, its own key before its aliases and those before first words."""
    parts = F.concat(
        F.array(F.struct(F.lit(0).alias("turn"), F.col("canonical").alias("name"))),
        F.transform(F.split(F.coalesce("aliases", F.lit("")), "[,，]"), lambda a: F.struct(F.lit(1).alias("turn"), F.trim(a).alias("name"))),
        F.array(F.struct(F.lit(2).alias("turn"), F.regexp_extract("canonical", r"^\S+", 0).alias("name"))),
    )
    rows = names.select("canonical", F.inline(parts)).withColumn("key", name_key(F.col("name"))).where("key <> ''")
    return rows.groupBy("key").agg(F.min(F.struct("turn", "canonical")).alias("first")).select("key", "first.canonical")


def canonical_names(rows: DataFrame, column: str, index: DataFrame) -> DataFrame:
    """The rows with ``canonical``: the name that ``column`` is an alias of, itself where it is none; blank ones null."""
    keyed = rows.withColumn("key", name_key(F.col(column)))
    out = keyed.join(index.withColumnRenamed("canonical", "_known"), "key", "left")
    return out.withColumn("canonical", F.coalesce("_known", F.nullif(F.trim(column), F.lit("")))).drop("key", "_known")


def grounded(proposed: DataFrame, text: str, kinds: list[str]) -> DataFrame:
    """entity, kind and contexts of proposed entities (name, aliases, kind, and a chunk's text) that the text names: the
    sentences that do. Other kinds and names that no sentence holds drop; of one name and kind the first stays."""
    pieces = F.filter(trimmed(F.regexp_extract_all(F.col(text), F.lit(r"[^。！？；\n]+[。！？；]?"), F.lit(0))), lambda s: s != "")
    names = F.filter(F.transform(F.concat(F.array(F.col("name")), F.split(F.coalesce("aliases", F.lit("")), ",")), lambda n: F.lower(F.trim(n))), lambda n: n != "")
    says = lambda s, ns: holding(F.lower(s), lambda low: F.exists(ns, lambda n: F.contains(low, n)))
    contexts = holding(names, lambda ns: F.filter(pieces, lambda s: says(s, ns)))
    rows = once(proposed.where(F.col("kind").isin(kinds)), "contexts", F.array_distinct(contexts)).where(F.size("contexts") > 0)
    first = F.row_number().over(Window.partitionBy("chunk", "name", "kind").orderBy("place"))
    return rows.withColumn("nth", first).where("nth = 1").select("chunk", F.col("name").alias("entity"), "kind", "contexts")


def with_sources(found: DataFrame) -> DataFrame:
    """entity, kind, n_sources and sources (chunk and sentence, each once) of grounded entities over all chunks."""
    rows = found.select("chunk", "entity", "kind", F.explode("contexts").alias("sentence")).distinct()
    return rows.groupBy("entity", "kind").agg(F.count(F.lit(1)).alias("n_sources"), F.array_sort(F.collect_list(F.struct("chunk", "sentence"))).alias("sources"))


def checked_edges(proposed: DataFrame, evidence: DataFrame, pairs: dict[str, list[tuple[str, str]]]) -> DataFrame:
    """The proposed edges (type, from_name, from_type, to_name, to_type, citation) with ``reason``: why one is refused, null
    where it isn't. ``pairs``: the kinds of ends that each type may join; ``evidence``: citation and content."""
    rows = proposed.join(evidence.select("citation", "content"), "citation", "left")
    known = F.col("type").isin(list(pairs))
    fits = reduce(lambda a, b: a | b, ((F.col("type") == t) & (F.col("from_type") == x) & (F.col("to_type") == y) for t, ends in pairs.items() for x, y in ends), F.lit(False))
    low = F.lower("content")
    named = F.contains(low, F.lower("from_name")) & F.contains(low, F.lower("to_name"))
    reason = (
        F.when(~F.coalesce(known, F.lit(False)), "unknown type").when(~F.coalesce(fits, F.lit(False)), "ends do not fit").when(F.col("content").isNull(), "no such source")
        .when(~F.coalesce(named, F.lit(False)), "names not in source")
    )
    return rows.withColumn("reason", reason).drop("content")


def focused(edges: DataFrame, wanted: list[str], companies: str = "COMPANY") -> DataFrame:
    """The edges (from_name, from_type, to_name, to_type) at asked-for companies, those to other companies left out; all
    of them where no company of that name is there."""
    keys = [w.lower() for w in wanted]
    is_one = lambda e: (F.col(f"{e}_type") == companies) & reduce(lambda a, b: a | b, (F.contains(F.lower(f"{e}_name"), F.lit(k)) for k in keys), F.lit(False))
    other = lambda e: (F.col(f"{e}_type") == companies) & ~is_one(e)
    rows = edges.withColumns({"_hit": is_one("from") | is_one("to"), "_other": other("from") | other("to")})
    there = rows.agg(F.max("_hit").alias("_any"))
    return rows.crossJoin(there).where(~F.coalesce("_any", F.lit(False)) | (F.col("_hit") & ~F.col("_other"))).drop("_hit", "_other", "_any")  # one row


#: Ends of lines after which a sentence is over, and beginnings that don't go on with one.
LINE_ENDS, NEW_LINES = "。！？；：、.!?;:）)》」】", ["图", "表", "数据来源", "资料来源", "下载日志"]


def clean_lines(text: Column) -> Column:
    """The lines of a page's text: single spaces, no empty ones, none that repeats the one before."""
    lines = F.transform(F.split(F.translate(F.coalesce(text, F.lit("")), "\u0000", " "), r"\R"), lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"[\t\x0B\f\r]+", " "), " {2,}", " ")))
    lines = F.filter(lines, lambda x: x != "")
    return holding(lines, lambda ls: F.filter(ls, lambda x, i: (i == 0) | (x != F.get(ls, i - 1))))


def joined_lines(lines: Column) -> Column:
    """Lines that a page's width has broken, as one: a line of 18 characters or more without an end goes on with the
    next, unless that is empty or begins a figure, a table, a source or a numbered point. Latin words keep a space
    between them; empty lines drop."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def step(acc: Column, line: Column) -> Column:
        now = acc["now"]
        fresh = reduce(lambda a, b: a | b, (F.startswith(line, F.lit(w)) for w in NEW_LINES)) | line.rlike(r"^[（(]?\d+[）).、]")
        goes_on = (line != "") & (F.length(now) >= 18) & ~F.right(now, F.lit(1)).isin(list(LINE_ENDS)) & ~fresh
        gap = F.when(F.right(now, F.lit(1)).rlike("[A-Za-z0-9]") & F.left(line, F.lit(1)).rlike("[A-Za-z0-9]"), " ").otherwise("")
        return F.struct(F.when(goes_on | (now == ""), acc["done"]).otherwise(F.concat(acc["done"], F.array(now))).alias("done"), F.when(goes_on, F.concat(now, gap, line)).otherwise(line).alias("now"))

    return F.aggregate(lines, start, step, lambda acc: F.when(acc["now"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["now"]))))


def sub_questions(question: Column) -> Column:
    """The questions of a text: its numbered lines if there are two, else what question marks divide, without requests
    and very short parts, if that makes two; else the text."""
    lines = F.filter(trimmed(F.split(F.trim(question), r"\R+")), lambda x: x != "")
    mark = r"^\s*(?:[（(]?\d+[）).、．]|[一二三四五六七八九十]+[、.])\s*"
    numbered = F.filter(F.transform(F.filter(lines, lambda x: x.rlike(mark)), lambda x: F.trim(F.regexp_replace(x, mark, ""))), lambda x: F.length(x) >= 2)
    parts = F.transform(F.split(F.trim(question), "[？?]"), lambda x: F.regexp_replace(F.trim(x), r"^[，,；;、\s]+", ""))
    parts = F.filter(parts, lambda x: (F.length(x) >= 2) & ~x.rlike("^(?:不要|请勿|注意)"))
    return F.when(F.size(numbered) >= 2, numbered).when(F.size(parts) >= 2, parts).otherwise(F.array(F.trim(question)))


def missing_years(question: Column, found: Column) -> Column:
    """The years that a question asks for and what was found lacks, in order."""
    return F.array_sort(F.array_except(F.array_distinct(F.regexp_extract_all(question, F.lit(r"(?<!\d)20\d{2}(?!\d)"), F.lit(0))), found))


def nearest_years(text: Column, pattern: str, reach: int = 40) -> Column:
    """number and year of each match of ``pattern`` (its first group): the last year named within ``reach`` characters of it."""
    from tidegrid.operators.evidence import places

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    both = F.arrays_zip(found.alias("n"), places(text, found).alias("at"))

    def year(m: Column) -> Column:
        start = F.greatest(m["at"] - reach, F.lit(1))
        near = F.regexp_extract_all(F.substr(text, start, m["at"] + reach - start), F.lit(r"(20\d{2})\s*年"), F.lit(1))
        return F.struct(m["n"].alias("number"), F.when(F.size(near) > 0, F.element_at(near, -1)).cast("int").alias("year"))

    return F.transform(both, year)


def neighbourhood(
    relations: DataFrame, sources: DataFrame, *, names: list[str] | None = None, chunks: list[int] | None = None, period: str = "", data_type: str = "",
    roles: list[str] | None = None, admin: bool = False, of_sources: list[int] | None = None, limit: int = 500,
) -> DataFrame:
    """The newest relations (id, from_name, from_type, to_name, to_type, source_id, version_id, chunk_id, period, data_type) at the named
    entities, or of the named chunks, that the roles may see; at most ``limit``.

    ``sources``: source_id, current_version and allowed_roles (comma-separated; null or empty: all may). Chunks are looked up whatever
    their version, entities only in current ones. FINANCIAL and NEWS also take what an entity of that type stands at either end of."""
    if (names is None) == (chunks is None):
        raise ValueError("either names or chunks")
    rows = relations
    if chunks is not None:
        rows = rows.where(F.col("chunk_id").isin(chunks))
    else:
        rows = rows.where(F.col("from_name").isin(names) | F.col("to_name").isin(names))
    if of_sources is not None:
        rows = rows.where(F.col("source_id").isin(of_sources))
    if period:
        rows = rows.where(F.col("period") == period)
    if data_type in ("FINANCIAL", "NEWS"):
        rows = rows.where((F.col("data_type") == {"FINANCIAL": "REPORT"}.get(data_type, data_type)) | (F.col("from_type") == data_type) | (F.col("to_type") == data_type))
    elif data_type:
        rows = rows.where(F.col("data_type") == data_type)
    allowed = F.coalesce("allowed_roles", F.lit(""))
    seen = sources if admin else sources.where((allowed == "") | F.arrays_overlap(F.split(allowed, ","), F.array(*map(F.lit, roles or [])).cast("array<string>")))
    rows = rows.join(seen.select("source_id", "current_version"), "source_id")
    if chunks is None:
        rows = rows.where(F.col("version_id") == F.col("current_version"))
    return rows.drop("current_version").orderBy(F.desc("id")).limit(max(1, min(limit, 500)))


#: Metrics of a report that hold its numbers, and what a chunk with such numbers writes.
PACKS, PACK_IDS = ["fact_pack", "line_chart"], ["market.top_model", "market.full_model"]
PACK_TEXTS = [['"monthly_trend"'], ['"对象"', "销量/数值"]]


def report_context(found: DataFrame, chunks: DataFrame, prefix: str = "market.") -> DataFrame:
    """version, metric_id, title_path, content and is_found: what a search has found, whole metrics put together from their fragments, and the
    parts of the same reports that hold numbers. ``found``: id; ``chunks``: id, version, chunk_no, metric_id, title_path and content.

    Only versions of reports that were found are read on. Fragments of one metric are a few rows."""
    from tidegrid.operators.evidence import coalesced

    metric = F.lower(F.coalesce("metric_id", F.lit("")))
    hit = chunks.join(found.select("id").distinct(), "id", "left_semi")
    named = hit.where(metric != "").select("version", "metric_id", "title_path").distinct()
    mine = chunks.join(hit.where(metric.startswith(prefix)).select("version").distinct(), "version", "left_semi")
    holds = reduce(lambda a, b: a | b, (F.contains(metric, F.lit(w)) for w in PACKS)) | metric.isin(PACK_IDS)
    says = reduce(lambda a, b: a | b, (reduce(lambda a, b: a & b, (F.contains("content", F.lit(w)) for w in ws)) for ws in PACK_TEXTS))
    useful = mine.where(F.coalesce(holds | says, F.lit(False)))
    key = ["version", "metric_id", "title_path"]
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in key]
    own = chunks.alias("a").join(named.alias("b"), same, "left_semi").withColumn("is_found", F.lit(True))
    more = useful.alias("a").join(named.alias("b"), same, "left_anti").withColumn("is_found", F.lit(False))
    plain = hit.where(metric == "").withColumn("is_found", F.lit(True)).withColumn("alone", F.col("id"))
    more = more.join(plain.select("id"), "id", "left_anti")
    alone = lambda d: d.withColumn("alone", F.when(metric == "", F.col("id")))
    rows = alone(own).unionByName(alone(more)).unionByName(plain)
    parts = rows.groupBy(*key, "alone", "is_found").agg(F.array_sort(F.collect_list(F.struct("chunk_no", "id", "content"))).alias("parts"))
    return parts.select(*key, coalesced(F.transform("parts", lambda p: F.coalesce(p["content"], F.lit("")))).alias("content"), "is_found")
