"""Queries over documents as a knowledge base: sources are the documents' sources, chunks their lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegrid.operators import text as op
from tidegrid.operators.evidence import near_each_other
from tidegrid.plans.registry import query
from tidegrid.sources.tables import table

_LINES = "l AS (SELECT doc_id, source, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents)"
#: Words in the roles of companies, by alias.
ALIASES = {"there": "alpha", "thing": "alpha", "ander": "beta", "einheit": "gamma", "schen": "gamma", "ción": "delta", "ement": "epsilon", "tionth": "zeta"}
_MENTIONS = "m AS (SELECT doc_id, entity, min(place) AS place FROM (" + " UNION ALL ".join(f"SELECT doc_id, '{e}' AS entity, instr(lower(text), '{a}') AS place FROM documents" for a, e in ALIASES.items()) + ") WHERE place > 0 GROUP BY ALL)"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).where("text is not null").select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


@query(
    """WITH RECURSIVE d AS (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '[\\t\\x0B\\f\\r]+', ' ', 'g'), ' *\\n *', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), ' {2,}', ' ', 'g'), ' ' || chr(10)) AS t FROM documents),
    s(doc_id, a) AS (SELECT doc_id, 0 FROM d WHERE t <> '' UNION ALL SELECT d.doc_id, greatest(a + 1, e.stop - 120) FROM s JOIN d ON d.doc_id = s.doc_id, LATERAL (SELECT CASE WHEN a + 1200 >= length(t) THEN length(t)
      ELSE (SELECT CASE WHEN x > 601 THEN a + x ELSE a + 1200 END FROM (SELECT length(rtrim(regexp_replace(substr(t, a + 1, 1201), '[^' || chr(10) || '。]*$', ''), '')) AS x)) END AS stop) e WHERE e.stop < length(t)),
    c AS (SELECT s.doc_id, a, CASE WHEN a + 1200 >= length(t) THEN substr(t, a + 1) ELSE (SELECT CASE WHEN x > 601 THEN substr(t, a + 1, x) ELSE substr(t, a + 1, 1200) END FROM (SELECT length(regexp_replace(substr(t, a + 1, 1201), '[^' || chr(10) || '。]*$', '')) AS x)) END AS c FROM s JOIN d ON d.doc_id = s.doc_id),
    k AS (SELECT doc_id, a, trim(c, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS c FROM c)
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY a) - 1 AS INT) AS chunk_no, CAST(a AS INT) AS start, CAST(length(c) AS INT) AS n_chars, sha256(c) AS sha256 FROM k WHERE c <> ''"""
)
def fixed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping chunks of whole texts."""
    return op.fixed_chunks(_docs(spark, sf_dir)).select("doc_id", "chunk_no", "start", F.length("content").alias("n_chars"), F.sha2("content", 256).alias("sha256"))


@query(
    """WITH s AS (SELECT doc_id, source, """
    + " + ".join(f"CAST(contains(lower(text), '{p}') AS INT)" for p in sorted({"the tion"[i : i + 2] for i in range(7) if " " not in "the tion"[i : i + 2]}))
    + """ + 100 * CAST(contains(lower(text), 'the tion') AS INT) + 30 * CAST(contains(lower(text), 'the') AS INT) AS score FROM documents) SELECT doc_id, CAST(score AS INT) AS score FROM s WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 50"""
)
def keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty documents that answer best to two words (a report, hence the limit)."""
    rows = _docs(spark, sf_dir).select("doc_id", op.bigram_score(F.coalesce("text", F.lit("")), "the tion").alias("score"))
    return rows.where("score > 0").orderBy(F.desc("score"), "doc_id").limit(50)


_TERMS = ["the", "benchmark", "schichau", "ourereth", "quecióncióncio", "leauxmentere"]


@query(
    "WITH f AS (SELECT source, "
    + ", ".join(f"max(CAST(contains(lower(text), '{t}') AS INT)) AS t{i}" for i, t in enumerate(_TERMS))
    + " FROM documents GROUP BY 1), r AS (SELECT source, greatest("
    + ", ".join(f"CASE WHEN sum(t{i}) OVER () = 1 THEN t{i} ELSE 0 END" for i, t in enumerate(_TERMS) if len(t) >= 4)
    + ") AS rare FROM f) SELECT source FROM r WHERE (SELECT sum(rare) FROM r) IN (0, (SELECT count(*) FROM r)) OR rare = 1"
)
def rare_term_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.rare_term_sources(_docs(spark, sf_dir), "source", _TERMS)


@query(
    """WITH c AS (SELECT doc_id, lang, n_chars, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rk FROM documents), t AS (SELECT * FROM c WHERE rk <= 40),
    s AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY rk) AS k, min(rk) OVER (PARTITION BY lang) AS f, (SELECT count(DISTINCT lang) FROM t) AS n FROM t),
    p AS (SELECT *, n > 1 AND k <= greatest(1, least(2, 10 // n)) AS seated FROM s)
    SELECT doc_id, lang, n_chars, CAST(row_number() OVER (ORDER BY seated DESC, CASE WHEN seated THEN f ELSE 0 END, rk) AS INT) AS seat FROM p QUALIFY seat <= 10"""
)
def diversified_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten of the forty longest documents with seats for every language."""
    order = [F.desc("n_chars"), F.col("doc_id")]
    hits = _docs(spark, sf_dir).select("doc_id", "lang", "n_chars").orderBy(*order).limit(40)
    return op.diversified(hits, "lang", order, 10)


@query(f"WITH {_LINES}, h AS (SELECT DISTINCT doc_id, line_no FROM l WHERE contains(line, 'tionth')) SELECT DISTINCT l.doc_id, CAST(l.line_no AS INT) AS line_no FROM l JOIN h ON h.doc_id = l.doc_id AND l.line_no BETWEEN h.line_no - 1 AND h.line_no + 1")
def adjacent_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.explode(op.lines_near(F.col("text"), "tionth")).alias("line_no"))


@query(f"WITH {_LINES}, n AS (SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS next FROM l) SELECT doc_id, CAST(line_no AS INT) AS line_no, CAST(length(line || coalesce(CASE WHEN NOT regexp_matches(line, '[.!?]$') THEN next END, '')) AS INT) AS n_chars FROM n WHERE line <> ''")
def sentence_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that end inside a sentence take the next one with them."""
    split = F.split("text", "\n")
    rows = _docs(spark, sf_dir).select("doc_id", F.posexplode(F.arrays_zip(split.alias("line"), F.slice(split, 2, F.size(split)).alias("next"))).alias("line_no", "l")).select("doc_id", "line_no", "l.line", "l.next").where("line <> ''")
    whole = F.concat("line", F.coalesce(F.when(~F.col("line").rlike(r"[.!?]\z"), F.col("next")), F.lit("")))
    return rows.select("doc_id", "line_no", F.length(whole).alias("n_chars"))


@query(f"WITH {_LINES}, p AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS before FROM l) SELECT doc_id, count(*) AS n_lines, count(*) FILTER (before IS NOT NULL AND line = before) AS n_dropped FROM p GROUP BY 1")
def repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that repeat the one right before them."""
    split = F.split("text", "\n")
    same = F.filter(F.arrays_zip(F.slice(split, 2, F.size(split)).alias("a"), split.alias("b")), lambda p: p["a"] == p["b"])
    return _docs(spark, sf_dir).where("text is not null").select("doc_id", F.size(split).cast("long").alias("n_lines"), F.size(same).cast("long").alias("n_dropped"))


@query(f"WITH {_MENTIONS} SELECT doc_id, entity, CAST(place AS INT) AS place FROM m")
def entity_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.mentions(_docs(spark, sf_dir), ALIASES)


@query(f"WITH {_MENTIONS} SELECT a.entity AS from_entity, b.entity AS to_entity, count(*) AS n_mentions, min(a.doc_id) AS first_doc FROM m a JOIN m b ON a.doc_id = b.doc_id AND a.entity < b.entity GROUP BY ALL")
def entity_cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.edges(_docs(spark, sf_dir), ALIASES)


@query(f"WITH {_MENTIONS} SELECT a.entity AS from_entity, b.entity AS to_entity, source, count(*) AS n_mentions, count(DISTINCT lang) AS n_langs FROM m a JOIN m b ON a.doc_id = b.doc_id AND a.entity < b.entity JOIN documents d ON d.doc_id = a.doc_id WHERE 'alpha' IN (a.entity, b.entity) GROUP BY ALL")
def edge_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The neighbourhood of one entity by source."""
    pairs = F.inline(op.pairs_of(op.entities_of(F.col("text"), ALIASES)))
    rows = _docs(spark, sf_dir).select("source", "lang", pairs).where("from_entity = 'alpha' or to_entity = 'alpha'")
    return rows.groupBy("from_entity", "to_entity", "source").agg(F.count(F.lit(1)).alias("n_mentions"), F.countDistinct("lang").alias("n_langs"))


@query(
    """WITH c AS (SELECT source, unnest(list_distinct(regexp_extract_all(regexp_replace(text, '([0-9]),([0-9])', '\\1\\2', 'g'), '[0-9]+(?:[.][0-9]+)?'))) AS number FROM documents WHERE doc_id % 2 = 0), e AS (SELECT source, unnest(list_distinct(regexp_extract_all(regexp_replace(text, '([0-9]),([0-9])', '\\1\\2', 'g'), '[0-9]+(?:[.][0-9]+)?'))) AS number FROM documents WHERE doc_id % 2 = 1)
    SELECT DISTINCT source, number FROM c WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.source = c.source AND e.number = c.number)"""
)
def ungrounded_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of a source's even documents that its odd ones lack."""
    docs = _docs(spark, sf_dir)
    return op.ungrounded(docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1"), "source")


@query("WITH h AS (SELECT item_id, lower(string_split(text, ' ')[1]) AS hint FROM benchmark) SELECT p_partkey, item_id FROM part JOIN h ON length(hint) > 0 AND (contains(lower(p_name), hint) OR (length(p_name) >= 4 AND contains(hint, lower(p_name))))")
def fuzzy_label_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names that hold a hint, or are held by one."""
    hints = table(spark, sf_dir, "benchmark").select("item_id", F.lower(F.split("text", " ")[0]).alias("hint")).where("length(hint) > 0")
    parts = table(spark, sf_dir, "part").select("p_partkey", F.lower("p_name").alias("name"))
    matches = op.containments(parts.select("name"), "name", hints.select("hint"), "hint")
    return parts.join(matches, "name").join(hints, "hint").select("p_partkey", "item_id")


@query("WITH c AS (SELECT source, lang, count(*) AS n_docs FROM documents GROUP BY ALL) SELECT *, n_docs / sum(n_docs) OVER (PARTITION BY source) AS share FROM c")
def source_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n_docs"))
    return rows.withColumn("share", F.col("n_docs") / F.sum("n_docs").over(Window.partitionBy("source")))


@query("SELECT conv_id, CAST(length(string_agg(role || ': ' || text, chr(10) ORDER BY turn)) AS INT) AS n_chars, sha256(string_agg(role || ': ' || text, chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY 1")
def concatenated_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole conversations in the order of their turns."""
    parts = F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.lit(": "), "text").alias("t"))))
    whole = F.array_join(F.transform(parts, lambda p: p["t"]), "\n")
    rows = table(spark, sf_dir, "conversations").where("text is not null").groupBy("conv_id").agg(whole.alias("whole"))
    return rows.select("conv_id", F.length("whole").alias("n_chars"), F.sha2("whole", 256).alias("digest"))


@query(
    """WITH s AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^.!?]+[.!?]')) AS s FROM documents)
    SELECT doc_id, CASE WHEN regexp_matches(lower(s), 'idiot|scum') THEN 'insult' WHEN regexp_matches(s, '[0-9]{4}') THEN 'dated' WHEN regexp_matches(lower(s), 'copyright|license') THEN 'legal' ELSE 'other' END AS kind, count(*) AS n_sentences FROM s GROUP BY ALL"""
)
def sentence_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences by the first rule that they meet."""
    rows = _docs(spark, sf_dir).select("doc_id", F.explode(F.split("text", r"(?<=[.!?])")).alias("s")).where(F.col("s").rlike(r"^[^.!?]+[.!?]\z"))
    low = F.lower("s")
    kind = F.when(low.rlike("idiot|scum"), "insult").when(F.col("s").rlike("[0-9]{4}"), "dated").when(low.rlike("copyright|license"), "legal").otherwise("other")
    return rows.groupBy("doc_id", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n_sentences"))


_QUESTION = "the tion"
_SCORE_SQL = (
    " + ".join(f"CAST(contains(lower(text), '{p}') AS INT)" for p in sorted({_QUESTION[i : i + 2] for i in range(len(_QUESTION) - 1) if " " not in _QUESTION[i : i + 2]}))
    + f" + 100 * CAST(contains(lower(text), '{_QUESTION}') AS INT) + 30 * CAST(contains(lower(text), 'the') AS INT)"
)
_WIDE = {"en": 20, "de": 8}


@query(
    f"""WITH s AS (SELECT doc_id, source, lang, {_SCORE_SQL} AS score, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place FROM documents WHERE text IS NOT NULL),
    w AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, doc_id) AS r FROM s WHERE score > 0 QUALIFY r <= CASE lang WHEN 'en' THEN 20 WHEN 'de' THEN 8 ELSE 5 END), k AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) - 1 AS rank FROM w),
    d AS (SELECT source, 40.0 / (min(rank) + 1) + least(count(*), 3) * 4 AS points FROM k GROUP BY 1 ORDER BY points DESC, source LIMIT 4), h AS (SELECT s.* FROM s JOIN d USING (source) WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) <= 5),
    n AS (SELECT DISTINCT s.doc_id, s.source FROM s JOIN h ON h.source = s.source AND abs(h.place - s.place) <= 1) SELECT n.doc_id, n.source, n.doc_id IN (SELECT doc_id FROM h) AS is_hit FROM n"""
)
def two_stage_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide recall by language, the four best sources of what it found, a search within them, and each hit's neighbours."""
    place = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    scored = _docs(spark, sf_dir).where("text is not null").select("doc_id", "source", "lang", op.bigram_score(F.col("text"), _QUESTION).alias("score")).withColumn("place", place)
    best = [F.desc("score"), F.col("doc_id")]
    seats = F.coalesce(*(F.when(F.col("lang") == lang, n) for lang, n in _WIDE.items()), F.lit(5))
    wide = scored.where("score > 0").withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(*best))).where(F.col("r") <= 20).where(F.col("r") <= seats)
    ranked = wide.withColumn("rank", F.row_number().over(Window.orderBy(*best)) - 1)  # some forty rows
    points = F.lit(40.0) / (F.min("rank") + 1) + F.least(F.count(F.lit(1)), F.lit(3)) * 4
    sources = ranked.groupBy("source").agg(points.alias("points")).orderBy(F.desc("points"), "source").limit(4).select("source")
    inside = scored.join(sources, "source", "left_semi")
    hits = inside.where("score > 0").withColumn("k", F.row_number().over(Window.partitionBy("source").orderBy(*best))).where("k <= 5")
    near = hits.select("source", F.explode(F.array(F.col("place") - 1, F.col("place"), F.col("place") + 1)).alias("place"), F.col("place").alias("at")).groupBy("source", "place").agg(F.max(F.col("place") == F.col("at")).alias("is_hit"))
    return inside.join(near, ["source", "place"]).select("doc_id", "source", "is_hit")


_COMPANIES, _TARGETS = {"alpha": ["there", "thing"], "beta": ["ander"], "gamma": ["einheit", "schen"]}, {"delta": "ción", "epsilon": "ement", "zeta": "tionth"}


def _near_sql(c: str, t: str) -> str:
    tests = []
    for a in _COMPANIES[c]:
        gap = 220 - len(_TARGETS[t])
        tests += [f"regexp_matches(t, '(?s){a}.{{0,{gap}}}{_TARGETS[t]}')", f"regexp_matches(t, '(?s){_TARGETS[t]}.{{0,{gap}}}{a}')"]
        if t == "zeta" and a.startswith("th"):
            tests.append(f"contains(t, 'tion{a}')")
    return " OR ".join(tests)


_SAYS = {c: " OR ".join(f"contains(t, '{a}')" for a in ws) for c, ws in _COMPANIES.items()}


@query(
    "WITH d AS (SELECT doc_id, lower(text) AS t FROM documents WHERE text IS NOT NULL), m AS (SELECT *, " + " + ".join(f"CAST(({w}) AS INT)" for w in _SAYS.values()) + " AS n FROM d), e AS ("
    + " UNION ALL ".join(f"SELECT '{c}' AS company, '{t}' AS target, doc_id FROM m WHERE ({_SAYS[c]}) AND contains(t, '{w}') AND (n = 1 OR {_near_sql(c, t)})" for c in _COMPANIES for t, w in _TARGETS.items())
    + ") SELECT company, target, count(*) AS n_docs, min(doc_id) AS first_doc FROM e GROUP BY ALL"
)
def company_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies and what texts link them with: where a text names several, only what stands near a company's name."""
    low = F.lower("text")
    says = lambda words: reduce(lambda a, b: a | b, (F.contains(low, F.lit(w)) for w in words))
    n = reduce(lambda a, b: a + b, (says(ws).cast("int") for ws in _COMPANIES.values()))
    pairs = F.array(*(
        F.when(says(ws) & F.contains(low, F.lit(w)) & ((F.col("n") == 1) | near_each_other(F.col("text"), F.array(*map(F.lit, ws)), F.lit(w))), F.struct(F.lit(c).alias("company"), F.lit(t).alias("target")))
        for c, ws in _COMPANIES.items() for t, w in _TARGETS.items()
    ))
    rows = _docs(spark, sf_dir).where("text is not null").select("doc_id", "text", n.alias("n")).select("doc_id", F.inline(F.filter(pairs, lambda p: p.isNotNull())))
    return rows.groupBy("company", "target").agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("first_doc"))
