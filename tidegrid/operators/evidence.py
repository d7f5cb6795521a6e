"""Facts in texts, and claims held against evidence: arrays inside a row, so texts are never shuffled."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.functions.arrays import SPACES, holding, trimmed

HAN = "一-鿿"
#: Patterns of facts in texts.
TRIPLE = r"行:\s*([^|\n]{2,80}?)\s*\|\s*列:\s*([^|\n]{1,40}?)\s*\|\s*值:\s*([^\s|]+)"
LABEL_NUMBER = rf"([{HAN}]{{2,30}})(?:(?!\d{{1,3}}(?:,\d{{3}}))[^\n]){{0,36}}(\d{{1,3}}(?:,\d{{3}})+(?:\.\d+)?)"
PERCENT, YEAR, MOST_FACTS = r"(-?\d+(?:\.\d+)?)%", r"(20\d{2})", 40


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def places(text: Column, parts: Column) -> Column:
    """Where each of the parts, which follow one another in a text, starts (from 1)."""
    start = F.struct(F.lit(1).alias("next"), F.array().cast("array<int>").alias("found"))

    def step(acc: Column, part: Column) -> Column:
        at = F.call_function("locate", part, text, acc["next"])
        return F.struct((at + F.length(part)).alias("next"), F.concat(acc["found"], F.array(at)).alias("found"))

    return F.aggregate(parts, start, step, lambda acc: acc["found"])


def _last(found: Column) -> Column:
    return F.when(F.size(found) > 0, F.element_at(found, -1))


def last_year(text: Column) -> Column:
    return _last(_all(text, YEAR, 1)).cast("int")


def _meaningful(label: Column) -> Column:
    low = F.lower(label)
    return (F.length(label) >= 2) & ~F.startswith(low, F.lit("column")) & ~F.contains(low, F.lit("表头")) & ~low.isin("标题", "数据", "数值")


def _fact(row: Column, col: Column, metric: Column, raw: Column, unit: Column, year: Column) -> Column:
    return F.struct(row.alias("row_label"), col.alias("col_header"), metric.alias("metric"), F.replace(raw, F.lit("%"), F.lit("")).alias("raw_value"), unit.alias("unit"), year.alias("year"))


def _percents(label: Column, line: Column, content: Column, year: Column) -> Column:
    """The share and the change that a line states beside its number."""
    found = _all(line, PERCENT, 1)
    ratio = F.contains(line, F.lit("占总")) | F.contains(content, F.lit("占总资产")) | F.contains(line, F.lit("比重"))
    change = reduce(lambda a, b: a | b, (F.contains(line, F.lit(w)) for w in ("增减", "同比"))) | F.contains(content, F.lit("本年比上年增减")) | F.contains(content, F.lit("同比增减"))
    made = lambda name, value: _fact(label, F.lit(name), F.concat(label, F.lit(name)), value, F.lit("%"), year)
    both = F.array(F.when((F.size(found) > 0) & ratio, made("占比", F.get(found, F.lit(0)))), F.when((F.size(found) > 0) & change, made("同比", _last(found))))
    return F.filter(both, lambda f: f.isNotNull())


def facts(content: Column) -> Column:
    """The facts of a chunk, forty at most: rows of tables written as row, column and value, or else numbers with
    thousands separators and the words before them; each with the percentages of its line."""
    lines, year = F.split(content, "\n"), last_year(content)

    def of_line(line: Column) -> Column:
        found = F.arrays_zip(_all(line, TRIPLE, 1).alias("r"), _all(line, TRIPLE, 2).alias("c"), _all(line, TRIPLE, 3).alias("v"))
        found = F.filter(found, lambda m: _meaningful(F.trim(m["r"])))
        return F.flatten(F.transform(found, lambda m: F.concat(
            F.array(_fact(F.trim(m["r"]), F.trim(m["c"]), F.trim(m["r"]), m["v"], F.when(F.contains(m["v"], F.lit("%")), "%").otherwise(""), F.coalesce(year, last_year(m["c"])))),
            F.when(F.contains(m["v"], F.lit("%")), F.array()).otherwise(_percents(F.trim(m["r"]), line, content, year)),
        )))

    def labelled(line: Column) -> Column:
        found = F.arrays_zip(_all(line, LABEL_NUMBER, 1).alias("l"), _all(line, LABEL_NUMBER, 2).alias("v"))
        found = F.filter(found, lambda m: _meaningful(m["l"]))
        return F.flatten(F.transform(found, lambda m: F.concat(F.array(_fact(m["l"], F.lit(""), m["l"], m["v"], F.lit(""), last_year(line))), _percents(m["l"], line, content, year))))

    triples = F.flatten(F.transform(lines, of_line))
    return F.slice(F.when(F.size(triples) > 0, triples).otherwise(F.flatten(F.transform(lines, labelled))), 1, MOST_FACTS)


def table_text(title: Column, cells: Column) -> Column:
    """A table as text that ``facts`` reads: a line for each number below a header, named by its row's first label.

    ``cells``: rows as arrays of header and value. A unit that the header has in brackets is put back to bare numbers."""
    plain = lambda v: F.trim(F.regexp_replace(F.coalesce(v, F.lit("")), "[​﻿]", ""))
    is_number = lambda v: F.replace(plain(v), F.lit(","), F.lit("")).rlike(r"^[+-]?\d+(?:\.\d+)?%?$")
    is_label = lambda v: (plain(v) != "") & ~plain(v).rlike(r"(?i)^column_\d+$") & ~is_number(v)

    def of_row(row: Column) -> Column:
        label = plain(F.get(F.filter(row, lambda c: is_label(c["value"])), F.lit(0))["value"])
        unit = lambda c: F.trim(F.regexp_extract(c["header"], "[（(]([^（）()]+)[）)]", 1))
        bare = lambda c: F.trim(c["value"]).rlike(r"^[+-]?\d+(?:\.\d+)?$")
        value = lambda c: F.when((unit(c) != "") & bare(c), F.concat(c["value"], unit(c))).otherwise(c["value"])
        header = lambda c: F.when(is_label(c["header"]), c["header"]).otherwise("数值")
        numbers = F.filter(row, lambda c: is_number(c["value"]) & (c["value"] != label))
        lines = F.transform(numbers, lambda c: F.concat(F.lit("行: "), label, F.lit(" | 列: "), header(c), F.lit(" | 值: "), value(c)))
        return F.when(label.isNotNull(), lines).otherwise(F.array().cast("array<string>"))

    return F.array_join(F.concat(F.array(F.concat(F.lit("标题: "), title)), F.flatten(F.transform(cells, of_row))), "\n")


#: Numbers in claims and evidence, words of a fall, and pairs of characters that say nothing.
NUMBER = r"(?i)(?<=Y)\d{2}(?!\d)|(?<![A-Za-z0-9])[-+]?\d+(?:[.,]\d+)*%?"
FALLS = r"(?:下降|减少|下滑|降低|收缩)(?:约|为|了)?$"
STOP_PAIRS = ["根据", "资料", "显示", "指出", "认为", "可以", "以及", "相关", "情况", "其中", "目前"]
#: English words of claims that stand for others in evidence.
SAME_WORDS = {"shipment": ["出货"], "shipments": ["出货"], "yoy": ["同比", "变化"], "share": ["占比"], "technology": ["技术"], "application": ["应用"], "size": ["尺寸"]}
SENTENCE_END = "。！？!?；;"


def numeric_tokens(text: Column) -> Column:
    """value, percent, decimals and year_like of each number of a text; percentages after a word of a fall are negative."""
    found = _all(text, NUMBER)
    both = F.arrays_zip(found.alias("raw"), places(text, found).alias("at"))

    def token(m: Column) -> Column:
        percent, number = F.endswith(m["raw"], F.lit("%")), F.regexp_replace(m["raw"], "[%,]", "")
        start = F.greatest(m["at"] - 8, F.lit(1))
        prefix = F.regexp_replace(F.substr(text, start, m["at"] - start), r"\s+", "")
        value = number.try_cast("double")
        value = F.when(percent & (value > 0) & prefix.rlike(FALLS), -value).otherwise(value)
        short_year = value.between(0, 99) & prefix.rlike("(?i)Y$")
        return F.struct(value.alias("value"), percent.alias("percent"), F.length(F.regexp_extract(number, r"\.(\d*)$", 1)).alias("decimals"), (~percent & (value.between(2000, 2099) | short_year)).alias("year_like"))

    return F.filter(F.transform(both, token), lambda t: t["value"].isNotNull())


def equivalent(expected: Column, candidate: Column) -> Column:
    """Two tokens name one number: years with and without a century, shares as fractions and percentages, and a
    candidate within half of the last digit that is shown."""
    century = lambda t: F.when(t["value"] < 100, t["value"] + 2000).otherwise(t["value"])
    shown = F.when(expected["percent"] & ~candidate["percent"], candidate["value"] * 100).when(~expected["percent"] & candidate["percent"], candidate["value"] / 100).otherwise(candidate["value"])
    near = F.abs(expected["value"] - shown) <= F.greatest(F.lit(1e-9), F.lit(0.5) * F.pow(F.lit(10.0), -expected["decimals"]))
    return F.when(expected["year_like"] & candidate["year_like"], F.abs(century(expected) - century(candidate)) < 1e-9).otherwise(near)


def numbers_covered(claim: Column, evidence: Column) -> Column:
    """Every number of a claim's tokens is among the evidence's."""
    return F.forall(claim, lambda n: F.exists(evidence, lambda m: equivalent(n, m)))


def squeezed(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[\s,，。！？!?；;:：()（）\[\]%-]", "")


def terms(text: Column) -> Column:
    """What a sentence is about: Latin words (and what some of them stand for), pairs of Chinese characters, numbers."""
    own = F.regexp_replace(F.coalesce(text, F.lit("")), rf"(?<=[{HAN}])\s+(?=[{HAN}])", "")
    latin = F.transform(_all(own, r"[A-Za-z][A-Za-z0-9-]{1,}"), F.lower)
    more = F.flatten(F.transform(latin, lambda w: reduce(lambda a, kv: F.when(w == kv[0], F.array(*map(F.lit, kv[1]))).otherwise(a), SAME_WORDS.items(), F.array().cast("array<string>"))))
    runs = _all(own, rf"[{HAN}]{{2,}}")
    pairs = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substr(r, i, F.lit(2)))))
    pairs = F.filter(pairs, lambda p: ~p.isin(STOP_PAIRS))
    return F.array_distinct(F.concat(latin, more, pairs, F.transform(_all(own, NUMBER), squeezed)))


def windows(text: Column) -> Column:
    """The sentences and lines of a text, trimmed; longer than 500 characters in pieces of 500 that overlap by 100."""
    sentences = F.filter(trimmed(_all(text, rf"[^{SENTENCE_END}\n]*[{SENTENCE_END}\n]|[^{SENTENCE_END}\n]+$")), lambda s: s != "")
    sentences = F.filter(F.transform(sentences, lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")
    pieces = lambda s: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.length(s) - 500) / 400).cast("int"))), lambda k: F.substr(s, k * 400 + 1, F.lit(500)))
    return F.flatten(F.transform(sentences, pieces))


def support(claim: Column, content: Column) -> Column:
    """score and snippet of the sentence that bears a claim best; null where none does.

    One does if it has all numbers of the claim and the claim itself, 18 % of its terms, or three of them."""
    said = F.struct(terms(claim).alias("own"), numeric_tokens(claim).alias("numbers"), squeezed(claim).alias("exact"))
    return holding(said, lambda c: _support(c["own"], c["numbers"], c["exact"], content))


def _support(own: Column, numbers: Column, exact: Column, content: Column) -> Column:
    def rated(window: Column) -> Column:
        hits = F.size(F.array_intersect(own, terms(window)))
        score = F.when(F.size(own) > 0, hits / F.size(own)).otherwise(0.0)
        said = (F.length(exact) >= 6) & F.contains(squeezed(window), exact)
        bears = numbers_covered(numbers, numeric_tokens(window)) & (said | (score >= 0.18) | (hits >= 3))
        return F.when(bears, F.struct(score.alias("score"), window.alias("snippet")))

    found = F.filter(F.transform(windows(content), rated), lambda r: r.isNotNull())
    # The first of the best: a later one must be better.
    best = F.aggregate(found, F.lit(None).cast("struct<score: double, snippet: string>"), lambda a, r: F.when(a.isNull() | (r["score"] > a["score"]), r).otherwise(a))
    return holding(best, lambda b: F.when(b.isNotNull(), F.struct(F.round(b["score"], 3).alias("score"), b["snippet"].alias("snippet"))))


#: How claims are marked, listed and headed, and what isn't a claim.
CITATION, BULLET = r"\[S(\d+)\]", r"^\s*(?:[-*+>]|\d+[.)、]|[一二三四五六七八九十]+[、.])\s*"
HEADINGS = ["结论", "核心结论", "数据结论", "分析结论", "数据与报告证据", "新闻解释", "新闻解释证据", "外部解释", "新闻与政策解释证据", "原因分析", "参考来源", "来源"]
NO_CLAIM = ["资料不足", "现有资料不足", "无法根据现有资料", "无法从现有资料", "未检索到", "未找到匹配", "当前未检索到", "当前没有检索到"]


def claims(answer: Column) -> Column:
    """claim and cited (source numbers) of each sentence of an answer that states something; headings drop."""
    lines = F.transform(F.split(F.regexp_replace(F.coalesce(answer, F.lit("")), "\r", ""), "\n"), lambda x: F.trim(F.regexp_replace(F.trim(x), BULLET, "")))
    bare = lambda x: F.trim(F.regexp_replace(x, CITATION, ""))
    heading = lambda x: F.startswith(bare(x), F.lit("#")) | F.regexp_replace(bare(x), r"^[#*_`\s]+|[#*_`\s]+$", "").isin(HEADINGS) | ((F.length(bare(x)) <= 40) & bare(x).rlike("[：:]$"))
    kept = F.filter(lines, lambda x: (x != "") & ~heading(x))
    units = F.flatten(F.transform(kept, lambda x: _all(x, rf"[^{SENTENCE_END}]*[{SENTENCE_END}](?:\s*\[S\d+\])*|[^{SENTENCE_END}]+$")))
    rows = F.transform(F.filter(trimmed(units), lambda u: u != ""), lambda u: F.struct(bare(u).alias("claim"), F.array_distinct(F.transform(_all(u, CITATION, 1), lambda d: d.cast("int"))).alias("cited")))
    plain = lambda c: F.trim(F.regexp_replace(c, r"^[\s:：—-]+", ""))
    return F.filter(rows, lambda r: (plain(r["claim"]) != "") & ~plain(r["claim"]).rlike("^(?:" + "|".join(NO_CLAIM) + ")"))


def checked_claims(answers: DataFrame, evidence: DataFrame, key: str) -> DataFrame:
    """key, claim_no, claim, source, cited, score and snippet: each claim with every source of its answer that it cites.

    ``answers``: key and answer; ``evidence``: key, source (the number it is cited by) and content."""
    rows = answers.select(key, F.posexplode(claims(F.col("answer"))).alias("claim_no", "c")).select(key, "claim_no", "c.claim", F.explode("c.cited").alias("source"))
    joined = rows.join(evidence.select(key, "source", "content"), [key, "source"], "left")
    return joined.withColumn("s", support(F.col("claim"), F.col("content"))).select(key, "claim_no", "claim", "source", F.col("s").isNotNull().alias("supported"), "s.score", "s.snippet")


def best_sources(answers: DataFrame, evidence: DataFrame, key: str) -> DataFrame:
    """key, claim_no, claim and source: for each claim without a citation the source that bears it best, the first of
    equals; without any that does, the one that holds most of its terms."""
    rows = answers.select(key, F.posexplode(claims(F.col("answer"))).alias("claim_no", "c")).select(key, "claim_no", "c.claim", "c.cited").where(F.size("cited") == 0)
    joined = rows.join(evidence.select(key, "source", "content"), key)
    hits = holding(squeezed(F.col("content")), lambda plain: F.size(F.filter(terms(F.col("claim")), lambda t: F.contains(plain, t))))
    joined = joined.withColumns({"s": support(F.col("claim"), F.col("content"))["score"], "hits": hits})
    best = F.max_by("source", F.struct(F.col("s").isNotNull(), F.coalesce("s", "hits"), -F.col("source")))
    return joined.groupBy(key, "claim_no", "claim").agg(best.alias("source"))


def near_each_other(text: Column, names: Column, target: Column, window: int = 220) -> Column:
    """The target stands within ``window`` characters of one of the names; true where no name stands in the text.

    The text around each occurrence of a name is cut out at the name, so no pair of places is made."""
    wanted = F.lower(target)

    def beside(low: Column, name: Column) -> Column:
        cut = lambda parts, i: F.concat(F.right(F.element_at(parts, i), F.lit(window)), name, F.left(F.element_at(parts, i + 1), F.lit(window)))
        inside = lambda parts: F.exists(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.when(F.size(parts) > 1, F.contains(cut(parts, i), wanted)).otherwise(False))
        return holding(F.call_function("split", low, F.concat(F.lit("\\Q"), name, F.lit("\\E")), F.lit(-1)), inside)

    said = lambda low: F.filter(F.transform(names, F.lower), lambda n: (n != "") & F.contains(low, n))
    near = lambda low: holding(said(low), lambda ns: (F.size(ns) == 0) | F.exists(ns, lambda n: beside(low, n)))
    return (wanted != "") & holding(F.lower(text), near)


#: What multiplies a count, the largest first, and what divides a size to inches.
MULTIPLIERS = [("亿", 1e8), ("万", 1e4), (r"billion|(?<![a-z])(?:bn|b)(?![a-z])", 1e9), (r"million|mpcs|(?<![a-z])(?:mn|m)(?![a-z])", 1e6), (r"thousand|kpcs|(?<![a-z])k(?![a-z])", 1e3)]
TO_INCHES = [("mm|毫米", "25.4"), ("cm|厘米", "2.54")]


def _first_number(raw: Column) -> Column:
    return F.regexp_extract(F.replace(raw, F.lit(","), F.lit("")), r"[+-]?\d+(?:\.\d+)?", 0).try_cast("decimal(28,6)")


def units_sold(raw: Column) -> Column:
    """A count with its Chinese or English multiplier, in units."""
    low, out = F.lower(raw), F.lit(1).cast("decimal(10,0)")
    for pattern, by in reversed(MULTIPLIERS):
        out = F.when(low.rlike(pattern), F.lit(int(by)).cast("decimal(10,0)")).otherwise(out)
    return (_first_number(raw) * out).cast("double")


def inches(raw: Column) -> Column:
    """A size in inches; millimetres and centimetres to four decimals, half up."""
    low, number = F.lower(raw), _first_number(raw)
    out = number
    for pattern, by in reversed(TO_INCHES):
        out = F.when(low.rlike(pattern), F.round(number / F.lit(by).cast("decimal(6,2)"), 4)).otherwise(out)
    return out.cast("double")


def language(text: Column) -> Column:
    han, latin = text.rlike(f"[{HAN}]"), text.rlike("[A-Za-z]{2,}")
    return F.when(han & latin, "MIXED").when(han, "ZH").when(latin, "EN").otherwise("UNKNOWN")


def packed_paragraphs(text: Column, most: int = 1200) -> Column:
    """A text's lines joined to chunks of at most ``most`` characters; longer lines are cut, and stand alone."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "[ \t]+", " "), "\n{3,}", "\n\n"))
    parts = F.filter(trimmed(F.split(clean, "\n"), SPACES), lambda p: p != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def step(acc: Column, p: Column) -> Column:
        fits = F.length(acc["now"]) + F.length(p) + 1 <= most
        joined = F.when(acc["now"] == "", p).otherwise(F.concat(acc["now"], F.lit("\n"), p))
        closed = F.when(acc["now"] != "", F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"])
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.length(p) - 1) / most).cast("int")), lambda k: F.substr(p, k * most + 1, F.lit(most)))
        short = F.length(p) <= most
        return F.struct(F.when(fits, acc["done"]).when(short, closed).otherwise(F.concat(closed, cut)).alias("done"), F.when(fits, joined).when(short, p).otherwise("").alias("now"))

    return F.aggregate(parts, start, step, lambda acc: F.when(acc["now"] != "", F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"]))


def coalesced(parts: Column, most: int = 240) -> Column:
    """Fragments of one text put together again: of each, what its beginning shares with the end so far (up to
    ``most`` characters) stands once."""

    def step(text: Column, part: Column) -> Column:
        sizes = F.sequence(F.least(F.lit(most), F.length(text), F.length(part)), F.lit(0), F.lit(-1))
        shared = F.get(F.filter(sizes, lambda n: (n == 0) | (F.right(text, n) == F.left(part, n))), F.lit(0))
        return F.when(F.trim(part) == "", text).when(text == "", part).otherwise(F.concat(text, F.substr(part, shared + 1)))

    return F.aggregate(parts, F.lit(""), step)


def best_facts(found: DataFrame, key: str, hint: Column, year: Column | None = None, wants_ratio: bool = False, wants_change: bool = False) -> DataFrame:
    """The fact of each key that answers best to a hint, if it has forty points.

    100 points for the hint as label, 80 for a label that holds it; five less for a column without a name, three for
    separators, one a character up to 24; 40 for a share where one is asked for, 70 less for others; 50 less for
    changes unless asked for; 15 for the asked year."""
    has = lambda w: F.contains("metric", F.lit(w)) | F.contains("row_label", F.lit(w))
    base = F.when((F.col("metric") == hint) | (F.col("row_label") == hint), 100).when(F.contains("metric", hint) | F.contains("row_label", hint), 80).otherwise(0)
    score = base - F.when(F.col("col_header") == "数值", 5).otherwise(0) + F.when(F.contains("raw_value", F.lit(",")), 3).otherwise(0) + F.least(F.length("raw_value"), F.lit(24))
    if wants_ratio:
        score = score + F.when(has("占比") | has("比例"), 40).otherwise(-70)
    if not wants_change:
        score = score - F.when(has("同比") | F.contains("metric", F.lit("增减")), 50).otherwise(0)
    if year is not None:
        score = score + F.when(F.col("year") == year, 15).otherwise(0)
    rows = found.withColumns({"base": base, "score": score}).where("base > 0")
    first = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "place"))
    return rows.withColumn("nth", first).where("nth = 1 and score >= 40").drop("nth", "base")
