"""Dictionaries of any size in texts, an inverted index with ranked search, and a re-rank of what a search has found.

A dictionary is matched by an automaton that tasks build from its terms, so a text is read once whatever the number of terms.
Only terms of at most ``MOST`` bytes together go to a task: a larger dictionary is dealt into blocks by hash, each matched
in a pass of its own over the texts where they lie, and what all passes found is resolved in the row. The index is a table of postings
(gram, document, frequency) in order of grams, so a search reads the postings of its own grams alone.

Edge cases: null or empty texts hold nothing; null and blank terms are left out; equal rows are found alike; a gram that no document
holds adds nothing; an empty index finds nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.functions.arrays import once
from tidegrid.sources.files import written

#: Bytes of a dictionary's terms that a task receives at once.
MOST = 32 << 20
#: Characters whose grams a task counts and sorts; the number of tasks follows from it, whatever their texts compress to.
CHARACTERS = 8_000_000
_FOUND = pa.list_(pa.struct([("place", pa.int32()), ("end", pa.int32()), ("term", pa.string())]))


def _longest(found: list[dict]) -> list[dict]:
    """Of matches that overlap the first, of those that begin together the longest."""
    out, at = [], 0
    for m in sorted(found, key=lambda m: (m["place"], -m["end"])):
        if m["place"] >= at:
            out.append(m)
            at = m["end"]
    return out


def _pass(texts: DataFrame, text: str, terms: list[str], before: bool, last: bool) -> DataFrame:
    """``texts`` with the matches of one block of terms added to ``found_``; after the last one resolved."""
    shared = texts.sparkSession.sparkContext.broadcast(terms)
    columns = [c for c in texts.columns if c != "found_"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for term in shared.value:
            automaton.add_word(term, term)
        automaton.make_automaton()
        whole = last and not before  # no other block: the automaton itself leaves out what overlaps
        for batch in batches:
            names = batch.schema.names
            olds = batch.column(names.index("found_")).to_pylist() if before else [[]] * batch.num_rows
            new = []
            for old, value in zip(olds, batch.column(names.index(text)).to_pylist(), strict=True):
                value = (value or "").lower()
                found = [{"place": end - len(t) + 1, "end": end + 1, "term": t} for end, t in (automaton.iter_long(value) if whole else automaton.iter(value))] if len(automaton) else []
                new.append(found if whole else _longest([*old, *found]) if last else [*old, *found])
            yield pa.RecordBatch.from_arrays([*(batch.column(names.index(c)) for c in columns), pa.array(new, _FOUND)], names=[*columns, "found_"])

    own = texts.select(*columns, *(["found_"] if before else []))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.select(*columns).schema)
    return own.mapInArrow(run, f"{schema}, found_ array<struct<place: int, end: int, term: string>>")


def terms_in(texts: DataFrame, text: str, terms: DataFrame, most: int = MOST) -> DataFrame:
    """``texts`` with ``found_``: place (from 0), end and term of the dictionary's terms in ``text``, the longest where terms begin
    together, none over another; letters' case doesn't count. ``terms``: one column."""
    column = terms.columns[0]
    own = terms.select(F.lower(F.trim(column)).alias("term")).where("term <> ''").distinct()
    total = own.agg(F.sum(F.octet_length("term").cast("long"))).first()[0] or 0
    blocks = max(1, -(-total // most))
    own = written(own.withColumn("block", F.pmod(F.xxhash64("term"), F.lit(blocks))), "terms") if blocks > 1 else own.withColumn("block", F.lit(0))
    for k in range(blocks):
        held = [r["term"] for r in own.where(F.col("block") == k).select("term").collect()]  # about ``most`` bytes
        texts = _pass(texts, text, sorted(held), before=k > 0, last=k == blocks - 1)
    return texts


def bigrams(text: Column) -> Column:
    """Every two characters side by side without white space, lower case, repeats included."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?=(\S\S))"), F.lit(1))


def index_of(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """An index as two tables: postings (gram, key, tf) in order of grams, and grams (gram, idf), log10 of documents over documents that hold it."""
    n, chars = docs.agg(F.count(F.lit(1)), F.sum(F.length(text).cast("long"))).first()
    tasks = 1 + (chars or 0) // CHARACTERS
    held = once(docs.select(key, text).repartition(tasks, key), "grams", bigrams(F.col(text)))
    counts = held.select(key, F.explode("grams").alias("gram")).groupBy("gram", key).agg(F.count(F.lit(1)).alias("tf"))  # where the document is
    # A gram that many documents hold is in several files, the more the more documents there are; each file holds few grams, in order.
    several = max(8, 1 + n // 1_000_000)
    postings = written(counts.repartition(tasks, "gram", F.pmod(F.xxhash64(key), F.lit(several))).sortWithinPartitions("gram"), "postings")
    grams = postings.groupBy("gram").agg(F.count(F.lit(1)).alias("df")).select("gram", F.log10(F.lit(n) / F.col("df")).alias("idf"))
    return postings, written(grams, "grams")


def search(index: tuple[DataFrame, DataFrame], key: str, query: str, k: int) -> DataFrame:
    """key and score of the k documents with the largest sum of tf * idf * idf over the query's grams; of equal ones the first keys."""
    postings, grams = index
    wanted = sorted({query.lower()[i : i + 2] for i in range(len(query) - 1) if not any(c.isspace() for c in query[i : i + 2])})
    held = postings.where(F.col("gram").isin(wanted)).join(F.broadcast(grams.where(F.col("gram").isin(wanted))), "gram")  # a row for each of the query's grams
    scores = held.groupBy(key).agg(F.round(F.sum(F.col("tf") * F.col("idf") * F.col("idf")), 6).alias("score"))
    return scores.where("score > 0").orderBy(F.desc("score"), key).limit(k)


#: What a question is about, in the order in which it is tried, and of which kind it is.
VOLUME = ["销量", "销售量", "销售台数", "销售数量", "多少辆", "万辆", "累计销售", "月度销售", "年度销售"]
DOMAINS = {
    "HUMAN_RESOURCES": ["员工", "在职", "母公司", "生产人员", "销售人员", "销售员工", "人数", "专业构成", "技术人员", "硕士", "本科", "学历"],
    "FINANCIAL": ["营业收入", "营收", "净利润", "减值", "研发投入", "毛利率", "总资产", "闪电配售", "配售", "货币资金", "销售费用", "管理费用", "短期借款", "每股收益", "现金流量"],
    "RESEARCH": ["研发项目", "主要研发", "项目名称", "刀片电池", "动力电池", "汽车级电池"],
    "PRODUCT": ["王朝", "海洋", "产品系列", "共同构建", "王朝网", "海洋网"],
}
SUMS, LISTS = ["合计", "之和", "一共", "总共", "共多少", "分别是多少，合计"], ["全部", "所有", "列出", "有哪些", "分别是什么"]
COMPARED, SUMMARY = ["对比", "比较", "同比", "增减"], ["总结", "介绍", "如何", "概述"]
#: Topic, and for what a chunk must hold (all of one group) and must not, its points.
POINTS = {
    "battery": [([["动力电池领域"]], [], 120), ([["刀片电池"]], ["弗迪电池"], 60), ([["第二代刀片"]], [], 40), ([["弗迪电池"], ["高新技术企业"], ["西部大开发"]], [], -90), ([["加计抵减"], ["企业所得税"]], [], -50)],
    "research": [([["主要研发项"]], [], 120), ([["第二代刀片"], ["项目进展"], ["拟达到的目标"]], [], 50), ([["高新技术企业"], ["担保"], ["适用年份"]], [], -80)],
    "brand": [([["共同构建", "王朝", "海洋"]], [], 150), ([["王朝", "海洋"]], [], 80), ([["龙颜美学"], ["海洋美学"]], [], 40), ([["经营范围"], ["总经销商"]], [], -60)],
    "staff": [([["母公司在职员工"]], [], 120), ([["生产人员", "销售人员"]], [], 80), ([["万辆"]], ["人员"], -40)],
    "impairment": [([["信用减值"]], [], 100), ([["资产减值"]], [], 100), ([["销量"]], ["减值"], -40)],
    "revenue": [([["营业收入（元）"], ["营业收入合计"]], [], 120), ([["本年比上年增减", "营业收入"]], [], 60)],
    "research_spend": [([["研发投入约人民币"], ["研发投入金额"]], [], 120), ([["同比上升", "研发"]], [], 40)],
    "overseas": [([["国家和地区"]], [], 120), ([["出海覆盖"]], [], 60)],
    "placement": [([["闪电配售"]], [], 140), ([["56亿美元"], ["H 股"], ["H股"]], [], 40)],
}


def _any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(w)) for w in words))


def sells_units(question: Column) -> Column:
    """Whether a question asks for numbers sold. Sales of money, people or places are no numbers sold."""
    return _any(F.lower(question), VOLUME)


def domain(question: Column) -> Column:
    out = F.when(sells_units(question), "VEHICLE_SALES")
    for name, words in DOMAINS.items():
        out = out.when(_any(question, words), name)
    return out.otherwise("GENERAL")


def kind(question: Column) -> Column:
    has, about = lambda *w: _any(question, list(w)), domain(question)
    listed = has(*LISTS) & (about.isin("RESEARCH", "PRODUCT") | has("项目", "系列"))
    return (
        F.when(listed & has("全部", "所有", "列出"), "COMPLETE_LIST").when(listed, "FACT").when(has(*SUMS), "CALCULATION")
        .when((has("分别") & has("多少", "是什么")) | has(*COMPARED), "COMPARISON").when(has(*SUMMARY), "SUMMARY").when(about.isin("HUMAN_RESOURCES", "FINANCIAL"), "FACT").otherwise("GENERAL")
    )


def topics(question: Column) -> dict[str, Column]:
    """For each topic whether a question is about it."""
    has, about = lambda *w: _any(question, list(w)), domain(question)
    return {
        "battery": has("汽车级电池", "电池业务", "动力电池"), "research": (about == "RESEARCH") | (has("研发") & has("项目", "投入")), "brand": about == "PRODUCT", "staff": about == "HUMAN_RESOURCES",
        "impairment": (about == "FINANCIAL") & has("减值"), "revenue": has("营业收入", "营收"), "research_spend": has("研发投入"), "overseas": has("国家和地区", "出海"), "placement": has("闪电配售", "H股"),
    }


def evidence_points(question: Column, content: Column, names: Column) -> Column:
    """How well a chunk fits a question: points for its topic's words, and for a year in its document's name: 200 for an asked one, 80
    less for another; where none is asked, the later the better."""
    out, content = F.lit(0), F.coalesce(content, F.lit(""))
    for topic, asked in topics(question).items():
        for groups, never, points in POINTS[topic]:
            fits = reduce(lambda a, b: a | b, (reduce(lambda a, b: a & b, (F.contains(content, F.lit(w)) for w in g)) for g in groups))
            out = out + F.when(asked & (fits & ~_any(content, never) if never else fits), points).otherwise(0)
    years = lambda c: F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(20\d{2})"), F.lit(1)), lambda y: y.cast("int"))
    named, asked = F.array_max(years(names)), years(question)
    fit = F.when(F.size(asked) > 0, F.when(F.array_contains(asked, named), 200).when(named.isNotNull(), -80).otherwise(0)).otherwise(F.coalesce(named - 2000, F.lit(0)))
    return out + F.coalesce(fit, F.lit(0))


def reranked(found: DataFrame, key: str) -> DataFrame:
    """Chunks found for questions (key, question, rank, content, names) with points and place: the most points first, equal ones as they were found."""
    rows = found.withColumn("points", evidence_points(F.col("question"), F.col("content"), F.col("names")))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("points"), "rank")))  # what one search found, not a corpus
