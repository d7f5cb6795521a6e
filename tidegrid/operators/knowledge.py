"""Sources, chunks and what is asked of them: rankings, candidates, alignment, events, categories, totals by year."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.functions.arrays import once, trimmed


def any_of(text: Column, words: list[str]) -> Column:
    """The text holds one of the words."""
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(w)) for w in words), F.lit(False))


@dataclass(frozen=True)
class TermGroup:
    """Words of a question, words of a document that answer to them, and how much that counts."""

    weight: int
    asked: tuple[str, ...]
    held: tuple[str, ...]


def metric_ranking(chunks: DataFrame, question: str, groups: list[TermGroup], words: list[str], most: int) -> DataFrame:
    """The best chunk (id, metric_id, content) of each metric for a question, ``most`` at most: id, metric_id, score, matched.

    Of the groups that the question asks for, one that a chunk answers adds its weight, another takes half of it (one at
    least); each of ``words`` adds four, a metric that is a dataset takes twelve. More groups go before more points,
    later chunks before earlier ones."""
    q = question.lower().replace(" ", "")
    asked = [g for g in groups if any(a in q for a in g.asked)]
    text = F.regexp_replace(F.lower(F.concat_ws(" ", "metric_id", "content")), r"\s+", "")
    hits = [any_of(text, list(g.held)) for g in asked]
    score = reduce(lambda a, b: a + b, (F.when(h, g.weight).otherwise(-max(1, g.weight // 2)) for h, g in zip(hits, asked, strict=True)), F.lit(0))
    score = score + reduce(lambda a, b: a + b, (F.contains(text, F.lit(w)).cast("int") * 4 for w in words), F.lit(0)) - F.startswith(F.lower("metric_id"), F.lit("dataset")).cast("int") * 12
    matched = reduce(lambda a, b: a + b, (h.cast("int") for h in hits), F.lit(0))
    rows = chunks.select("id", "metric_id", score.alias("score"), matched.alias("matched")).where("matched > 0 and score > 0")
    order = [F.desc("matched"), F.desc("score"), F.desc("id")]
    first = F.row_number().over(Window.partitionBy(F.coalesce(F.nullif("metric_id", F.lit("")), F.col("id").cast("string"))).orderBy(*order))
    return rows.withColumn("nth", first).where("nth = 1").drop("nth").orderBy(*order).limit(most)


def candidate_documents(hits: DataFrame, subjects: list[str], years: list[str], most: int, favoured: dict[str, float] | None = None) -> DataFrame:
    """document and score of the documents to search within: hits (rank from 0, document, name, type) by document.

    40 points over one plus the best rank, four a hit up to three, 60 for a name of a subject (80 less without one
    where another has it), 20 for each asked year in the name (12 less for another year), the name's latest year where
    none is asked for, and what its type is favoured by. With a name of a subject anywhere only those stay."""
    docs = hits.groupBy("document").agg(F.min("rank").alias("best"), F.count(F.lit(1)).alias("n"), F.max_by("name", "rank").alias("name"), F.max_by("type", "rank").alias("type"))
    name = F.lower("name")
    docs = docs.withColumn("named", any_of(name, [s.lower() for s in subjects]))
    docs = docs.withColumn("any_named", F.max("named").over(Window.partitionBy()))  # documents among a result list
    in_name = F.transform(F.regexp_extract_all(name, F.lit(r"20\d{2}"), F.lit(0)), lambda y: y.cast("int"))
    asked = reduce(lambda a, b: a + b, (F.contains(name, F.lit(y)).cast("int") for y in years), F.lit(0))
    by_year = F.when(asked > 0, asked * 20).when(F.size(in_name) > 0, -12).otherwise(0) if years else F.when(F.size(in_name) > 0, F.array_max(in_name) - 2000).otherwise(0)
    by_type = reduce(lambda a, kv: F.when(F.upper("type") == kv[0], kv[1]).otherwise(a), (favoured or {"PDF": 8.0}).items(), F.lit(0.0))
    by_name = F.when(F.col("named"), 60).when(F.col("any_named") & F.lit(bool(subjects)), -80).otherwise(0)
    score = F.lit(40.0) / (F.col("best") + 1) + F.least("n", F.lit(3)) * 4.0 + by_name + by_year + by_type
    kept = docs.where(~F.col("any_named") | F.col("named")) if subjects else docs
    return kept.select("document", score.alias("score")).orderBy(F.desc("score"), "document").limit(most)


def aligned(chunks: DataFrame, name: str, body: str, subjects: list[str]) -> DataFrame:
    """The chunks of documents named after a subject; where no document is, those that mention one."""
    words = [s.lower() for s in subjects]
    rows = chunks.withColumns({"_named": any_of(F.lower(name), words), "_said": any_of(F.lower(body), words)})
    named = rows.agg(F.max("_named").alias("_any"))
    return rows.crossJoin(named).where(F.when(F.col("_any"), F.col("_named")).otherwise(F.col("_named") | F.col("_said"))).drop("_named", "_said", "_any")  # one row


#: Words of sales in evidence.
SALES_WORDS = ["销量", "万辆", "wholesale", "retail_sales", "monthly_trend"]


def is_sales_evidence(text: Column, brands: list[str], years: list[str]) -> Column:
    """A text that may answer for the sales of a brand: it names the brand, an asked year if there are any, and sales;
    JSON that holds nothing but where it comes from doesn't."""
    low = F.lower(F.coalesce(text, F.lit("")))
    source_only = F.startswith(F.trim(low), F.lit("{")) & F.contains(low, F.lit('"source')) & ~any_of(low, ['"value"', '"points"', '"series"'])
    return (any_of(low, [y for y in years]) if years else F.lit(True)) & any_of(low, [b.lower() for b in brands]) & ~source_only & any_of(low, SALES_WORDS)


def first_of_searches(searches: list[DataFrame], key: str, order: str) -> DataFrame:
    """The hits of several searches one after another, each key once, where it was found first: key, search, place."""
    rows = [s.select(key, F.lit(i).alias("search"), F.col(order).alias("place")) for i, s in enumerate(searches)]
    found = reduce(lambda a, b: a.unionByName(b), rows).groupBy(key).agg(F.min(F.struct("search", "place")).alias("f"))
    return found.select(key, "f.search", "f.place")


def appended(stored: DataFrame, new: DataFrame, signature: list[str]) -> DataFrame:
    """The stored rows and the new ones whose signature (nulls equal) is not there yet, each once."""
    keyed = new.dropDuplicates(signature)
    same = reduce(lambda a, b: a & b, (F.col(f"n.{c}").eqNullSafe(F.col(f"s.{c}")) for c in signature))
    fresh = keyed.alias("n").join(stored.select(*signature).distinct().alias("s"), same, "left_anti")
    return stored.unionByName(fresh)


def one_total(candidates: Column) -> Column:
    """Of several totals of one year (array of place, value and score, in order) the one to tell: of two where one is
    more than twice the other the smaller, else the one of more points, the earlier of equals."""

    def prefer(a: Column, b: Column) -> Column:
        both = (a["value"] > 0) & (b["value"] > 0)
        return F.when(both & (a["value"] > b["value"] * 2), b).when(both & (b["value"] > a["value"] * 2), a).when(a["score"] >= b["score"], a).otherwise(b)

    return F.aggregate(F.slice(candidates, 2, F.size(candidates)), F.get(candidates, F.lit(0)), prefer)


def year_totals(points: DataFrame, by: list[str]) -> DataFrame:
    """by, year, value, n_months and scope of the years with two months or more of ``points`` (time_period, value)."""
    year = F.substring("time_period", 1, 4)
    rows = points.where("value is not null").groupBy(*by, year.alias("year")).agg(F.sum("value").alias("value"), F.countDistinct("time_period").alias("n_months")).where("n_months >= 2")
    return rows.withColumn("scope", F.when(F.col("n_months") >= 12, F.concat("year", F.lit("年1-12月"))).otherwise(F.concat("year", F.lit("年已有"), F.col("n_months").cast("string"), F.lit("个月"))))


def summed_facts(facts: DataFrame, key: str) -> DataFrame:
    """key, total and formula of facts (family, place, raw_value, value) of one family; null where families differ."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("place", "raw_value"))), lambda p: p["raw_value"])
    rows = facts.groupBy(key).agg(F.countDistinct("family").alias("n_families"), F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), parts.alias("parts")).where("n >= 2")
    same = F.col("n_families") == 1
    return rows.select(key, F.when(same, F.col("total")).alias("total"), F.when(same, F.concat(F.array_join("parts", " + "), F.lit(" = "), F.col("total").cast("string"))).alias("formula"))


#: Kinds of events, the first rule that a sentence meets counts; times, effects and keywords.
EVENTS = [
    ("诉讼/知识产权", r"起诉|诉讼|侵权|专利"),
    ("人事任命", r"任命|出任|加盟|辞任|辞职"),
    ("战略合作", r"战略合作|合作伙伴|签署.{0,20}(?:合作|协议)|建立.{0,20}合作"),
    ("投资并购", r"收购|购买|并购|私有化|入股|投资|IPO"),
    ("政策动态", r"加征.{0,20}关税|提高.{0,20}关税|出台.{0,20}(?:政策|规划|建议)|发布.{0,20}(?:通知|条例|政策)|调整.{0,20}(?:政策|制度|规划|计划)"),
    ("产能/生产", r"扩产|投产|建厂|产能.{0,20}(?:提升|扩大|新增)"),
    ("产品发布", r"发布|推出|上市"),
    ("销量动态", r"销量突破|出货.{0,20}(?:增长|下降|下跌)|销量.{0,20}(?:增长|下降|下跌|激增|突破)|同比.{0,20}(?:增长|下降|下跌)|(?:增长|下降|下跌|激增).{0,12}(?:销量|出货)"),
    ("技术动态", r"技术突破|芯片.{0,20}(?:发布|获准|出口|供应)|LTPS.{0,20}(?:增长|提升)|OLED.{0,20}(?:发布|量产|侵权)"),
    ("市场动态", r"(?:进入|进军)(?:德国|中国|欧洲|市场)|推迟.{0,20}(?:燃油车|计划)|联合.{0,20}(?:造车|生产)|市场份额.{0,20}(?:增长|下降|提升)|召回|获得订单"),
]
TIMES = [r"(?:20\d{2}|\d{2})年前三季度", r"20\d{2}年(?:1[0-2]|[1-9])月(?:\d{1,2}日)?", r"(?i)20\d{2}年Q[1-4]", r"\d{1,2}月\d{1,2}日", r"20\d{2}年"]
EFFECT = r"(?:推动|支撑|带动|拖累|导致|提升|下降|加速|影响)[^，,。！？；\n]{0,80}"
KEYWORDS = ["新能源", "插混", "纯电", "800V", "固态电池", "智能驾驶", "LTPS", "LCD", "OLED", "MicroLED", "专利", "关税", "芯片"]


def sentences(text: Column) -> Column:
    return F.filter(trimmed(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^。！？；\n]+[。！？；]?"), F.lit(0))), lambda s: s != "")


def _first(sentence: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(sentence, pattern, 0), F.lit(""))


def _event_kind(sentence: Column) -> Column:
    return F.coalesce(*(F.when(sentence.rlike(p), k) for k, p in EVENTS))


def _event_time(sentence: Column) -> Column:
    return F.coalesce(*(_first(sentence, p) for p in TIMES))


def event(sentence: Column) -> Column:
    """kind, time, effect and keywords of a sentence that tells of an event; null for any other."""
    kind, found = _event_kind(sentence), lambda p: _first(sentence, p)
    words = F.filter(F.array(*map(F.lit, KEYWORDS)), lambda w: F.contains(sentence, w))
    return F.when(kind.isNotNull() & (F.length(F.trim(sentence)) >= 4), F.struct(kind.alias("kind"), _event_time(sentence).alias("time"), F.trim(found(EFFECT)).alias("effect"), words.alias("keywords")))


def distinct_events(rows: DataFrame, key: str) -> DataFrame:
    """The events of sentences (key, sentence), each once by kind, text without white space and time, with all its sources."""
    found = once(rows.where(F.length(F.trim("sentence")) >= 4), "kind", _event_kind(F.col("sentence"))).where("kind is not null")
    bare = F.regexp_replace("sentence", r"\s+", "")
    return found.groupBy("kind", bare.alias("text"), _event_time(F.col("sentence")).alias("time")).agg(F.countDistinct(key).alias("n_sources"), F.min(key).alias("first_source"))


#: Headings of reports that decide a category, before any words do.
SECTIONS = [(r"(?:^|\n)\s*1\.1.*市场.*观察", "other"), (r"(?:^|\n)\s*1\.2.*宏观政策", "macro_policy"), (r"(?:^|\n)\s*2\.1.*人事", "personnel"), (r"(?:^|\n)\s*2\.2.*战略", "strategy"), (r"(?:^|\n)\s*3(?:\.1)?.*产业链", "industry_chain"), (r"(?:^|\n)\s*4(?:\.1)?.*竞争追踪", "competition")]


#: The words of each category.
CATEGORIES = {
    "macro_policy": ["政策", "法规", "条例", "指南", "征求意见", "工信部", "商务部", "财政部", "市场监管", "补贴", "税收", "关税", "欧盟", "美国政府", "日本政府", "十五五", "准入", "碳边境", "cbam"],
    "personnel": ["任命", "履新", "离职", "辞任", "卸任", "接任", "出任", "升任", "人事", "ceo", "总裁", "董事长", "首席", "负责人", "换帅", "高管"],
    "strategy": ["战略", "布局", "投资", "工厂", "产能", "出海", "海外", "合作", "合资", "重组", "私有化", "收缩", "扩张", "渠道", "品牌", "产品规划", "组织调整", "本地化生产", "并购"],
    "industry_chain": ["产业链", "智能驾驶", "自动驾驶", "robotaxi", "电池", "固态电池", "芯片", "座舱", "显示", "micro led", "oled", "lcd", "供应链", "tier1", "传感器", "激光雷达", "充电", "零部件"],
    "competition": ["竞争", "专利", "诉讼", "收购", "股权", "市场份额", "份额", "竞品", "竞争追踪", "定点", "客户", "供应商", "排名", "价格战", "反内卷"],
}


def category(text: Column, words: dict[str, list[str]] = CATEGORIES) -> Column:
    """A text's category: by the heading in its first 120 characters, else the one whose words count most (two in the
    first 160 characters, one behind), the first of equals; other without any."""
    low = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    heading = F.coalesce(*(F.when(F.substring(low, 1, 120).rlike(p), c) for p, c in SECTIONS))
    points = lambda ws: reduce(lambda a, b: a + b, (F.when(F.contains(F.substring(low, 1, 160), F.lit(w)), 2).when(F.contains(low, F.lit(w)), 1).otherwise(0) for w in ws), F.lit(0))
    scored = F.array(*(F.struct(points(ws).alias("points"), F.lit(-i).alias("turn"), F.lit(c).alias("name")) for i, (c, ws) in enumerate(words.items())))
    best = F.array_max(scored)
    return F.coalesce(heading, F.when(best["points"] > 0, best["name"]).otherwise("other"))


#: Kinds of metrics by their names, changes by theirs, and units that may follow a number.
METRIC_KINDS = [
    ("financial", ["营收", "营业收入", "净利润", "毛利", "现金流", "研发", "资产", "负债", "亏损"]), ("shipment", ["出货", "发货"]), ("sales", ["销量"]), ("production", ["产量"]),
    ("export", ["出口"]), ("inventory", ["库存"]), ("market_share", ["市场份额", "占有率"]),
]
CHANGES = [("yoy", ["同比"]), ("mom", ["环比"]), ("share", ["份额", "占比", "占有率"])]
VALUE_UNIT = r"^\s*([+＋\-−]?\d+(?:\.\d+)?)\s*(亿元|万元|元|万辆|万台|万片|百万片|辆|台|片|百分点|%)\s*$"


def metric_type(name: Column, value: Column) -> Column:
    """kind, change, value and unit of a metric's name and written value."""
    kind = F.coalesce(*(F.when(any_of(F.lower(name), ws), k) for k, ws in METRIC_KINDS), F.lit("other"))
    change = F.coalesce(*(F.when(any_of(name, ws), k) for k, ws in CHANGES))
    fits = value.rlike(VALUE_UNIT)
    number = F.translate(F.regexp_extract(value, VALUE_UNIT, 1), "＋−", "+-")
    return F.struct(kind.alias("kind"), change.alias("change"), F.when(fits, number).otherwise(value).alias("value"), F.when(fits, F.regexp_extract(value, VALUE_UNIT, 2)).alias("unit"))


#: What a text is about by its words, the first that it has.
KNOWLEDGE = [("risk", ["风险", "下滑", "压力", "不确定"]), ("policy", ["政策", "购置税", "补贴", "法规"]), ("technology", ["电池", "800V", "智能驾驶", "技术"]), ("company_event", ["推出", "发布", "产能", "合作"]), ("sales_analysis", ["销量", "同比", "增长率", "万辆"])]


def knowledge_type(text: Column) -> Column:
    return F.coalesce(*(F.when(any_of(text, ws), k) for k, ws in KNOWLEDGE), F.lit("market_trend"))


#: Words of questions that tell documents apart by nothing.
STOP = [
    "什么", "哪些", "如何", "怎么", "多少", "大约", "左右", "请问", "介绍", "预测", "分别", "是否", "可以", "我们", "他们", "以及", "其中", "目前", "已经", "还是", "不是", "这个",
    "一个", "没有", "关于", "进行", "相关", "情况", "资料", "报告", "研报", "年报", "年度", "公司", "汽车", "销量", "出口", "收入", "业务", "主要", "核心", "技术", "定位", "纪录",
    "达成", "上市", "地位", "前景", "最新", "研究",
]
TOKEN = r"[一-鿿]{2,10}|[A-Za-z][A-Za-z0-9]{1,15}|[一-鿿]{1,8}[A-Za-z0-9]{1,6}|[A-Za-z0-9]{1,6}[一-鿿]{1,8}"


def content_terms(question: Column) -> Column:
    """The words of a question that may tell documents apart: its tokens, and windows of four to six Chinese characters."""
    useful = lambda t: F.length(t).between(2, 16) & ~t.isin(STOP) & ~t.rlike(r"^20\d{2}$") & ~t.rlike("多少|大约|什么")
    segments = F.filter(F.split(question, r"[\p{P}\p{S}\s]+"), lambda s: s != "")
    tokens = F.flatten(F.transform(segments, lambda s: F.regexp_extract_all(s, F.lit(TOKEN), F.lit(0))))
    runs = F.flatten(F.transform(segments, lambda s: F.regexp_extract_all(s, F.lit("[一-鿿]{4,}"), F.lit(0))))
    windows = F.flatten(F.transform(runs, lambda r: F.flatten(F.transform(F.sequence(F.lit(4), F.least(F.lit(6), F.length(r))), lambda n: F.transform(F.sequence(F.lit(1), F.length(r) - n + 1), lambda i: F.substr(r, i, n))))))
    return F.array_distinct(F.filter(F.concat(tokens, windows), useful))


def shown_number(value: Column) -> Column:
    """A figure as reports show it: thousands with separators from ten thousand on, else one decimal."""
    return F.when(value.isNull(), "缺失").when(F.abs(value) >= 10000, F.format_string("%,d", F.bround(value, 0).cast("long"))).otherwise(F.format_string("%.1f", F.bround(value, 1)))


def shown_percent(value: Column) -> Column:
    return F.when(value.isNull(), "缺失").otherwise(F.concat(F.format_string("%+.1f", F.bround(value * 100, 1)), F.lit("%")))


def shown_with_change(value: Column, yoy: Column) -> Column:
    return F.when(value.isNotNull() & yoy.isNotNull(), F.concat(shown_number(value), F.lit("\n（同比"), shown_percent(yoy), F.lit("）"))).otherwise(shown_number(value))
