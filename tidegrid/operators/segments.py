"""Pages and slides of documents as typed segments: sections, events, narratives, tables and charts, each with its path of headings.

What a page holds is decided from that page alone, so pages stay where they are and are cut in one Arrow function. Only
headings know about other pages: a segment's path follows from the last heading of each level before it, by running
windows over a document's segments, which stream and hold no document in memory.

Edge cases: a page without text and tables has no segment; tables whose rows aren't as wide as their header keep their title
alone and aren't indexed; text before the first event of a page that has events isn't kept, as headings of such pages repeat.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEAST, MOST, TITLE, LABEL, LEVELS = 20, 2000, 120, 30, 6
#: Words of events, short names of companies, words of contents pages, and what a fact looks like.
EVENT = re.compile(
    r"发布|宣布|任命|出任|加盟|调整|合作|签署|投资|收购|购买|并购|起诉|召回|进入|进军|上市|IPO|投产|扩产|推出|交付|布局|出售|建立|升级|暂停|延后|私有化|"
    r"加征|关税|推迟|联合|增长|下降|下跌|侵权|获得订单"
)
SHORT_NAMES = {"理想": "理想汽车", "小米": "小米汽车", "吉利": "吉利汽车", "深天马": "天马微电子", "天马": "天马微电子"}
CONTENTS = ["目录", "CONTENTS", "行业全景", "企业行动", "产业链", "竞争追踪", "市场观察", "宏观政策"]
FACT = re.compile(r"\d{1,2}月\d{1,2}日|同比|\d+(?:\.\d+)?(?:万|辆|%)")
STATEMENT, LABEL_STOP = re.compile(r"[。！？；]"), re.compile(r"[。！？；，,:：]")
OUTLINE = re.compile(r"(?=\d+[.、．])(\d+(?:\.\d+)*)|([一二三四五六七八九十]+)[、.]")
SENTENCE_END = re.compile(r"(?<=[。！？；])\s*|\n+")
NUMBERISH, PLACEHOLDER, UNIT = re.compile(r"[+-]?\d+(?:\.\d+)?%?"), re.compile(r"column_\d+", re.IGNORECASE), re.compile(r"[（(]([^（）()]+)[）)]")
GROUPING, SUBJECT = re.compile(r"前[五十]\s*家|TOP\d+", re.IGNORECASE), re.compile("车企|企业|品牌|厂商|公司|车型|指标")
TITLE_HINTS = [re.compile(r"TOP\d+", re.IGNORECASE), re.compile(r"^\d+\.\d+"), re.compile(r"^(?!（同比).*(?:销量|整车厂|预测)", re.IGNORECASE)]
DIGITS = "一二三四五六七八九"

ITEMS = "doc string, page long, text string, is_slide boolean, tables array<struct<title: string, columns: array<string>, rows: array<array<string>>>>, charts array<struct<title: string, chart_type: string, categories: array<string>, series: array<struct<name: string, values: array<double>>>>>"
SEGMENTS = "doc string, page long, part int, kind string, title string, subject string, content string, indexable boolean, outline array<int>"


def chinese_number(word: str) -> int:
    """一 to 九十九."""
    tens, ten, ones = word.partition("十")
    value = lambda c, default: DIGITS.index(c) + 1 if c else default
    return value(tens[-1:], 1) * 10 + value(ones[:1], 0) if ten else value(word[-1:], 0)


def outline_of(title: str) -> list[int] | None:
    """A heading's number as its level's numbers: 二、 is [2], 1.3. is [0, 1, 3] (below a heading in Chinese numerals); null for others."""
    found = OUTLINE.match(title)
    if not found:
        return None
    return [0, *map(int, found[1].split("."))] if found[1] else [chinese_number(found[2])]


def lines_of(text: str | None) -> list[str]:
    lines = (x.strip() for x in (text or "").splitlines())
    return [x for x in lines if x and not re.fullmatch(r"\d{1,3}", x)]


def is_contents(lines: list[str]) -> bool:
    """A page of navigation: short labels without a statement, a fact or an event, two of which are words of contents pages."""
    if len(lines) < 5 or sum(len(x) <= 24 for x in lines) < 0.75 * len(lines):
        return False
    if any(len(x) >= 80 or STATEMENT.search(x) or FACT.search(x) or (len(x) > 30 and EVENT.search(x)) for x in lines):
        return False
    return sum(any(w in x for w in CONTENTS) for x in lines) >= 2


def event_starts(lines: list[str]) -> list[int]:
    """Lines that name whom the next line's event is about."""
    label = lambda x: len(x) <= LABEL and not LABEL_STOP.search(x) and not EVENT.search(x)
    return [k for k, (x, after) in enumerate(zip(lines, lines[1:])) if label(x) and EVENT.search(after)]


def pieces(content: str) -> list[str]:
    """A long content in runs of sentences and lines of at most ``MOST`` characters; a longer sentence is one alone."""
    if len(content) <= MOST:
        return [content]
    out, held, size = [], [], 0
    for part in filter(None, (p.strip() for p in SENTENCE_END.split(content))):
        if held and size + len(part) > MOST:
            out.append("\n".join(held))
            held, size = [], 0
        held.append(part)
        size += len(part)
    return [*out, "\n".join(held)] if held else out


def _cell(value: str | None) -> str:
    return re.sub("[​﻿]", "", value or "").strip()


def _names_something(value: str) -> bool:
    return bool(value) and not PLACEHOLDER.fullmatch(value) and not NUMBERISH.fullmatch(value.replace(",", ""))


def table_content(title: str, columns: list[str], rows: list[list[str]]) -> str | None:
    """A table as a line for each number, with its row's name and its column's; null where rows and header don't fit."""
    columns = [_cell(c) for c in columns or []]
    if not columns or any(len(r) != len(columns) for r in rows or []):
        return None
    rows = [[_cell(v) for v in r] for r in rows or []]
    grouping = [k for k, c in enumerate(columns) if GROUPING.search(c)]
    data = [k for k in range(len(columns)) if k not in grouping]
    lines = [f"标题: {title}"]
    for row in rows:
        name = next((row[k] for k in data if _names_something(row[k])), "")
        for k in data if name else []:
            value = row[k]
            if value and value != name and NUMBERISH.fullmatch(value.replace(",", "")):
                unit = UNIT.search(columns[k])
                if unit and re.fullmatch(r"[+-]?\d+(?:\.\d+)?", value):
                    value += unit[1].strip()
                lines.append(f"行: {name} | 列: {columns[k] if _names_something(columns[k]) else '数值'} | 值: {value}")
    notes = dict.fromkeys(row[k] for row in rows for k in grouping if row[k])
    return "\n".join([*lines, *([f"分组信息: {'；'.join(notes)}"] if notes else [])])


def chart_content(chart: dict) -> str:
    shown = lambda v: "" if v is None else f"{v:g}"
    out, names = [f"图表标题: {chart['title']}", f"图表类型: {chart['chart_type']}"], chart["categories"] or []
    if names:
        out.append(f"分类: {' | '.join(names)}")
    out.append("系列数据:")
    for s in chart["series"] or []:
        values = [shown(v) for v in s["values"] or []]
        labels = [*names, *(f"分类{k + 1}" for k in range(len(names), len(values)))]
        points = [f"{n}: {v}" for n, v in zip(labels, values + [""] * (len(labels) - len(values)))] if names else values
        out.append(f"{s['name']}: {' | '.join(points)}")
    return "\n".join(out)


def segments_of(page: dict) -> list[dict]:
    """The segments of one page, in order."""
    tables, charts, out = page["tables"] or [], page["charts"] or [], []

    def add(kind: str, title: str, content: str, subject: str | None = None, indexable: bool | None = None, outline: list[int] | None = None) -> None:
        content = content.strip()
        own = len(content) >= LEAST and kind != "section" if indexable is None else indexable
        out.append({"kind": kind, "title": title[:TITLE], "subject": subject, "content": content, "indexable": own, "outline": outline})

    in_tables = {" | ".join((v or "").strip() for v in r).strip() for t in tables for r in t["rows"] or []} | {" | ".join(t["columns"] or []).strip() for t in tables}
    lines = [x for x in lines_of(page["text"]) if x not in in_tables]
    if not tables and len(lines) == 1 and (number := outline_of(lines[0])):
        add("section", lines[0], lines[0], outline=number)
    elif not tables and is_contents(lines):
        add("section", lines[0], "\n".join(lines))
    elif lines:
        starts = [] if tables and page["is_slide"] else event_starts(lines)
        for begin, end in zip(starts, [*starts[1:], len(lines)]):
            for piece in pieces("\n".join(lines[begin:end])):
                add("event", lines[begin + 1], piece, SHORT_NAMES.get(lines[begin], lines[begin]))
        for piece in pieces("\n".join(lines)) if not starts else []:
            add("narrative", lines[0], piece)
    left = [x for x in lines if "|" not in x]
    for number, t in enumerate(tables, 1):
        title = t["title"] or ""
        if title.startswith(("Slide ", "第")):  # a parser's stand-in
            title = next((x for hint in TITLE_HINTS for x in left if hint.search(x)), f"表格 {number}")
            left = [x for x in left if x != title]
        content = table_content(title, t["columns"], t["rows"])
        add("table", title, f"表标题: {title}" if content is None else content, indexable=content is not None)
    for c in charts:
        add("chart", c["title"] or "", chart_content(c), indexable=bool(c["series"]))
    return out


def segments(items: DataFrame) -> DataFrame:
    """doc, page, part, kind, title, subject, content, indexable and outline of every segment of every page (``ITEMS``)."""
    schema = pa.schema([("doc", pa.string()), ("page", pa.int64()), ("part", pa.int32()), *((n, pa.string()) for n in ("kind", "title", "subject", "content")), ("indexable", pa.bool_()), ("outline", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                rows = [{"doc": p["doc"], "page": p["page"], "part": k, **s} for p in batch.slice(start, 500).to_pylist() for k, s in enumerate(segments_of(p))]
                yield pa.RecordBatch.from_pylist(rows, schema)

    return items.mapInArrow(run, SEGMENTS)


def with_paths(found: DataFrame) -> DataFrame:
    """Segments with section_path: the headings above each, its own included, the highest first."""
    so_far = Window.partitionBy("doc").orderBy("page", "part").rowsBetween(Window.unboundedPreceding, 0)
    level, at = F.when(F.col("outline").isNotNull(), F.least(F.size("outline"), F.lit(LEVELS))), F.struct("page", "part")
    last = {k: F.last(F.when(level == k, F.struct(at.alias("at"), "title")), ignorenulls=True).over(so_far) for k in range(1, LEVELS + 1)}
    rows = found.withColumns({f"_h{k}": c for k, c in last.items()})
    # A heading holds until one of a higher level comes.
    ends = lambda k: F.greatest(*(F.col(f"_h{j}.at") for j in range(1, k)), F.struct(F.lit(None).cast("long").alias("page"), F.lit(None).cast("int").alias("part")))
    holds = lambda k: F.col(f"_h{k}").isNotNull() & (F.lit(True) if k == 1 else F.coalesce(F.col(f"_h{k}.at") > ends(k), F.lit(True)))
    path = F.array_compact(F.array(*(F.when(holds(k), F.col(f"_h{k}.title")) for k in last)))
    return rows.withColumn("section_path", path).drop(*(f"_h{k}" for k in last))


def outline_checks(found: DataFrame) -> DataFrame:
    """doc, page, title, outline, expected and follows of every numbered heading: a number follows the last one of its level below the same heading, the first is 1."""
    heads = found.where("outline is not null").withColumn("above", F.slice("outline", 1, F.size("outline") - 1))
    heads = heads.withColumn("own", F.element_at("outline", -1))
    upper = Window.partitionBy("doc").orderBy("page", "part").rowsBetween(Window.unboundedPreceding, -1)
    # Sections of level k count anew after each heading of a higher level.
    heads = heads.withColumn("level", F.size("outline"))
    breaks = F.array(*(F.coalesce(F.count(F.when(F.col("level") < k, 1)).over(upper), F.lit(0)) for k in range(1, LEVELS + 2)))
    heads = heads.withColumn("run", F.element_at(breaks, F.least("level", F.lit(LEVELS + 1))))
    before = F.lag("own").over(Window.partitionBy("doc", "above", "run").orderBy("page", "part"))
    expected = F.concat("above", F.array(F.coalesce(before, F.lit(0)) + 1))
    return heads.select("doc", "page", "title", "outline", expected.alias("expected"), (F.col("outline") == expected).alias("follows"))
