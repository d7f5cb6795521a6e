"""Reports as JSON of any depth: metrics, other data and conclusions as rows, and JSON cut out of running text.

A report is one value, and its parts refer to one another (a metric's evidence, a conclusion's trace), so it is taken apart in the
row that holds it, by an Arrow function; nothing is shuffled. JSON inside other text is cut out by the depth of its brackets; brackets inside
strings, which may hold escaped quotes, don't count.

Edge cases: a null, empty or broken report, or one that isn't an object, has no rows; a metric that occurs more than once is its longest
object (the first of equals) at its first path; blank ids and blank conclusions don't count; objects without an end are no slices.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: Below which keys strings are conclusions, the roots without any, keys of evidence, and how ranked models are written.
NARRATIVE_KEYS = ["executive_summary", "insights", "overview", "drivers", "conclusion", "conclusions", "analysis"]
NO_NARRATIVE, EVIDENCE_KEYS = ["computed_metrics", "evidence", "narrative_sources", "quality"], ["evidence", "comparison_evidence", "source_evidence"]
RANKED = r'"对象"\s*:\s*"([^"]{1,80})"\s*,\s*"销量/数值"\s*:\s*([0-9]+(?:\.[0-9]+)?)'
PROJECTED = "report_id long, nr int, kind string, key string, title string, content string, json_path string, evidence string"


def _text(value: object) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def _plain(value: object) -> str:
    return re.sub(r"\s+", " ", value).strip() if isinstance(value, str) else ""


def _metric_id(node: dict) -> str | None:
    own = node.get("metric_id")
    return None if own is None else own if isinstance(own, str) else _text(own)


def _children(node: object, path: str) -> list[tuple[str, object]]:
    if isinstance(node, dict):
        return [(f"{path}.{k}", v) for k, v in node.items()]
    return [(f"{path}[{k}]", v) for k, v in enumerate(node)] if isinstance(node, list) else []


def walk(node: object, path: str, stops: Callable[[object], bool]) -> Iterator[tuple[str, object]]:
    """Every node of a tree with its path, in reading order; what ``stops`` holds for is not looked into."""
    left = [(path, node)]
    while left:
        at, own = left.pop()
        yield at, own
        if not stops(own):
            left += reversed(_children(own, at))


def rebuilt(node: object, f: Callable[[object, list], object]) -> object:
    """A tree put together again from its leaves: ``f`` gets each node and its children's new values."""
    done: list[object] = []
    left = [(node, False)]
    while left:
        own, ready = left.pop()
        inner = list(own.values()) if isinstance(own, dict) else own if isinstance(own, list) else []
        if ready or not inner:
            args = done[len(done) - len(inner) :] if inner else []
            del done[len(done) - len(inner) :]
            done.append(f(own, args))
        else:
            left.append((own, True))
            left += [(x, False) for x in reversed(inner)]
    return done[0]


def _without(keys: list[str]) -> Callable[[object, list], object]:
    return lambda node, new: {k: v for k, v in zip(node, new) if k not in keys} if isinstance(node, dict) else new if isinstance(node, list) else node


def _rest(node: object, new: list) -> object:
    """What is left of a node without metrics; null where nothing is."""
    if isinstance(node, dict):
        return None if node.get("metric_id") is not None else {k: v for k, v in zip(node, new) if v not in (None, {}, [])}
    return [v for v in new if v not in (None, {}, [])] if isinstance(node, list) else node


def metrics_of(root: dict) -> Iterator[dict]:
    computed = root.get("computed_metrics")
    named = lambda n: isinstance(n, dict) and bool((_metric_id(n) or "").strip())
    longest, path = {}, {}
    for at, node in walk(computed, "$.computed_metrics", named):
        if named(node):
            own = _metric_id(node)
            path.setdefault(own, at)
            if own not in longest or len(_text(node)) > len(_text(longest[own])):
                longest[own] = node
    evidence = root.get("evidence") if isinstance(root.get("evidence"), list) else []
    given = {}
    for item in evidence:
        if isinstance(item, dict) and (_metric_id(item) or "").strip():
            given.setdefault(_metric_id(item), item.get("evidence"))
    for own, node in longest.items():
        inside = {k: node[k] for k in ("evidence", "comparison_evidence") if k in node}
        found = given[own] if own in given else inside or None
        yield {"kind": "METRIC", "key": own, "title": f"指标 / {own}", "content": _text(rebuilt(node, _without(EVIDENCE_KEYS))), "json_path": path[own], "evidence": None if found is None else _text(found)}
    for section, node in computed.items() if isinstance(computed, dict) else []:
        rest = rebuilt(node, _rest)
        if rest not in (None, {}, []):
            yield {"kind": "DATASET", "key": f"dataset.{section}", "title": f"数据集 / {section}", "content": _text(rest), "json_path": f"$.computed_metrics.{section}", "evidence": None}


def conclusions_of(root: dict) -> Iterator[dict]:
    traced: dict[str, dict] = {}
    for item in root.get("narrative_sources") if isinstance(root.get("narrative_sources"), list) else []:
        if isinstance(item, dict) and (own := _plain(item.get("conclusion"))):
            traced.setdefault(own, item)
    said: dict[str, None] = {}
    left: list[tuple[object, bool]] = [(root, False)]
    while left:
        node, inside = left.pop()
        if isinstance(node, dict):
            left += reversed([(v, inside or k in NARRATIVE_KEYS) for k, v in node.items() if k not in NO_NARRATIVE])
        elif isinstance(node, list):
            left += reversed([(v, inside) for v in node])
        elif inside and (own := _plain(node)):
            said.setdefault(own)
    for number, own in enumerate([*said, *(t for t in traced if t not in said)], 1):
        source = traced.get(own)
        if source is None:
            trace, key, text = {"traceability": "REPORT_ONLY"}, "", own
        else:
            trace = {"traceability": "METRIC_EVIDENCE"} | {k: source.get(k) for k in ("citation_label", "source_file", "metric_ids", "metrics")}
            if "evidence" in source:
                trace["source_evidence"] = source["evidence"]
            ids = source.get("metric_ids")
            key, text = (str(ids[0]) if isinstance(ids, list) and ids else ""), source["conclusion"].strip()
        yield {"kind": "CONCLUSION", "key": key, "title": f"结论 / {number}", "content": f"结论：{text}", "json_path": None, "evidence": _text(trace)}


def metadata_of(report: dict, root: dict) -> Iterator[dict]:
    more = {k: root[k] for k in ("quality", "data_gaps") if k in root}
    if more:
        about = {"report_id": report["report_id"], "report_type": report["report_type"], "generation_mode": report["generation_mode"]}
        yield {"kind": "METADATA", "key": "", "title": "报告元数据", "content": _text(about | more), "json_path": None, "evidence": None}


def projected(reports: DataFrame) -> DataFrame:
    """report_id, nr, kind (METRIC, DATASET, CONCLUSION, METADATA), key, title, content, json_path and evidence.

    ``reports``: report_id, report_type, generation_mode and content (JSON)."""
    schema = pa.schema([("report_id", pa.int64()), ("nr", pa.int32()), *((n, pa.string()) for n in ("kind", "key", "title", "content", "json_path", "evidence"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                rows = []
                for report in batch.slice(start, 200).to_pylist():
                    try:
                        root = json.loads(report["content"] or "")
                    except (ValueError, RecursionError):  # deeper than the parser goes
                        continue
                    if isinstance(root, dict):
                        parts = [*metrics_of(root), *conclusions_of(root), *metadata_of(report, root)]
                        rows += [{"report_id": report["report_id"], "nr": k} | p for k, p in enumerate(parts, 1)]
                yield pa.RecordBatch.from_pylist(rows, schema)

    return reports.select(F.col("report_id").cast("long").alias("report_id"), "report_type", "generation_mode", "content").mapInArrow(run, PROJECTED)


_MARKS = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\[\]]', re.DOTALL)


def balanced(content: str | None, key: str, opening: str) -> str | None:
    """The first object (``{``) or list (``[``) after the quoted key, from its bracket to the one that closes it; null if there is none."""
    begin = (content or "").find(f'"{key}"')
    if begin < 0:
        return None
    depth, start = 0, -1
    for mark in _MARKS.finditer(content, begin + len(key) + 2):
        if mark[0] == opening:
            start, depth = (mark.start() if start < 0 else start), depth + 1
        elif start >= 0 and mark[0] == "}]"["{[".index(opening)]:
            depth -= 1
            if not depth:
                return content[start : mark.end()]
    return None


def balanced_slice(content: Column, key: str, opening: str = "{") -> Column:
    @pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: balanced(v, key, opening)).astype(object)

    return run(content)


def ranking_slice(content: Column, names: Column) -> Column:
    """Where a chunk of a report ranks models: all of it if it is named so, else the part of its rankings that is of models."""

    @pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: (r := balanced(v, "rankings", "{")) and (balanced(r, "model", "{") or balanced(r, "model", "["))).astype(object)

    both = F.lower(F.concat_ws(" ", content, names))
    return F.when(F.contains(both, F.lit("top_model")) | F.contains(both, F.lit("full_model")), content).otherwise(run(content))


def period_label(content: Column) -> Column:
    """A report's display label, or its latest month; empty without either."""
    shown = F.regexp_extract(content, r'"display_label"\s*:\s*"([^"]{2,40})"', 1)
    latest = r'"latest_period"\s*:\s*"(20\d{2})-(\d{2})"'
    month = F.concat(F.regexp_extract(content, latest, 1), F.lit("年"), F.regexp_extract(content, latest, 2).try_cast("int").cast("string"), F.lit("月"))
    return F.when(shown != "", shown).otherwise(F.coalesce(month, F.lit("")))


def model_rankings(chunks: DataFrame, subject: str, most: int = 10) -> DataFrame:
    """The columns of ``chunks`` (content, names, ...) with nr, model, units and fact of the first ``most`` ranked models of each chunk that is
    about the subject; the subject itself is no model."""
    rows = chunks.where(F.contains(F.lower("names"), F.lit(subject.lower()))).withColumn("_slice", ranking_slice(F.col("content"), F.col("names")))
    models, units = (F.regexp_extract_all("_slice", F.lit(RANKED), F.lit(g)) for g in (1, 2))
    own = lambda m: F.contains(F.lower(m["model"]), F.lit(subject.lower())) & (F.length(m["model"]) <= len(subject) + 2)
    found = F.slice(F.filter(F.arrays_zip(models.alias("model"), units.alias("units")), lambda m: ~own(m)), 1, most)
    rows = rows.withColumn("_label", period_label(F.col("content"))).select("*", F.posexplode(found).alias("_at", "_m"))
    fact = F.concat("_label", F.lit(f"{subject}车型"), "_m.model", F.lit("销量为"), "_m.units", F.lit("辆"))
    return rows.select(*chunks.columns, (F.col("_at") + 1).alias("nr"), "_m.model", F.col("_m.units").cast("double").alias("units"), fact.alias("fact"))
