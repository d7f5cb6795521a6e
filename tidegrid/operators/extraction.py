"""What a model has read in a text, placed in it: entities and records with offsets, and a graph table rebuilt version by version.

A finding counts only where the text itself says it. All of a text's findings are in its row, so places, cover and duplicates are
decided there and nothing is shuffled.

Edge cases: null lists, null and blank values have no finding; a value that the text lacks has no place (-1) as an entity and is left out of a
record; of equal findings the first stays.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.functions.arrays import holding
from tidegrid.operators.evidence import inches, units_sold

#: Characters before and after a value that stand for its evidence, and the longest span of a record's.
BEFORE, AFTER, SPAN = 60, 100, 320
#: How technologies are written (without separators), whole names marked by =, and their names.
TECHNOLOGIES = [
    ("Mini LED", ["miniled"]), ("Micro LED", ["microled"]), ("OLED", ["oled"]), ("LTPS", ["ltps"]), ("a-Si", ["asi"]), ("TFT-LCD", ["tftlcd"]), ("BEV", ["=bev", "batteryelectric"]),
    ("PHEV", ["=phev", "pluginhybrid"]), ("HEV", ["=hev", "hybridelectric"]), ("ICE", ["=ice", "internalcombustion"]), ("EV", ["=ev", "electricvehicle"]),
]
FIELDS = ["supplier", "customer", "vehicle", "technology", "size", "sales"]


def _clean(value: Column) -> Column:
    return F.regexp_replace(F.coalesce(value, F.lit("")), r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def technology(raw: Column) -> Column:
    plain = F.regexp_replace(F.lower(raw), r"[\s_-]", "")
    said = lambda w: plain == w[1:] if w.startswith("=") else F.contains(plain, F.lit(w))
    out = reduce(lambda out, t: out.when(reduce(lambda a, b: a | b, map(said, t[1])), t[0]), TECHNOLOGIES[1:], F.when(reduce(lambda a, b: a | b, map(said, TECHNOLOGIES[0][1])), TECHNOLOGIES[0][0]))
    return out.otherwise(_clean(raw))


def normal_value(kind: Column, raw: Column) -> Column:
    """A technology by its name, a size in inches, sales in units; else the value with single spaces."""
    number = lambda v: F.regexp_replace(F.format_string("%.6f", v), r"\.?0+$", "")
    sold, size = units_sold(raw), inches(raw)
    plain = F.regexp_replace(_clean(raw), r"\s+", " ")
    return (
        F.when(kind == "TECHNOLOGY", technology(raw)).when((kind == "SALES") & sold.isNotNull(), F.concat(number(sold), F.lit(" unit")))
        .when((kind == "SIZE") & size.isNotNull(), F.concat(number(size), F.lit(" inch"))).otherwise(plain)
    )


def _window(text: Column, raw: Column) -> Column:
    """What stands around the first occurrence of a value; empty without one."""
    at = F.instr(text, raw) if isinstance(raw, str) else F.call_function("instr", text, raw)
    start = F.greatest(at - 1 - BEFORE, F.lit(0))
    return F.when(at > 0, _clean(F.substr(text, start + 1, at - 1 + F.length(raw) + AFTER - start))).otherwise("")


def _first_of_each(found: Column, key) -> Column:
    """The elements whose key no earlier one has."""
    return holding(found, lambda ls: holding(F.transform(ls, key), lambda keys: F.filter(ls, lambda x, i: F.array_position(keys, F.get(keys, i)) == i + 1)))


def entities(text: Column, items: Column) -> Column:
    """kind, raw, value, evidence, first and end (from 0; -1 where the text lacks it) of a text's items (kind, raw, evidence): the place is the
    first from the evidence on. Of one kind, value and place one stays."""

    def located(t: Column, item: Column) -> Column:
        kind, raw, said = F.upper(_clean(item["kind"])), _clean(item["raw"]), _clean(item["evidence"])
        evidence = F.when((said != "") & F.contains(t, said), said).otherwise(_window(t, raw))
        after = F.greatest(F.call_function("instr", t, evidence), F.lit(1))
        at = F.call_function("locate", raw, t, after)
        at = F.when(at > 0, at).otherwise(F.call_function("instr", t, raw)) - 1
        return holding(F.struct(kind.alias("kind"), raw.alias("raw"), evidence.alias("evidence"), at.alias("at")), lambda x: F.struct(
            x["kind"].alias("kind"), x["raw"].alias("raw"), normal_value(x["kind"], x["raw"]).alias("value"), x["evidence"].alias("evidence"), x["at"].alias("first"), F.when(x["at"] < 0, -1).otherwise(x["at"] + F.length(x["raw"])).alias("end")))

    real = F.filter(F.coalesce(items, F.array().cast("array<struct<kind:string,raw:string,evidence:string>>")), lambda x: (_clean(x["kind"]) != "") & (_clean(x["raw"]) != ""))
    found = holding(F.coalesce(text, F.lit("")), lambda t: F.transform(real, lambda x: located(t, x)))
    return _first_of_each(found, lambda x: F.struct(x["kind"], x["value"], x["first"]))


def records(text: Column, items: Column) -> Column:
    """The fields, evidence, first and end of a text's records (``FIELDS`` and evidence): two fields or more that the text holds, one of
    them a supplier, customer or vehicle, and an evidence that covers them all: the given one, or the span of their first places."""

    def placed(t: Column, item: Column) -> Column:
        own = lambda f: holding(_clean(item[f]), lambda v: F.when((v != "") & F.contains(t, v), v))
        values = F.struct(*(own(f).alias(f) for f in FIELDS), _clean(item["evidence"]).alias("said"))

        def proven(v: Column) -> Column:
            held = [v[f] for f in FIELDS]
            covers = lambda e: (e != "") & reduce(lambda a, b: a & b, (x.isNull() | F.contains(e, x) for x in held))
            places = [F.when(x.isNotNull(), F.call_function("instr", t, x)) for x in held]
            begin, end = F.least(*places), F.greatest(*(p + F.length(x) for p, x in zip(places, held, strict=True)))
            span = F.when(end - begin <= SPAN, _clean(F.substr(t, begin, end - begin))).otherwise(_window(t, F.coalesce(*held)))
            evidence = F.when(F.contains(t, v["said"]) & covers(v["said"]), v["said"]).otherwise(span)
            enough = (reduce(lambda a, b: a + b, (x.isNotNull().cast("int") for x in held)) >= 2) & F.coalesce(*held[:3]).isNotNull()
            at = lambda e: F.call_function("instr", t, e) - 1
            return F.when(enough, holding(evidence, lambda e: F.when(covers(e), F.struct(*(v[f].alias(f) for f in FIELDS), e.alias("evidence"), at(e).alias("first"), (at(e) + F.length(e)).alias("end")))))

        return holding(values, proven)

    given = F.coalesce(items, F.array().cast(f"array<struct<{','.join(f'{f}:string' for f in [*FIELDS, 'evidence'])}>>"))
    found = holding(F.coalesce(text, F.lit("")), lambda t: F.filter(F.transform(given, lambda x: placed(t, x)), lambda r: r.isNotNull()))
    return _first_of_each(found, lambda r: F.struct(*(r[f] for f in FIELDS), r["first"]))


def rebuild(edges: DataFrame, versions: DataFrame, path: str, by: str) -> None:
    """Replaces the edges of ``versions`` (one column, ``by``) in the table at ``path`` by ``edges``; other versions aren't touched.

    Every version gets a row without an edge too, so one that has lost all its edges is emptied; running it again changes nothing, and a run that
    fails leaves the table as it was. Edges of a version of any size are written by as many tasks as hold them."""
    empty = versions.select(by).distinct().withColumns({f.name: F.lit(None).cast(f.dataType) for f in edges.schema if f.name != by})
    rows = edges.join(versions.select(by).distinct(), by, "left_semi").unionByName(empty)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def graph_at(spark: SparkSession, path: str, required: str) -> DataFrame:
    """The edges of the table, without the rows that only name a version."""
    return spark.read.parquet(path).where(F.col(required).isNotNull())
