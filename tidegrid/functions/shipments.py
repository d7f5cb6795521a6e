"""Columns of quarterly shipment records: canonical names, exact numbers, quarters of file names, period labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidegrid.functions.values import quarter_of

#: Makers by other names, and applications by the names of the reports.
MAKERS = {"tianma": "Tianma", "auo": "AUO", "boe": "BOE", "china star": "CSOT", "china_star": "CSOT", "csot": "CSOT"}
APPLICATIONS = {
    "instrument cluster": "仪表", "center stack display": "中控", "head-up display": "HUD", "control panel": "控制屏",
    "room mirror": "后视镜", "side mirror": "后视镜", "passenger display": "娱乐屏",
}
#: The order of applications in reports, the years that count, and the one specification that does.
APPLICATION_ORDER = ["仪表", "中控", "HUD", "控制屏", "后视镜", "娱乐屏"]
YEARS, SPECIFICATION = (2022, 2035), "automobile monitor"


def _text(value: Column) -> Column:
    return F.trim(F.coalesce(value.cast("string"), F.lit("")))


def _named(value: Column, names: dict[str, str]) -> Column:
    low = F.lower(_text(value))
    return F.coalesce(*(F.when(low == k, v) for k, v in names.items()))


def maker(value: Column) -> Column:
    """The maker's own name for its aliases, other names as they are, null for blank ones."""
    return F.coalesce(_named(value, MAKERS), F.nullif(_text(value), F.lit("")))


def application(value: Column) -> Column:
    return _named(value, APPLICATIONS)


def technology(value: Column) -> Column:
    """LTPS, a-Si or Oxide of a longer name; empty for any other."""
    low = F.lower(_text(value))
    return F.when(F.contains(low, F.lit("ltps")), "LTPS").when(low.rlike("a[-_]si") | (low == "asi"), "a-Si").when(F.contains(low, F.lit("oxide")), "Oxide").otherwise("")


def decimal(value: Column) -> Column:
    """An exact number without thousands separators."""
    return F.replace(_text(value), F.lit(","), F.lit("")).try_cast("decimal(38,6)")


def rounded(value: Column) -> Column:
    """Six decimals, half to even."""
    return F.bround(value, 6)


def slug(value: Column) -> Column:
    """Lower case, slashes, hyphens and white space as single underscores."""
    return F.array_join(F.filter(F.split(F.lower(F.translate(_text(value), "/-", "  ")), r"\s+"), lambda w: w != ""), "_")


def slug_each(value: Column) -> Column:
    """Lower case, each character that is neither letter nor digit as an underscore, none at the ends."""
    return F.regexp_replace(F.lower(F.regexp_replace(value.cast("string"), r"[^\p{L}\p{N}]", "_")), "^_+|_+$", "")


def fact(record: dict[str, Column]) -> dict[str, Column]:
    """The typed columns of a record of texts (year, quarter, maker, technology, specification, application, size, quantity, display_area)."""
    return {
        "year": record["year"].try_cast("double").cast("int"), "quarter": F.substring(quarter_of(record["quarter"]), 2, 1).cast("int"), "maker": maker(record["maker"]),
        "technology": technology(record["technology"]), "application": _text(record["application"]), "size": decimal(record["size"]), "quantity": decimal(record["quantity"]), "display_area": decimal(record["display_area"]),
    }


def counts(population: str, specification: Column, technology_text: Column) -> Column:
    """Whether a typed record counts for one of the reports: market (three technologies), history (all of them),
    product (LTPS and a-Si) or application (a known application, no oxide). Other monitors never do."""
    spec = F.lower(_text(specification)) == SPECIFICATION
    app = F.lower(F.translate(F.col("application"), "（）", "()"))
    others = F.contains(app, F.lit(SPECIFICATION)) & F.contains(app, F.lit("others"))
    base = F.col("year").between(*YEARS) & F.col("quarter").isNotNull() & spec & ~others
    oxide = F.contains(F.lower(_text(technology_text)), F.lit("oxide"))
    own = {
        "market": F.col("maker").isNotNull() & F.col("quantity").isNotNull() & F.col("technology").isin("LTPS", "a-Si", "Oxide"),
        "history": F.lit(True),
        "product": F.col("quantity").isNotNull() & F.col("technology").isin("LTPS", "a-Si"),
        "application": F.col("quantity").isNotNull() & application(F.col("application")).isNotNull() & ~oxide,
    }
    return F.coalesce(base & own[population], F.lit(False))


#: How file names give quarters (1Q26, 26 1Q, with 3Q25 Results).
_QUARTER_YEAR, _YEAR_QUARTER = r"(?i)(?<![0-9A-Za-z])([1-4])\s*Q\s*([0-9]{2})(?![0-9])", r"(?i)(?<![0-9A-Za-z])([0-9]{2})\s*([1-4])\s*Q(?![0-9A-Za-z])"
_RESULTS = r"(?i)with\s+([1-4])\s*Q\s*([0-9]{2})\s+Results"


def publication(name: Column) -> Column:
    """publication and data_through of a file's name, as quarters counted from the year 2000 (4 * year + quarter - 1).

    Results follow the quarter by one: a file of 1Q26 holds 4Q25. Results that are named go before that rule; the
    publication is then another quarter of the name, or the one after. Null without a quarter."""
    at = lambda y, q: y.cast("int") * 4 + q.cast("int") - 1
    marks = F.regexp_extract_all(name, F.lit(f"{_QUARTER_YEAR}|{_YEAR_QUARTER}"), F.lit(0))
    pair = lambda m: F.coalesce(
        F.when(m.rlike(r"(?i)^[1-4]\s*Q"), at(F.regexp_extract(m, r"(\d{2})$", 1), F.substring(m, 1, 1))), at(F.substring(m, 1, 2), F.regexp_extract(m, r"(?i)([1-4])\s*Q$", 1))
    )
    quarters = F.transform(marks, pair)
    results = F.when(name.rlike(_RESULTS), at(F.regexp_extract(name, _RESULTS, 2), F.regexp_extract(name, _RESULTS, 1)))
    other = F.get(F.filter(quarters, lambda q: q != results), F.lit(0))
    last = F.element_at(quarters, -1)
    return F.when(F.size(marks) > 0, F.struct(F.when(results.isNotNull(), F.coalesce(other, results + 1)).otherwise(last).alias("publication"), F.coalesce(results, last - 1).alias("data_through")))


def quarter_label(at: Column) -> Column:
    """1Q26 of a quarter counted from the year 2000."""
    return F.concat((at % 4 + 1).cast("string"), F.lit("Q"), F.lpad(F.floor(at / 4).cast("string"), 2, "0"))


def period_key(label: Column) -> Column:
    """year and quarter of Y24, Y25F, Y25Q1-Q3 and Y26Q1 (no quarter but for the last); null for anything else."""
    text = F.upper(F.trim(label))
    year = F.regexp_extract(text, r"^Y(\d+)(?:F|Q1-Q3.*|Q[1-4])?$", 1).try_cast("int") + 2000
    quarter = F.regexp_extract(text, r"^Y\d+Q([1-4])$", 1).try_cast("int")
    return F.when(year.isNotNull(), F.struct(year.alias("year"), quarter.alias("quarter")))


def period_order(label: Column) -> Column:
    """What labels sort by: a year, its first three quarters, the full year, then its quarters; others last."""
    key, text = period_key(label), F.upper(F.trim(label))
    place = F.when(F.endswith(text, F.lit("F")), 41).when(F.contains(text, F.lit("Q1-Q3")), 30).otherwise(F.coalesce(key["quarter"] * 10 + 2, F.lit(0)))
    return F.struct(F.coalesce(key["year"], F.lit(9999)).alias("year"), F.when(key.isNull(), 999).otherwise(place).alias("place"))


def year_peer(label: Column) -> Column:
    """The same quarter a year before; null for labels that name no quarter."""
    key = period_key(label)
    return F.when(key["quarter"].isNotNull(), F.format_string("Y%02dQ%d", key["year"] - 2001, key["quarter"]))


def within(label: Column, year: int, quarter: int) -> Column:
    """Labels of quarters up to one, and of years up to its year."""
    key = period_key(label)
    return F.when(key.isNull(), F.upper(F.trim(label)).rlike("F$|Q1-Q3")).otherwise(F.when(key["quarter"].isNull(), key["year"] <= year).otherwise((key["year"] * 4 + key["quarter"]) <= year * 4 + quarter))
