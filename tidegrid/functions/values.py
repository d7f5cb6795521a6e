"""Numbers and dates in loosely written cells.

A cell is cut into its numbers once, each with the percent sign after it, and what it means is decided from those.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words before a change on the year or the month before, and cells that stand for no number.
CHANGE_WORDS, NO_NUMBER = ["同比", "环比"], ["", "-", "--", "—", "–"]
#: The ways to write a period, and the key of each.
PERIODS = [
    (r"^(20\d{2})(0[1-9]|1[0-2])(?:\.0)?$", "$1-$2"),
    (r"^(20\d{2})[.\-/年](0[1-9]|1[0-2])月?$", "$1-$2"),
    (r"^(20\d{2})[.\-/年]([1-9])月?$", "$1-0$2"),
    (r"^(20\d{2})年?[Qq]([1-4])$", "$1-Q$2"),
    (r"^(20\d{2})年([1-4])季度$", "$1-Q$2"),
    (r"^(\d{2})月$", "M$1"),
    (r"^(\d)月$", "M0$1"),
]


def normal_text(cell: Column) -> Column:
    """Ideographic spaces and full-width parentheses as their ASCII forms, trimmed; null as empty."""
    return F.trim(F.translate(F.coalesce(cell, F.lit("")), "　（）", " ()"))


def _numbers(cell: Column) -> Column:
    """The numbers of a cell in order, without thousands separators, those before a percent sign with it."""
    return F.regexp_extract_all(F.regexp_replace(cell, ",", ""), F.lit(r"[+-]?\d+(?:\.\d+)?(?:\s*%)?"), F.lit(0))


def _percents(numbers: Column) -> Column:
    return F.filter(numbers, lambda n: F.endswith(n, F.lit("%")))


def _fraction(percent: Column) -> Column:
    return F.regexp_replace(percent, r"\s*%", "").try_cast("double") / 100


def parse_numeric(cell: Column) -> Column:
    """The first number of a cell; dashes and blanks are null.

    A cell is a fraction where its only number is a percentage that ends it, or where it begins with the word for
    a change and holds a percentage. Units don't scale."""
    text = normal_text(cell)
    found, bare = _numbers(text), F.regexp_replace(text, r"\s+", "")
    change = F.substring(bare, 1, 2).isin(CHANGE_WORDS)
    alone = (F.size(found) == 1) & F.endswith(bare, F.lit("%"))
    first = F.regexp_replace(F.get(found, F.lit(0)), r"\s*%", "").try_cast("double")
    return F.when(text.isin(NO_NUMBER), None).when((change | alone) & (F.size(_percents(found)) > 0), _fraction(F.get(_percents(found), F.lit(0)))).otherwise(first)


def extract_yoy(cell: Column) -> Column:
    """The first percentage of a cell that speaks of a change on the year before, as a fraction."""
    text = normal_text(cell)
    return F.when(F.contains(text, F.lit(CHANGE_WORDS[0])), _fraction(F.get(_percents(_numbers(text)), F.lit(0))))


def parse_period(cell: Column) -> Column:
    """YYYY-MM, YYYY-Qn or Mnn by the first way of ``PERIODS`` that a cell is written in; other text of up to 20 characters as it is."""
    text = F.regexp_replace(normal_text(cell), " ", "")
    ways = [F.when(text.rlike(pattern), F.regexp_replace(text, pattern, key)) for pattern, key in PERIODS]
    return F.when(text != "", F.coalesce(*ways, F.when(F.length(text) <= 20, text)))


def quarter_of(cell: Column) -> Column:
    """Q1 to Q4 of 1, Q1, 1Q or Quarter 1; else null."""
    compact = F.regexp_replace(F.replace(F.upper(normal_text(cell)), F.lit("QUARTER"), F.lit("Q")), " ", "")
    return F.when(compact.rlike(r"^(?:Q?[1-4]|[1-4]Q)$"), F.concat(F.lit("Q"), F.regexp_extract(compact, "[1-4]", 0)))
