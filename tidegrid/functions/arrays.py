"""Arrays inside a row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def holding(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once.

    An expression inside a lambda is computed anew for every element, so an array that is used within its own
    ``transform`` costs the square of its length; the variable of a lambda over one element is there already."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


#: What DuckDB's trim takes away: characters of Unicode's category Zs.
SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def trimmed(texts: Column, spaces: str | None = None) -> Column:
    """Each text without blanks (or ``spaces``) at its ends.

    ``F.trim`` itself as a lambda would be given the place as what to trim, as it takes two columns."""
    return F.transform(texts, lambda x: F.trim(x) if spaces is None else F.trim(x, F.lit(spaces)))


def once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """The rows with a column that is computed once a row.

    Filters on a column, and several uses of it, would be merged with what it is computed from, which they then do anew
    each; past an ``explode`` nothing is moved."""
    return rows.select("*", F.explode(F.array(value)).alias(name))
