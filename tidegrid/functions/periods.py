"""Month arithmetic on YYYY-MM strings, and the period that a question is about."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def shift_months(period: Column, months: int) -> Column:
    """The month so many later, as YYYY-MM."""
    return F.date_format(F.add_months(F.concat(period, F.lit("-01")).cast("date"), months), "yyyy-MM")


def month_list(first: str, last: str) -> list[str]:
    a, b = (int(p[:4]) * 12 + int(p[5:]) - 1 for p in (first, last))
    return [f"{m // 12:04d}-{m % 12 + 1:02d}" for m in range(a, b + 1)]


def month_before(period: str) -> str:
    """The month before a YYYY-MM."""
    year, month = int(period[:4]), int(period[5:7])
    return f"{year - 1}-12" if month == 1 else f"{year}-{month - 1:02d}"


def year_before(period: str) -> str:
    return f"{int(period[:4]) - 1:04d}{period[4:]}"


@dataclass(frozen=True)
class AnalysisPeriod:
    """Months asked for, those present, and the same a year earlier."""

    expected: tuple[str, ...]
    present: tuple[str, ...]
    compared: tuple[str, ...]
    compared_present: tuple[str, ...]
    trend: tuple[str, ...]
    stock: str | None
    warnings: tuple[str, ...] = ()

    @property
    def complete(self) -> bool:
        return bool(self.expected) and self.expected == self.present

    @property
    def comparable(self) -> bool:
        return bool(self.compared) and self.compared == self.compared_present

    @property
    def is_range(self) -> bool:
        return len(self.expected) > 1


def available_months(facts: DataFrame) -> list[str]:
    """The sorted months of a fact view; as many rows as months come to the driver."""
    rows = facts.where("time_period is not null").select("time_period").distinct().collect()
    return sorted(r[0] for r in rows)


def resolve_period(months: list[str], mode: str = "latest", start: str | None = None, end: str | None = None) -> AnalysisPeriod:
    """``latest``; ``single`` (start); ``year`` (start is YYYY); ``range`` (start to end)."""
    if not months:
        return AnalysisPeriod((), (), (), (), (), None, ("no period in the data",))
    if mode == "latest":
        start = end = months[-1]
    elif mode == "single":
        if start not in months:
            raise ValueError(f"no data for {start}")
        end = start
    elif mode == "year":
        if not 1900 <= int(start) <= 2100:
            raise ValueError(f"no such year: {start}")
        start, end = f"{start}-01", f"{start}-12"
    elif mode == "range":
        if start > end:
            raise ValueError("the range ends before it starts")
    else:
        raise ValueError(f"no such mode: {mode}")
    there, expected = set(months), month_list(start, end)
    present = [m for m in expected if m in there]
    compared = [year_before(m) for m in expected]
    trend = [m for m in months if m <= end] if mode in ("latest", "single") else present
    stock = end if end in there else (present[-1] if present else None)
    missing = [m for m in expected if m not in there]
    return AnalysisPeriod(
        tuple(expected), tuple(present), tuple(compared), tuple(m for m in compared if m in there), tuple(trend), stock,
        (f"missing months: {', '.join(missing)}",) if missing else (),
    )
