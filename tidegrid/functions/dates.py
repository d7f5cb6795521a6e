"""Publication dates as publishers write them: calendar dates and instants, never guessed from the time of reading."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
#: The forms of dates that are read, with the groups of year, month and day.
COMPACT = (r"^(\d{4})(\d{2})(\d{2})(?:\d{4}(?:\d{2})?)?$", 1, 2, 3)
SHORT_YEAR = (r"(?<!\d)(\d{1,2})[/.](\d{1,2})[/.](\d{2})(?!\d)", 3, 2, 1)
SLASHED = (r"(?<!\d)(\d{1,2})/(\d{1,2})/(\d{4})(?!\d)", 3, 1, 2)
NUMERIC = (r"(\d{4})\s*(?:[-/.]|年)\s*(\d{1,2})\s*(?:[-/.]|月)\s*(\d{1,2})", 1, 2, 3)
WITH_ZONE = (r"(?i)(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)\s+([A-Za-z]{3,9})\.?\s+(\d{1,2})\s+\d{1,2}:\d{2}(?::\d{2})?\s+[A-Za-z]{2,8}\s+(\d{4})", 3, 1, 2)
ENGLISH = r"(\d{1,2}\s+[A-Za-z]{3,9}\.?\s+\d{4}|[A-Za-z]{3,9}\.?\s+\d{1,2},\s*\d{4})"
EPOCH = r"^\d{10}(?:\d{3})?$"


def _plain(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def _date(year: Column, month: Column, day: Column) -> Column:
    """The date of three texts or numbers; null where there is none."""
    return F.concat(F.lpad(year.cast("string"), 4, "0"), F.lit("-"), F.lpad(month.cast("string"), 2, "0"), F.lit("-"), F.lpad(day.cast("string"), 2, "0")).try_cast("date")


def _found(text: Column, form: tuple[str, int, int, int]) -> list[Column]:
    pattern, *groups = form
    return [F.regexp_extract(text, pattern, g) for g in groups]


def _month_number(name: Column) -> Column:
    """1 to 12 of a month's full English name or its first three letters (four for September)."""
    low = F.lower(name)
    tests = [F.when(low.isin(m.lower(), m[:3].lower(), *(["sept"] if k == 9 else [])), k) for k, m in enumerate(_MONTHS, 1)]
    return F.coalesce(*tests)


def _seconds(text: Column) -> Column:
    number = text.try_cast("long")
    return F.when(F.length(text) == 13, number / 1000).otherwise(number.cast("double"))


def _utc(micros: Column) -> Column:
    """A moment in microseconds as a timestamp without zone, read in UTC whatever the session's zone."""
    return F.timestamp_add("MICROSECOND", micros, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def parse_publish_date(value: Column) -> Column:
    """The calendar date that a publisher's text names; null for relative, ambiguous and impossible ones.

    The first form that a text is written in decides: packed digits, seconds or milliseconds since 1970, day/month/
    two-digit year, month/day/year (not where both could be months), year first, and English month names."""
    text = _plain(value)
    year, first, second = _found(text, SLASHED)
    ambiguous = (first.try_cast("int") <= 12) & (second.try_cast("int") <= 12)
    short = _found(text, SHORT_YEAR)
    zone_year, zone_month, zone_day = _found(text, WITH_ZONE)
    english = F.regexp_extract(text, ENGLISH, 1)
    english_date = _date(F.regexp_extract(english, r"(\d{4})$", 1), _month_number(F.regexp_extract(english, "[A-Za-z]+", 0)), F.regexp_extract(english, r"(?<!\d)(\d{1,2})(?!\d)", 1))
    return (
        F.when(text.rlike(COMPACT[0]), _date(*_found(text, COMPACT)))
        .when(text.rlike(EPOCH), _utc((_seconds(text) * 1_000_000).cast("long")).cast("date"))
        .when(text.rlike(SHORT_YEAR[0]), _date(F.concat(F.lit("20"), short[0]), short[1], short[2]))
        .when(text.rlike(SLASHED[0]), F.when(~ambiguous, _date(year, first, second)))
        .when(text.rlike(NUMERIC[0]), _date(*_found(text, NUMERIC)))
        .when(text.rlike(WITH_ZONE[0]), _date(zone_year, _month_number(zone_month), zone_day))
        .when(english != "", english_date)
    )


_ISO = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?"


def published_at(value: Column, hint: str | None = None) -> Column:
    """A publication time as it is stored: instants in UTC, calendar dates and times without a zone as YYYY-MM-DD.

    Numeric dates with slashes whose first two numbers could both be months are null, unless ``hint`` (a pattern such
    as dd/MM/yyyy) says their order."""
    text = _plain(value)
    moment = _utc((_seconds(text) * 1_000_000).cast("long"))
    with_zone = text.rlike(_ISO + r"(?:Z|[+-]\d{2}:?\d{2})$")
    zoned = _utc(F.unix_micros(text.try_cast("timestamp")))
    iso = lambda t: F.concat(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.date_format(t, "SSSSSS") != "000000", F.concat(F.lit("."), F.date_format(t, "SSSSSS"))).otherwise(""), F.lit("+00:00"))
    slashed = r"^(\d{1,2})/(\d{1,2})/(\d{2}|\d{4})$"
    a, b, y = (F.regexp_extract(text, slashed, g) for g in (1, 2, 3))
    year = F.when(F.length(y) == 2, F.concat(F.lit("20"), y)).otherwise(y)
    ordered = F.when(a.try_cast("int") > 12, _date(year, b, a)).otherwise(_date(year, a, b))
    ambiguous = (a.try_cast("int") <= 12) & (b.try_cast("int") <= 12)
    hinted = F.to_date(F.try_to_timestamp(text, F.lit(hint))) if hint else F.lit(None).cast("date")
    day = (
        F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text.try_cast("date")).when(text.rlike(_ISO + "$"), F.substring(text, 1, 10).try_cast("date"))
        .when(hinted.isNotNull(), hinted).when(text.rlike(slashed), F.when(~ambiguous, ordered)).otherwise(parse_publish_date(text))
    )
    return F.when(text.rlike(EPOCH) & F.year(moment).between(1970, 2100), iso(moment)).when(with_zone, iso(zoned)).otherwise(F.date_format(day, "yyyy-MM-dd"))


def frequency(text: Column) -> Column:
    """30m, 6h or 1d as an interval; null for anything else."""
    n, unit = F.regexp_extract(F.lower(F.trim(text)), r"^(\d+)([mhd])$", 1).try_cast("int"), F.regexp_extract(F.lower(F.trim(text)), r"^(\d+)([mhd])$", 2)
    return F.make_dt_interval(F.when(unit == "d", n).otherwise(0), F.when(unit == "h", n).otherwise(0), F.when(unit == "m", n).otherwise(0), F.when(unit == "", None).otherwise(F.lit(0).cast("decimal(18,6)")))


def is_due(last_success: Column, every: Column, now: Column) -> Column:
    """A source without a success is due, others once their frequency has passed since."""
    return last_success.isNull() | frequency(every).isNull() | (now >= last_success + frequency(every))
