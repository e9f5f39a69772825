"""Dates in statements and receipts, and the clock arithmetic of queues and plans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyspark.functions.tables import MONTHS
from tallyspark.functions.text import let, strip_marks


def _int(text: Column) -> Column:
    return text.try_cast("int")


def month_number(name: Column) -> Column:
    """1 to 12 for a month's name or short form in six languages, else null."""
    number = F.create_map(*(F.lit(x) for pair in MONTHS.items() for x in pair))
    return F.try_element_at(number, F.lower(strip_marks(name)))


def full_year(year: Column) -> Column:
    """Two-digit years from 70 on lie in the last century."""
    return F.when(year >= 1000, year).when(year >= 70, year + 1900).otherwise(year + 2000)


def _date(year: Column, month: Column, day: Column) -> Column:
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.concat(F.lpad(let(year, full_year).cast("string"), 4, "0"), F.lit("-"), two(month), F.lit("-"), two(day)).try_cast("date")


def parse_date(raw: Column, order: Column | str = "auto") -> Column:
    """The date in `raw`, or null: ISO, day-month-year and month-day-year by name, numeric by `order` (dmy, mdy, or
    auto, which is dmy) unless a part over 12 settles it, and yyyymmdd."""
    order = F.lit(order) if isinstance(order, str) else order
    return let(F.trim(raw), lambda text: _parsed_date(text, order))


def _parsed_date(text: Column, order: Column) -> Column:
    part = lambda pattern, i: F.nullif(F.regexp_extract(text, pattern, i), F.lit(""))
    iso = r"^(\d{4})-(\d{1,2})-(\d{1,2})(?:[T ].*)?\z"
    named = r"^(\d{1,2})[ .\-/]+(\p{L}{3,})\.?[ .,\-/]+(\d{2,4})\z"
    american = r"^(\p{L}{3,})\.?[ .\-/]+(\d{1,2})(?:st|nd|rd|th)?[ .,\-/]+(\d{2,4})\z"
    numeric = r"^(\d{1,2})[./\- ](\d{1,2})[./\- ](\d{2,4})(?:[ T].*)?\z"
    compact = r"^(\d{4})(\d{2})(\d{2})\z"
    a, b, y = (_int(part(numeric, i)) for i in (1, 2, 3))
    month_first = (b > 12) | ((a <= 12) & (order == "mdy"))
    return (
        F.when(text.rlike(iso), _date(*(_int(part(iso, i)) for i in (1, 2, 3))))
        .when(text.rlike(named), _date(_int(part(named, 3)), month_number(part(named, 2)), _int(part(named, 1))))
        .when(text.rlike(american), _date(_int(part(american, 3)), month_number(part(american, 1)), _int(part(american, 2))))
        .when(text.rlike(numeric), F.when(month_first, _date(y, a, b)).otherwise(_date(y, b, a)))
        .when(text.rlike(compact), _date(*(_int(part(compact, i)) for i in (1, 2, 3))))
    )


def ambiguous_dates(samples: Column) -> Column:
    """Whether an array of samples has numeric dates and none with a part over 12."""
    numeric = r"^\s*(\d{1,2})[./\- ](\d{1,2})[./\- ]\d{2,4}"
    dates = F.filter(samples, lambda v: v.rlike(numeric))
    settled = F.exists(dates, lambda v: (F.regexp_extract(v, numeric, 1).cast("int") > 12) | (F.regexp_extract(v, numeric, 2).cast("int") > 12))
    return (F.size(dates) > 0) & ~settled


def days_left(end: Column, now: Column) -> Column:
    """Whole days until `end`, begun ones counted; null for no end."""
    return F.ceil((F.unix_timestamp(end) - F.unix_timestamp(now)) / 86400).cast("long")


def backoff_seconds(attempt: Column) -> Column:
    """10 seconds doubled with each attempt, 600 at most."""
    return F.least(F.lit(10.0) * F.pow(F.lit(2.0), attempt - 1), F.lit(600.0))


def backup_name(at: Column, prefix: str = "", suffix: str = ".rcbk") -> Column:
    """A snapshot's name, which sorts by time: backup-20240116T120000Z."""
    return F.concat(F.lit(prefix + "backup-"), F.date_format(at, "yyyyMMdd'T'HHmmss'Z'"), F.lit(suffix))


def backup_time(name: Column) -> Column:
    """When a snapshot was made, by its name; null for other names."""
    stamp = F.regexp_extract(name, r"backup-([0-9]{8}T[0-9]{6})Z", 1)
    return F.try_to_timestamp(stamp, F.lit("yyyyMMdd'T'HHmmss")).cast("timestamp_ntz")
