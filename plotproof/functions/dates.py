"""Lenient date parsing and date formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lenient_date(c: Column) -> Column:
    """ISO date or datetime, day-first with slash or dash, year-first with slash, or compact."""
    text = F.trim(c.cast("string"))
    head = F.substring(text, 1, 10)
    iso_time = F.regexp_extract(text, r"^(\d{4}-\d{1,2}-\d{1,2})T\d{1,2}:\d{1,2}:\d{1,2}", 1)
    return F.coalesce(
        F.try_to_date(head, "yyyy-M-d"),
        F.try_to_date(head, "d/M/yyyy"),
        F.try_to_date(F.nullif(iso_time, F.lit("")), "yyyy-M-d"),
        F.try_to_date(head, "yyyy/M/d"),
        F.try_to_date(head, "d-M-yyyy"),
        F.try_to_date(F.when(text.rlike(r"^\d{8}$"), text), "yyyyMMdd"),
    )


def year_first(c: Column) -> Column:
    """Date of a text ``yyyy-MM-dd``; null when the calendar has no such day. Cast, as a failed parse by a pattern throws and catches an exception."""
    return F.when(~c.startswith("0000"), c.try_cast("date"))


def day_first(c: Column) -> Column:
    """Date of a text ``dd/MM/yyyy``; null when the calendar has no such day."""
    return year_first(F.concat(F.substring(c, 7, 4), F.lit("-"), F.substring(c, 4, 2), F.lit("-"), F.substring(c, 1, 2)))


def format_date_br(c: Column) -> Column:
    return F.coalesce(F.date_format(c, "dd/MM/yyyy"), F.lit("—"))


def format_datetime_br(c: Column) -> Column:
    return F.coalesce(F.date_format(c, "dd/MM/yyyy HH:mm"), F.lit("—"))
