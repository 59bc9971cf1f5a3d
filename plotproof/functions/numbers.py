"""Lenient number parsing and number formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lenient_number(c: Column) -> Column:
    """Number from free text: ``1.234,56``, ``12,5`` and ``12.5`` all parse, junk is null."""
    kept = F.regexp_replace(c.cast("string"), r"[^\d,.\-]", "")
    both = kept.contains(",") & kept.contains(".")
    plain = F.when(both, F.translate(kept, ",.", ".")).otherwise(F.translate(kept, ",", "."))
    value = plain.try_cast("double")
    return F.when(~F.isnan(value), value)


def comma_decimal(c: Column) -> Column:
    return F.translate(F.trim(c), ",", ".").try_cast("double")


def round_half_up(c: Column, places: int) -> Column:
    """Rounding as plain double arithmetic, the same in every engine."""
    scale = float(10**places)
    return F.floor(c * scale + 0.5) / scale


def ratio(a: Column, b: Column) -> Column:
    """Division that yields null on a zero or null denominator."""
    return F.try_divide(a, F.when(b != 0, b))


def format_br(c: Column, places: int = 2) -> Column:
    """``1234.5`` -> ``1.234,50``; null -> dash."""
    return F.coalesce(F.translate(F.format_number(c, places), ",.", ".,"), F.lit("—"))
