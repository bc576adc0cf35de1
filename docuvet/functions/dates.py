"""Printed and machine-readable dates."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .fixed import CENTURY_PIVOT


def yymmdd(text: Column) -> Column:
    """Six digits to a date; impossible calendar dates become NULL."""
    century = F.when(F.substring(text, 1, 2) <= str(CENTURY_PIVOT), "20").otherwise("19")
    return F.when(
        text.rlike(r"^[0-9]{6}$"), F.try_to_date(F.concat(century, text), "yyyyMMdd")
    )


def ddmmyyyy(text: Column) -> Column:
    """Strict ``DD/MM/YYYY``; anything else becomes NULL."""
    return F.when(text.rlike(r"^[0-9]{2}/[0-9]{2}/[0-9]{4}$"), F.try_to_date(text, "dd/MM/yyyy"))


def iso_day(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM-dd")


def years_between(earlier: Column, later: Column) -> Column:
    return F.datediff(later, earlier) / F.lit(365.25)
