"""Dates in mixed spellings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text
from .text import bound


def _full_year(c: Column) -> Column:
    """Years written by two digits, moved to within 50 years of today."""
    return F.when(F.year(c) >= F.year(F.current_date()) + 50, F.add_months(c, -1200)).otherwise(c)


def _numbers(numeric: Column, year: str, day_first: bool) -> Column:
    formats = [f"d/M/{year}", f"M/d/{year}"]
    return F.coalesce(*[F.try_to_date(numeric, f) for f in (formats if day_first else formats[::-1])])


def _numeric(numeric: Column, day_first: bool) -> Column:
    return (
        F.when(numeric.rlike(r"^\d{4}/\d{1,2}/\d{1,2}$"), F.coalesce(F.try_to_date(numeric, "yyyy/M/d"), F.try_to_date(numeric, "yyyy/d/M")))
        .when(numeric.rlike(r"^\d{8}$"), F.try_to_date(numeric, "yyyyMMdd"))
        .when(numeric.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), _numbers(numeric, "yyyy", day_first))
        .when(numeric.rlike(r"^\d{1,2}/\d{1,2}/\d{2}$"), bound(_numbers(numeric, "yy", day_first), _full_year))
    )


def _named(words: Column) -> Column:
    full = F.coalesce(*[F.try_to_date(words, f) for f in ("d MMM yyyy", "d MMMM yyyy", "MMM d yyyy", "MMMM d yyyy")])
    short = bound(F.coalesce(*[F.try_to_date(words, f) for f in ("d MMM yy", "d MMMM yy")]), _full_year)
    return F.when(words.rlike(r"\b\d{4}$"), full).otherwise(short)


def parse_date(c: Column, day_first: bool) -> Column:
    """A date from text: ISO, year first, or day and month in either order with / - . between, or with the month's name;
    a time behind it is left out. What doesn't fit the order asked for is read in the other one; what fits none is null.
    """

    def read(bare: Column) -> Column:
        spaced = F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, r"[.,/\-]", " "), r"(\d)([A-Za-z])", "$1 $2"), r"([A-Za-z])(\d)", "$1 $2")
        named = bound(F.trim(F.regexp_replace(spaced, r"\s+", " ")), _named)
        numeric = bound(F.regexp_replace(bare, r"[.\-]", "/"), lambda n: _numeric(n, day_first))
        return F.when(bare.rlike("[A-Za-z]"), named).otherwise(numeric)

    return bound(F.regexp_replace(text.strip(c), r"[T\s]\d{1,2}:\d{2}.*$", ""), read)
