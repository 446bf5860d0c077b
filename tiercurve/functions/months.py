"""Months as whole numbers, so that a trailing window is plain integer arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_number(day: Column) -> Column:
    """Months since year 0: 1996-01 is 1996 * 12."""
    return F.year(day) * 12 + F.month(day) - 1


def month_number_of(ym: str) -> int:
    year, month = ym.split("-")
    return int(year) * 12 + int(month) - 1


def month_text(number: Column) -> Column:
    """``yyyy-MM`` of a month number that is never NULL.

    Non-null in the plan as well, so that a later join on the month adds no null check: that
    would be computed before the rows are summed up. Cheaper than formatting a date.
    """
    year = F.lpad(F.floor(number / 12).cast("string"), 4, "0")
    month = F.lpad((F.pmod(number, F.lit(12)) + 1).cast("string"), 2, "0")
    return F.coalesce(F.concat(year, F.lit("-"), month), F.lit(""))
