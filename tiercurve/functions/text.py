"""Label texts. Rounding is half-even, as in R; NULL stays NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def percent_text(share: Column) -> Column:
    """0.1234 -> ``12.3%``. Rounded before formatting, because ``%.1f`` rounds half up."""
    tenths = F.bround(share * 1000, 0) / 10
    return F.when(share.isNotNull(), F.format_string("%.1f%%", tenths))


def thousands_text(amount: Column, unit: str = "천원") -> Column:
    """1234500 -> ``1,234천원``."""
    return F.concat(F.format_number(F.bround(amount / 1000, 0), 0), F.lit(unit))
