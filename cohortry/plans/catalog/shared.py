"""Small helpers shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rnd(value: Column | str, digits: int = 6) -> Column:
    """Round for comparison; the nudge keeps exact ties on one side in every engine."""
    value = F.col(value) if isinstance(value, str) else value
    return F.round(value.cast("double") + F.lit(10.0 ** -(digits + 2)), digits)


def day(value: Column | str) -> Column:
    """A date or timestamp as YYYY-MM-DD text."""
    return F.date_format(value, "yyyy-MM-dd")
