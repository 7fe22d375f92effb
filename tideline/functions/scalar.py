"""Column helpers. All of them stay JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rnd(x: Column, digits: int = 4) -> Column:
    """Rounded double without a negative zero."""
    return F.round(x.cast("double"), digits) + F.lit(0.0)


def finite(x: Column) -> Column:
    """NaN and infinities become null before JSON output."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)
