"""Numbers that must agree with the figures users already have.

Spark's own rounding and casting differ in two places. ``round(x, n)`` rounds
the decimal text of a double (1.005 -> 1.01), where the expected figure scales
first (1.005 * 100 = 100.499... -> 1.0). A cast to bigint truncates, where the
expected figure is the nearest integer, halves to even.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_scaled(value: Column, digits: int) -> Column:
    scale = F.lit(float(10**digits))
    return F.round(value * scale, 0) / scale


def to_bigint(value: Column) -> Column:
    return F.rint(value).cast("bigint")


def ratio(part: Column, whole: Column) -> Column:
    """Division that gives NULL, not an error, on zero: filters that rule a
    zero out may be evaluated after the projection."""
    return F.try_divide(part, whole)
