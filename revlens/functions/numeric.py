"""Exact money arithmetic.

All money stays DECIMAL; nothing goes through DOUBLE.  Spark's decimal
division keeps only a bounded scale (6..18 digits), and AVG(decimal) rounds
to 6 digits before the caller rounds again, so ``round_ratio`` computes
ROUND(mult * num / den, digits) with half-away-from-zero rounding of the true
rational value, using integer arithmetic on DECIMAL(38, *).
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def money(x: Column | str) -> Column:
    """ROUND(x, 2) on an exact decimal (a no-op scale-wise for sums of 2-dp money)."""
    return F.round(_c(x), 2)


def round_ratio(num: Column | str, den: Column | str, digits: int = 2, mult: int = 1) -> Column:
    """ROUND(mult * num / den, digits), half away from zero, exact; NULL when den is 0 or NULL.

    ``num`` and ``den`` must be exact (integral or decimal) columns.
    """
    n = _c(num) * F.lit(Decimal(mult * 10**digits))
    d = F.nullif(_c(den), F.lit(0))
    two = F.lit(Decimal(2))
    a = F.abs(n) * two + F.abs(d)
    b = F.abs(d) * two
    q = ((a - a % b) / b).cast("decimal(38,0)")  # a - a % b is a multiple of b: exact
    signed = F.when((n < 0) != (d < 0), -q).otherwise(q)
    return (signed * F.lit(Decimal(1).scaleb(-digits))).cast(f"decimal(38,{digits})")


def pct(num: Column | str, den: Column | str, digits: int = 2) -> Column:
    """ROUND(num / den * 100, digits)."""
    return round_ratio(num, den, digits, mult=100)


def exact_avg(sum_col: Column | str, count_col: Column | str, digits: int = 2) -> Column:
    """ROUND(AVG(x), digits) from SUM(x) and COUNT(x), without AVG's intermediate rounding."""
    return round_ratio(sum_col, count_col, digits)


def int_div(a: Column, b: Column) -> Column:
    """Integer division of non-negative integral columns, exact at any size."""
    return ((a - a % b) / b).cast("long")
