"""Calendar helpers (all return DATE or INT, never TIMESTAMP)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def month_start(d: Column | str) -> Column:
    """DATE_TRUNC('month', d)::DATE."""
    return F.trunc(_c(d), "MM")


def quarter_start(d: Column | str) -> Column:
    """DATE_TRUNC('quarter', d)::DATE."""
    return F.trunc(_c(d), "quarter")


def year_start(d: Column | str) -> Column:
    return F.trunc(_c(d), "year")


def quarter_label(q: Column | str) -> Column:
    """TO_CHAR(q, 'YYYY "Q"Q') -> '2023 Q2'."""
    return F.date_format(_c(q), "yyyy 'Q'q")


def month_label(m: Column | str, pad: bool = True) -> Column:
    """TO_CHAR(m, 'Month YYYY'): the month name is blank-padded to 9 characters."""
    name = F.date_format(_c(m), "MMMM")
    if pad:
        name = F.rpad(name, 9, " ")
    return F.concat(name, F.lit(" "), F.date_format(_c(m), "yyyy"))


def month_index(m: Column | str) -> Column:
    """Months since year 0: consecutive calendar months differ by exactly 1."""
    m = _c(m)
    return F.year(m) * 12 + F.month(m)


def months_apart(later: Column | str, earlier: Column | str) -> Column:
    """Whole months between two month-start dates (EXTRACT YEAR*12 + MONTH of AGE)."""
    return month_index(later) - month_index(earlier)


def next_month(m: Column | str) -> Column:
    """m + INTERVAL '1 month' (as DATE)."""
    return F.add_months(_c(m), 1)


# Calendar periods: name -> (trunc unit, months per period, one-letter tag).
PERIODS = {"month": ("MM", 1, "m"), "quarter": ("quarter", 3, "q"), "year": ("year", 12, "y")}


def period_start(d: Column | str, period: str = "month") -> Column:
    """First day of the month / quarter / year containing ``d``."""
    return F.trunc(_c(d), PERIODS[period][0])


def next_period(p: Column | str, period: str = "month") -> Column:
    """p + one period (as DATE)."""
    return F.add_months(_c(p), PERIODS[period][1])
