"""Scalar building blocks: PostgreSQL-compatible text, exact money, calendar."""

from revlens.functions.dates import (  # noqa: F401
    PERIODS,
    month_index,
    month_label,
    month_start,
    months_apart,
    next_month,
    next_period,
    period_start,
    quarter_label,
    quarter_start,
    year_start,
)
from revlens.functions.numeric import exact_avg, int_div, money, pct, round_ratio  # noqa: F401
from revlens.functions.text import pg_initcap, standardize  # noqa: F401
