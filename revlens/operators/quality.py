"""Load verification and data-quality checks on the raw fact (before cleaning).

The single-row checks can share one scan: ``quality_report`` computes A5, A6,
A9 and A11 in one aggregate.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.functions.dates import month_start, year_start
from revlens.functions.numeric import exact_avg, money
from revlens.operators.ordering import pg_order
from revlens.operators.rank import percentiles_cont
from revlens.schema import RAW_COLUMNS

CRITICAL_COLUMNS = ("order_id", "order_date", "customer_id", "customer", "sales", "product", "region")


def raw_row_count(raw: DataFrame) -> DataFrame:
    """SELECT COUNT(*) AS total_rows."""
    return raw.agg(F.count(F.lit(1)).alias("total_rows"))


def raw_preview(raw: DataFrame, n: int = 10) -> DataFrame:
    """First n rows; ordered on every column so the sample is repeatable (a top-k, not a full sort)."""
    return pg_order(raw, *RAW_COLUMNS).limit(n)


def _load_profile_cols() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("total_rows"),
        F.count("order_id").alias("non_null_order_id"),
        F.count("customer_id").alias("non_null_customer_id"),
        F.count("order_date").alias("non_null_order_date"),
        F.count("sales").alias("non_null_sales"),
        F.min("order_date").alias("earliest_order"),
        F.max("order_date").alias("latest_order"),
        money(F.sum("sales")).alias("total_revenue_usd"),
    ]


def load_profile(raw: DataFrame) -> DataFrame:
    """One-row load check: row count, non-NULL counts, date range, total revenue."""
    return raw.agg(*_load_profile_cols())


def _null_profile_cols(cols) -> list[Column]:
    # SUM (not COUNT_IF) so an empty table gives NULL, as in the reference.
    return [F.sum(F.when(F.col(c).isNull(), 1).otherwise(0)).alias(f"null_{c}") for c in cols]


def null_profile(raw: DataFrame, cols=CRITICAL_COLUMNS) -> DataFrame:
    """NULL count per critical column."""
    return raw.agg(*_null_profile_cols(cols))


def duplicate_orders(raw: DataFrame) -> DataFrame:
    """order_id values that occur more than once, most frequent first."""
    dup = raw.groupBy("order_id").agg(F.count(F.lit(1)).alias("occurrences")).where(F.col("occurrences") > 1)
    return pg_order(dup, "-occurrences")


def duplicate_order_count(raw: DataFrame) -> DataFrame:
    """Number of distinct order ids that repeat (reported as total_duplicate_rows)."""
    dup = raw.groupBy("order_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    return dup.agg(F.count(F.lit(1)).alias("total_duplicate_rows"))


def _date_coverage_cols() -> list[Column]:
    return [
        F.min("order_date").alias("earliest_date"),
        F.max("order_date").alias("latest_date"),
        F.countDistinct(month_start("order_date")).alias("months_covered"),
        F.countDistinct(year_start("order_date")).alias("years_covered"),
    ]


def date_coverage(raw: DataFrame) -> DataFrame:
    """Date range plus number of distinct calendar months and years.

    Rows are first reduced to one per month (map-side), then months and years are counted.
    """
    month = month_start("order_date").alias("_month")
    per = raw.groupBy(month).agg(F.min("order_date").alias("_lo"), F.max("order_date").alias("_hi"))
    return per.agg(
        F.min("_lo").alias("earliest_date"),
        F.max("_hi").alias("latest_date"),
        F.count("_month").alias("months_covered"),
        F.countDistinct(year_start("_month")).alias("years_covered"),
    )


def suspicious_dates(raw: DataFrame, lo: str | _dt.date = "2000-01-01", as_of: str | _dt.date | None = None) -> DataFrame:
    """Orders dated before ``lo`` or after ``as_of`` (default CURRENT_DATE)."""
    d = F.col("order_date")
    upper = F.current_date() if as_of is None else F.lit(str(as_of)).cast("date")
    return raw.where((d < F.lit(str(lo)).cast("date")) | (d > upper)).select("order_id", "order_date")


def nonpositive_sales(raw: DataFrame) -> DataFrame:
    """Rows with sales <= 0 (NULL sales are not counted)."""
    return raw.where(F.col("sales") <= 0).agg(F.count(F.lit(1)).alias("suspicious_revenue_rows"))


def sales_distribution(raw: DataFrame, median: float = 0.5, high: float = 0.95) -> DataFrame:
    """min, max, avg (2 dp), exact median and 95th percentile (PERCENTILE_CONT, DOUBLE) of sales."""
    p = percentiles_cont(raw, "sales", {"median_sales": median, "p95_sales": high})
    return p.select(
        F.col("_min").alias("min_sales"),
        F.col("_max").alias("max_sales"),
        exact_avg(F.col("_sum"), F.col("_n")).alias("avg_sales"),
        "median_sales",
        "p95_sales",
    )


def sales_distribution_approx(raw: DataFrame, median: float = 0.5, high: float = 0.95, accuracy: int = 10000) -> DataFrame:
    """Same as ``sales_distribution`` with bounded-memory approximate percentiles."""
    return raw.agg(
        F.min("sales").alias("min_sales"),
        F.max("sales").alias("max_sales"),
        exact_avg(F.sum("sales"), F.count("sales")).alias("avg_sales"),
        F.percentile_approx(F.col("sales").cast("double"), median, accuracy).alias("median_sales"),
        F.percentile_approx(F.col("sales").cast("double"), high, accuracy).alias("p95_sales"),
    )


def distinct_values(raw: DataFrame, col: str) -> DataFrame:
    """SELECT DISTINCT col ORDER BY col (spots casing/spacing variants before cleaning)."""
    return pg_order(raw.select(col).distinct(), col)


def distinct_regions(raw: DataFrame) -> DataFrame:
    return distinct_values(raw, "region")


def distinct_segments(raw: DataFrame) -> DataFrame:
    return distinct_values(raw, "segment")


def distinct_products(raw: DataFrame) -> DataFrame:
    return distinct_values(raw, "product")


def load_metrics() -> list[Column]:
    """A3, A5, A6 and A11 as aggregates without DISTINCT, so that a load can observe them as it writes."""
    suspicious = F.count(F.when(F.col("sales") <= 0, 1)).alias("suspicious_revenue_rows")
    return [*_load_profile_cols(), *_null_profile_cols(CRITICAL_COLUMNS), suspicious]


def quality_report(raw: DataFrame) -> DataFrame:
    """A5 + A6 + A9 + A11 in one pass over the raw table (one row)."""
    return raw.agg(*load_metrics(), *_date_coverage_cols())
