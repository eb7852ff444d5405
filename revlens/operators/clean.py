"""The cleaned view (``saas_clean``) and its checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.functions.dates import month_start
from revlens.functions.text import standardize
from revlens.operators.ordering import pg_order
from revlens.schema import CLEAN_COLUMNS


def clean(raw: DataFrame) -> DataFrame:
    """18-column standardised projection of the raw fact.

    Keeps rows with sales > 0, a date and a customer id.  Text columns are
    INITCAP(TRIM(x)) with PostgreSQL word rules (so 'SMB' becomes 'Smb'),
    customer_id is UPPER(TRIM(x)).  COALESCE(sales, 0) is dropped: after
    ``sales > 0`` it can never fire.  The three filters reach the Parquet scan.
    Duplicated order ids are not removed (the reference only reports them).
    """
    kept = raw.where((F.col("sales") > 0) & F.col("order_date").isNotNull() & F.col("customer_id").isNotNull())
    return kept.select(
        "order_id",
        "order_date",
        month_start("order_date").alias("order_month"),
        F.year("order_date").alias("order_year"),
        F.month("order_date").alias("order_month_num"),
        standardize("customer").alias("customer"),
        F.upper(F.trim("customer_id")).alias("customer_id"),
        standardize("country").alias("country"),
        standardize("region").alias("region"),
        standardize("subregion").alias("subregion"),
        standardize("industry").alias("industry"),
        standardize("segment").alias("segment"),
        standardize("product").alias("product"),
        "license",
        "sales",
        F.coalesce("quantity", F.lit(1)).cast("int").alias("quantity"),
        F.coalesce("discount", F.lit(0)).cast("decimal(5,4)").alias("discount"),
        F.coalesce("profit", F.lit(0)).cast("decimal(12,2)").alias("profit"),
    )


def register_clean_view(raw: DataFrame, name: str = "saas_clean") -> DataFrame:
    """CREATE OR REPLACE VIEW saas_clean: a temp view re-evaluated on every read."""
    c = clean(raw)
    c.createOrReplaceTempView(name)
    return c


def clean_row_count(C: DataFrame) -> DataFrame:
    return C.agg(F.count(F.lit(1)).alias("clean_row_count"))


def clean_preview(C: DataFrame, n: int = 5) -> DataFrame:
    """First n rows of the view, in a fixed order (all columns) so it is repeatable."""
    return pg_order(C, *CLEAN_COLUMNS).limit(n)
