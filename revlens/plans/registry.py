"""Query registry: key -> (operator, input) plus the report projection used by the driver.

Library operators return exact DECIMAL money; the registered queries cast
DECIMAL to DOUBLE and small integers to BIGINT at the very end so results
compare 1:1 with the DuckDB oracle (whose decimals also leave as DOUBLE).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, DecimalType, IntegerType, ShortType

from revlens import operators as ops
from revlens.sources.store import clean_table, csv_table, grain_table, sales_table

# GRAIN: the customer-month grain; these operators sum sales by its columns, so they take the cleaned sales as well
RAW, CLEAN, CSV, GRAIN = "raw", "clean", "csv", "grain"

# key -> (input kind, operator).  Order follows the reference scripts.
CATALOG: dict[str, tuple[str, Callable[[DataFrame], DataFrame]]] = {
    # 2.1 load, schema and data quality
    "csv_load_profile": (CSV, ops.load_profile),  # CSV export of the fact -> load_table -> load check
    "raw_table": (CSV, lambda raw: raw),  # the same table, all rows and columns
    "raw_row_count": (RAW, ops.raw_row_count),
    "raw_preview": (RAW, ops.raw_preview),
    "load_profile": (RAW, ops.load_profile),
    "null_profile": (RAW, ops.null_profile),
    "duplicate_orders": (RAW, ops.duplicate_orders),
    "duplicate_order_count": (RAW, ops.duplicate_order_count),
    "date_coverage": (RAW, ops.date_coverage),
    "suspicious_dates": (RAW, ops.suspicious_dates),
    "nonpositive_sales": (RAW, ops.nonpositive_sales),
    "sales_distribution": (RAW, ops.sales_distribution),
    "distinct_regions": (RAW, ops.distinct_regions),
    "distinct_segments": (RAW, ops.distinct_segments),
    "distinct_products": (RAW, ops.distinct_products),
    "clean_view": (CLEAN, lambda C: C),
    "clean_row_count": (CLEAN, ops.clean_row_count),
    "clean_preview": (CLEAN, ops.clean_preview),
    # 2.2 exploratory
    "business_overview": (CLEAN, ops.business_overview),
    "revenue_by_region": (CLEAN, ops.revenue_by_region),
    "revenue_by_product": (CLEAN, ops.revenue_by_product),
    "revenue_by_segment": (CLEAN, ops.revenue_by_segment),
    "revenue_by_industry": (CLEAN, ops.revenue_by_industry),
    "top_customers": (CLEAN, ops.top_customers),
    "annual_summary": (CLEAN, ops.annual_summary),
    "discount_impact": (CLEAN, ops.discount_impact),
    # 2.3 MRR
    "mrr_monthly": (CLEAN, ops.mrr_monthly),
    "mrr_growth": (GRAIN, ops.mrr_growth),
    "mrr_running": (GRAIN, ops.mrr_running),
    "quarterly_summary": (CLEAN, ops.quarterly_summary),
    "mrr_by_product": (CLEAN, ops.mrr_by_product),
    "best_worst_months": (GRAIN, ops.best_worst_months),
    # 2.4 churn and cohorts
    "churn_status": (GRAIN, ops.churn_status),
    "monthly_churn": (GRAIN, ops.monthly_churn),
    "churned_revenue_list": (GRAIN, ops.churned_revenue_list),
    "cohort_retention": (GRAIN, ops.cohort_retention),
    "revenue_churn": (GRAIN, ops.revenue_churn),
    # 2.5 ARPU and customer value
    "arpu_overall": (GRAIN, ops.arpu_overall),
    "arpu_monthly": (GRAIN, ops.arpu_monthly),
    "arpu_by_segment": (GRAIN, ops.arpu_by_segment),
    "arpu_by_region": (GRAIN, ops.arpu_by_region),
    "arpu_by_product": (CLEAN, ops.arpu_by_product),
    "customer_tiers": (CLEAN, ops.customer_tiers),
    "customer_running_revenue": (GRAIN, ops.customer_running_revenue),
    "revenue_movement": (GRAIN, ops.revenue_movement),
    "cross_sell": (CLEAN, ops.cross_sell),
    "executive_summary": (GRAIN, ops.executive_summary),
    # 2.6 README variants
    "mrr_growth_brief": (GRAIN, ops.mrr_growth_brief),
    "monthly_churn_brief": (GRAIN, ops.monthly_churn_brief),
    "customer_tiers_brief": (GRAIN, ops.customer_tiers_brief),
}


def report(df: DataFrame) -> DataFrame:
    """Cast DECIMAL -> DOUBLE and INT/SHORT/BYTE -> BIGINT, keep everything else."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, (IntegerType, ShortType, ByteType)):
            c = c.cast("long")
        cols.append(c.alias(f.name))
    return df.select(*cols)


# Session setting: "false" keeps the cleaned relation a view over the fact (half the
# storage; INITCAP is then evaluated by every query that reads a text column).
MATERIALIZE_CLEAN = "spark.revlens.materializeClean"


def source(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    if kind == CSV:
        return csv_table(spark, sf_dir)
    raw = sales_table(spark, sf_dir)
    if kind == RAW:
        return raw
    if spark.conf.get(MATERIALIZE_CLEAN, "true").lower() == "false":
        return ops.clean(raw)
    return grain_table(spark, sf_dir) if kind == GRAIN else clean_table(spark, sf_dir)


def run(spark: SparkSession, sf_dir: str, key: str) -> DataFrame:
    kind, op = CATALOG[key]
    return report(op(source(spark, sf_dir, kind)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {key: (lambda spark, sf_dir, _k=key: run(spark, sf_dir, _k)) for key in CATALOG}


def oracle_sql() -> dict[str, str]:
    from revlens.plans.oracle import build

    sql = build()
    return {k: sql[k] for k in CATALOG if k in sql}
