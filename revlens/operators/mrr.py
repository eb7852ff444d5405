"""Monthly recurring revenue: trend, growth, running totals, quarters, product mix, best/worst months.

MRR is the month's total sales (there is no recurring flag).  Every monthly
series is built from the customer-month grain (``customer_month``): the
shuffle after map-side aggregation carries at most one row per customer and
month per task, and COUNT(DISTINCT customer_id) per month becomes a plain
COUNT over that grain.  The month-ordered windows then run over one row per
month (a few hundred rows), so their single partition is bounded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revlens.functions.dates import PERIODS, month_label, period_start, quarter_label, quarter_start
from revlens.functions.numeric import exact_avg, money, pct, round_ratio
from revlens.operators import labels
from revlens.operators.breakdown import revenue_breakdown
from revlens.operators.ordering import pg_order


def _by_month(col: str = "month") -> Window:
    """Period order for the per-period series (one row per period: a bounded single partition).

    ASC NULLS LAST as in PostgreSQL; it also equals the final ORDER BY, so the
    window's sorted single partition already satisfies it (no extra exchange).
    """
    return Window.orderBy(F.col(col).asc_nulls_last())


def _period_col(C: DataFrame, period: str) -> DataFrame:
    """Add the period start as ``order_<period>`` (``order_month`` already exists)."""
    if period == "month":
        return C
    return C.withColumn(f"order_{period}", period_start("order_month", period))


def customer_month(C: DataFrame) -> DataFrame:
    """(customer_id, order_month) -> revenue (unrounded SUM(sales)): the shared churn/MRR grain."""
    return C.groupBy("customer_id", "order_month").agg(F.sum("sales").alias("revenue"))


def customer_period(C: DataFrame, period: str = "month", entity: str = "customer_id") -> DataFrame:
    """(customer_id, order_<period>) -> revenue: the customer-month grain for any period (or another ``entity``'s)."""
    col = f"order_{period}"
    return _period_col(C, period).groupBy(entity, col).agg(F.sum("sales").alias("revenue"))


def monthly_totals(C: DataFrame, period: str = "month") -> DataFrame:
    """<period> -> active_customers, _rev (unrounded) from the customer-period grain."""
    col = f"order_{period}"
    return (
        customer_period(C, period)
        .groupBy(col)
        .agg(F.count(F.lit(1)).alias("active_customers"), F.sum("revenue").alias("_rev"))
        .withColumnRenamed(col, period)
    )


def mrr_monthly(C: DataFrame) -> DataFrame:
    """month, active_customers, total_orders (distinct), mrr, avg_deal_size."""
    out = revenue_breakdown(
        C.withColumnRenamed("order_month", "month"),
        ["month"],
        [
            ("active_customers", "customers"),
            ("total_orders", "distinct_orders"),
            ("mrr", "revenue"),
            ("avg_deal_size", "avg_sale"),
        ],
    )
    return pg_order(out, "month")


_GROWTH = {"month": "mom", "quarter": "qoq", "year": "yoy"}


def mrr_growth(C: DataFrame, period: str = "month") -> DataFrame:
    """Revenue per period with the previous period (LAG), absolute change and growth %.

    ``period`` is month (the reference), quarter or year; columns are named
    after it (``prev_month_mrr`` / ``mom_growth_rate_pct`` for months,
    ``prev_quarter_mrr`` / ``qoq_growth_rate_pct`` for quarters, ...).
    """
    prev_col, growth_col = f"prev_{period}_mrr", f"{_GROWTH[period]}_growth_rate_pct"
    m = monthly_totals(C, period).select(period, "active_customers", money("_rev").alias("mrr"))
    m = m.withColumn(prev_col, F.lag("mrr", 1).over(_by_month(period)))
    out = m.select(
        period,
        "active_customers",
        "mrr",
        prev_col,
        (F.col("mrr") - F.coalesce(prev_col, F.lit(0))).alias("mrr_change"),
        F.when(F.col(prev_col).isNull(), F.lit(None))
        .otherwise(pct(F.col("mrr") - F.col(prev_col), prev_col))
        .alias(growth_col),
    )
    return pg_order(out, period)


def mrr_growth_brief(C: DataFrame) -> DataFrame:
    """README variant: month, mrr, prev_month_mrr, mom_growth_pct."""
    g = mrr_growth(C)
    return g.select("month", "mrr", "prev_month_mrr", F.col("mom_growth_rate_pct").alias("mom_growth_pct"))


def mrr_running(C: DataFrame, window: int = 3, period: str = "month") -> DataFrame:
    """Cumulative revenue (default RANGE frame) and a rolling average over the last ``window`` periods (rows)."""
    m = monthly_totals(C, period).select(period, money("_rev").alias("mrr"))
    run = _by_month(period)  # RANGE UNBOUNDED PRECEDING .. CURRENT ROW
    roll = _by_month(period).rowsBetween(-(window - 1), Window.currentRow)
    tag = PERIODS[period][2]
    out = m.select(
        period,
        "mrr",
        money(F.sum("mrr").over(run)).alias("cumulative_revenue"),
        exact_avg(F.sum("mrr").over(roll), F.count("mrr").over(roll)).alias(f"rolling_{window}{tag}_avg_mrr"),
    )
    return pg_order(out, period)


def quarterly_summary(C: DataFrame) -> DataFrame:
    q = C.withColumn("quarter_start", quarter_start("order_month")).withColumn(
        "quarter_label", quarter_label("quarter_start")
    )
    out = revenue_breakdown(
        q,
        ["quarter_start", "quarter_label"],
        [
            ("active_customers", "customers"),
            ("quarterly_revenue", "revenue"),
            ("quarterly_profit", "profit"),
            ("profit_margin_pct", "margin_pct"),
        ],
    )
    return pg_order(out, "quarter_start")


def mrr_by_product(C: DataFrame) -> DataFrame:
    """(month, product): customers, product_mrr and its % of the month's revenue."""
    out = revenue_breakdown(
        C.withColumnRenamed("order_month", "month"),
        ["month", "product"],
        [("customers", "customers"), ("product_mrr", "revenue"), ("pct_of_monthly_revenue", "share_pct")],
        share_within=["month"],
    )
    return pg_order(out, "month", "-product_mrr")


def best_worst_months(C: DataFrame, n: int = 3, pad_label: bool = True) -> DataFrame:
    """Rank months by MRR; flag the top n, then the bottom n (top wins when they overlap)."""
    m = monthly_totals(C).select("month", month_label("month", pad_label).alias("month_label"), money("_rev").alias("mrr"))
    down = F.rank().over(Window.orderBy(F.col("mrr").desc_nulls_first()))
    up = F.rank().over(Window.orderBy(F.col("mrr").asc_nulls_last()))
    m = m.withColumn("revenue_rank", down).withColumn("_up", up)
    flag = (
        F.when(F.col("revenue_rank") <= n, labels.TOP_MONTH.format(n=n))
        .when(F.col("_up") <= n, labels.BOTTOM_MONTH.format(n=n))
        .otherwise(labels.AVERAGE_MONTH)
    )
    out = m.select("month", "month_label", "mrr", F.col("revenue_rank").cast("long").alias("revenue_rank"), flag.alias("performance_flag"))
    return pg_order(out, "-mrr")


_ADJ = {"month": "monthly", "quarter": "quarterly", "year": "yearly"}


def arpu_monthly(C: DataFrame, period: str = "month") -> DataFrame:
    """<period>, active_customers, mrr, <periodic>_arpu and its change vs the previous period.

    The change is LAG over the *unrounded* ARPU, computed exactly as
    (rev1*n0 - rev0*n1) / (n1*n0) and rounded once.
    """
    m = monthly_totals(C, period)
    w = _by_month(period)
    m = m.withColumn("_prev_rev", F.lag("_rev", 1).over(w)).withColumn("_prev_n", F.lag("active_customers", 1).over(w))
    change = round_ratio(
        F.col("_rev") * F.col("_prev_n") - F.col("_prev_rev") * F.col("active_customers"),
        F.col("active_customers") * F.col("_prev_n"),
    )
    out = m.select(
        period,
        "active_customers",
        money("_rev").alias("mrr"),
        round_ratio("_rev", "active_customers").alias(f"{_ADJ[period]}_arpu"),
        change.alias(f"arpu_change_vs_prev_{period}"),
    )
    return pg_order(out, period)


def executive_summary(C: DataFrame) -> DataFrame:
    """One row: period, total / average / peak / lowest MRR, average monthly customers, ARPU on them."""
    m = monthly_totals(C)
    s = m.agg(
        F.min("month").alias("data_from"),
        F.max("month").alias("data_to"),
        F.sum("_rev").alias("_total"),
        F.count(F.lit(1)).alias("_months"),
        F.max("_rev").alias("_peak"),
        F.min("_rev").alias("_low"),
        F.sum("active_customers").alias("_cust_months"),
    )
    return s.select(
        "data_from",
        "data_to",
        money("_total").alias("total_revenue_usd"),
        round_ratio("_total", "_months").alias("avg_mrr_usd"),
        money("_peak").alias("peak_mrr_usd"),
        money("_low").alias("lowest_mrr_usd"),
        round_ratio("_cust_months", "_months", digits=0).alias("avg_monthly_active_customers"),
        # revenue / (customer-months / months) = revenue * months / customer-months
        round_ratio(F.col("_total") * F.col("_months"), "_cust_months").alias("overall_arpu_usd"),
    )
