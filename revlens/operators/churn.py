"""Inferred churn, retention and cohorts.

A customer-month is *churned* when the customer's next active month is
missing or later than the following calendar month; a returning customer is
counted as churned at each gap.  ``period`` (month/quarter/year) and ``gap``
(how many periods may pass before it counts) generalise the rule; the
rates and cohorts also take an ``entity`` column other than the customer
(rows where it is NULL count as one entity). The defaults are the reference's.  The last month of the data is therefore
always 100 % churned (right-censored); pass ``exclude_last=True`` to drop it.

Per-customer work runs either on a customer's sorted set of active months
(one shuffle by customer, sets merged map-side) or in windows partitioned by
customer over the customer-month grain; either way a customer holds at most
one entry per month (or per name and month), however many transactions a hot
customer has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revlens.functions.dates import PERIODS, month_index, months_apart, next_period
from revlens.functions.numeric import money, pct, round_ratio
from revlens.operators import labels
from revlens.operators.mrr import _period_col, customer_period
from revlens.operators.ordering import pg_order


def _gap_after(current: Column, nxt: Column, period: str = "month", gap: int = 1) -> Column:
    """True when there is no next active period or it is more than ``gap`` periods later."""
    limit = F.add_months(current, PERIODS[period][1] * gap) if gap != 1 else next_period(current, period)
    return nxt.isNull() | (nxt > limit)


def _drop_last(df: DataFrame, C: DataFrame, period: str, col: str, exclude_last: bool) -> DataFrame:
    """Without the last period of ``C``, whose customers all look churned; read from one column of ``C``."""
    if not exclude_last:
        return df
    last = _period_col(C, period).select(F.max(f"order_{period}")).scalar()
    return df.where(F.col(col) < last)


def churn_status(C: DataFrame, exclude_last: bool = False, period: str = "month", gap: int = 1) -> DataFrame:
    """Per distinct (customer_id, customer, month): next active month and Churned/Retained.

    As in the reference, ``customer`` is part of the DISTINCT but not of the
    window partition: an id with two names in one month sees its own month as
    "next" for the first name (ordered by name) and is Retained there.
    """
    col, cur, nxt = f"order_{period}", f"current_{period}", f"next_active_{period}"
    active = _period_col(C, period).select("customer_id", "customer", col).distinct()
    w = Window.partitionBy("customer_id").orderBy(F.col(col).asc_nulls_last(), F.col("customer").asc_nulls_last())
    flagged = active.select(
        "customer_id",
        "customer",
        F.col(col).alias(cur),
        F.lead(col, 1).over(w).alias(nxt),
    ).withColumn(
        "churn_status",
        F.when(_gap_after(F.col(cur), F.col(nxt), period, gap), labels.CHURNED).otherwise(labels.RETAINED),
    )
    flagged = _drop_last(flagged, C, period, cur, exclude_last)
    return pg_order(flagged, "customer_id", cur)


def _active_months(C: DataFrame, period: str = "month", entity: str = "customer_id") -> DataFrame:
    """entity -> ascending array of its distinct active periods (months by default).

    One shuffle by customer; sets are merged map-side and bounded by the
    calendar (one entry per period), however many sales a customer has.
    """
    col = f"order_{period}"
    return _period_col(C, period).groupBy(entity).agg(F.array_sort(F.collect_set(col)).alias("_months"))


def _months_with_next(C: DataFrame, period: str = "month", entity: str = "customer_id") -> DataFrame:
    """One row per (entity, period) with the entity's next active period (LEAD without a window)."""
    months = F.col("_months")
    pairs = F.transform(
        months, lambda m, i: F.struct(m.alias(period), F.try_element_at(months, i + 2).alias("next_active_month"))
    )
    return _active_months(C, period, entity).select(entity, F.inline(pairs))


def _grain_with_next(C: DataFrame, period: str = "month", gap: int = 1, entity: str = "customer_id") -> DataFrame:
    """customer-period grain + next active period + churned flag (0/1)."""
    col = f"order_{period}"
    g = customer_period(C, period, entity)
    w = Window.partitionBy(entity).orderBy(F.col(col).asc_nulls_last())
    g = g.withColumn("next_active_month", F.lead(col, 1).over(w))
    return g.withColumn(
        "churned", F.when(_gap_after(F.col(col), F.col("next_active_month"), period, gap), 1).otherwise(0)
    )


def monthly_churn(
    C: DataFrame, exclude_last: bool = False, period: str = "month", gap: int = 1, entity: str = "customer_id"
) -> DataFrame:
    """<period>, active, churned, retained customers and churn / retention rates (2 dp).

    The rate divides by customers active *in* the month (the reference's
    header says "at start of month"; its code does this).  ``period`` =
    quarter / year counts a customer as churned when the next active period
    is not the following one.
    """
    g = _months_with_next(C, period, entity)
    churned = F.when(_gap_after(F.col(period), F.col("next_active_month"), period, gap), 1).otherwise(0)
    m = g.groupBy(period).agg(
        F.count(F.lit(1)).alias("total_active_customers"), F.sum(churned).alias("churned_customers")
    )
    m = _drop_last(m, C, period, period, exclude_last)
    out = m.select(
        period,
        "total_active_customers",
        "churned_customers",
        (F.col("total_active_customers") - F.col("churned_customers")).alias("retained_customers"),
        pct("churned_customers", "total_active_customers").alias("churn_rate_pct"),
        pct(F.col("total_active_customers") - F.col("churned_customers"), "total_active_customers").alias(
            "retention_rate_pct"
        ),
    )
    return pg_order(out, period)


def monthly_churn_brief(C: DataFrame) -> DataFrame:
    """README variant: month, total_customers, churned_customers, churn_rate_pct."""
    m = monthly_churn(C)
    return m.select(
        "month",
        F.col("total_active_customers").alias("total_customers"),
        "churned_customers",
        "churn_rate_pct",
    )


def churned_revenue_list(
    C: DataFrame, exclude_last: bool = False, period: str = "month", gap: int = 1
) -> DataFrame:
    """Churned (customer, period) pairs with the revenue of that last period, per name/segment/region.

    Join-free: aggregate the 5-key grain once, then find each customer's next
    active month with a RANGE window over month numbers (min month strictly
    after the current one) — correct even when one id has several names,
    segments or regions in a month.  Same result as joining the churned pairs
    back to the sales rows, without re-shuffling the sales.
    """
    col, cur = f"order_{period}", f"churn_{period}"
    g = _period_col(C, period).groupBy("customer_id", col, "customer", "segment", "region").agg(F.sum("sales").alias("_rev"))
    g = g.withColumn("_m", month_index(col))
    after = Window.partitionBy("customer_id").orderBy("_m").rangeBetween(1, Window.unboundedFollowing)
    g = g.withColumn("_next", F.min(col).over(after))
    out = g.where(_gap_after(F.col(col), F.col("_next"), period, gap)).select(
        F.col(col).alias(cur),
        "customer_id",
        "customer",
        "segment",
        "region",
        money("_rev").alias(f"last_{period}_revenue"),
    )
    return pg_order(_drop_last(out, C, period, cur, exclude_last), cur, f"-last_{period}_revenue")


def cohort_retention(C: DataFrame, digits: int = 1, period: str = "month", entity: str = "customer_id") -> DataFrame:
    """cohort_month, original_cohort_size, months_since_join, active_customers, retention_pct.

    Cohort = first active month, read off each customer's sorted month set
    (one shuffle by customer, no window).  Each exploded customer-month is one
    row, so the distinct customer count per (cohort, age) is a COUNT; the cohort size is
    the age-0 count, taken with a window over the aggregated rows (at most
    one row per month per cohort) instead of a join.
    """
    cohort, age = f"cohort_{period}", f"{period}s_since_join"
    g = _active_months(C, period, entity).select(
        F.array_min("_months").alias(cohort), F.explode("_months").alias("_at")
    )
    g = g.withColumn(age, (months_apart("_at", cohort) / PERIODS[period][1]).cast("int"))
    a = g.groupBy(cohort, age).agg(F.count(F.lit(1)).alias("active_customers"))
    size = F.max(F.when(F.col(age) == 0, F.col("active_customers"))).over(Window.partitionBy(cohort))
    a = a.withColumn("original_cohort_size", size)
    out = a.select(
        cohort,
        "original_cohort_size",
        age,
        "active_customers",
        pct("active_customers", "original_cohort_size", digits).alias("retention_pct"),
    )
    return pg_order(out, cohort, age)


def revenue_churn(
    C: DataFrame, period: str = "month", gap: int = 1, exclude_last: bool = False, entity: str = "customer_id"
) -> DataFrame:
    """<period>, total_mrr, churned_mrr (NULL when nobody churned), revenue_churn_rate_pct."""
    g = _grain_with_next(C, period, gap, entity)
    m = g.groupBy(F.col(f"order_{period}").alias(period)).agg(
        F.sum(F.when(F.col("churned") == 1, F.col("revenue"))).alias("_churned"),
        F.sum("revenue").alias("_total"),
    )
    out = m.select(
        period,
        money("_total").alias("total_mrr"),
        money("_churned").alias("churned_mrr"),
        round_ratio("_churned", "_total", mult=100).alias("revenue_churn_rate_pct"),
    )
    return pg_order(_drop_last(out, C, period, period, exclude_last), period)
