"""Customer value: revenue tiers, running revenue, expansion/contraction, cross-sell."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revlens.functions.numeric import money
from revlens.operators import labels
from revlens.operators.ordering import pg_order
from revlens.operators.rank import rank_ntile

TIER_KEYS = ("customer_id", "customer", "segment", "region")


def customer_totals(C: DataFrame, keys: Sequence[str] = TIER_KEYS, revenue_only: bool = False) -> DataFrame:
    """Lifetime totals per (customer_id, customer, segment, region): a customer with two regions is two rows."""
    revenue = money(F.sum("sales")).alias("lifetime_revenue")
    if revenue_only:
        return C.groupBy(*keys).agg(revenue)
    return C.groupBy(*keys).agg(
        F.countDistinct("order_id").alias("total_orders"),
        revenue,
        F.min("order_date").alias("first_order"),
        F.max("order_date").alias("last_order"),
    )


def _tier_label(bucket, tier_labels: Sequence[str]):
    expr = None
    for i, name in enumerate(tier_labels, start=1):
        expr = F.when(bucket == i, name) if expr is None else expr.when(bucket == i, name)
    return expr


def customer_tiers(
    C: DataFrame,
    n: int = 4,
    tier_labels: Sequence[str] = labels.TIERS,
    keys: Sequence[str] = TIER_KEYS,
    revenue_only: bool = False,
) -> DataFrame:
    """RANK and NTILE(n) of customers by lifetime revenue, with one tier label per bucket.

    ``revenue_only`` leaves out order counts, dates and the rank, and their share of the work.

    Ranking is distributed (``rank_ntile``): no task ever holds all customers.
    NTILE ties are broken by the group keys so the buckets are deterministic.
    """
    if len(tier_labels) != n:
        raise ValueError(f"{n} buckets need {n} tier labels, got {len(tier_labels)}")
    ct = customer_totals(C, keys, revenue_only)
    ranked = rank_ntile(
        ct, "lifetime_revenue", list(keys), n=n, descending=True,
        rank_col=None if revenue_only else "revenue_rank", ntile_col="revenue_quartile",
    )
    out = ranked.select(
        *[c for c in ct.columns if c in (*keys, "total_orders", "lifetime_revenue")],
        *[c for c in ct.columns if c in ("first_order", "last_order")],
        *[c for c in ranked.columns if c == "revenue_rank"],
        F.col("revenue_quartile").cast("long").alias("revenue_quartile"),
        _tier_label(F.col("revenue_quartile"), tier_labels).alias("customer_tier"),
    )
    return pg_order(out, "-lifetime_revenue", *keys)


def customer_tiers_brief(C: DataFrame) -> DataFrame:
    """README variant: emoji-free labels, fewer columns."""
    t = customer_tiers(C, tier_labels=labels.TIERS_BRIEF, revenue_only=True)
    return t.select("customer_id", "customer", "segment", "lifetime_revenue", "revenue_quartile", "customer_tier")


def customer_running_revenue(C: DataFrame) -> DataFrame:
    """(customer_id, customer, month): monthly revenue and the customer's cumulative revenue.

    Default RANGE frame: two names of one id in the same month are peers and
    share the cumulative value.
    """
    g = C.groupBy("customer_id", "customer", "order_month").agg(F.sum("sales").alias("_rev"))
    run = Window.partitionBy("customer_id").orderBy(F.col("order_month").asc_nulls_last())
    out = g.select(
        "customer_id",
        "customer",
        "order_month",
        money("_rev").alias("monthly_revenue"),
        money(F.sum("_rev").over(run)).alias("cumulative_customer_revenue"),
    )
    return pg_order(out, "customer_id", "order_month")


def revenue_movement(C: DataFrame) -> DataFrame:
    """Month-over-month revenue change per customer (vs its previous *active* month) and its label."""
    g = C.groupBy("customer_id", "customer", "segment", "order_month").agg(money(F.sum("sales")).alias("monthly_revenue"))
    w = Window.partitionBy("customer_id").orderBy(
        F.col("order_month").asc_nulls_last(), F.col("customer").asc_nulls_last(), F.col("segment").asc_nulls_last()
    )
    g = g.withColumn("prev_month_revenue", F.lag("monthly_revenue", 1).over(w))
    cur, prev = F.col("monthly_revenue"), F.col("prev_month_revenue")
    movement = (
        F.when(prev.isNull(), labels.NEW_CUSTOMER)
        .when(cur > prev, labels.EXPANSION)
        .when(cur < prev, labels.CONTRACTION)
        .otherwise(labels.FLAT)
    )
    out = g.select(
        "customer_id",
        "customer",
        "segment",
        "order_month",
        "monthly_revenue",
        "prev_month_revenue",
        (cur - F.coalesce(prev, F.lit(0))).alias("revenue_change"),
        movement.alias("revenue_movement"),
    )
    return pg_order(out, "customer_id", "order_month")


def cross_sell(C: DataFrame, sep: str = ", ") -> DataFrame:
    """Products bought per (customer_id, customer, segment), their sorted list and a customer type.

    Collects distinct products per group (map-side partial sets), so a group's
    list is bounded by the product catalogue, not by its number of sales; the
    product count is the size of that set (one aggregate, no distinct rewrite).
    """
    g = C.groupBy("customer_id", "customer", "segment").agg(
        F.collect_set("product").alias("_products"),
        money(F.sum("sales")).alias("total_revenue"),
    )
    # COUNT(DISTINCT product) = size of the distinct set (both skip NULLs); no Expand needed.
    g = g.withColumn("products_purchased", F.size("_products").cast("long"))
    n = F.col("products_purchased")
    listed = F.when(F.size("_products") > 0, F.array_join(F.array_sort("_products"), sep))
    kind = (
        F.when(n == 1, labels.SINGLE_PRODUCT)
        .when(n == 2, labels.CROSS_SELL_2)
        .otherwise(F.concat(F.lit(labels.MULTI_PRODUCT[0]), n.cast("string"), F.lit(labels.MULTI_PRODUCT[1])))
    )
    out = g.select(
        "customer_id", "customer", "segment", "products_purchased", listed.alias("product_list"), "total_revenue",
        kind.alias("customer_type"),
    )
    return pg_order(out, "-products_purchased", "-total_revenue")
