"""Generic grouped revenue report and the exploratory / ARPU queries built on it.

``revenue_breakdown(C, by, measures)`` aggregates map-side first, with one shuffle
on the group keys, and derives ratios from the aggregated columns.  A grand-total share
divides by a lazy scalar, a second scan of the one column (no window that pulls
every group into one task); a share within a sub-key is a window over the aggregated rows
partitioned by that key.

Several exact distinct counts in one aggregate would make Catalyst copy every row once per
counted column. Each is an aggregate of its own instead, which scans its column and the keys
only, and the counts are joined to the groups (without keys: read as scalars). A top-k whose
order needs no distinct count finds its groups first and counts for those only.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revlens.functions.numeric import exact_avg, money, pct, round_ratio
from revlens.operators import labels
from revlens.operators.ordering import pg_sort_keys

# measure kind -> (aggregates it needs, final expression over them)
# distinct-count aggregates: exact COUNT(DISTINCT) or, with exact=False, HLL++ sketches
_DISTINCT = {
    "_cust": "customer_id",
    "_dorders": "order_id",
    "_dproducts": "product",
    "_dcountries": "country",
    "_dregions": "region",
}

_AGGS = {
    "_orders": lambda: F.count("order_id"),
    "_units": lambda: F.sum("quantity"),
    "_rev": lambda: F.sum("sales"),
    "_nsales": lambda: F.count("sales"),
    "_profit": lambda: F.sum("profit"),
    "_first": lambda: F.min("order_date"),
    "_last": lambda: F.max("order_date"),
}

_MEASURES = {
    "customers": (("_cust",), lambda: F.col("_cust")),
    "orders": (("_orders",), lambda: F.col("_orders")),
    "distinct_orders": (("_dorders",), lambda: F.col("_dorders")),
    "distinct_products": (("_dproducts",), lambda: F.col("_dproducts")),
    "distinct_countries": (("_dcountries",), lambda: F.col("_dcountries")),
    "distinct_regions": (("_dregions",), lambda: F.col("_dregions")),
    "units": (("_units",), lambda: F.col("_units")),
    "revenue": (("_rev",), lambda: money("_rev")),
    "avg_sale": (("_rev", "_nsales"), lambda: exact_avg("_rev", "_nsales")),
    "profit": (("_profit",), lambda: money("_profit")),
    "margin_pct": (("_profit", "_rev"), lambda: pct("_profit", "_rev")),
    "arpu": (("_rev", "_cust"), lambda: round_ratio("_rev", "_cust")),
    "first_date": (("_first",), lambda: F.col("_first")),
    "last_date": (("_last",), lambda: F.col("_last")),
    "lifespan_days": (("_first", "_last"), lambda: F.datediff("_last", "_first")),
    "share_pct": (("_rev",), None),  # filled in by revenue_breakdown
}


def revenue_breakdown(
    C: DataFrame,
    by: Sequence[str | Column],
    measures: Sequence[tuple[str, str]],
    share_within: Sequence[str] | None = None,
    order: Sequence[str | Column] = (),
    limit: int | None = None,
    exact: bool = True,
    rsd: float = 0.01,
) -> DataFrame:
    """Group ``C`` by ``by`` and compute named measures.

    ``measures`` is a list of (output name, kind) with kinds from ``_MEASURES``.
    ``share_pct`` is revenue as a % of all groups, or of the groups sharing the
    ``share_within`` keys.  ``order`` uses pg_order specs; ``limit`` makes it a top-k.
    ``exact=False`` computes distinct counts with HLL++ sketches (error ``rsd``).
    """

    def agg(a: str) -> Column:
        if a in _DISTINCT:
            c = _DISTINCT[a]
            return F.countDistinct(c) if exact else F.approx_count_distinct(c, rsd)
        return _AGGS[a]()

    names = list(dict.fromkeys(a for _, kind in measures for a in _MEASURES[kind][0]))
    distinct = [a for a in names if a in _DISTINCT]
    first = _order_without_counts(order, measures) if exact and limit is not None else None
    apart = distinct if exact and (len(distinct) > 1 or first and distinct) else []
    needed = {a: agg(a).alias(a) for a in names if a not in apart}
    grouped = C.groupBy(*by).agg(*needed.values()) if by else C.agg(*needed.values())
    keys = [k for k in grouped.columns if k not in needed]
    if apart and first:
        grouped = grouped.orderBy(*first).limit(limit)
    for a in apart:
        grouped = _with_distinct(grouped, C, by, keys, a, few=limit if first else None)
    needed = names

    if any(kind == "share_pct" for _, kind in measures):
        if share_within:
            # Window over the aggregated rows, one partition per share_within key.
            total = F.sum("_rev").over(Window.partitionBy(*share_within))
        else:
            # A lazy scalar: one narrow column of the fact, summed map-side.
            total = C.select(F.sum("sales").cast(grouped.schema["_rev"].dataType)).scalar()
        grouped = grouped.withColumn("_total_rev", total)

    cols = [F.col(k) for k in keys]
    for name, kind in measures:
        if kind == "share_pct":
            cols.append(pct("_rev", "_total_rev").alias(name))
        else:
            cols.append(_MEASURES[kind][1]().alias(name))
    out = grouped.select(*cols)
    if order:
        out = out.orderBy(*pg_sort_keys(*order))
    if limit is not None:
        out = out.limit(limit)
    return out


def _order_without_counts(order: Sequence[str | Column], measures: Sequence[tuple[str, str]]) -> list[Column] | None:
    """Sort keys over the aggregated columns, if the order names group keys and plain sums only."""
    kinds, keys = dict(measures), []
    for o in order:
        if not isinstance(o, str):
            return None
        name = o.lstrip("-")
        kind = kinds.get(name)
        if kind is not None and (_MEASURES[kind][1] is None or any(a in _DISTINCT for a in _MEASURES[kind][0])):
            return None
        c = F.col(name) if kind is None else _MEASURES[kind][1]()
        keys.append(c.desc_nulls_first() if o.startswith("-") else c.asc_nulls_last())
    return keys or None


def _with_distinct(grouped: DataFrame, C: DataFrame, by, keys: list[str], a: str, few: int | None) -> DataFrame:
    """``grouped`` with COUNT(DISTINCT) ``a`` of each group, from an aggregate of its own.

    ``few``: ``grouped`` has at most so many rows, and only their rows of ``C`` are counted.
    """
    counted = F.countDistinct(_DISTINCT[a]).alias(a)
    if not keys:  # DISTINCT as a step of its own: Catalyst would merge plain counts into one expanded aggregate
        return grouped.withColumn(a, C.select(_DISTINCT[a]).distinct().agg(F.count(_DISTINCT[a])).scalar())
    # NULL keys are groups too: a struct of them joins like any value
    wanted = grouped.withColumn("_group", F.struct(*keys))
    rows = C.select(F.struct(*[b if isinstance(b, Column) else F.col(b) for b in by]).alias("_group"), _DISTINCT[a])
    if few is not None:
        rows = rows.join(F.broadcast(wanted.select("_group")), "_group", "left_semi")
    counts = rows.groupBy("_group").agg(counted)
    return wanted.join(F.broadcast(counts) if few is not None else counts, "_group").drop("_group")


def business_overview(C: DataFrame, exact: bool = True, rsd: float = 0.01) -> DataFrame:
    """Headline KPIs in one row.

    Five exact distinct counts, each a scan of its own column.  ``exact=False``
    uses HyperLogLog++ sketches instead (``approx_count_distinct``, relative
    error ``rsd``): fixed-size partial states in one scan.
    """
    return revenue_breakdown(
        C,
        [],
        [
            ("total_unique_customers", "customers"),
            ("total_orders", "distinct_orders"),
            ("total_products", "distinct_products"),
            ("countries_served", "distinct_countries"),
            ("regions", "distinct_regions"),
            ("total_revenue_usd", "revenue"),
            ("avg_order_value_usd", "avg_sale"),
            ("total_profit_usd", "profit"),
            ("overall_profit_margin_pct", "margin_pct"),
            ("data_start_date", "first_date"),
            ("data_end_date", "last_date"),
        ],
        exact=exact,
        rsd=rsd,
    )


def revenue_by_region(C: DataFrame) -> DataFrame:
    return revenue_breakdown(
        C,
        ["region"],
        [
            ("customers", "customers"),
            ("orders", "orders"),
            ("total_revenue", "revenue"),
            ("avg_order_value", "avg_sale"),
            ("revenue_share_pct", "share_pct"),
        ],
        order=["-total_revenue"],
    )


def revenue_by_product(C: DataFrame) -> DataFrame:
    return revenue_breakdown(
        C,
        ["product"],
        [
            ("customers", "customers"),
            ("total_orders", "orders"),
            ("total_units_sold", "units"),
            ("total_revenue", "revenue"),
            ("avg_deal_size", "avg_sale"),
            ("total_profit", "profit"),
            ("profit_margin_pct", "margin_pct"),
        ],
        order=["-total_revenue"],
    )


def revenue_by_segment(C: DataFrame) -> DataFrame:
    return revenue_breakdown(
        C,
        ["segment"],
        [
            ("customers", "customers"),
            ("total_revenue", "revenue"),
            ("avg_order_value", "avg_sale"),
            ("revenue_share_pct", "share_pct"),
            ("profit_margin_pct", "margin_pct"),
        ],
        order=["-total_revenue"],
    )


def revenue_by_industry(C: DataFrame, limit: int = 10) -> DataFrame:
    """Top industries by revenue; the share is over all industries (computed before the limit)."""
    return revenue_breakdown(
        C,
        ["industry"],
        [
            ("customers", "customers"),
            ("total_revenue", "revenue"),
            ("avg_deal_size", "avg_sale"),
            ("revenue_share_pct", "share_pct"),
        ],
        order=["-total_revenue", "industry"],
        limit=limit,
    )


def top_customers(C: DataFrame, n: int = 10) -> DataFrame:
    """Top-n (customer_id, customer, segment, region) groups by revenue (TakeOrderedAndProject)."""
    keys = ["customer_id", "customer", "segment", "region"]
    return revenue_breakdown(
        C,
        keys,
        [
            ("total_orders", "distinct_orders"),
            ("total_revenue", "revenue"),
            ("avg_order_value", "avg_sale"),
            ("first_order_date", "first_date"),
            ("last_order_date", "last_date"),
            ("customer_lifespan_days", "lifespan_days"),
        ],
        order=["-total_revenue", *keys],
        limit=n,
    )


def annual_summary(C: DataFrame) -> DataFrame:
    return revenue_breakdown(
        C,
        ["order_year"],
        [
            ("active_customers", "customers"),
            ("total_orders", "distinct_orders"),
            ("annual_revenue", "revenue"),
            ("avg_order_value", "avg_sale"),
            ("annual_profit", "profit"),
        ],
        order=["order_year"],
    )


def discount_bucket(discount: Column | str = "discount") -> Column:
    d = F.col(discount) if isinstance(discount, str) else discount
    b = labels.DISCOUNT_BUCKETS
    lo, mid, hi = (F.lit(Decimal(x)) for x in labels.DISCOUNT_BOUNDS)
    return (
        F.when(d == 0, b[0]).when(d <= lo, b[1]).when(d <= mid, b[2]).when(d <= hi, b[3]).otherwise(b[4])
    )


def discount_impact(C: DataFrame) -> DataFrame:
    """Orders, revenue, profit and margin per discount bucket (ordered by label, binary collation)."""
    return revenue_breakdown(
        C.withColumn("discount_bucket", discount_bucket()),
        ["discount_bucket"],
        [
            ("orders", "orders"),
            ("total_revenue", "revenue"),
            ("total_profit", "profit"),
            ("profit_margin_pct", "margin_pct"),
        ],
        order=["discount_bucket"],
    )


def arpu_overall(C: DataFrame) -> DataFrame:
    return revenue_breakdown(
        C, [], [("total_revenue", "revenue"), ("total_customers", "customers"), ("overall_arpu", "arpu")]
    )


def _arpu_by(C: DataFrame, key: str, share: bool = False) -> DataFrame:
    m = [("customers", "customers"), ("total_revenue", "revenue"), ("arpu", "arpu")]
    if share:
        m.append(("revenue_share_pct", "share_pct"))
    return revenue_breakdown(C, [key], m, order=["-arpu"])


def arpu_by_segment(C: DataFrame) -> DataFrame:
    return _arpu_by(C, "segment")


def arpu_by_region(C: DataFrame) -> DataFrame:
    return _arpu_by(C, "region")


def arpu_by_product(C: DataFrame) -> DataFrame:
    return _arpu_by(C, "product", share=True)
