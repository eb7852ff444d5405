"""Distinct counts without row expansion, and top-k that counts for its own groups only."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from revlens import operators as ops
from revlens.plans import registry
from revlens.sources.store import clean_table


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", ["business_overview", "annual_summary", "mrr_monthly", "quarterly_summary"])
def test_no_expand(spark, sf_small, key):
    plan = _plan(registry.run(spark, sf_small, key))
    assert "Expand" not in plan


def test_each_count_scans_its_own_column(spark, sf_small):
    C = clean_table(spark, sf_small)
    df = ops.revenue_breakdown(C, [], [("a", "customers"), ("b", "distinct_orders"), ("c", "revenue")])
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 3
    assert "Expand" not in plan
    row = df.first()
    want = C.agg(F.countDistinct("customer_id"), F.countDistinct("order_id"), F.round(F.sum("sales"), 2)).first()
    assert tuple(row) == tuple(want)


def _tiny(spark):
    d = dt.date(2024, 1, 1)
    rows = [
        ("o1", "C1", None, "s", d, 2024, "5.00"), ("o1", "C1", None, "s", d, 2024, "5.00"), ("o2", "C1", None, "s", d, 2024, "1.00"),
        ("o3", "C2", "x", None, d, None, "50.00"), (None, "C2", "x", None, d, None, "1.00"),
        ("o4", "C3", "x", "t", d, 2023, "11.00"), ("o5", None, "x", "t", d, 2023, "2.00"),
    ]
    schema = "order_id string, customer_id string, customer string, segment string, order_date date, order_year int, sales decimal(12,2)"
    rows = [(*r[:6], Decimal(r[6])) for r in rows]
    return spark.createDataFrame(rows, schema).withColumn("region", F.lit("r")).withColumn("profit", F.col("sales"))


def test_null_keys_and_null_counts(spark):
    got = {(r.order_year, r.active_customers, r.total_orders) for r in ops.annual_summary(_tiny(spark)).collect()}
    assert got == {(2024, 1, 2), (None, 1, 1), (2023, 1, 2)}


@pytest.mark.parametrize("n", [1, 2, 3, 10])
def test_top_k_counts_for_its_groups(spark, n):
    got = [(r.customer_id, r.total_orders, r.total_revenue) for r in ops.top_customers(_tiny(spark), n).collect()]
    want = [("C2", 1, Decimal("51.00")), ("C1", 2, Decimal("11.00")), ("C3", 1, Decimal("11.00")), (None, 1, Decimal("2.00"))]
    assert got == want[:n]
    assert ops.top_customers(_tiny(spark).where("false"), n).collect() == []


def test_pairs_of_other_customers_are_not_shuffled(spark, sf_small):
    """The distinct count's input is filtered by the ten groups before any exchange."""
    plan = _plan(ops.top_customers(clean_table(spark, sf_small))).split("\n")
    at = next(i for i, x in enumerate(plan) if "BroadcastHashJoin" in x and "LeftSemi" in x)
    depth = lambda x: len(x) - len(x.lstrip(" :+-"))
    left = []
    for x in plan[at + 1 :]:
        if depth(x) <= depth(plan[at]):
            break
        left.append(x)
    stream = left[: next(i for i, x in enumerate(left) if "BroadcastExchange" in x)]
    assert any("Scan parquet" in x for x in stream) and not any(" Exchange" in x for x in stream)
    above = [x for x in plan[:at] if "hashpartitioning" in x and "order_id" in x]
    assert above and all("_group" in x for x in above)


def test_orders_by_a_count_keep_one_aggregate(spark):
    df = ops.revenue_breakdown(_tiny(spark), ["customer_id"], [("n", "distinct_orders"), ("r", "revenue")], order=["-n"], limit=1)
    assert df.first().customer_id == "C1"
