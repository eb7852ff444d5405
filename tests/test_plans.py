"""Plan checks: native expressions only, no cartesian products, filters and pruning reach the scan."""

import contextlib
import io

import pytest

from revlens import operators as ops
from revlens.plans import registry
from revlens.sources.store import clean_table, sales_table

FORBIDDEN = ("PythonUDF", "BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin")


def _plan(df):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


@pytest.mark.parametrize("key", list(registry.CATALOG))
def test_no_python_udf_or_cartesian(spark, sf_small, key):
    plan = _plan(registry.run(spark, sf_small, key))
    for bad in FORBIDDEN:
        assert bad not in plan, f"{key}: {bad}"


def test_clean_filters_reach_parquet_scan(spark, sf_small):
    plan = _plan(ops.clean(sales_table(spark, sf_small)))
    line = next(x for x in plan.splitlines() if x.startswith("PushedFilters:"))
    for f in ("IsNotNull(sales)", "IsNotNull(order_date)", "IsNotNull(customer_id)", "GreaterThan(sales,0.00)"):
        assert f in line


def test_column_pruning_on_clean_table(spark, sf_small):
    plan = _plan(ops.mrr_growth(clean_table(spark, sf_small)))
    assert "ReadSchema: struct<order_month:date,customer_id:string,sales:decimal(12,2)>" in plan


def test_star_join_leaves_broadcasts_to_the_byte_threshold(spark, sf_small):
    from revlens.sources.star import star_sales

    plan = star_sales(spark, sf_small)._jdf.queryExecution()
    assert "broadcast" not in plan.optimizedPlan().toString()  # no hint on any side
    assert plan.sparkPlan().toString().count("BroadcastHashJoin") >= 2  # nation and region by their size
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" not in star_sales(spark, sf_small)._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def _subtrees(plan_text, marker):
    """Yield (line, subtree lines) for every plan node whose line contains ``marker``."""
    lines = [ln for ln in plan_text.splitlines() if ln.strip()]

    def depth(ln):
        return len(ln) - len(ln.lstrip(" :+-"))

    for i, ln in enumerate(lines):
        if marker in ln:
            d, sub = depth(ln), []
            for nxt in lines[i + 1:]:
                if depth(nxt) <= d:
                    break
                sub.append(nxt)
            yield ln, sub


@pytest.mark.parametrize("key", list(registry.CATALOG))
def test_fact_rows_are_combined_map_side_before_any_shuffle(spark, sf_small, key):
    """Every shuffle over the fact has an aggregate under it: raw rows never cross the network,
    so a hot customer/month/value is collapsed map-side first."""
    assert not _raw_row_shuffles(registry.run(spark, sf_small, key)), key


def _raw_row_shuffles(df):
    plan = df._jdf.queryExecution().executedPlan().toString()  # AQE initial plan, exchanges included
    assert "Exchange" in plan or "Scan" in plan
    bad = []
    for line, sub in _subtrees(plan, "Exchange "):
        if "SinglePartition" in line:
            continue
        text = "\n".join(sub)
        if "Scan parquet" not in text or "ExistingRDD" in text:
            continue
        if "HashAggregate" not in text and "ObjectHashAggregate" not in text:
            bad.append(line.strip())
    return bad


def test_raw_row_shuffle_is_detected(spark, sf_small):
    from pyspark.sql import functions as F

    C = clean_table(spark, sf_small)
    bad = C.repartition("customer_id").groupBy("customer_id").agg(F.sum("sales"))
    assert _raw_row_shuffles(bad)
    good = C.groupBy("customer_id").agg(F.sum("sales"))
    assert not _raw_row_shuffles(good)
