"""Every registered query equals its DuckDB oracle SQL (schema names, rows, values)."""

import pytest

from tests.oracle_harness import compare, duck

import __spark_entry__ as entry
from revlens.plans import registry


@pytest.fixture(scope="module")
def con(sf_small):
    return duck(sf_small)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["month", "active_customers", "mrr", "prev_month_mrr", "mrr_change", "mom_growth_rate_pct"]
    assert df.count() > 0


def test_every_query_has_oracle_sql():
    assert set(registry.queries()) == set(registry.oracle_sql())


@pytest.mark.parametrize("key", sorted(registry.queries()))
def test_query_matches_oracle(spark, sf_small, con, key):
    r = compare(spark, sf_small, key, entry.queries()[key], entry.oracle_sql()[key], con)
    assert r["status"] == "ok", r


def test_clean_as_view_gives_same_results(spark, sf_small):
    from revlens.plans import registry

    keys = ["business_overview", "cross_sell", "churn_status"]
    before = {k: sorted(map(tuple, registry.run(spark, sf_small, k).collect())) for k in keys}
    spark.conf.set(registry.MATERIALIZE_CLEAN, "false")
    try:
        after = {k: sorted(map(tuple, registry.run(spark, sf_small, k).collect())) for k in keys}
    finally:
        spark.conf.unset(registry.MATERIALIZE_CLEAN)
    assert before == after
