"""Hand-checkable micro fixture: 12 raw rows, expected values worked out by hand."""

import datetime as dt
from decimal import Decimal as D

import pytest

from revlens import operators as ops
from revlens.operators import labels as L
from revlens.schema import RAW_SCHEMA


def _d(s):
    return dt.date.fromisoformat(s) if s else None


# row_id, order_id, date, customer, customer_id, region, segment, product, sales, qty, discount, profit
_ROWS = [
    (1, "O1", "2023-01-05", "acme corp", "c1", "emea", "SMB", "alpha", "100.00", 1, "0", "20.00"),
    (2, "O1", "2023-01-05", " ACME CORP ", " C1", "EMEA", "smb", "beta", "50.00", 2, "0.10", "5.00"),
    (3, "O2", "2023-02-10", "acme corp", "C1", "EMEA", "SMB", "alpha", "30.00", 1, "0.20", "3.00"),
    (4, "O3", "2023-04-01", "acme corp", "C1", "EMEA", "SMB", "alpha", "70.00", 1, "0.50", "-7.00"),
    (5, "O4", "2023-01-20", "o'neil-smith co.uk", "c2", "amer", "mid-market", "alpha", "200.00", 3, "0.40", "40.00"),
    (6, "O5", "2023-02-20", "o'neil-smith co.uk", "c2", "amer", "mid-market", "gamma", "100.00", None, None, None),
    (7, "O6", "2023-03-03", "o'neil-smith co.uk", "c2", "amer", "mid-market", "beta", "50.00", 1, "0", "10.00"),
    (8, "O7", "2023-02-14", "zen ltd", "c3", "apac", "enterprise", "alpha", "400.00", 4, "0", "100.00"),
    (9, "O8", "2023-03-15", "refund co", "c4", "apac", "enterprise", "alpha", "-10.00", 1, "0", "-1.00"),
    (10, "O9", None, "no date", "c5", "apac", "enterprise", "alpha", "20.00", 1, "0", "1.00"),
    (11, "O10", "2023-03-20", "no id", None, "apac", "enterprise", "alpha", "20.00", 1, "0", "1.00"),
    (12, "O11", "2023-03-21", "no sales", "c6", "apac", "enterprise", "alpha", None, 1, "0", None),
]


@pytest.fixture(scope="module")
def raw(spark):
    rows = []
    for r in _ROWS:
        rid, oid, date, cust, cid, region, seg, prod, sales, qty, disc, profit = r
        d = _d(date)
        rows.append(
            (
                rid, oid, d, int(date.replace("-", "")) if date else None, "contact", "Country " + region,
                "city", region, region + " sub", cust, cid, "software", seg, prod, "LIC",
                D(sales) if sales else None, qty, D(disc) if disc else None, D(profit) if profit else None,
            )
        )
    return spark.createDataFrame(rows, RAW_SCHEMA)


@pytest.fixture(scope="module")
def C(raw):
    return ops.clean(raw)


def _map(df, key, *cols):
    out = {}
    for r in df.collect():
        out[r[key]] = tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]]
    return out


def test_quality_checks(raw):
    assert raw.count() == 12
    n = ops.null_profile(raw).first().asDict()
    assert n == {
        "null_order_id": 0, "null_order_date": 1, "null_customer_id": 1, "null_customer": 0,
        "null_sales": 1, "null_product": 0, "null_region": 0,
    }
    assert [tuple(r) for r in ops.duplicate_orders(raw).collect()] == [("O1", 2)]
    assert ops.duplicate_order_count(raw).first()[0] == 1
    assert ops.nonpositive_sales(raw).first()[0] == 1
    s = ops.sales_distribution(raw).first()
    # 11 non-NULL values: -10 20 20 30 50 50 70 100 100 200 400
    assert (s.min_sales, s.max_sales, s.avg_sales) == (D("-10.00"), D("400.00"), D("93.64"))
    assert s.median_sales == 50.0 and s.p95_sales == 300.0
    cov = ops.date_coverage(raw).first()
    assert (cov.months_covered, cov.years_covered) == (4, 1)
    assert ops.suspicious_dates(raw, as_of="2023-03-31").count() == 1  # O3 on 2023-04-01
    assert [r.region for r in ops.distinct_regions(raw).collect()] == ["EMEA", "amer", "apac", "emea"]


def test_clean(C):
    assert C.count() == 8
    assert sorted(set(_map(C, "customer_id", "customer").items())) == [
        ("C1", "Acme Corp"), ("C2", "O'Neil-Smith Co.Uk"), ("C3", "Zen Ltd")
    ]
    assert {r.segment for r in C.collect()} == {"Smb", "Mid-Market", "Enterprise"}
    r6 = C.where("order_id = 'O5'").first()
    assert (r6.quantity, r6.discount, r6.profit) == (1, D("0.0000"), D("0.00"))


def test_overview_and_buckets(C):
    b = ops.business_overview(C).first()
    assert (b.total_unique_customers, b.total_orders, b.total_products, b.regions) == (3, 7, 3, 3)
    assert (b.total_revenue_usd, b.avg_order_value_usd, b.total_profit_usd) == (D("1000.00"), D("125.00"), D("171.00"))
    assert b.overall_profit_margin_pct == D("17.10")
    buckets = _map(ops.discount_impact(C), "discount_bucket", "orders", "total_revenue", "profit_margin_pct")
    assert buckets[L.DISCOUNT_BUCKETS[0]] == (4, D("650.00"), D("20.00"))
    assert set(buckets) == set(L.DISCOUNT_BUCKETS)


def test_mrr(C):
    g = _map(ops.mrr_growth(C), "month", "mrr", "prev_month_mrr", "mrr_change", "mom_growth_rate_pct")
    assert g[dt.date(2023, 1, 1)] == (D("350.00"), None, D("350.00"), None)
    assert g[dt.date(2023, 2, 1)][3] == D("51.43")
    assert g[dt.date(2023, 3, 1)][3] == D("-90.57")
    assert g[dt.date(2023, 4, 1)][3] == D("40.00")
    run = _map(ops.mrr_running(C), "month", "cumulative_revenue", "rolling_3m_avg_mrr")
    assert [run[dt.date(2023, m, 1)] for m in (1, 2, 3, 4)] == [
        (D("350.00"), D("350.00")), (D("880.00"), D("440.00")), (D("930.00"), D("310.00")), (D("1000.00"), D("216.67"))
    ]
    flags = _map(ops.best_worst_months(C), "month", "revenue_rank", "performance_flag")
    assert flags[dt.date(2023, 2, 1)] == (1, L.TOP_MONTH.format(n=3))
    assert flags[dt.date(2023, 3, 1)] == (4, L.BOTTOM_MONTH.format(n=3))
    ex = ops.executive_summary(C).first()
    assert (ex.avg_mrr_usd, ex.peak_mrr_usd, ex.lowest_mrr_usd) == (D("250.00"), D("530.00"), D("50.00"))
    assert ex.avg_monthly_active_customers == D("2") and ex.overall_arpu_usd == D("571.43")
    arpu = _map(ops.arpu_monthly(C), "month", "monthly_arpu", "arpu_change_vs_prev_month")
    assert arpu[dt.date(2023, 2, 1)] == (D("176.67"), D("1.67"))
    assert arpu[dt.date(2023, 3, 1)] == (D("50.00"), D("-126.67"))


def test_churn_and_cohorts(C):
    m = _map(ops.monthly_churn(C), "month", "total_active_customers", "churned_customers", "churn_rate_pct", "retention_rate_pct")
    assert m[dt.date(2023, 1, 1)] == (2, 0, D("0.00"), D("100.00"))
    assert m[dt.date(2023, 2, 1)] == (3, 2, D("66.67"), D("33.33"))
    assert m[dt.date(2023, 4, 1)] == (1, 1, D("100.00"), D("0.00"))
    rc = _map(ops.revenue_churn(C), "month", "churned_mrr", "revenue_churn_rate_pct")
    assert rc[dt.date(2023, 1, 1)] == (None, None)  # FILTER matched nothing -> NULL, not 0
    assert rc[dt.date(2023, 2, 1)] == (D("430.00"), D("81.13"))
    st = {(r.customer_id, r.current_month): r.churn_status for r in ops.churn_status(C).collect()}
    assert st[("C1", dt.date(2023, 1, 1))] == L.RETAINED
    assert st[("C1", dt.date(2023, 2, 1))] == L.CHURNED  # gap: next active month is April
    lst = {(r.churn_month, r.customer_id): r.last_month_revenue for r in ops.churned_revenue_list(C).collect()}
    assert lst[(dt.date(2023, 2, 1), "C3")] == D("400.00") and len(lst) == 4  # Feb C1, Feb C3, Mar C2, Apr C1
    co = {(r.cohort_month, r.months_since_join): (r.original_cohort_size, r.active_customers, r.retention_pct)
          for r in ops.cohort_retention(C).collect()}
    jan = dt.date(2023, 1, 1)
    assert co[(jan, 0)] == (2, 2, D("100.0"))
    assert co[(jan, 2)] == (2, 1, D("50.0"))
    assert co[(dt.date(2023, 2, 1), 0)] == (1, 1, D("100.0"))


def test_value(C):
    t = _map(ops.customer_tiers(C), "customer_id", "lifetime_revenue", "revenue_rank", "revenue_quartile", "customer_tier")
    assert t["C3"] == (D("400.00"), 1, 1, L.TIERS[0])
    assert t["C2"] == (D("350.00"), 2, 2, L.TIERS[1])
    assert t["C1"] == (D("250.00"), 3, 3, L.TIERS[2])
    x = _map(ops.cross_sell(C), "customer_id", "products_purchased", "product_list", "customer_type")
    assert x["C1"] == (2, "Alpha, Beta", L.CROSS_SELL_2)
    assert x["C2"] == (3, "Alpha, Beta, Gamma", "Multi-Product Customer (3 products)")
    assert x["C3"] == (1, "Alpha", L.SINGLE_PRODUCT)
    mv = {r.order_month: (r.revenue_change, r.revenue_movement) for r in ops.revenue_movement(C).where("customer_id = 'C1'").collect()}
    assert mv[dt.date(2023, 1, 1)] == (D("150.00"), L.NEW_CUSTOMER)
    assert mv[dt.date(2023, 2, 1)] == (D("-120.00"), L.CONTRACTION)
    assert mv[dt.date(2023, 4, 1)] == (D("40.00"), L.EXPANSION)
    run = {r.order_month: r.cumulative_customer_revenue for r in ops.customer_running_revenue(C).where("customer_id = 'C1'").collect()}
    assert run[dt.date(2023, 4, 1)] == D("250.00")


def test_clean_view_is_queryable_with_sql(spark, raw):
    ops.register_clean_view(raw, "saas_clean_test")
    r = spark.sql("SELECT COUNT(*) AS n, COUNT(DISTINCT customer_id) AS c FROM saas_clean_test").first()
    assert (r.n, r.c) == (8, 3)


def test_quality_report_equals_separate_checks(raw):
    one = ops.quality_report(raw).first().asDict()
    separate = {}
    for df in (ops.load_profile(raw), ops.null_profile(raw), ops.date_coverage(raw), ops.nonpositive_sales(raw)):
        separate.update(df.first().asDict())
    assert one == separate


def test_period_parameter(C):
    q1, q2 = dt.date(2023, 1, 1), dt.date(2023, 4, 1)
    g = {r.quarter: (r.mrr, r.prev_quarter_mrr, r.qoq_growth_rate_pct) for r in ops.mrr_growth(C, period="quarter").collect()}
    assert g == {q1: (D("930.00"), None, None), q2: (D("70.00"), D("930.00"), D("-92.47"))}
    # quarterly MRR equals the quarterly summary's revenue and distinct customers
    qs = {r.quarter_start: (r.quarterly_revenue, r.active_customers) for r in ops.quarterly_summary(C).collect()}
    mg = {r.quarter: (r.mrr, r.active_customers) for r in ops.mrr_growth(C, period="quarter").collect()}
    assert qs == mg
    # Q1: C1 returns in Q2 (retained), C2 and C3 never return (churned); Q2: C1 is the last -> churned
    ch = {r.quarter: (r.total_active_customers, r.churned_customers) for r in ops.monthly_churn(C, period="quarter").collect()}
    assert ch == {q1: (3, 2), q2: (1, 1)}
    rc = {r.quarter: (r.churned_mrr, r.revenue_churn_rate_pct) for r in ops.revenue_churn(C, period="quarter").collect()}
    assert rc[q1] == (D("750.00"), D("80.65"))  # (350 + 400) / 930
    yr = ops.mrr_running(C, window=2, period="year").collect()
    assert [(r.year, r.cumulative_revenue, r.rolling_2y_avg_mrr) for r in yr] == [(q1, D("1000.00"), D("1000.00"))]


def test_quarterly_cohorts(C):
    co = {(r.cohort_quarter, r.quarters_since_join): (r.original_cohort_size, r.active_customers, r.retention_pct)
          for r in ops.cohort_retention(C, period="quarter").collect()}
    q1 = dt.date(2023, 1, 1)
    assert co == {(q1, 0): (3, 3, D("100.0")), (q1, 1): (3, 1, D("33.3"))}


def test_quarterly_arpu(C):
    rows = {r.quarter: (r.quarterly_arpu, r.arpu_change_vs_prev_quarter) for r in ops.arpu_monthly(C, period="quarter").collect()}
    # Q1: 930 over 3 customers = 310.00; Q2: 70 over 1 = 70.00, change -240.00
    assert rows == {dt.date(2023, 1, 1): (D("310.00"), None), dt.date(2023, 4, 1): (D("70.00"), D("-240.00"))}


def test_churn_gap_parameter(C):
    feb = dt.date(2023, 2, 1)
    st1 = {(r.customer_id, r.current_month): r.churn_status for r in ops.churn_status(C).collect()}
    st2 = {(r.customer_id, r.current_month): r.churn_status for r in ops.churn_status(C, gap=2).collect()}
    assert st1[("C1", feb)] == L.CHURNED and st2[("C1", feb)] == L.RETAINED  # next active month is April
    m2 = {r.month: r.churned_customers for r in ops.monthly_churn(C, gap=2).collect()}
    assert m2[feb] == 1  # only C3 (never returns)
    q = {(r.customer_id, r.current_quarter): r.churn_status for r in ops.churn_status(C, period="quarter").collect()}
    assert q[("C1", dt.date(2023, 1, 1))] == L.RETAINED and q[("C2", dt.date(2023, 1, 1))] == L.CHURNED
