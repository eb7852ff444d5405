
import datetime as dt
from decimal import Decimal as D

from revlens import operators as ops
from revlens.operators import labels as L
from revlens.operators.ordering import pg_order
from revlens.schema import RAW_SCHEMA


def _raw(spark, rows):
    out = []
    for i, (date, cust, cid, region, prod, sales, disc) in enumerate(rows):
        d = dt.date.fromisoformat(date)
        out.append(
            (i, f"O{i}", d, None, None, "x", None, region, None, cust, cid, "x", "SMB", prod, None,
             D(sales), 1, D(disc), D("0"))
        )
    return spark.createDataFrame(out, RAW_SCHEMA)


def test_s3_null_placement(spark):
    df = spark.createDataFrame([(None,), ("b",), ("a",)], "v string")
    assert [r.v for r in pg_order(df, "v").collect()] == ["a", "b", None]  # ASC NULLS LAST
    assert [r.v for r in pg_order(df, "-v").collect()] == [None, "b", "a"]  # DESC NULLS FIRST


def test_s10_bucket_labels_sort_in_binary_order(spark):
    raw = _raw(spark, [("2023-01-01", "a", "c1", "x", "p", "10.00", d) for d in ("0", "0.05", "0.15", "0.30", "0.50")])
    got = [r.discount_bucket for r in ops.discount_impact(ops.clean(raw)).collect()]
    assert got == sorted(L.DISCOUNT_BUCKETS, key=lambda s: s.encode("utf-8"))
    assert got[1] == "11–20%"  # '1' (0x31) sorts before the en dash (0xE2...)


def test_d1_two_names_in_one_month_sees_own_month_as_next(spark):
    raw = _raw(
        spark,
        [
            ("2023-01-03", "acme", "c1", "x", "p", "10.00", "0"),
            ("2023-01-09", "acme inc", "c1", "x", "p", "10.00", "0"),
            ("2023-03-01", "acme", "c1", "x", "p", "10.00", "0"),
        ],
    )
    st = {(r.customer, r.current_month): (r.next_active_month, r.churn_status) for r in ops.churn_status(ops.clean(raw)).collect()}
    jan = dt.date(2023, 1, 1)
    assert st[("Acme", jan)] == (jan, L.RETAINED)  # peer month counts as "next"
    assert st[("Acme Inc", jan)] == (dt.date(2023, 3, 1), L.CHURNED)
    # monthly_churn works on (id, month) only: January is churned there
    m = {r.month: r.churned_customers for r in ops.monthly_churn(ops.clean(raw)).collect()}
    assert m[jan] == 1


def test_exclude_last_month_option(spark):
    raw = _raw(spark, [("2023-01-03", "a", "c1", "x", "p", "10.00", "0"), ("2023-02-03", "a", "c1", "x", "p", "10.00", "0")])
    C = ops.clean(raw)
    assert [r.month for r in ops.monthly_churn(C).collect()] == [dt.date(2023, 1, 1), dt.date(2023, 2, 1)]
    assert [r.month for r in ops.monthly_churn(C, exclude_last=True).collect()] == [dt.date(2023, 1, 1)]


def test_revenue_churn_null_when_nobody_churns(spark):
    raw = _raw(spark, [("2023-01-03", "a", "c1", "x", "p", "10.00", "0"), ("2023-02-03", "a", "c1", "x", "p", "10.00", "0")])
    r = {x.month: (x.churned_mrr, x.revenue_churn_rate_pct) for x in ops.revenue_churn(ops.clean(raw)).collect()}
    assert r[dt.date(2023, 1, 1)] == (None, None)
    assert r[dt.date(2023, 2, 1)] == (D("10.00"), D("100.00"))


def test_s12_running_revenue_peers_share_range_frame(spark):
    raw = _raw(
        spark,
        [
            ("2023-01-03", "acme", "c1", "x", "p", "10.00", "0"),
            ("2023-01-09", "acme inc", "c1", "x", "p", "5.00", "0"),
        ],
    )
    got = {r.customer: r.cumulative_customer_revenue for r in ops.customer_running_revenue(ops.clean(raw)).collect()}
    assert got == {"Acme": D("15.00"), "Acme Inc": D("15.00")}


def test_best_worst_top_wins_with_few_months(spark):
    raw = _raw(spark, [(f"2023-0{m}-01", "a", "c1", "x", "p", f"{m}0.00", "0") for m in (1, 2, 3, 4)])
    flags = [r.performance_flag for r in ops.best_worst_months(ops.clean(raw)).collect()]
    assert flags == [L.TOP_MONTH.format(n=3)] * 3 + [L.BOTTOM_MONTH.format(n=3)]


def test_business_overview_approx_distinct(spark, sf_small):
    from revlens.sources.store import clean_table

    C = clean_table(spark, sf_small)
    exact = ops.business_overview(C).first()
    approx = ops.business_overview(C, exact=False).first()
    assert approx.total_revenue_usd == exact.total_revenue_usd
    assert abs(approx.total_unique_customers - exact.total_unique_customers) <= 0.05 * exact.total_unique_customers


def test_sales_distribution_approx_close_to_exact(spark, sf_small):
    from revlens.sources.store import sales_table

    raw = sales_table(spark, sf_small)
    e = ops.sales_distribution(raw).first()
    a = ops.sales_distribution_approx(raw).first()
    assert a.min_sales == e.min_sales and a.avg_sales == e.avg_sales
    assert abs(a.median_sales - e.median_sales) <= 0.01 * float(e.max_sales - e.min_sales)


def test_d1_null_name_sorts_last_like_the_window(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    raw = _raw(
        spark,
        [
            ("2023-01-03", None, "c1", "x", "p", "10.00", "0"),
            ("2023-01-09", "acme", "c1", "x", "p", "10.00", "0"),
            ("2023-02-01", None, "c1", "x", "p", "10.00", "0"),
            ("2023-04-01", "zen", "c2", "x", "p", "10.00", "0"),
        ],
    )
    C = ops.clean(raw)
    got = {(r.customer_id, r.customer, r.current_month): r.next_active_month for r in ops.churn_status(C).collect()}
    w = Window.partitionBy("customer_id").orderBy(F.col("order_month").asc_nulls_last(), F.col("customer").asc_nulls_last())
    ref = C.select("customer_id", "customer", "order_month").distinct().withColumn("n", F.lead("order_month").over(w))
    want = {(r.customer_id, r.customer, r.order_month): r.n for r in ref.collect()}
    assert got == want
    assert got[("C1", "Acme", dt.date(2023, 1, 1))] == dt.date(2023, 1, 1)  # NULL name sorts after 'Acme'


def test_churn_and_cohorts_of_another_entity(spark):
    raw = _raw(spark, [
        ("2023-01-05", "a", "c1", "East", "p", "10.00", "0"), ("2023-02-05", "b", "c2", "East", "p", "20.00", "0"),
        ("2023-01-09", "d", "c3", "West", "p", "30.00", "0"), ("2023-03-09", "d", "c3", "West", "p", "40.00", "0"),
    ])
    C = ops.clean(raw)
    jan, feb, mar = (dt.date(2023, m, 1) for m in (1, 2, 3))
    found = {r.month: (r.total_active_customers, r.churned_customers) for r in ops.monthly_churn(C, entity="region").collect()}
    assert found == {jan: (2, 1), feb: (1, 1), mar: (1, 1)}  # East goes on in February with another customer
    lost = {r.month: r.churned_mrr for r in ops.revenue_churn(C, entity="region").collect()}
    assert lost == {jan: D("30.00"), feb: D("20.00"), mar: D("40.00")}
    ages = {(r.cohort_month, r.months_since_join): r.active_customers for r in ops.cohort_retention(C, entity="region").collect()}
    assert ages == {(jan, 0): 2, (jan, 1): 1, (jan, 2): 1}
