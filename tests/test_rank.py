"""Distributed RANK / NTILE / percentiles must equal the single-task window versions."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from revlens.operators.rank import percentiles_cont, rank_ntile


def _frame(spark, n, distinct_values, nulls=0, seed=7):
    rnd = random.Random(seed)
    rows = [(f"k{i:05d}", Decimal(rnd.randrange(distinct_values)) / 4) for i in range(n)]
    rows += [(f"n{i:03d}", None) for i in range(nulls)]
    rnd.shuffle(rows)
    return spark.createDataFrame(rows, "key string, v decimal(12,2)").repartition(5)


@pytest.mark.parametrize(
    "n, distinct, nulls, buckets, descending",
    [
        (1000, 7, 0, 4, True),  # heavy ties straddling range partitions
        (1000, 1, 0, 4, True),  # one value everywhere (a hot key)
        (500, 1000, 3, 4, True),  # mostly unique, NULLs first
        (300, 20, 5, 7, False),  # ascending, NULLs last
        (3, 10, 0, 4, True),  # fewer rows than buckets
    ],
)
def test_rank_ntile_matches_window(spark, n, distinct, nulls, buckets, descending):
    df = _frame(spark, n, distinct, nulls)
    got = rank_ntile(df, "v", ["key"], n=buckets, descending=descending)
    vkey = F.col("v").desc_nulls_first() if descending else F.col("v").asc_nulls_last()
    want = df.select(
        "key",
        "v",
        F.rank().over(Window.orderBy(vkey)).alias("rank"),
        F.ntile(buckets).over(Window.orderBy(vkey, F.col("key").asc())).alias("ntile"),
    )
    g = {r.key: (r.rank, r.ntile) for r in got.collect()}
    w = {r.key: (r.rank, r.ntile) for r in want.collect()}
    assert g == w


@pytest.mark.parametrize("fracs", [(0.5, 0.95), (0.0, 0.25, 1.0)])
def test_percentiles_match_spark_percentile(spark, fracs):
    df = _frame(spark, 777, 50, nulls=4)
    names = {f"p{i}": f for i, f in enumerate(fracs)}
    got = percentiles_cont(df, "v", names).first()
    want = df.agg(*[F.percentile(F.col("v").cast("double"), f).alias(k) for k, f in names.items()]).first()
    for k in names:
        assert got[k] == pytest.approx(want[k], abs=1e-9)


def test_percentile_of_empty_input_is_null(spark):
    df = spark.createDataFrame([], "v decimal(12,2)")
    assert percentiles_cont(df, "v", {"m": 0.5}).first().m is None


def test_rank_ntile_on_empty_input(spark):
    df = spark.createDataFrame([], "key string, v decimal(12,2)")
    assert rank_ntile(df, "v", ["key"], n=4).count() == 0


@pytest.mark.parametrize("spread", [3, 10**5, 10**8, 10**12 - 1])  # one, two and three levels of buckets
def test_percentiles_refine_buckets_of_any_range(spark, spread):
    rnd = random.Random(spread)
    cents = [rnd.randrange(-spread, spread + 1) for _ in range(400)] + [rnd.randrange(-3, 4) for _ in range(300)] + [spread, -spread, 7]
    df = spark.createDataFrame([(Decimal(c) / 100,) for c in cents] + [(None,)], "v decimal(12,2)").repartition(5)
    names = {"lo": 0.0, "q": 0.25, "m": 0.5, "m2": 0.501, "p95": 0.95, "hi": 1.0}
    got = percentiles_cont(df, "v", names).first()
    cents.sort()
    for name, f in names.items():
        p = f * (len(cents) - 1)
        a, b = cents[int(p)] / 100, cents[-(-p // 1).__int__()] / 100
        assert got[name] == a + (b - a) * (p - int(p))
    assert (got._min, got._max, got._sum, got._n) == (Decimal(cents[0]) / 100, Decimal(cents[-1]) / 100, Decimal(sum(cents)) / 100, len(cents))


def test_percentiles_of_other_types(spark):
    rnd = random.Random(1)
    rows = [(rnd.randrange(-100, 100), rnd.random(), rnd.randrange(10**15)) for _ in range(301)]
    df = spark.createDataFrame(rows, "i int, d double, l long").repartition(3)
    for c in ("i", "d", "l"):
        want = df.agg(F.percentile(c, 0.3).alias("x"), F.percentile(c, 0.5).alias("y")).first()
        got = percentiles_cont(df, c, {"x": 0.3, "y": 0.5}).first()
        assert got.x == pytest.approx(want.x, rel=1e-12) and got.y == want.y


def test_one_row_and_equal_values(spark):
    one = percentiles_cont(spark.createDataFrame([(Decimal("1.25"),)], "v decimal(12,2)"), "v", {"m": 0.5, "h": 0.95}).first()
    assert (one.m, one.h, one._n) == (1.25, 1.25, 1)
    many = percentiles_cont(spark.range(1000).select(F.lit(Decimal("-3.50")).cast("decimal(12,2)").alias("v")), "v", {"m": 0.5}).first()
    assert (many.m, many._n) == (-3.5, 1000)


def _exchanges(df):
    return [x for x in df._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange" in x and "Reused" not in x]


def test_percentiles_shuffle_counts_only_and_run_one_job_while_built(spark, sf_small):
    from revlens.sources.store import sales_table

    raw = sales_table(spark, sf_small)
    sc = spark.sparkContext
    sc.setJobGroup("percentiles", "percentiles")
    try:
        df = percentiles_cont(raw, "sales", {"m": 0.5, "p95": 0.95})
        assert len(sc.statusTracker().getJobIdsForGroup("percentiles")) <= 2  # the statistics; AQE runs its two stages as jobs
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "HashAggregate" in plan


def test_rank_moves_whole_rows_once(spark):
    df = _frame(spark, 400, 30).withColumn("wide", F.lit("x" * 50))
    ranked = rank_ntile(df, "v", ["key"], rank_col=None)
    assert all("SinglePartition" in x or "Broadcast" in x or "_pid" in x for x in _exchanges(ranked))
    with_rank = rank_ntile(df, "v", ["key"])
    assert "wide" in with_rank.columns and with_rank.count() == 400
    assert "Window [row_number" not in with_rank._jdf.queryExecution().executedPlan().toString()
