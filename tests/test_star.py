"""Amounts of the sales fact: whole cents for usual lines, decimals for all others, the same values."""

from decimal import ROUND_HALF_UP, Decimal

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from revlens.schema import RAW_SCHEMA
from revlens.sources import star, versions

PRICES = [0.0, -0.0, 0.01, 0.1, 1.005, 2.675, 3.335, -3.335, 901.45, 1234.56, -77.77, 104949.5, 99999999.99, 123456789.01, 5e8, 33.333333, None]
RATES = [0.0, 0.01, 0.03, 0.07, 0.1, 0.2, 0.29, 0.005, 0.045, -0.05, 1.5, None]


def _cut(x, places):
    return x.quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP)


def _expected(price, rate, flag, status):
    discount = None if rate is None else _cut(Decimal(repr(rate)), 2) * 5
    if price is None or rate is None or status == "O":
        return None, discount, None
    listed = _cut(Decimal(repr(price)), 2)
    net = _cut(listed * (1 - discount), 2)
    margin = _cut(net - listed * Decimal("0.75"), 2)
    sign = -1 if (flag, status) == ("R", "F") else 1
    return sign * net, discount, sign * margin


def _lines(spark):
    rows = [(i, p, r, f, s) for i, (p, r, f, s) in enumerate((p, r, f, s) for p in PRICES for r in RATES for f, s in [("R", "F"), ("N", "F"), ("N", "O"), (None, "F")])]
    return rows, spark.createDataFrame(rows, "l_orderkey long, l_extendedprice double, l_discount double, l_returnflag string, l_linestatus string")


def _others(li):
    """The columns of the other tables; all orders are pending."""
    given = {"l_linenumber": "int", "l_suppkey": "long", "l_quantity": "double", "c_custkey": "long", "c_acctbal": "double", "o_orderdate": "timestamp"}
    text = dict.fromkeys(["o_orderpriority", "n_name", "r_name", "c_name", "c_mktsegment", "p_product"], "string")
    return li.withColumns({c: F.lit(None).cast(t) for c, t in (given | text).items()} | {"o_orderstatus": F.lit("P")})


@pytest.mark.parametrize("type_", ["double", "decimal(14,4)"])
def test_amounts_follow_the_decimal_rules(spark, type_):
    rows, li = _lines(spark)
    li = li.withColumns({c: F.col(c).cast(type_) for c in ("l_extendedprice", "l_discount")})
    if type_ != "double":  # halves of a cent that a decimal holds to four places
        rows = [(i, p if p is None else float(_cut(Decimal(repr(p)), 4)), *more) for i, p, *more in rows]
    out = _others(star._with_money(li)).select("l_orderkey", *star._mapping())
    got = {r.l_orderkey: (r.sales, r.discount, r.profit) for r in out.collect()}
    assert got == {i: _expected(*row) for i, *row in rows}


def test_usual_lines_need_no_decimals(spark):
    _, li = _lines(spark)
    usual = li.where("l_extendedprice in (0.1, 901.45, 1234.56, -77.77, 104949.5) and l_discount in (0.0, 0.01, 0.07, 0.29)")
    left = star._with_money(usual).where("l_sales is null or l_extendedprice is not null")
    assert usual.count() > 0 and left.count() == 0


def test_not_a_number_is_left_to_the_decimals(spark):
    rows = [(float(x), 0.1, "N", "F") for x in ("nan", "inf", "-inf")]
    li = spark.createDataFrame(rows, "l_extendedprice double, l_discount double, l_returnflag string, l_linestatus string")
    assert [r.l_sales for r in star._with_money(li).collect()] == [None] * 3


def test_stored_rows_have_dictionaries_for_repeated_values_only(spark, tmp_path):
    from revlens.sources.store import PARQUET_OPTIONS

    values = {f.name: F.lit("x") if f.name == "region" else F.col("id").cast("string") for f in RAW_SCHEMA.fields}
    df = spark.range(1000, numPartitions=1).select(*[v.alias(k) for k, v in values.items()])
    path = versions.replace(df, str(tmp_path / "t"), "s", **PARQUET_OPTIONS)
    file = next(p for p in (tmp_path / "t" / path.rsplit("/", 1)[1]).iterdir() if p.suffix == ".parquet")
    group = pq.read_metadata(file).row_group(0)
    coded = {group.column(i).path_in_schema for i in range(group.num_columns) if group.column(i).has_dictionary_page}
    assert "region" in coded and not coded & {"row_id", "order_id", "contact_name", "customer", "customer_id", "sales", "profit"}
