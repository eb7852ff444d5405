"""Derive the ``saas_sales`` fact table from the TPC-H-style star schema.

One sales transaction per ``lineitem`` row (left joins: a line whose order,
customer or part is missing still yields a row, with NULL attributes, which
the cleaning step then filters).  The rules below are fixed; the oracle SQL in
``revlens.plans.oracle`` spells out the same mapping.

* order_id      'ORD-' || l_orderkey            (repeats for every line of an order)
* row_id        l_orderkey * 10 + l_linenumber
* order_date    o_orderdate as DATE;  date_key = YYYYMMDD
* customer_id   'C' || c_custkey;  customer = c_name;  contact_name = 'Contact ' || c_custkey
* country       n_name;  city = n_name || ' City';  region = r_name;  subregion = r_name || ' / ' || n_name
* industry      c_mktsegment
* segment       c_acctbal < 2500 -> 'SMB', < 6000 -> 'Mid-Market', else 'Enterprise'
* product       second word of p_name ('small ring' -> 'ring')
* license       'LIC-' || l_suppkey
* quantity      l_quantity as INT
* discount      5 * l_discount   (0.00 .. 0.50)
* sales         ROUND(l_extendedprice * (1 - discount), 2);
                negated for returned+finalised lines (refunds);
                NULL for open lines of pending orders (not invoiced yet)
* profit        ROUND(sales - 0.75 * l_extendedprice, 2), same sign / NULL rule
* Orders of priority '5-LOW' carry unnormalised text (lower/upper case,
  padding) in customer, customer_id, region, segment and product, which is
  what the cleaning step standardises.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from revlens.schema import RAW_SCHEMA

STAR_TABLES = ("lineitem", "orders", "customer", "nation", "region", "part")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def star_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lazy star join producing the 19 raw ``saas_sales`` columns (RAW_SCHEMA)."""
    li = _with_money(read_table(spark, sf_dir, "lineitem")).select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", *_MONEY,
        "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus",
    )
    orders = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority"
    )
    customer = read_table(spark, sf_dir, "customer").select(
        "c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"
    )
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    region = read_table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    # Product name is derived once per part, not once per line.
    part = read_table(spark, sf_dir, "part").select(
        "p_partkey", F.split_part(F.col("p_name"), F.lit(" "), F.lit(2)).alias("p_product")
    )

    # Spark's own size threshold decides on broadcasting nation and region, in bytes and without a job.
    geo = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    cust = customer.join(geo, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    oc = orders.join(cust, F.col("o_custkey") == F.col("c_custkey"), "left")
    # lineitem meets part first, while its rows are still narrow, then orders+customer: the
    # second lineitem shuffle carries one short product string instead of all order/customer
    # text.  Big sides are shuffle joins (AQE may broadcast from runtime sizes, and splits a
    # hot part or order on the lineitem side); lineitem stays the left side of both left joins.
    fact = li.join(part, F.col("l_partkey") == F.col("p_partkey"), "left").join(
        oc, F.col("l_orderkey") == F.col("o_orderkey"), "left"
    )
    return fact.select(*_mapping())


#: Amounts of a line as :func:`_with_money` finds them.
_MONEY = ("l_sales", "l_profit", "l_rate")


def _with_money(li: DataFrame) -> DataFrame:
    """Lines with their signed sales and profit and their discount, in whole cents and hundredths.

    The mapping's decimal rules in integers, which cost a fraction of decimal arithmetic, for lines
    whose price and discount are doubles next to a number of cents and hundredths; bounds keep all
    results inside their types. Such lines carry no price, discount and flag to the mapping any
    more; of all others the amounts are NULL, and the mapping works them out as decimals.
    """
    if any(not isinstance(li.schema[c].dataType, DoubleType) for c in ("l_extendedprice", "l_discount")):
        return li.withColumns({c: F.lit(None).cast("decimal(12,2)") for c in _MONEY})
    cents, rate = (F.rint(F.col(c) * 100) for c in ("l_extendedprice", "l_discount"))
    out = li.withColumns({"__cents": cents, "__rate": rate})
    # the bounds exclude NaN, which Spark orders last
    exact = (F.abs("l_extendedprice") < 1e8) & (F.col("__cents") / 100 == F.col("l_extendedprice"))
    exact = exact & (F.abs("l_discount") < 1.99) & (F.col("__rate") / 100 == F.col("l_discount"))
    out = out.withColumn("__exact", F.coalesce(exact, F.lit(False)))
    out = out.withColumns({c: F.when(F.col("__exact"), F.col(c).cast("long")) for c in ("__cents", "__rate")})
    out = out.withColumn("__net", _half_up(F.col("__cents") * (10000 - F.col("__rate") * 500), 10000))
    out = out.withColumn("__margin", _half_up(F.col("__net") * 100 - F.col("__cents") * 75, 100))
    sign = F.when((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F"), -1).otherwise(1)

    def shifted(whole, type_):
        return (whole.cast("decimal(12,0)") * F.lit(Decimal("0.01"))).cast(type_)

    return out.withColumns(
        {
            "l_sales": shifted(F.col("__net") * sign, "decimal(12,2)"),
            "l_profit": shifted(F.col("__margin") * sign, "decimal(12,2)"),
            "l_rate": shifted(F.col("__rate") * 5, "decimal(5,4)"),
            **{c: F.when(~F.col("__exact"), F.col(c)) for c in ("l_extendedprice", "l_discount", "l_returnflag")},
        }
    )


def _half_up(x, unit: int):
    """``x`` in ``unit``s, rounded half away from zero (``div`` cuts towards zero)."""
    half = F.when(x < 0, -(unit // 2)).otherwise(unit // 2)
    return F.call_function("div", x + half, F.lit(unit))


def _mapping():
    messy = F.col("o_orderpriority") == "5-LOW"
    custkey = F.col("c_custkey").cast("string")
    list_price = F.col("l_extendedprice").cast("decimal(12,2)")
    discount = (F.col("l_discount").cast("decimal(4,2)") * F.lit(Decimal(5))).cast("decimal(5,4)")
    net = F.round(list_price * (F.lit(Decimal(1)) - discount), 2)
    margin = F.round(net - list_price * F.lit(Decimal("0.75")), 2)
    refund = (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F")
    uninvoiced = (F.col("o_orderstatus") == "P") & (F.col("l_linestatus") == "O")

    def signed(known, x):
        x = F.when(refund, -x).otherwise(x)
        return F.when(uninvoiced, F.lit(None)).when(known.isNotNull(), known).otherwise(x.cast("decimal(12,2)"))

    def untidy(clean_value, messy_value):
        return F.when(messy, messy_value).otherwise(clean_value)

    segment = (
        F.when(F.col("c_acctbal") < 2500, F.lit("SMB"))
        .when(F.col("c_acctbal") < 6000, F.lit("Mid-Market"))
        .when(F.col("c_acctbal") >= 6000, F.lit("Enterprise"))
    )
    product = F.col("p_product")
    d = F.to_date(F.col("o_orderdate"))
    cols = {
        "row_id": F.col("l_orderkey") * 10 + F.col("l_linenumber"),
        "order_id": F.concat(F.lit("ORD-"), F.col("l_orderkey").cast("string")),
        "order_date": d,
        "date_key": F.year(d) * 10000 + F.month(d) * 100 + F.dayofmonth(d),
        "contact_name": F.concat(F.lit("Contact "), custkey),
        "country": F.col("n_name"),
        "city": F.concat(F.col("n_name"), F.lit(" City")),
        "region": untidy(F.col("r_name"), F.lower("r_name")),
        "subregion": F.concat(F.col("r_name"), F.lit(" / "), F.col("n_name")),
        "customer": untidy(F.col("c_name"), F.concat(F.lit("  "), F.lower("c_name"), F.lit(" "))),
        "customer_id": untidy(F.concat(F.lit("C"), custkey), F.concat(F.lit(" c"), custkey, F.lit(" "))),
        "industry": F.col("c_mktsegment"),
        "segment": untidy(segment, F.lower(segment)),
        "product": untidy(product, F.upper(product)),
        "license": F.concat(F.lit("LIC-"), F.col("l_suppkey").cast("string")),
        "sales": signed(F.col("l_sales"), net),
        "quantity": F.col("l_quantity").cast("int"),
        "discount": F.coalesce(F.col("l_rate"), discount),
        "profit": signed(F.col("l_profit"), margin),
    }
    return [cols[f.name].cast(f.dataType).alias(f.name) for f in RAW_SCHEMA.fields]
