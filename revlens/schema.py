"""Fixed schemas of the sales fact (raw) and of the cleaned view."""

from pyspark.sql.types import (
    DateType,
    DecimalType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)

MONEY = DecimalType(12, 2)
RATE = DecimalType(5, 4)

# Column order matters: CSV files are matched to it by position.
# row_id is widened from INTEGER to BIGINT so it cannot overflow at cluster scale.
RAW_SCHEMA = StructType(
    [
        StructField("row_id", LongType()),
        StructField("order_id", StringType()),
        StructField("order_date", DateType()),
        StructField("date_key", IntegerType()),
        StructField("contact_name", StringType()),
        StructField("country", StringType()),
        StructField("city", StringType()),
        StructField("region", StringType()),
        StructField("subregion", StringType()),
        StructField("customer", StringType()),
        StructField("customer_id", StringType()),
        StructField("industry", StringType()),
        StructField("segment", StringType()),
        StructField("product", StringType()),
        StructField("license", StringType()),
        StructField("sales", MONEY),
        StructField("quantity", IntegerType()),
        StructField("discount", RATE),
        StructField("profit", MONEY),
    ]
)

RAW_COLUMNS = [f.name for f in RAW_SCHEMA.fields]

#: Parquet writer options of stored sales rows: no dictionaries for values that rarely repeat in a file,
#: which would be hashed one by one until the dictionary is full and then written plainly all the same.
PARQUET_OPTIONS = {
    f"parquet.enable.dictionary#{c}": "false"
    for c in ("row_id", "order_id", "contact_name", "customer", "customer_id", "sales", "profit")
}

# Declared VARCHAR(n) limits of the source table, checked by sources.load_table.
VARCHAR_LIMITS = {
    "order_id": 50,
    "contact_name": 100,
    "country": 100,
    "city": 100,
    "region": 50,
    "subregion": 50,
    "customer": 150,
    "customer_id": 50,
    "industry": 100,
    "segment": 50,
    "product": 100,
    "license": 50,
}

CLEAN_COLUMNS = [
    "order_id",
    "order_date",
    "order_month",
    "order_year",
    "order_month_num",
    "customer",
    "customer_id",
    "country",
    "region",
    "subregion",
    "industry",
    "segment",
    "product",
    "license",
    "sales",
    "quantity",
    "discount",
    "profit",
]
