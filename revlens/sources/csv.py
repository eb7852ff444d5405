"""CSV ingest (``\\copy saas_sales FROM file CSV HEADER DELIMITER ','``) and table save."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from revlens.schema import PARQUET_OPTIONS, RAW_SCHEMA, VARCHAR_LIMITS

CORRUPT_COLUMN = "_corrupt_record"

# No field of a file equals this, so unquoted empty fields are NULL and quoted ones stay text.
_UNQUOTED_EMPTY = "\u0001"


def load_csv(
    spark: SparkSession,
    path: str,
    mode: str = "FAILFAST",
    date_format: str = "yyyy-MM-dd",
    sep: str = ",",
    quoted_empty_as_null: bool = False,
    multi_line: bool = False,
) -> DataFrame:
    """Read sales CSV files with a header row; columns are matched to RAW_SCHEMA by position.

    The dialect is that of ``\\copy ... CSV``: quotes inside a quoted field are doubled, a
    backslash is an ordinary character, an unquoted empty field is NULL and a quoted one is
    the empty text (``quoted_empty_as_null`` makes both NULL). ``multi_line`` allows line
    breaks inside quoted fields; it is off by default because such files can't be split.

    ``mode='FAILFAST'`` fails on a malformed row, but only in columns that the query reads:
    use :func:`load_table` for a load that is all or nothing. ``mode='quarantine'`` keeps
    going and returns the raw text of bad rows in ``_corrupt_record`` (NULL for good rows).
    Executors parse file splits in parallel; nothing is inferred.
    """
    reader = spark.read.option("header", True).option("sep", sep).option("dateFormat", date_format)
    reader = reader.option("enforceSchema", True).option("quote", '"').option("escape", '"')
    reader = reader.option("multiLine", multi_line)
    if not quoted_empty_as_null:
        reader = reader.option("nullValue", _UNQUOTED_EMPTY).option("emptyValue", "")
    if mode.lower() == "quarantine":
        schema = StructType(RAW_SCHEMA.fields + [StructField(CORRUPT_COLUMN, StringType())])
        return (
            reader.schema(schema)
            .option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", CORRUPT_COLUMN)
            .csv(path)
        )
    return reader.schema(RAW_SCHEMA).option("mode", mode.upper()).csv(path)


def varchar_violations(raw: DataFrame) -> DataFrame:
    """Rows whose text exceeds the declared VARCHAR(n) limits (PostgreSQL would reject them)."""
    cond = None
    for name, limit in VARCHAR_LIMITS.items():
        c = F.length(F.rtrim(F.col(name))) > limit
        cond = c if cond is None else (cond | c)
    return raw.where(cond)


def _within(name: str, limit: int) -> Column:
    """The column as VARCHAR(limit): blanks past the limit are cut, other text fails the job."""
    c = F.col(name)
    message = F.concat(F.lit(f"value too long for {name} VARCHAR({limit}): "), F.left(c, F.lit(limit)))
    too_long = F.when(F.length(F.rtrim(c)) > limit, F.raise_error(message).cast("string"))
    # text of no more bytes has no more characters: only the rest is counted through
    over = (F.octet_length(c) > limit) & (F.length(c) > limit)
    return F.when(over, F.coalesce(too_long, F.left(c, F.lit(limit)))).otherwise(c).alias(name)


def load_table(
    spark: SparkSession,
    path: str,
    target: str,
    mode: str = "errorifexists",
    metrics: Observation | None = None,
    **options,
) -> DataFrame:
    """Load CSV files into the raw table at ``target`` (Parquet), all or nothing, and read it back.

    Every cell of all 19 columns is parsed and checked against its type and VARCHAR limit by
    the one job that writes the table; a bad cell fails that job before it commits.
    ``metrics`` gathers the load check in that same job, without a scan of the table:
    ``metrics.get`` then holds row count, non-NULL and NULL counts, date range, revenue and the
    rows with no positive sales, under the names of :func:`quality_report`.
    ``options`` are those of :func:`load_csv`.
    """
    raw = load_csv(spark, path, mode="FAILFAST", **options)
    checked = raw.select(
        *[_within(f.name, VARCHAR_LIMITS[f.name]) if f.name in VARCHAR_LIMITS else F.col(f.name) for f in RAW_SCHEMA.fields]
    )
    if metrics is not None:
        from revlens.operators.quality import load_metrics

        checked = checked.observe(metrics, *load_metrics())
    save_raw(checked, target, mode)
    if "/" in target or ":" in target:
        return spark.read.schema(RAW_SCHEMA).parquet(target)
    return spark.table(target)


def save_raw(raw: DataFrame, target: str, mode: str = "overwrite") -> None:
    """Drop-and-recreate the raw table (``DROP TABLE; CREATE TABLE; load``) as Parquet.

    ``target`` is a path (contains '/' or a URI scheme) or a catalog table name.
    """
    w = raw.select(*[F.col(f.name).cast(f.dataType) for f in RAW_SCHEMA.fields]).write.mode(mode).format("parquet").options(**PARQUET_OPTIONS)
    if "/" in target or ":" in target:
        w.save(target)
    else:
        w.saveAsTable(target)


def write_csv(raw: DataFrame, path: str, mode: str = "overwrite", **options: str | int) -> None:
    """Write sales rows as header CSV in RAW_SCHEMA column order (input for ``load_csv``).

    ``options`` are more of the writer's (compression, say); :func:`load_csv` reads compressed files by their names.
    """
    # The CSV writer trims text by default; raw text must round-trip untouched (padding is data here).
    (
        raw.select(*RAW_SCHEMA.fieldNames())
        .write.mode(mode)
        .option("header", True)
        .option("dateFormat", "yyyy-MM-dd")
        .option("quote", '"')
        .option("escape", '"')
        .option("emptyValue", '""')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .options(**options)
        .csv(path)
    )
