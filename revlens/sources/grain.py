"""The customer-month grain: a small stored table that most revenue queries scan instead of the sales.

One row per (customer_id, customer, segment, region, order_month) with the sum of ``sales``
under the same name, so any operator that sums sales by those columns takes the grain or the
cleaned sales alike. The table is kept up by increments: each refresh aggregates only
the files that no earlier refresh has read into a *part*, and merges the parts. Parts are
sums, so they merge in any order. If a file that was read has gone, all parts are made anew.

The merged rows are bucketed and sorted by ``customer_id``: a customer has at most one row per
name, segment, region and month, whatever the number of sales, so buckets stay even where
the sales themselves are skewed, and windows and aggregates per customer need no exchange.
"""

from __future__ import annotations

import math
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.sources import versions

GRAIN_KEYS = ("customer_id", "customer", "segment", "region", "order_month")
#: Bytes of parts that make one more bucket.
BUCKET_BYTES = 128 << 20
_SUM = "decimal(22,2)"  # what Spark sums DECIMAL(12,2) to


def grain_of(C: DataFrame) -> DataFrame:
    """The grain of cleaned sales, or of parts of it."""
    return C.groupBy(*GRAIN_KEYS).agg(F.sum("sales").cast(_SUM).alias("sales"))


def _files(spark: SparkSession, source: str) -> list[str]:
    """Data files under ``source``, as Spark lists them: one call, and none is opened."""
    return sorted(spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(source).inputFiles())


def _rows(spark: SparkSession, parts: list[str], buckets: int) -> DataFrame:
    """The merged parts, dealt by customer: the only exchange, as the sums' keys begin with the customer."""
    rows = reduce(DataFrame.unionByName, [spark.read.parquet(p) for p in parts])
    return grain_of(rows.repartition(buckets, "customer_id"))


def _merged(spark: SparkSession, parts: list[str], path: str) -> int:
    """Write the merged parts to ``path``, bucketed; return the number of buckets."""
    held = sum(versions._fs(spark, p)[0].getContentSummary(versions._fs(spark, p)[1]).getLength() for p in parts)
    buckets = max(spark.sparkContext.defaultParallelism, math.ceil(held / BUCKET_BYTES))
    rows = _rows(spark, parts, buckets)
    name = f"revlens_grain_{uuid.uuid4().hex}"
    out = rows.write.bucketBy(buckets, "customer_id").sortBy("customer_id", "order_month")
    out.option("path", path).format("parquet").saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay; each session declares them under their version's name
    return buckets


def refresh(spark: SparkSession, source: str, root: str) -> list[str]:
    """Bring the grain at ``root`` up to the files of the cleaned table at ``source``; return the files read."""
    old = versions.current(spark, root)
    files = _files(spark, source)
    known = set(old["files"]) if old else set()
    parts = list(old["parts"]) if old else []
    if not known <= set(files):  # a file went or was rewritten: its share can't be taken out again
        known, parts = set(), []
    new = [f for f in files if f not in known]
    if old and not new and len(known) == len(files) == len(old["files"]):
        return []
    if new or not parts:
        part = f"{root}/p-{uuid.uuid4().hex}"
        read = spark.read.parquet(*new) if new else spark.read.parquet(source)
        grain_of(read).write.parquet(part)
        parts.append(part)
    path = f"{root}/m-{uuid.uuid4().hex}"
    buckets = _merged(spark, parts, path)
    versions.publish(spark, root, {"path": path, "source": source, "parts": parts, "files": files, "buckets": buckets})
    return new


def grain(spark: SparkSession, root: str) -> DataFrame:
    """The newest merged grain at ``root`` (refreshed before by any session)."""
    manifest = versions.current(spark, root)
    if manifest is None:
        raise ValueError(f"no grain at {root}; call refresh first")
    name = "revlens_grain_" + manifest["path"].rsplit("m-", 1)[1]
    if not spark.catalog.tableExists(name):
        columns = "customer_id STRING, customer STRING, segment STRING, region STRING, order_month DATE, sales DECIMAL(22,2)"
        spark.sql(
            f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (customer_id) "
            f"SORTED BY (customer_id, order_month) INTO {manifest['buckets']} BUCKETS LOCATION '{manifest['path']}'"
        )
    return spark.table(name)
