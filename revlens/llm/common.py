"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import functools
import uuid
import weakref

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from revlens.session import checkpoint_dir, shuffles_deleted

#: A word of the contracts: a run of anything but space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"


#: Folders of the tables that :func:`cut` wrote in this process, for :func:`discard`.
_folders: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it back.

    Cuts the lineage: a lost executor costs a re-read, not a recomputation, and what
    is not deterministic to recompute (range bounds, partition ids) is fixed for good.
    Shuffle files of the write are deleted with it, so those of a chain of cuts don't add up.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"
    with shuffles_deleted(spark):
        df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _folders[table] = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete the folders of tables that :func:`cut` returned, when all that is read from them is written itself."""
    for table in tables:
        folder, spark = _folders.pop(table), table.sparkSession
        if not hasattr(spark, "_jsparkSession"):  # Spark Connect: no file system at hand
            continue
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def range_blocks(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """``df`` written in range partitions of ``order``, with the partition as ``block``.

    Blocks are in order: every row of a lower block sorts before every row of a higher
    one. The range bounds come from Spark's sample, so a block holds a bounded share of
    the rows whatever the key distribution (rows equal in all of ``order`` stay together).
    """
    return cut(df.repartitionByRange(*order).withColumn("block", F.spark_partition_id()), name)


def numbered(df: DataFrame, name: str, out: str, *order: Column) -> DataFrame:
    """``df`` with ``out`` = 0-based position in the total order ``order``, without a single-task sort.

    Positions inside a block come from a window per block, the block's offset from a
    running sum over one row per block.
    """
    blocks = range_blocks(df, name, *order)
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        blocks.groupBy("block")
        .agg(F.count("*").alias("__n"))
        .select("block", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    )
    inside = F.row_number().over(Window.partitionBy("block").orderBy(*order)) - 1
    return (
        blocks.withColumn("__at", inside)
        .join(offsets, "block")
        .withColumn(out, F.col("__at") + F.col("__offset"))
        .drop("__at", "__offset", "block")
    )


def unit_hash(seed: str, *cols: Column) -> Column:
    """A reproducible number in [0, 1) from the first 52 bits of an MD5 (null counts as empty)."""
    text = F.concat_ws("|", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def own_names(*known: str):
    """For an operator on documents: columns other than ``known`` are numbered on the way in and
    get their names back on the way out, so none clashes with a name the operator uses."""

    def wrap(op):
        @functools.wraps(op)
        def run(docs: DataFrame, *args, **options) -> DataFrame:
            inner = [c if c in known else f"column{i}" for i, c in enumerate(docs.columns)]
            out = op(docs.select(*[F.col(f"`{c}`").alias(x) for c, x in zip(docs.columns, inner)]), *args, **options)
            return out.select(*[F.col(x).alias(c) for c, x in zip(docs.columns, inner)])

        return run

    return wrap
