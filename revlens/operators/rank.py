"""Global order statistics without a single-task window.

``Window.orderBy(...)`` with no PARTITION BY sends every row to one task.
For RANK / NTILE over all customers we instead:

1. range-partition on the sort keys, tie breakers included (sampled bounds), and sort inside
   the partitions: the one exchange of whole rows;
2. read a row's place in its partition off ``monotonically_increasing_id`` (partition number
   and row number in one long: no window, no second exchange) and write the rows, so that the
   sampled bounds cannot differ between the jobs that read them;
3. turn per-partition counts into global offsets on a table of P rows (P = number of range
   partitions, fixed by configuration), broadcast it and add.

RANK is the place of the first row with an equal value. Only values that occur more than once
need looking up; they are found by an aggregate over (value, place), pre-combined map-side.

Exact percentiles of decimals and whole numbers count values in a histogram and refine the
buckets that hold the wanted order statistics (``percentiles_cont``); no value is sorted or
shuffled. Other types range-partition the distinct values.
"""

from __future__ import annotations

import math
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, DecimalType, IntegerType, ShortType

from revlens.functions.numeric import int_div
from revlens.session import freeze

_UNB = Window.unboundedPreceding


def _ranged(df: DataFrame, order: list[Column]) -> DataFrame:
    return freeze(df.repartitionByRange(*order).withColumn("_pid", F.spark_partition_id()))


def _offsets(stats: DataFrame, count_col: str) -> DataFrame:
    """Exclusive prefix sum and grand total over the P-row per-partition table."""
    by_pid = Window.orderBy("_pid").rowsBetween(_UNB, -1)
    return stats.withColumn("_offset", F.coalesce(F.sum(count_col).over(by_pid), F.lit(0))).withColumn(
        "_total", F.sum(count_col).over(Window.partitionBy())
    )


def ntile_of(index0: Column, total: Column, n: int) -> Column:
    """NTILE(n) bucket of the row at 0-based position ``index0`` among ``total`` rows.

    The first ``total % n`` buckets hold one extra row (same rule as PostgreSQL and Spark).
    """
    k = F.lit(n).cast("long")
    q = int_div(total, k)
    r = total - q * k
    big = r * (q + 1)
    return (
        F.when(index0 < big, int_div(index0, q + 1) + 1)
        .otherwise(r + int_div(index0 - big, F.greatest(q, F.lit(1).cast("long"))) + 1)
        .cast("int")
    )


def rank_ntile(
    df: DataFrame,
    value: str,
    tie_breakers: list[str],
    n: int = 4,
    descending: bool = True,
    rank_col: str | None = "rank",
    ntile_col: str = "ntile",
) -> DataFrame:
    """Add RANK() OVER (ORDER BY value) and NTILE(n) OVER (ORDER BY value, tie_breakers).

    ``descending`` follows PostgreSQL: DESC puts NULLs first, ASC puts them last.
    The tie breakers make NTILE deterministic (the reference leaves it open).
    ``rank_col=None`` leaves RANK out, and its look-up of equal values.
    """
    v = F.col(value)
    order = [v.desc_nulls_first() if descending else v.asc_nulls_last()]
    order += [F.col(c).asc_nulls_last() for c in tie_breakers]
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
    rows = freeze(placed).withColumn("_pid", F.shiftright("_place", 33)).withColumn("_at", F.col("_place").bitwiseAND((1 << 33) - 1))
    stats = _offsets(rows.groupBy("_pid").agg(F.count(F.lit(1)).alias("_cnt")), "_cnt").drop("_cnt")
    rows = rows.join(F.broadcast(stats), "_pid")  # one row per range partition
    index0 = F.col("_offset") + F.col("_at")
    out = [F.col(c) for c in df.columns]
    if rank_col is not None:
        ties = rows.groupBy(F.struct(value).alias("_run")).agg(F.min(index0).alias("_start"), F.count(F.lit(1)).alias("_n"))
        ties = ties.where("_n > 1").drop("_n")  # a struct of a NULL joins like any other
        rows = rows.join(ties, F.struct(value) == F.col("_run"), "left")
        out.append((F.coalesce("_start", index0) + 1).cast("long").alias(rank_col))
    return rows.select(*out, ntile_of(index0, F.col("_total"), n).alias(ntile_col))


#: Buckets of a histogram, as a power of two: at most so many rows reach its single-task window.
_BITS = 16


def _ranks(n: int, fractions: dict[str, float]) -> dict[str, tuple[int, int, float]]:
    """Places (from 0) of the two values each fraction lies between, and how far it lies between them."""
    out = {}
    for name, f in fractions.items():
        p = float(f) * (n - 1)
        lo = math.floor(p)
        out[name] = (lo, math.ceil(p), p - lo)
    return out


def _order_statistics(values: DataFrame, low: int, high: int, places: list[int]) -> DataFrame:
    """One row, one column ``w``: an array with the values at ``places`` (0-based, in order).

    ``values`` has one whole number ``u`` per row, all from ``low`` to ``high``. A histogram of at
    most 2^_BITS buckets finds the bucket of each place and how many values lie below it;
    buckets wider than one value are refined by a histogram of their own, over their values only.
    The chain is lazy: a level reads the one above it as a scalar.
    """
    at = F.col("u") - F.lit(low)
    shift = max(0, (high - low).bit_length() - _BITS)
    counts = values.groupBy(F.lit(0).cast("long").alias("above"), F.shiftright(at, shift).alias("b"))
    found = None
    while True:
        counts = counts.agg(F.count(F.lit(1)).alias("c"))
        run = Window.partitionBy("above").orderBy("b").rowsBetween(_UNB, -1)
        counts = counts.withColumn("below", F.coalesce(F.sum("c").over(run), F.lit(0)))
        if found is not None:  # what lies below the bucket above
            at_above = (F.array_position(found["b"], F.col("above")) - 1).cast("int")
            counts = counts.withColumn("below", F.col("below") + F.get(found["below"], at_above))
        picks = []
        for k in places:
            hit = (F.col("below") <= k) & (k < F.col("below") + F.col("c"))
            if found is not None:  # buckets of other places are not below this one's
                hit = hit & (F.col("above") == F.get(found["b"], F.lit(places.index(k))))
            picks.append(F.max(F.when(hit, F.struct("b", "below"))))
        one = counts.agg(F.array(*picks).alias("w"))
        if shift == 0:
            return one.select(F.transform("w", lambda x: x["b"] + low).alias("w"))
        # arrays side by side: a scalar may not stand inside a lambda
        found = one.select(F.struct(F.col("w")["b"].alias("b"), F.col("w")["below"].alias("below"))).scalar()
        wanted = values.where(F.array_contains(found["b"], F.shiftright(at, shift)))
        above, shift = shift, max(0, shift - _BITS)
        counts = wanted.groupBy(F.shiftright(at, above).alias("above"), F.shiftright(at, shift).alias("b"))


def _scale(kind) -> int | None:
    """Digits after the point of a type whose values are whole numbers of 64 bits over a power of ten."""
    if isinstance(kind, DecimalType) and kind.precision <= 18:
        return kind.scale
    return 0 if isinstance(kind, (ByteType, ShortType, IntegerType)) else None


def percentiles_cont(df: DataFrame, value: str, fractions: dict[str, float]) -> DataFrame:
    """Exact PERCENTILE_CONT(f) WITHIN GROUP (ORDER BY value) for each named fraction, as DOUBLE.

    Decimals of up to 18 digits and whole numbers of up to 32 bits: one job over the one column
    finds count, sum, least and greatest value (the only job run while the result is built), then
    histograms find the order statistics, lazily. Only bucket counts, combined map-side, are
    shuffled. Other types: :func:`_percentiles_by_range`.

    Interpolates lo + (hi - lo) * frac, as PostgreSQL does in float8. Returns one row with the
    fractions plus ``_min, _max, _sum, _n`` of the non-NULL values (all but ``_n`` NULL on empty input).
    """
    kind = df.schema[value].dataType
    scale = _scale(kind)
    if scale is None:
        return _percentiles_by_range(df, value, fractions)
    v = F.col(value)
    found = df.agg(F.min(v).alias("_min"), F.max(v).alias("_max"), F.sum(v).alias("_sum"), F.count(v).alias("_n"))
    known = found.first()
    spark, out = df.sparkSession, found.schema
    row = spark.createDataFrame([tuple(known)], out)
    if not known["_n"]:
        return row.select("*", *[F.lit(None).cast("double").alias(name) for name in fractions])
    unit = Decimal(10) ** scale
    values = df.where(v.isNotNull()).select((v * F.lit(unit)).cast("long").alias("u") if scale else v.cast("long").alias("u"))
    ranks = _ranks(known["_n"], fractions)
    places = sorted({k for lo, hi, _ in ranks.values() for k in (lo, hi)})
    low, high = int(known["_min"] * unit), int(known["_max"] * unit)
    stats = _order_statistics(values, low, high, places)
    pick = lambda k: F.get("w", F.lit(places.index(k))).cast("decimal(38,0)") / F.lit(unit)
    cols = []
    for name, (lo, hi, fr) in ranks.items():
        a, b = pick(lo).cast("double"), pick(hi).cast("double")
        cols.append((a + (b - a) * F.lit(fr)).alias(name))
    return stats.select(*[F.lit(known[f.name]).cast(f.dataType).alias(f.name) for f in out.fields], *cols)


def _percentiles_by_range(df: DataFrame, value: str, fractions: dict[str, float]) -> DataFrame:
    """``percentiles_cont`` for any type that can be ordered.

    1. distinct values with their counts (map-side aggregated: a hot value costs one row);
    2. range-partition + freeze them; per-partition count/min/max/sum give, on
       the P-row stats table, the global offsets and totals;
    3. only the partitions that hold a wanted order statistic (at most two per
       fraction) are sorted; every other partition is skipped;
    4. interpolate: lo + (hi - lo) * frac, as PostgreSQL does in float8.

    Returns one row with the fractions plus ``_min, _max, _sum, _n`` of the
    non-NULL values (all NULL on empty input).
    """
    v = F.col(value)
    vals = df.where(v.isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("_cnt"))
    frozen = _ranged(vals, [v.asc()])
    stats = frozen.groupBy("_pid").agg(
        F.sum("_cnt").alias("_c"),
        F.min(value).alias("_pmin"),
        F.max(value).alias("_pmax"),
        F.sum(v * F.col("_cnt")).alias("_psum"),
    )
    stats = _offsets(stats, "_c")
    everything = Window.partitionBy()  # over the P-row stats table only
    stats = (
        stats.withColumn("_min", F.min("_pmin").over(everything))
        .withColumn("_max", F.max("_pmax").over(everything))
        .withColumn("_sum", F.sum("_psum").over(everything))
    )
    need = F.lit(False)
    for name, f in fractions.items():
        p = F.lit(float(f)) * (F.col("_total") - 1).cast("double")
        stats = stats.withColumn(f"_lo_{name}", F.floor(p)).withColumn(f"_hi_{name}", F.ceil(p)).withColumn(
            f"_fr_{name}", p - F.floor(p)
        )
        for k in (f"_lo_{name}", f"_hi_{name}"):
            need = need | ((F.col("_offset") <= F.col(k)) & (F.col(k) < F.col("_offset") + F.col("_c")))
    wanted = stats.where(need).drop("_c", "_pmin", "_pmax", "_psum")

    sel = frozen.join(F.broadcast(wanted), "_pid")  # at most 2 x len(fractions) partitions survive
    run = Window.partitionBy("_pid").orderBy(v.asc()).rowsBetween(_UNB, Window.currentRow)
    sel = sel.withColumn("_start", F.col("_offset") + F.sum("_cnt").over(run) - F.col("_cnt"))

    def pick(k):
        hit = (F.col("_start") <= F.col(k)) & (F.col(k) < F.col("_start") + F.col("_cnt"))
        return F.max(F.when(hit, v)).cast("double")

    aggs = [F.max(c).alias(c) for c in ("_min", "_max", "_sum")] + [F.max("_total").alias("_n")]
    for name in fractions:
        aggs += [pick(f"_lo_{name}").alias(f"_lo_{name}"), pick(f"_hi_{name}").alias(f"_hi_{name}"),
                 F.max(f"_fr_{name}").alias(f"_fr_{name}")]
    row = sel.agg(*aggs)
    out = [F.col(c) for c in ("_min", "_max", "_sum", "_n")]
    for name in fractions:
        lo, hi, fr = F.col(f"_lo_{name}"), F.col(f"_hi_{name}"), F.col(f"_fr_{name}")
        out.append((lo + (hi - lo) * fr).alias(name))
    return row.select(*out)
