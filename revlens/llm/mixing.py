"""Mixing sources to target weights (DataFrame operations only).

Tokens (words) are summed per source, the sums give each source a target and so a
repetition rate, and every document is emitted ``floor(rate)`` times plus one more copy
drawn by a Bernoulli trial whose probability is the rate's fraction. The trial's seed is
a hash of the document, so reruns and retried tasks agree.

Only sums per source meet in a shuffle (pre-aggregated map-side), so a source with a
third of all rows costs no more than any other.

Defined cases: null text has size 0; null source is a source of its own and sorts last;
a source without words gets target 0 and rate 0; rows repeated exactly draw the same
trial; very long texts are counted whole; an empty table gives an empty result; columns other
than ``doc_id, text, source``, whatever their names, are carried by :func:`mix` and ignored by :func:`plan`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.llm.common import WORD, cut, documents, numbered, own_names, unit_hash

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
SEED = "mix-1"


def sized(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns plus source, size in words and the document's draw in [0, 1)."""
    return docs.select(
        *keep,
        F.col("source").alias("__source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("__size"),
        unit_hash(SEED, F.col("doc_id"), F.col("text")).alias("__draw"),
    )


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """One row per source: source, source_size, target.

    ``sizes`` has ``__source`` and ``__size``. Weights repeat over the sources in code point
    order. All sources below their ceiling ``most * source_size`` get ``level * weight``;
    the level is raised, source by source reaching its ceiling, until nothing is left over.
    Each round is one aggregate over the table of sources, which stays distributed.
    """
    per = sizes.groupBy("__source").agg(F.sum("__size").alias("source_size"))
    per = numbered(per, "mix-sources", "__pos", F.col("__source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("__pos") % len(weights) + 1).cast("int"))
    per = per.select("__source", "source_size", weight.alias("__w"), (F.col("source_size") * F.lit(most)).alias("__top"))
    per = cut(per, "mix-targets")
    total = per.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        under = F.col("__top") >= F.col("__w") * F.lit(level)
        full, w = per.agg(
            F.sum(F.when(~under, F.col("__top"))).alias("full"), F.sum(F.when(under, F.col("__w"))).alias("w")
        ).first()
        raised = (share * total - (full or 0.0)) / w if w else level
        if raised <= level:
            break
        level = raised
    target = F.when(F.col("__top") >= F.col("__w") * F.lit(level), F.col("__w") * F.lit(level)).otherwise(F.col("__top"))
    return per.select("__source", "source_size", target.alias("target"))


def rated(sizes: DataFrame, goals: DataFrame) -> DataFrame:
    """``sizes`` with source_size, target and ``__copies``, the times each document is emitted.

    The goals are joined by null-safe source with the small side first in line for a
    broadcast; past Spark's size threshold the join is a shuffle that AQE splits where skewed.
    """
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    copies = whole + (F.col("__draw") < rate - whole).cast("long")
    goals = goals.withColumnRenamed("__source", "__goal")
    joined = sizes.join(goals, F.col("__source").eqNullSafe(F.col("__goal")))
    return joined.withColumn("__copies", copies).drop("__goal")


def plan(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies, source."""
    sizes = cut(sized(docs, "doc_id"), "mix-sizes")
    return rated(sizes, targets(sizes, weights, share, most)).select(
        "doc_id",
        F.col("__size").alias("size"),
        "source_size",
        "target",
        (F.col("__size") * F.col("__copies")).alias("taken"),
        F.col("__copies").alias("copies"),
        F.col("__source").alias("source"),
    )


@own_names("doc_id", "text", "source", "n_chars")
def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """The mixed documents: the input's columns, each row as often as its source's rate says."""
    names = [f"`{c}`" for c in docs.columns]
    sizes = sized(docs, *names)
    goals = targets(cut(sizes.select("__source", "__size"), "mix-sizes"), weights, share, most)
    many = rated(sizes, goals).where("__copies > 0")
    return many.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select(*names)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(documents(spark, sf_dir))


SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('mix-1|' || coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')), 1, 13))::BIGINT::DOUBLE
           / 4503599627370496.0 AS draw
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w
  FROM d GROUP BY source
), fill AS (
  -- words placed if the level rose to the point where this source is full
  SELECT *, 2.0::DOUBLE * source_size AS top,
         (SELECT sum(least(2.0::DOUBLE * o.source_size, o.w * (2.0::DOUBLE * s.source_size / s.w))) FROM s o) AS placed,
         1.5::DOUBLE * (SELECT sum(source_size) FROM s)::DOUBLE AS total
  FROM s
), level AS (
  SELECT (any_value(total) - coalesce(sum(top) FILTER (placed < total), 0)) / sum(w) FILTER (placed >= total) AS level FROM fill
), goal AS (
  SELECT source, source_size, CASE WHEN placed < total THEN top ELSE w * level END AS target FROM fill, level
), r AS (
  SELECT doc_id, size, source_size, target, d.source,
         CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate, draw
  FROM d JOIN goal ON d.source IS NOT DISTINCT FROM goal.source
)
SELECT doc_id, size, source_size, target, size * copies AS taken, copies, source
FROM (SELECT *, (floor(rate) + (draw < rate - floor(rate))::INT)::BIGINT AS copies FROM r)
"""
