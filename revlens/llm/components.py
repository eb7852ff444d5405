"""Connected components of an edge list as DataFrame joins, with the lineage cut in each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.llm.common import cut, discard


def components(edges: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """One row per node of ``edges``: (node, root), root the smallest node of its component.

    Distributed union-find. The parent table starts with each node under its smallest
    neighbour; a round (1) hangs the root of either end of each edge under the smaller of
    the two, by one min-aggregate, and (2) halves the paths (parent of parent). Edges whose
    ends share a root are dropped from the next round, so the work shrinks as it goes.
    Aggregates are pre-combined map-side and joins can be split by AQE, so a component or a
    node with a third of all rows does not meet in one task. No step leaves the cluster but
    one count per round. Rounds: logarithmic in the longest path. Tables of earlier rounds are deleted.
    """
    left = cut(
        edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u < v").distinct(), f"{name}-edges"
    )
    nodes = left.select(F.explode(F.array("u", "v")).alias("node"), F.col("u").alias("near"))
    parent = cut(nodes.groupBy("node").agg(F.min("near").alias("root")), f"{name}-parent")
    while True:
        parent = _flat(parent, name)
        flat, edges = parent, left
        left = cut(_relabel(_relabel(edges, flat, "u"), flat, "v").where("u <> v").distinct(), f"{name}-edges")
        discard(edges)
        if left.isEmpty():
            discard(left)
            return flat.select("node", "root")
        hung = (
            left.select(F.greatest("u", "v").alias("node"), F.least("u", "v").alias("under"))
            .groupBy("node")
            .agg(F.min("under").alias("under"))
        )
        parent = cut(
            flat.join(hung, "node", "left").select("node", F.coalesce("under", "root").alias("root")), f"{name}-parent"
        )
        discard(flat)


def _relabel(edges: DataFrame, parent: DataFrame, end: str) -> DataFrame:
    p = parent.select(F.col("node").alias(end), "root")
    return edges.join(p, end).select(F.col("root").alias(end), *[c for c in edges.columns if c != end])


def _flat(parent: DataFrame, name: str) -> DataFrame:
    """Paths halved until every node hangs directly under its root; ``parent`` and what lies between are deleted."""
    while True:
        up = parent.select(F.col("node").alias("root"), F.col("root").alias("above"))
        shorter = cut(parent.join(up, "root").select("node", F.col("above").alias("root"), (F.col("above") < F.col("root")).alias("moved")), f"{name}-parent")
        discard(parent)
        parent = shorter
        if shorter.where("moved").isEmpty():
            return parent
