"""Near-duplicates among embeddings: random-hyperplane tables, exact cosines, connected components.

Every distinct vector gets one key per table, the signs of its products with ``bits`` random
hyperplanes. Vectors that share a key in some table are compared by their exact cosine in
double precision, blocks of them at a time by matrix products; a pair counts in the first
table in which it meets, so links are counted once. Two vectors at angle a share a key in a
given table with probability (1 - a / pi) ^ bits; :func:`plan` takes so many tables that a pair
right at the threshold is found with probability ``RECALL`` (closer pairs with more), and so
many bits that a bucket of evenly spread vectors has about ``BUCKET`` members. Both follow
from the number of vectors by the same rule at every size.

Hot groups. Equal vectors are one row after a map-side aggregate. A bucket of more than
``BLOCK`` vectors is dealt into blocks, and pairs of blocks are tasks of their own. So that a
group of a third of all rows, all near one another, does not cost its square, the vectors of
such a bucket that lie within half the threshold's angle of the bucket's mean direction form a
*core*: by the triangle inequality all of them are linked, so they are counted and joined
without being compared or paired. A vector belongs to one core at most. What is left over
(core against other vectors, other vectors among themselves) is compared block by block. No
pairs leave a task, only sums per vector and a spanning forest of the links, which
distributed union-find joins.

Defined cases: vectors that are null, empty, zero or hold null or non-finite entries link
with nothing; vectors of unlike length don't link; equal vectors (0.0 equals -0.0) link, also
in rows of one ``vec_id``; a component's id is the smallest ``vec_id`` in it, null if no
member has one, and a row is kept if its ``vec_id`` is that (null equals null); an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.llm.common import cut
from revlens.llm.components import components

COSINE = 0.95
#: Probability that a pair at the threshold meets in a table.
RECALL = 0.9995
#: Members aimed at in a bucket of evenly spread vectors.
BUCKET = 1024
BLOCK = 2048
SEED = 12
#: Rows of a block compared at a time.
_STEP = 256
#: A core's radius is less than half the threshold's angle by this, in radians.
_MARGIN = 1e-6


def plan(vectors: int, cosine: float = COSINE, recall: float = RECALL, bucket: int = BUCKET) -> tuple[int, int]:
    """(bits, tables) for so many distinct vectors."""
    bits = min(30, max(4, round(math.log2(max(1, vectors) / bucket))))
    meet = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log1p(-recall) / math.log1p(-meet)))


def usable(vec: Column) -> Column:
    """Not null or empty, all entries finite, not all zero."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vec, lambda x: x != 0), F.lit(False))


def _unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def keyed(distinct: DataFrame, bits: int, tables: int, seed: int = SEED) -> DataFrame:
    """``distinct`` (id, copies, vec) with ``keys``, the sign key of each table, and ``packed``: the
    keys' bytes and then the vector's, as one binary that costs little on its way to a block.

    The hyperplanes of a vector's length are drawn from the seed and the length.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        weight = 1 << np.arange(bits, dtype=np.int64)
        for batch in batches:
            vec = batch.column(2).to_numpy(zero_copy_only=False)
            size = np.array([len(v) for v in vec])
            keys = np.empty((len(vec), tables), dtype=np.int32)
            for d in np.unique(size):
                if d not in planes:
                    planes[d] = np.random.default_rng([seed, int(d)]).standard_normal((int(d), bits * tables))
                of = np.flatnonzero(size == d)
                side = _unit(np.stack(vec[of])) @ planes[d] > 0
                keys[of] = side.reshape(len(of), tables, bits) @ weight
            rows = pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), tables).cast(pa.list_(pa.int32()))
            packed = pa.array([k.tobytes() + v.tobytes() for k, v in zip(keys, vec)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, rows, packed], ["id", "copies", "vec", "keys", "packed"])

    vec = distinct.schema["vec"].dataType.simpleString()
    return distinct.select("id", "copies", "vec").mapInArrow(sign, f"id long, copies long, vec {vec}, keys array<int>, packed binary")


def _placed(signed: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns per table: t, dim and key are the bucket."""
    return signed.select(*keep, F.size("vec").alias("dim"), F.posexplode("keys").alias("t", "key"))


_BUCKET = ["t", "dim", "key"]


def cores(signed: DataFrame, cosine: float, block: int) -> DataFrame:
    """(id, core) of the vectors near the mean direction of a bucket of more than ``block``.

    All members of a core link with one another. Of several cores the one of the smallest
    bucket holds a vector. ``core`` is the bucket as text.
    """
    # written, so that Spark knows its size and broadcasts it only if it is small
    hot = cut(_placed(signed).groupBy(*_BUCKET).count().where(F.col("count") > block).select(*_BUCKET), "vectors-hot")
    members = _placed(signed, "id", "vec").join(hot, _BUCKET)
    unit = F.transform("vec", lambda x: x / F.col("norm"))
    members = members.withColumn("norm", F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x)))
    members = members.select(*_BUCKET, "id", unit.alias("unit"))
    sums = members.select(*_BUCKET, F.posexplode("unit").alias("i", "x")).groupBy(*_BUCKET, "i").agg(F.sum("x").alias("x"))
    mean = sums.groupBy(*_BUCKET).agg(F.sort_array(F.collect_list(F.struct("i", "x")))["x"].alias("mean"))
    mean = mean.withColumn("length", F.sqrt(F.aggregate("mean", F.lit(0.0), lambda s, x: s + x * x))).where("length > 0")
    dot = F.aggregate(F.zip_with("unit", "mean", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    near = math.cos(math.acos(cosine) / 2 - _MARGIN)
    inside = members.join(mean, _BUCKET).where(dot >= near * F.col("length"))
    return inside.groupBy("id").agg(F.min(F.struct(*_BUCKET)).cast("string").alias("core"))


def _dealt(signed: DataFrame, block: int) -> DataFrame:
    """The rows of every pair of blocks to compare: bucket, lo and hi (blocks), own (the row's block).

    A bucket's vectors are dealt into blocks, those of a core apart from the others. All pairs of
    blocks are compared, but for those within one core. Blocks of a pair have ``block`` rows each, about.
    """
    placed = _placed(signed, "id", "core")
    parts = placed.groupBy(*_BUCKET, "core").agg(F.count("*").alias("n"))
    parts = parts.withColumn("blocks", F.ceil(F.col("n") / block))
    # one row per bucket: its parts in order, with the first block of each
    whole = parts.groupBy(*_BUCKET).agg(
        F.sum("n").alias("n"), F.sum("blocks").alias("all"),
        F.sort_array(F.collect_list(F.struct(F.coalesce("core", F.lit("")).alias("core"), "blocks"))).alias("parts"),
    )
    before = lambda ps, i: F.aggregate(F.slice(ps, 1, i), F.lit(0).cast("long"), lambda s, p: s + p["blocks"])
    first = F.transform("parts", lambda p, i: F.struct(p["core"].alias("core"), p["blocks"].alias("blocks"), before(F.col("parts"), i).alias("first")))
    parts = whole.where("n > 1").select(*_BUCKET, "all", F.inline(first))
    # a bucket of nothing but one core has no pair left
    parts = cut(parts.where((F.col("core") == "") | (F.col("all") > F.col("blocks"))), "vectors-parts")
    rows = _placed(signed, "id", "copies", "packed", F.coalesce("core", F.lit("")).alias("core"))
    rows = rows.join(parts, [*_BUCKET, "core"])
    own = (F.col("first") + F.pmod(F.xxhash64("id"), F.col("blocks"))).alias("own")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("all") - 1)).alias("other")
    rows = rows.select(*_BUCKET, "core", "first", "blocks", "id", "copies", "packed", own, "all").select("*", other)
    same = (F.col("core") != "") & F.col("other").between(F.col("first"), F.col("first") + F.col("blocks") - 1)
    return rows.where(~same).select(
        *_BUCKET, F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "id", "copies", "packed"
    )


class _Forest:
    """Spanning forest of links that come in batches of pairs."""

    def __init__(self, n: int):
        self.root = np.arange(n)
        self.links: list[np.ndarray] = []

    def _flat(self) -> None:
        while True:
            up = self.root[self.root]
            if (up == self.root).all():
                return
            self.root = up

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        """A round hangs every root under its smallest neighbour; pairs that are joined drop out."""
        while True:
            p, q = self.root[i], self.root[j]
            open_ = p != q
            if not open_.any():
                return
            i, j, p, q = i[open_], j[open_], p[open_], q[open_]
            high, low = np.maximum(p, q), np.minimum(p, q)
            order = np.lexsort((low, high))
            first = order[np.concatenate([[True], high[order][1:] != high[order][:-1]])]
            self.root[high[first]] = low[first]
            self.links.append(np.column_stack([i[first], j[first]]))
            self._flat()


def compare(part: pd.DataFrame, cosine: float, tables: int, dtype: str) -> pd.DataFrame:
    """Sums of linked copies per vector (id, 0, n) and a spanning forest (a, b, 0) of one pair of blocks."""
    t, lo, hi = int(part["t"].iloc[0]), part["lo"].iloc[0], part["hi"].iloc[0]
    ids, copies, own = (part[c].to_numpy() for c in ("id", "copies", "own"))
    packed = np.frombuffer(b"".join(part["packed"]), np.uint8).reshape(len(ids), -1)
    keys = np.ascontiguousarray(packed[:, : 4 * tables]).view(np.int32)[:, :t]
    units = _unit(np.ascontiguousarray(packed[:, 4 * tables :]).view(dtype))
    left = np.flatnonzero(own == lo)
    right = left if lo == hi else np.flatnonzero(own == hi)
    forest, n = _Forest(len(ids)), np.zeros(len(ids), dtype=np.int64)
    for k in range(0, len(left), _STEP):
        rows = left[k : k + _STEP]
        later = right[k:] if lo == hi else right  # within a block, pairs of a row and a later one
        i, j = np.nonzero(units[rows] @ units[later].T >= cosine)
        if lo == hi:
            i, j = i[j > i], j[j > i]
        i, j = rows[i], later[j]
        if t:  # a pair that met in an earlier table counted there
            new = ~(keys[i] == keys[j]).any(axis=1)
            i, j = i[new], j[new]
        np.add.at(n, i, copies[j])
        np.add.at(n, j, copies[i])
        forest.add(i, j)
    links = np.concatenate([*forest.links, np.empty((0, 2), dtype=np.int64)])
    some = np.flatnonzero(n)
    return pd.DataFrame(
        {
            "a": np.concatenate([ids[some], ids[links[:, 0]]]),
            "b": np.concatenate([np.zeros(len(some), np.int64), ids[links[:, 1]]]),
            "n": np.concatenate([n[some], np.zeros(len(links), np.int64)]),
        }
    )


def neighbours(
    distinct: DataFrame, cosine: float = COSINE, recall: float = RECALL, bucket: int = BUCKET, block: int = BLOCK
) -> DataFrame:
    """(id, root, n) per row of ``distinct`` (id, copies, vec; written): its component and its linked copies."""
    bits, tables = plan(distinct.count(), cosine, recall, bucket)
    signed = cut(keyed(distinct, bits, tables), "vectors-keys")
    core = cut(cores(signed, cosine, block), "vectors-cores")
    signed = signed.join(core, "id", "left")

    dtype = "<f4" if distinct.schema["vec"].dataType.elementType.typeName() == "float" else "<f8"

    def one(part: pd.DataFrame) -> pd.DataFrame:
        return compare(part, cosine, tables, dtype)

    met = cut(_dealt(signed, block).groupBy(*_BUCKET, "lo", "hi").applyInPandas(one, "a long, b long, n long"), "vectors-met")
    counted = met.where("n > 0").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("met"))
    # a core's members hang under one of them
    whole = signed.where("core is not null").groupBy("core").agg(F.min("id").alias("b"), F.sum("copies").alias("near"))
    stars = signed.select("id", "core").join(whole, "core").select(F.col("id").alias("a"), "b")
    roots = components(met.where("n = 0").select("a", "b").unionByName(stars), "a", "b", "vectors")
    rows = signed.select("id", "copies", "core").join(counted, "id", "left").join(whole.drop("b"), "core", "left")
    rows = rows.join(roots.withColumnRenamed("node", "id"), "id", "left")
    links = F.coalesce("near", "copies") - 1 + F.coalesce("met", F.lit(0))
    return rows.select("id", F.coalesce("root", "id").alias("root"), links.alias("n"))


def linked(
    table: DataFrame, vec: str = "embedding", cosine: float = COSINE, recall: float = RECALL, bucket: int = BUCKET, block: int = BLOCK
) -> DataFrame:
    """One row per row of ``table``: vec_id, n_links, component_id, kept."""
    rows = table.select(F.col("vec_id"), F.col(f"`{vec}`").alias("vec"))
    if rows.schema["vec"].dataType.elementType.typeName() not in ("float", "double"):
        rows = rows.withColumn("vec", F.col("vec").cast("array<double>"))
    good = rows.where(usable(F.col("vec")))
    distinct = good.groupBy("vec").agg(F.count("*").alias("copies"), F.min("vec_id").alias("first"))
    distinct = cut(distinct.withColumn("id", F.monotonically_increasing_id()), "vectors-distinct")
    near = cut(neighbours(distinct, cosine, recall, bucket, block), "vectors-near")
    tree = distinct.select("id", "vec", "first").join(near, "id")
    best = tree.groupBy("root").agg(F.min("first").alias("component_id"))
    known = tree.join(best, "root").select("vec", "n", F.col("component_id"), F.lit(True).alias("known"))
    out = rows.join(known, "vec", "left")
    component = F.when(F.col("known"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select(
        "vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )


def op12_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
