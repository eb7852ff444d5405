"""SimHash near-dedup with a vantage-point tree over the fingerprints.

Texts become 64-bit SimHash fingerprints of their word shingles. Only distinct
fingerprints go on. A tree of vantage points, fitted on a bounded sample of them
(``SAMPLE``), cuts the Hamming space into shards: at a node, fingerprints nearer to the
vantage point than the node's radius go inside, the rest outside. By the triangle
inequality a pair within ``bits`` can be parted only if its inner end lies within ``bits``
of the radius, so those inner fingerprints are also sent outside: every pair within
``bits`` meets in at least one shard and no shard needs another. In its shard the same
rule is applied further down, with vantage points out of the shard, and small leaves are
compared exactly by XOR and popcount. A shard returns a spanning forest of its links, not
all pairs, and distributed union-find joins the forests.

Bounded memory: a shard holds about ``SHARD`` fingerprints (8 bytes each) by the tree's
sample, a leaf's comparison works in blocks, and the tree broadcast has at most
``SAMPLE / 64`` nodes. A fingerprint shared by a third of all documents is one row after a
map-side aggregate.

Defined cases: null and empty texts (and texts without words) have fingerprint zero and
link like any other; texts of fewer words than a shingle are one shingle; rows repeated
exactly or with equal ``doc_id`` share a component when their fingerprints link, and only
then; null ``doc_id`` is a component's id only if no other member has one, and each such
component keeps a row; an empty table gives an empty result; extra columns are ignored by :func:`fingerprints` and
carried by :func:`dedup`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.llm.common import cut, documents
from revlens.llm.components import components

SHINGLE = 3
BITS = 2
SEED = 42
#: Fingerprints the tree is fitted on, at most; and fingerprints aimed at in a shard.
SAMPLE = 65_536
SHARD = 16_384
LEAF = 512

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def simhash(text: str | None, shingle: int = SHINGLE) -> int:
    """Fingerprint of one text as an unsigned 64-bit number."""
    # bytes.split() parts at exactly the six ASCII blanks of the word rule
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    stops = ends[shingle - 1 :].tolist()
    starts = [0, *(ends[: len(stops) - 1] + 1).tolist()]
    digest = xxhash.xxh64_digest  # big-endian bytes
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(stops), 1 << 14):
        part = b"".join([digest(joined[i:j], SEED) for i, j in zip(starts[at : at + (1 << 14)], stops[at : at + (1 << 14)])])
        counts += np.unpackbits(np.frombuffer(part, dtype=np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(stops)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, text: str = "text", *keep: str) -> DataFrame:
    """``keep`` columns (default doc_id) and ``__fp``: the fingerprint as a signed long."""

    @F.pandas_udf("long")
    def fp(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield pd.Series(np.array([simhash(x, shingle) for x in s], dtype=np.uint64).astype(np.int64))

    return docs.select(*(keep or ("doc_id",)), fp(F.col(f"`{text}`")).alias("__fp"))


def _distance(points: np.ndarray, vantage: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ vantage)


def _split(points: np.ndarray, bits: int) -> tuple[np.uint64, int] | None:
    """A vantage point and radius (inside: nearer than it) that part the points with little overlap.

    A few of the points are tried, and for each the radii around the middle of its distances;
    the lightest larger side wins. None if no choice leaves both sides smaller than the whole.
    """
    best = None
    for v in np.unique(points[np.linspace(0, len(points) - 1, 6).astype(int)]):
        count = np.bincount(_distance(points, v), minlength=65)
        below = np.concatenate([[0], np.cumsum(count)])  # below[r]: points nearer than r
        for r in range(1, 65):
            inner, outer = below[r], len(points) - below[r] + (below[r] - below[max(0, r - bits)])
            if inner and outer < len(points):
                cost = max(inner, outer) + 0.5 * (inner + outer - len(points))
                if best is None or cost < best[0]:
                    best = (cost, v, r)
    return None if best is None or best[0] > 0.95 * len(points) else (best[1], best[2])


def fit_tree(sample: np.ndarray, total: int, bits: int = BITS, shard: int = SHARD) -> list[tuple[int, int, int, int]]:
    """Nodes (vantage, radius, inside, outside); a child below 0 is the shard ``-1 - child``."""
    nodes: list[tuple[int, int, int, int]] = []
    leaves = 0

    def grow(points: np.ndarray) -> int:
        nonlocal leaves
        cutting = _split(points, bits) if len(points) >= 64 and len(points) * (total / max(1, len(sample))) > shard else None
        if cutting is None:
            leaves += 1
            return -leaves
        v, r = cutting
        at = len(nodes)
        nodes.append((int(v), r, 0, 0))
        d = _distance(points, v)
        nodes[at] = (int(v), r, grow(points[d < r]), grow(points[d >= r - bits]))
        return at

    root = grow(np.unique(sample))
    return nodes if root >= 0 else []


def shards_of(points: np.ndarray, nodes: list[tuple[int, int, int, int]], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Every (position of a point, shard) the tree sends it to."""
    if not nodes:
        return np.arange(len(points)), np.zeros(len(points), dtype=np.int64)
    todo, at, to = [(0, np.arange(len(points)))], [], []
    while todo:
        k, rows = todo.pop()
        v, r, inside, outside = nodes[k]
        d = _distance(points[rows], np.uint64(v))
        for child, part in ((inside, rows[d < r]), (outside, rows[d >= r - bits])):
            if not len(part):
                continue
            if child >= 0:
                todo.append((child, part))
            else:
                at.append(part)
                to.append(np.full(len(part), -1 - child, dtype=np.int64))
    return np.concatenate(at), np.concatenate(to)


def forest(points: np.ndarray, bits: int = BITS) -> list[tuple[int, int]]:
    """Links of a spanning forest over all pairs of the (distinct) points within ``bits``."""
    root = np.arange(len(points))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    links: list[tuple[int, int]] = []

    def compare(rows: np.ndarray) -> None:
        x = points[rows]
        for k in range(0, len(rows), LEAF):
            d = np.bitwise_count(x[k : k + LEAF, None] ^ x[None, k:])
            i, j = np.nonzero(d <= bits)
            for a, b in zip((i + k)[j > i].tolist(), (j + k)[j > i].tolist()):
                p, q = find(rows[a]), find(rows[b])
                if p != q:
                    root[max(p, q)] = min(p, q)
                    links.append((int(rows[a]), int(rows[b])))

    todo = [np.arange(len(points))]
    while todo:
        rows = todo.pop()
        cutting = _split(points[rows], bits) if len(rows) > LEAF else None
        if cutting is None:
            compare(rows)
            continue
        v, r = cutting
        d = _distance(points[rows], v)
        todo += [rows[d < r], rows[d >= r - bits]]
    return links


def linked(distinct: DataFrame, bits: int = BITS, sample: int = SAMPLE, shard: int = SHARD) -> DataFrame:
    """Links (a, b) that join all fingerprints (column ``__fp``, distinct, written) within ``bits``."""
    total = distinct.count()
    few = distinct if total <= sample else distinct.sample(0.9 * sample / total, seed=SEED)
    points = np.array([r[0] for r in few.limit(sample).collect()], dtype=np.int64).view(np.uint64)
    nodes = fit_tree(points, total, bits, shard)
    spark = distinct.sparkSession
    tree = spark.sparkContext.broadcast(nodes)

    def route(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            fp = p["__fp"].to_numpy()
            at, to = shards_of(fp.view(np.uint64), tree.value, bits)
            yield pd.DataFrame({"shard": to, "__fp": fp[at]})

    def pairs(part: pd.DataFrame) -> pd.DataFrame:
        points = part["__fp"].to_numpy().view(np.uint64)
        links = np.array(forest(points, bits), dtype=np.int64).reshape(-1, 2)
        signed = points.view(np.int64)
        return pd.DataFrame({"a": signed[links[:, 0]], "b": signed[links[:, 1]]})

    routed = distinct.mapInPandas(route, "shard long, __fp long")
    return routed.groupBy("shard").applyInPandas(pairs, "a long, b long")


def classes(prints: DataFrame, bits: int = BITS) -> DataFrame:
    """(__fp, root, component_id) for a table of (doc_id, __fp): the component's root fingerprint
    and the smallest doc_id reachable by links (null if no member has one)."""
    per = cut(prints.groupBy("__fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    # parent links are kept on the smallest doc_id, so a component's root is a document
    roots = components(linked(per.select("__fp"), bits), "a", "b", "simhash")
    tree = per.join(roots, per["__fp"] == roots["node"], "left").select(
        "__fp", "first", F.coalesce("root", "__fp").alias("root")
    )
    best = tree.groupBy("root").agg(F.min("first").alias("component_id"))
    return tree.join(best, "root").select("__fp", "root", "component_id")


def cluster(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """One row per document: doc_id, fingerprint, component_id."""
    prints = cut(fingerprints(docs, shingle), "simhash-prints")
    hexed = F.lower(F.lpad(F.hex("__fp"), 16, "0"))
    return prints.join(classes(prints, bits), "__fp").select("doc_id", hexed.alias("fingerprint"), "component_id")


def dedup(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """The documents with one of each component: its smallest doc_id, or null if it has none
    (of several rows with that id, one), all columns kept."""
    names = docs.columns
    tagged = docs.withColumns({f"__{i}": F.col(f"`{c}`") for i, c in enumerate(names)}).select(
        *[f"__{i}" for i in range(len(names))], F.col("doc_id").alias("__doc"), F.col("text").alias("__text")
    )
    prints = cut(fingerprints(tagged, shingle, "__text", *[f"__{i}" for i in range(len(names))], "__doc"), "simhash-docs")
    best = classes(prints.select(F.col("__doc").alias("doc_id"), "__fp"), bits)
    best = best.select(F.col("__fp").alias("__key"), F.col("root").alias("__root"), "component_id")
    whole = F.struct(*[f"__{i}" for i in range(len(names))])
    first = F.col("__doc").eqNullSafe(F.col("component_id"))
    kept = prints.join(best, F.col("__fp") == F.col("__key")).where(first)
    # by root, not by component_id: components without any doc_id, or with unlike texts of one
    # doc_id, are apart; repeated rows of the chosen doc_id: the largest in column order stays
    rows = kept.groupBy("__root").agg(F.max(whole).alias("row"))
    return rows.select(*[F.col("row")[f"__{i}"].alias(c) for i, c in enumerate(names)])


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(documents(spark, sf_dir))
