"""Packing documents into windows by non-negative least squares.

Each document's ids are followed by an end id and cut into whole windows and a tail. Tail
lengths, rounded up to ``UNIT``, give a small histogram. All combinations of at most
``DEPTH`` lengths that fill a window exactly are enumerated, non-negative least squares
finds how often to use each so that the histogram is used up, the counts are rounded down
to what the histogram holds, and the tails left over are packed greedily: laid end to end
and cut at the windows' borders.

Only the histogram (``window / UNIT`` numbers) and one total per histogram bin reach the
driver. Which tail takes which place is decided by its rank in its bin; ranks come from
windows over (bin, block) with blocks of bounded size and a running sum over the blocks,
so that a bin with a third of all documents is spread over all tasks. Ids are written once
and joined once.

Defined cases: null and empty texts are the end id alone; texts of any length are cut;
rows repeated or with equal ``doc_id`` are packed one by one; null ``doc_id`` is passed
through; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from revlens.llm.common import cut, documents
from revlens.llm.tokens import WORD_BPE, word_encoder

WINDOW = 4096
UNIT = 32
DEPTH = 3
END = 2
BLOCK_ROWS = 50_000


def tokenized(docs: DataFrame, path: str = WORD_BPE, end: int = END) -> DataFrame:
    """doc_id, ids (packed, with the end id) and n per row of ``docs``."""

    def encode(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = word_encoder(path)
        stop = np.array([end], dtype=enc.dtype).tobytes()
        for p in parts:
            ids = [enc(t) + stop for t in p["text"]]
            yield pd.DataFrame({"doc_id": p["doc_id"], "ids": ids, "n": [len(i) // enc.dtype.itemsize for i in ids]})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(encode, f"doc_id {kind}, ids binary, n long")


def combinations(bins: int, depth: int = DEPTH) -> list[tuple[int, ...]]:
    """All multisets of at most ``depth`` numbers from 1..bins that add up to ``bins``, shallow first."""
    found = [(bins,)]
    for d in range(2, depth + 1):
        for head in combinations_with_replacement(range(1, bins), d - 1):
            if (last := bins - sum(head)) >= head[-1]:
                found.append((*head, last))
    return found


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x >= 0 that minimises |ax - b|, by the active set method."""
    n = a.shape[1]
    gram, target = a.T @ a, a.T @ b
    x, free = np.zeros(n), np.zeros(n, dtype=bool)
    limit = 1e-9 * max(1.0, float(np.abs(b).max(initial=0)))
    for _ in range(3 * n):
        w = target - gram @ x
        w[free] = -np.inf
        j = int(np.argmax(w))
        if w[j] <= limit:
            break
        free[j] = True
        while True:
            s = np.zeros(n)
            # the columns in use are independent but for rounding, hence the small ridge
            s[free] = np.linalg.solve(gram[np.ix_(free, free)] + 1e-9 * np.eye(int(free.sum())), target[free])
            low = free & (s <= limit)
            if not low.any():
                x = s
                break
            step = np.min(x[low] / np.maximum(x[low] - s[low], 1e-300))
            x = x + step * (s - x)
            free &= x > limit
            x[~free] = 0
    return x


def solve(histogram: np.ndarray, depth: int = DEPTH) -> list[tuple[tuple[int, ...], int]]:
    """(combination, times) whose use of each bin stays within ``histogram`` (index 0 unused)."""
    bins = len(histogram) - 1
    combos = combinations(bins, depth)
    a = np.zeros((bins, len(combos)))
    for k, c in enumerate(combos):
        for u in c:
            a[u - 1, k] += 1
    x = nnls(a, histogram[1:].astype(float))
    left, used = histogram.copy(), []
    for k in np.argsort(-x, kind="stable"):
        need = np.bincount(combos[k], minlength=len(left))
        times = int(min(np.floor(x[k] + 1e-6), (left[need > 0] // need[need > 0]).min()))
        if times > 0:
            left -= need * times
            used.append((combos[k], times))
    return used


def _before(df: DataFrame, value: str) -> DataFrame:
    """(bin, block, sum of ``value`` in the bin's earlier blocks, and in the bin)."""
    per = df.groupBy("bin", "block").agg(F.sum(value).alias("here"))
    w = Window.partitionBy("bin").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return per.select("bin", "block", F.coalesce(F.sum("here").over(w), F.lit(0)).alias("before"))


def _running(df: DataFrame, value: str, out: str) -> DataFrame:
    """``df`` with ``out`` = sum of ``value`` over the rows of its bin that come before it."""
    w = Window.partitionBy("bin", "block").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    here = df.withColumn(out, F.coalesce(F.sum(value).over(w), F.lit(0)))
    return here.join(_before(df, value), ["bin", "block"]).withColumn(out, F.col(out) + F.col("before")).drop("before")


def places(lengths: DataFrame, window: int = WINDOW, unit: int = UNIT, depth: int = DEPTH) -> DataFrame:
    """Where each row of ``lengths`` (row, n; written) goes: row, first_full, tail_seq, tail_offset.

    Whole windows of a row take the sequences from ``first_full`` on. A tail begins in
    ``tail_seq`` at ``tail_offset`` and runs over into the next sequence if the window ends.
    """
    spark = lengths.sparkSession
    blocks = max(1, -(-lengths.count() // BLOCK_ROWS))
    parts = lengths.select(
        "row",
        F.floor(F.col("n") / window).alias("full"),
        (F.col("n") % window).alias("tail"),
        F.pmod(F.xxhash64("row"), F.lit(blocks)).alias("block"),
    ).withColumn("bin", F.ceil(F.col("tail") / unit))
    one = F.lit(1).cast("long")
    ranked = cut(_running(parts.withColumn("one", one), "one", "rank").drop("one"), "pack-ranks")

    bins = window // unit
    counts = np.zeros(bins + 1, dtype=np.int64)
    for r in ranked.where("bin > 0").groupBy("bin").count().collect():
        counts[r["bin"]] = r["count"]
    used = solve(counts, depth)
    # Ranges of ranks of a bin and the sequences they go to, `per` ranks to a sequence.
    ranges, seq, taken = [], 0, np.zeros(bins + 1, dtype=np.int64)
    for combo, times in used:
        for u, per in zip(*np.unique(combo, return_counts=True)):
            ranges.append((int(u), int(taken[u]), int(taken[u] + per * times), int(per), seq))
            taken[u] += per * times
        seq += times
    table = spark.createDataFrame(ranges, "bin long, lo long, hi long, per long, seq long")
    inside = (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
    tails = ranked.where("bin > 0")
    filled = tails.join(F.broadcast(table), "bin").where(inside)  # at most bins * combinations used
    filled = filled.withColumn("tail_seq", F.col("seq") + F.floor((F.col("rank") - F.col("lo")) / F.col("per")))
    earlier = Window.partitionBy("tail_seq").orderBy("bin", "rank").rowsBetween(Window.unboundedPreceding, -1)
    filled = filled.select("row", "tail_seq", F.coalesce(F.sum("tail").over(earlier), F.lit(0)).alias("tail_offset"))

    first = F.element_at(F.array(*[F.lit(int(t)) for t in taken]), (F.col("bin") + 1).cast("int"))
    rest = _running(tails.where(F.col("rank") >= first), "tail", "at")
    totals = dict(tails.where(F.col("rank") >= first).groupBy("bin").agg(F.sum("tail")).collect())
    starts = np.concatenate([[0], np.cumsum([totals.get(b, 0) for b in range(bins + 1)])])
    start = F.element_at(F.array(*[F.lit(int(s)) for s in starts]), (F.col("bin") + 1).cast("int"))
    rest = rest.withColumn("at", F.col("at") + start).select(
        "row", (F.floor(F.col("at") / window) + seq).alias("tail_seq"), (F.col("at") % window).alias("tail_offset")
    )
    seq += -(-int(starts[-1]) // window)

    whole = ranked.where("full > 0").drop("rank").withColumn("bin", F.lit(0).cast("long"))
    whole = _running(whole, "full", "first_full").select("row", (F.col("first_full") + seq).alias("first_full"))
    return ranked.select("row").join(whole, "row", "left").join(filled.unionByName(rest), "row", "left")


def pack(
    docs: DataFrame, path: str = WORD_BPE, window: int = WINDOW, unit: int = UNIT, depth: int = DEPTH, with_ids: bool = True
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset
    and, with ``with_ids``, the piece's ids (little-endian unsigned 32 bit)."""
    tokens = cut(tokenized(docs, path).withColumn("row", F.monotonically_increasing_id()), "pack-tokens")
    placed = tokens.join(places(tokens.select("row", "n"), window, unit, depth), "row")
    kind = tokens.schema["doc_id"].dataType.simpleString()

    def pieces(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        dtype = word_encoder(path).dtype
        for p in parts:
            rows = []
            for doc, ids, n, full, seq, offset in zip(
                p["doc_id"], p["ids"], p["n"], p["first_full"], p["tail_seq"], p["tail_offset"]
            ):
                ids = np.frombuffer(ids, dtype=dtype).astype("<u4")
                spans = [(k * window, window, int(full) + k, 0) for k in range(n // window)]
                at, left = n - n % window, n % window
                while left:
                    size = min(left, window - int(offset))
                    spans.append((at, size, int(seq), int(offset)))
                    at, left, seq, offset = at + size, left - size, seq + 1, 0
                for start, size, s, o in spans:
                    data = ids[start : start + size].tobytes()
                    rows.append((doc, start, size, zlib.crc32(data), n, s, o, data if with_ids else None))
                if len(rows) >= 2000:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            yield pd.DataFrame(rows, columns=names)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
    out = placed.select("doc_id", "ids", "n", "first_full", "tail_seq", "tail_offset").mapInPandas(
        pieces,
        f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary",
    )
    return out if with_ids else out.drop("ids")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), with_ids=False)
