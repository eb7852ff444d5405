"""Whitening of embeddings by mixed-precision eigenvectors of a distributed covariance.

Vectors are put on a grid of whole numbers (:func:`on_grid`) and each distinct grid vector is
one entry of the fit list. Spark sums the entries, then the products of the entries centred
on the rounded mean; all sums are whole numbers and exact, so the covariance does not depend
on partitions, retries or order. Only its ``d * d`` numbers (``d``: the vectors' length) reach
the driver, where :func:`eigen` finds the eigenvectors in float32 and refines them by
Ogita-Aishima iterations, i.e. matrix products in higher precision: float64 until it no
longer helps, then extended precision where the machine has it. Eigenvalues closer than the
iteration can part are a cluster; each cluster is solved anew in its own subspace, shifted
by its mean. :func:`apply` projects the rows, and :func:`identity_error` measures the covariance
of what came out, again over the whole fit list.

Defined cases: vectors that are null, empty or hold null or non-finite entries are dropped, and
so are vectors whose length is not the most frequent one among distinct vectors (of equally
frequent ones the longest); entries beyond 2^40 grid steps count as 2^40. Repeated rows are one
entry of the fit list but rows of the result; an empty table gives an empty result. A component
without variance (constant data, fewer vectors than dimensions) has ``whitened`` null and
explains 0, and the identity is measured without it. Equal eigenvalues share a subspace, in
which any basis is right; the signs make each component's largest entry positive. Sums of
squares beyond a long are null. Other columns are carried by :func:`apply` or ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.llm.common import cut

SCALE = 64
ORIGIN = 1_000_000
COMPONENTS = 16
#: Grid steps from zero, at most.
_FAR = 1 << 40
#: Whole numbers up to here are exact in float64.
_EXACT = 1 << 53
_LONG = (1 << 63) - 1


def on_grid(vec: Column, scale: int = SCALE) -> Column:
    """floor(scale * entry) as longs; null where the vector can't be used."""
    finite = F.forall(vec, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    step = lambda c: F.floor(F.greatest(F.least(c.cast("double") * scale, F.lit(float(_FAR))), F.lit(float(-_FAR))))
    return F.when(F.coalesce(finite & (F.size(vec) > 0), F.lit(False)), F.transform(vec, step))


@dataclass
class Fit:
    """What whitening needs to know of the fit list; grid vectors are without ORIGIN here."""

    n: int
    sums: list[int]
    values: np.ndarray  # eigenvalues of all components, falling
    vectors: np.ndarray  # unit eigenvectors in columns, same order

    @property
    def dim(self) -> int:
        return len(self.sums)

    @property
    def explained(self) -> np.ndarray:
        whole = self.values.sum()
        return self.values / whole if whole > 0 else np.zeros_like(self.values)

    def live(self, k: int) -> np.ndarray:
        """Which of the first k components have variance."""
        return self.values[:k] > 64 * np.finfo(np.float64).eps * max(self.values[0], 0.0) if self.dim else np.zeros(0, bool)

    def projection(self, k: int) -> np.ndarray:
        """Columns by which a centred grid vector is whitened (zero for components without variance)."""
        live = self.live(k)
        return self.vectors[:, :k] / np.sqrt(np.where(live, self.values[:k], 1.0)) * live


def _grids(batch: pa.RecordBatch, column: int, dim: int) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _rows(matrix: np.ndarray) -> pa.RecordBatch:
    """Rows (i, j, x) of a matrix of Python whole numbers, its upper half if it is square."""
    i, j = np.triu_indices(len(matrix)) if matrix.shape[0] == matrix.shape[1] else np.indices(matrix.shape).reshape(2, -1)
    x = pa.array([Decimal(int(v)) for v in matrix[i, j]], pa.decimal128(38, 0))
    return pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), x], ["i", "j", "x"])


def _summed(parts: DataFrame) -> dict[tuple[int, int], int]:
    rows = parts.groupBy("i", "j").agg(F.sum("x").alias("x")).collect()
    return {(r.i, r.j): int(r.x) for r in rows}


def _moments(entries: DataFrame, dim: int) -> tuple[int, list[int], np.ndarray]:
    """n, the sums and the covariance (extended precision) of the grid vectors ``x`` of length ``dim``."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(dim, dtype=object)
        for batch in batches:
            x = _grids(batch, 0, dim)
            n, total = n + len(x), total + x.sum(axis=0).astype(object)
        yield _rows(np.append(total, n)[None, :])

    schema = "i int, j int, x decimal(38,0)"
    found = _summed(entries.select("x").mapInArrow(sums, schema))
    n, total = found.get((0, dim), 0), [found.get((0, j), 0) for j in range(dim)]
    centre = np.array([(2 * s + n) // (2 * n) for s in total], dtype=np.int64)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = np.zeros((dim, dim), dtype=object)
        for batch in batches:
            y = _grids(batch, 0, dim) - centre
            top = int(np.abs(y).max(initial=1))
            # so many rows at a time that float64 sums of products stay exact, if one product does
            step = max(1, min(len(y), _EXACT // (top * top)))
            exact = top * top <= _EXACT
            for k in range(0, len(y), step):
                part = y[k : k + step].astype(np.float64 if exact else object)
                sums = part.T @ part
                gram += sums.astype(np.int64).astype(object) if exact else sums
        yield _rows(gram)

    found = _summed(entries.select("x").mapInArrow(products, schema))
    off = [s - n * int(c) for s, c in zip(total, centre)]  # sums of the centred entries
    cov = np.zeros((dim, dim), dtype=np.longdouble)
    for (i, j), g in found.items():
        whole, rest = divmod(n * g - off[i] * off[j], n * n)
        cov[i, j] = cov[j, i] = np.longdouble(whole) + np.longdouble(rest) / np.longdouble(n * n)
    return n, total, cov


def _clusters(values: np.ndarray, gap: float) -> list[np.ndarray]:
    """Runs of the eigenvalues (in any order) whose neighbours lie within ``gap``: two or more each."""
    order = np.argsort(values)
    runs = np.split(order, np.flatnonzero(np.diff(values[order]) > gap) + 1)
    return [r for r in runs if len(r) > 1]


def _refined(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """One Ogita-Aishima step in the precision of ``a``: better vectors, values and the correction's size."""
    one = np.eye(len(a), dtype=a.dtype)
    r = one - x.T @ x
    s = x.T @ a @ x
    value = np.diag(s) / (1 - np.diag(r))
    off = s - np.diag(value)
    gap = 2 * (np.sqrt((off * off).sum()) + np.abs(value).max() * np.sqrt((r * r).sum()))  # Frobenius: never below the 2-norm
    apart = value[None, :] - value[:, None]
    far = np.abs(apart) > gap
    e = np.where(far, (s + value[None, :] * r) / np.where(far, apart, 1), r / 2)
    x = x + x @ e
    for run in _clusters(value, float(gap)):
        # the cluster's own problem, shifted by its mean: its small differences come out in full
        q = x[:, run]
        mid = value[run].mean()
        inner = q.T @ (a @ q - mid * q)
        inner = (inner + inner.T) / 2
        x[:, run] = q @ np.linalg.eigh(inner.astype(np.float64))[1].astype(a.dtype)
    return x, value, float(np.abs(e).max(initial=0))


def eigen(cov: np.ndarray, steps: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors (columns) of a symmetric matrix, to double precision."""
    scale = np.abs(cov).max(initial=0)
    if not scale > 0:
        return np.zeros(len(cov)), np.eye(len(cov))
    wide = cov / scale
    x = np.linalg.eigh(wide.astype(np.float32))[1].astype(np.float64)
    for dtype in (np.float64, np.longdouble):
        a, x, last = wide.astype(dtype), x.astype(dtype), np.inf
        for _ in range(steps):
            x, value, size = _refined(a, x)
            if size <= 4 * np.finfo(dtype).eps or size >= last / 2 and size < 1e-9:
                break
            last = size
    for _ in range(2):  # orthogonal to the last digit, also where tiny gaps make corrections large
        x = (3 * x - x @ (x.T @ x)) / 2
    value = np.einsum("ij,ij->j", x, a @ x)
    order = np.argsort(-value, kind="stable")
    x, value = x[:, order], np.maximum(value[order], 0) * scale
    x = x * np.where(x[np.abs(x).argmax(axis=0), np.arange(len(x))] < 0, -1, 1)
    return value.astype(np.float64), x.astype(np.float64)


def fit(entries: DataFrame) -> Fit:
    """Fit on a table of distinct grid vectors ``x`` of one length (written; may be empty)."""
    first = entries.select(F.size("x").alias("d")).first()
    if first is None:
        return Fit(0, [], np.zeros(0), np.zeros((0, 0)))
    n, sums, cov = _moments(entries, first["d"])
    return Fit(n, sums, *eigen(cov))


def _centred(x: np.ndarray, model: Fit) -> np.ndarray:
    mean = [divmod(s, model.n) for s in model.sums]
    whole = np.array([w for w, _ in mean], dtype=np.int64)
    rest = np.array([r / model.n for _, r in mean])
    return (x - whole) - rest  # whole numbers first: nothing cancels


def identity_error(entries: DataFrame, model: Fit, k: int = COMPONENTS) -> float:
    """Largest absolute entry of the whitened fit list's covariance minus the identity."""
    k = min(k, model.dim)
    live = np.flatnonzero(model.live(k))
    if not len(live):
        return 0.0
    dim, by = model.dim, model.projection(k)[:, live]

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, gram = np.zeros(len(live)), np.zeros((len(live), len(live)))
        for batch in batches:
            w = _centred(_grids(batch, 0, dim), model) @ by
            total, gram = total + w.sum(axis=0), gram + w.T @ w
        both = np.vstack([total, gram])
        i, j = np.indices(both.shape).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(both.ravel())], ["i", "j", "x"])

    rows = entries.select("x").mapInArrow(products, "i int, j int, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).collect()
    both = np.zeros((len(live) + 1, len(live)))
    for r in rows:
        both[r.i, r.j] = r.x / model.n
    return float(np.abs(both[1:] - np.outer(both[0], both[0]) - np.eye(len(live))).max())


def _deviation(x: np.ndarray, model: Fit) -> pa.Array:
    """Sum over dimensions of (n * x - S)^2, exact; null beyond a long."""
    reach = max((abs(s) for s in model.sums), default=0) + model.n * int(np.abs(x).max(initial=0))
    if reach * reach * max(1, model.dim) <= _LONG:
        off = x * model.n - np.array(model.sums, dtype=np.int64)
        return pa.array((off * off).sum(axis=1))
    off = x.astype(object) * model.n - np.array(model.sums, dtype=object)
    if int(np.abs(off).max()) ** 2 * model.dim <= _LONG:
        return pa.array((off.astype(np.int64) ** 2).sum(axis=1))
    return pa.array([v if v <= _LONG else None for v in (off * off).sum(axis=1)], pa.int64())


def apply(rows: DataFrame, model: Fit, k: int = COMPONENTS) -> DataFrame:
    """``rows`` (last column ``x``: grid vectors) with deviation and whitened (array of k numbers)."""
    k = min(k, model.dim)
    by, live = model.projection(k), model.live(k)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _grids(batch, batch.num_columns - 1, model.dim)
            w = _centred(x, model) @ by
            flat = pa.array(w.ravel(), mask=np.broadcast_to(~live, w.shape).ravel())
            lists = pa.FixedSizeListArray.from_arrays(flat, k).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, _deviation(x, model), lists], [*batch.schema.names, "deviation", "whitened"]
            )

    return rows.mapInArrow(project, f"{schema}, deviation long, whitened array<double>")


def whiten(table: DataFrame, vec: str = "embedding", k: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """One row per usable row of ``table`` and component: vec_id, component, n, deviation, whitened,
    explained, identity_error."""
    rows = table.select(F.col("vec_id"), on_grid(F.col(f"`{vec}`"), scale).alias("x")).where("x is not null")
    every = cut(rows.select("x").distinct(), "whitening-fit")
    sizes = every.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d"))
    main = sizes.first()
    dim = main["d"] if main else 0
    entries = every.where(F.size("x") == dim)
    model = fit(entries)
    error = identity_error(entries, model, k)
    out = apply(rows.where(F.size("x") == dim), model, k) if dim else rows.select(
        "*", F.lit(0).cast("long").alias("deviation"), F.array().cast("array<double>").alias("whitened")
    )
    explained = F.array(*[F.lit(float(v)) for v in model.explained[:k]]).cast("array<double>")
    out = out.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return out.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"),
    )


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
