"""Whitening and embedding near-dedup against numpy."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from revlens.llm import vectors, whitening
from tests.llm import brute

SCHEMA = "vec_id long, embedding array<float>, label int"
AWKWARD = [
    (1001, None, 1),
    (1002, [], 1),
    (1003, [float("nan")] * 12, None),
    (1004, [1.0, None] + [0.5] * 10, 2),
    (1005, [float("inf")] + [1.0] * 11, 2),
    (1006, [0.0] * 12, 3),
    (None, None, None),
]


def table(spark, rows, clash=True):
    df = spark.createDataFrame(rows, SCHEMA)
    if clash:
        names = ("id", "x", "vec", "keys", "packed", "key", "t", "n", "core", "root", "copies", "own", "deviation", "whitened", "first", "known")
        df = df.select("*", *[F.lit(f"extra-{c}").alias(c) for c in names])
    return df.repartition(4)


def cloud(seed=1, dim=12):
    """Spread vectors, a tight group, a chain, exact copies, a negative and a scaled copy, repeated rows."""
    r = np.random.default_rng(seed)
    spread = r.standard_normal((150, dim))
    hot = r.standard_normal(dim)
    tight = hot + 0.02 * r.standard_normal((60, dim))
    chain, step = [np.eye(dim)[0]], 0.28  # neighbours link, cos(0.28) = 0.961; the ends do not
    for k in range(1, 12):
        chain.append(math.cos(step * k) * np.eye(dim)[0] + math.sin(step * k) * np.eye(dim)[1])
    loose = hot + 0.11 * r.standard_normal((40, dim)) * np.linalg.norm(hot) / math.sqrt(dim)
    every = np.vstack([spread, tight, chain, loose, spread[:5], spread[:1], -spread[5:6], 3 * spread[6:7]]).astype(np.float32)
    rows = [(i, v.tolist(), i % 10) for i, v in enumerate(every)]
    return rows + [rows[3], rows[3], (None, rows[4][1], None), (2, rows[70][1], None)]


def link_all(rows, cosine=0.95):
    """(vec_id, n_links, component_id, kept) per row by all pairs."""
    units = []
    for _, v, _ in rows:
        good = v and all(x is not None and math.isfinite(x) for x in v) and any(v)
        units.append(np.array(v, dtype=np.float64) / np.linalg.norm(np.array(v, dtype=np.float64)) if good else None)
    n, pairs = [0] * len(rows), []
    for i, u in enumerate(units):
        for j in range(i):
            if u is not None and units[j] is not None and len(u) == len(units[j]) and u @ units[j] >= cosine:
                n[i] += 1
                n[j] += 1
                pairs.append((j, i))
    root, best = brute.components(range(len(rows)), pairs), {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            best[root[i]] = min(best.get(root[i], r[0]), r[0])
    return [(r[0], n[i], best.get(root[i]), r[0] == best.get(root[i])) for i, r in enumerate(rows)]


def same(got, want):
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("block, bucket", [(vectors.BLOCK, vectors.BUCKET), (20, 8), (7, 4)])
def test_links_equal_all_pairs(spark, block, bucket):
    rows = cloud() + AWKWARD + [(2000, [1.0, 2.0], 1), (2001, [1.0, 2.0001], 1)]
    got = vectors.linked(table(spark, rows), recall=0.9999999, bucket=bucket, block=block).collect()
    same([(r.vec_id, r.n_links, r.component_id, r.kept) for r in got], link_all(rows))


def test_a_hot_group_is_a_core_and_makes_no_pairs_of_blocks(spark):
    r = np.random.default_rng(3)
    hot = r.standard_normal(12)
    rows = [(i, (hot + 0.01 * r.standard_normal(12)).tolist(), 0) for i in range(300)]
    distinct = table(spark, rows, False).select(F.col("vec_id").alias("id"), F.lit(1).cast("long").alias("copies"), F.col("embedding").alias("vec"))
    signed = vectors.keyed(distinct, 4, 8).cache()
    core = vectors.cores(signed, 0.95, 50)
    assert core.count() == 300 and core.select("core").distinct().count() == 1
    assert vectors._dealt(signed.join(core, "id", "left"), 50).count() == 0
    got = vectors.linked(table(spark, rows), block=50).collect()
    assert {(x.n_links, x.component_id) for x in got} == {(299, 0)}


def test_blocks_of_a_bucket_stay_below_their_size(spark):
    r = np.random.default_rng(4)
    rows = [(i, r.standard_normal(6).tolist(), 0) for i in range(600)]
    distinct = table(spark, rows, False).select(F.col("vec_id").alias("id"), F.lit(1).cast("long").alias("copies"), F.col("embedding").alias("vec"))
    signed = vectors.keyed(distinct, 4, 3).withColumn("core", F.lit(None).cast("string"))
    tasks = vectors._dealt(signed, 10).groupBy("t", "dim", "key", "lo", "hi").count()
    assert tasks.agg(F.max("count")).first()[0] <= 2 * 2 * 10


def test_plan_keeps_the_recall_at_every_size():
    for n in (0, 1, 500, 10**4, 10**6, 10**9):
        bits, tables = vectors.plan(n)
        meet = (1 - math.acos(0.95) / math.pi) ** bits
        assert bits >= 4 and 1 - (1 - meet) ** tables >= vectors.RECALL


def test_recall_on_the_given_table():
    """The tables of ``plan`` find at least 0.9 of the pairs at the threshold (brute force over made pairs)."""
    r = np.random.default_rng(5)
    a = r.standard_normal((4000, 64))
    b = r.standard_normal((4000, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b -= (a * b).sum(axis=1)[:, None] * a
    b = 0.95 * a + math.sqrt(1 - 0.95**2) * b / np.linalg.norm(b, axis=1)[:, None]
    bits, tables = vectors.plan(10**6)
    planes = np.random.default_rng([vectors.SEED, 64]).standard_normal((64, bits * tables))
    met = ((a @ planes > 0) == (b @ planes > 0)).reshape(len(a), tables, bits).all(axis=2).any(axis=1)
    assert met.mean() > 0.998


def test_links_of_empty_and_unusable_tables(spark):
    assert vectors.linked(table(spark, [])).collect() == []
    got = vectors.linked(table(spark, AWKWARD)).collect()
    same([(r.vec_id, r.n_links, r.component_id, r.kept) for r in got], link_all(AWKWARD))


def whitened(rows, k=16):
    """Fit and rows in numpy: n, deviation, the whitened covariance's parts, by vec_id order."""
    good = [(i, v) for i, v, _ in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    x = np.array([[math.floor(64 * float(np.float32(c))) + whitening.ORIGIN for c in v] for _, v in good], dtype=np.int64)
    u = np.unique(x, axis=0)
    n, s = len(u), u.sum(axis=0)
    value, vec = np.linalg.eigh(np.cov((u - whitening.ORIGIN).T, bias=True))
    value, vec = value[::-1], vec[:, ::-1]
    z = (x - s / n) @ vec[:, :k] / np.sqrt(value[:k])
    return [i for i, _ in good], n, ((n * x - s) ** 2).sum(axis=1), value, z


def test_whitening_equals_numpy(spark):
    rows = [r for r in cloud() if r[0] is not None][:200] + [(500, cloud()[3][1], 0)] + AWKWARD[:1] + AWKWARD[2:5]
    ids, n, deviation, value, z = whitened(rows)
    got = whitening.whiten(table(spark, rows)).collect()
    assert len(got) == len(ids) * 12 and {r.n for r in got} == {n}
    assert max(r.identity_error for r in got) < 1e-12
    by = {(r.vec_id, r.component): r for r in got}
    for c in range(12):
        sign = np.sign(by[ids[0], c + 1].whitened) * np.sign(z[0, c])
        for i, vec_id in enumerate(ids):
            r = by[vec_id, c + 1]
            assert r.deviation == deviation[i]
            assert abs(r.whitened - sign * z[i, c]) < 1e-8
            assert abs(r.explained - value[c] / value.sum()) < 1e-12


def test_the_library_states_x_minus_its_origin():
    # a common origin moves neither deviation nor projection
    x = np.array([[3, -5], [7, 1], [2, 2]])
    m = whitening.Fit(3, [12, -2], np.ones(2), np.eye(2))
    off = 3 * (x + whitening.ORIGIN) - (np.array(m.sums) + 3 * whitening.ORIGIN)
    assert whitening._deviation(x, m).to_pylist() == (off**2).sum(axis=1).tolist()
    far = whitening.Fit(10**9, [10**18, 0], np.ones(2), np.eye(2))
    assert whitening._deviation(x, far).to_pylist() == [None] * 3
    mixed = whitening.Fit(10**6, [0, 0], np.ones(2), np.eye(2))
    assert whitening._deviation(np.array([[1 << 40, 0], [1, 2]]), mixed).to_pylist() == [None, 5 * 10**12]


def test_whitening_of_empty_constant_and_ragged_tables(spark):
    assert whitening.whiten(table(spark, [])).collect() == []
    assert whitening.whiten(table(spark, AWKWARD[:2])).collect() == []
    one = whitening.whiten(table(spark, [(1, [0.5, 0.25, 2.0], 0), (1, [0.5, 0.25, 2.0], 0), (2, [0.5, 0.25, 2.0], 0)])).collect()
    assert len(one) == 9 and {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one} == {(1, 0, None, 0.0, 0.0)}
    ragged = [(i, [float(i), float(i * i % 7), 1.0], 0) for i in range(20)] + [(90, [1.0], 0), (91, [3e38] * 2, 0), (92, [3e38, -3e38, 0.0], 0)]
    got = whitening.whiten(table(spark, ragged)).collect()
    assert {r.vec_id for r in got} == {*range(20), 92} and {r.n for r in got} == {21}
    assert {r.whitened is None for r in got if r.component == 3} == {True}


@pytest.mark.parametrize("part", [1, 7])
def test_the_fit_does_not_depend_on_partitions(spark, part):
    rows = [(i, v, 0) for i, v, _ in cloud() if i is not None]
    x = spark.createDataFrame(rows, SCHEMA).select(whitening.on_grid(F.col("embedding")).alias("x")).distinct()
    a, b = whitening.fit(x.repartition(part)), whitening.fit(x)
    assert a.n == b.n and a.sums == b.sums
    assert (a.values == b.values).all() and (a.vectors == b.vectors).all()


@pytest.mark.parametrize(
    "values",
    [
        [5, 5 + 1e-7, 5 + 2e-6, 1, 1 + 1e-5, 0.5],
        [5, 5 + 1e-10, 5, 1, 1, 0.5],
        [3, 1e-8, 1e-9, 2, 2],
        [1] * 9,
        [4, 1, 0, 0],
        [*np.random.default_rng(2).random(50), *(1 + 1e-7 * np.random.default_rng(3).random(20))],
    ],
)
def test_eigenvectors_in_double_precision_also_in_clusters(values):
    r = np.random.default_rng(7)
    q = np.linalg.qr(r.standard_normal((len(values),) * 2))[0].astype(np.longdouble)
    for _ in range(3):
        q = (3 * q - q @ (q.T @ q)) / 2
    values = np.sort(np.array(values, dtype=np.longdouble))[::-1]
    a = q @ np.diag(values) @ q.T
    a = (a + a.T) / 2
    found, x = whitening.eigen(a)
    assert np.abs(found - values).max() < 1e-14
    assert np.abs(x.T @ x - np.eye(len(x))).max() < 1e-14 and np.abs(a @ x - x * found).max() < 1e-14
    alone = [i for i in range(len(values)) if all(j == i or abs(values[i] - values[j]) > 1e-8 for j in range(len(values)))]
    for i in alone:  # the vectors themselves, as far as the matrix's own rounding (1e-19 over the gap) lets them be known
        assert abs(abs(float(q[:, i] @ x[:, i])) - 1) < 4e-15 and np.abs(np.abs(q[:, i]) - np.abs(x[:, i])).max() < 1e-11


def test_float32_alone_is_not_enough():
    r = np.random.default_rng(8)
    q = np.linalg.qr(r.standard_normal((40, 40)))[0]
    a = q @ np.diag(1 + 0.01 * np.arange(40)) @ q.T
    a = (a + a.T) / 2
    start = np.linalg.eigh(a.astype(np.float32))[1].astype(np.float64)
    off = lambda x: np.abs(np.abs(x.T @ q) - np.eye(40)).max()
    assert off(start) > 1e-6 and off(whitening.eigen(a)[1][:, ::-1]) < 1e-13


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.001/embeddings.parquet"), reason="test data not available")
def test_queries_on_the_given_table(spark):
    links = vectors.op12_vectors(spark, "/root/testdata/sf0.001").collect()
    rows = [(r.vec_id, list(r.embedding), r.label) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    same([(r.vec_id, r.n_links, r.component_id, r.kept) for r in links], link_all(rows))
    white = whitening.op11_whitening(spark, "/root/testdata/sf0.001")
    assert white.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    top = white.agg(F.max("identity_error"), F.count("*"), F.max("component")).first()
    assert top[0] < 1e-10 and top[1] == 16 * len(rows) and top[2] == 16


def test_double_and_integer_vectors(spark):
    rows = [(1, [1.0, 2.0, 3.0]), (2, [1.0, 2.0, 3.0 + 1e-12]), (3, [-1.0, 2.0, 3.0]), (4, [1e200, 2e200, 3e200])]
    doubles = vectors.linked(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {(r.vec_id, r.n_links, r.component_id) for r in doubles} == {(1, 2, 1), (2, 2, 1), (3, 0, 3), (4, 2, 1)}
    whole = spark.createDataFrame([(1, [1, 2]), (2, [2, 4]), (3, [2, -1])], "vec_id long, embedding array<int>")
    assert {(r.vec_id, r.component_id) for r in vectors.linked(whole).collect()} == {(1, 1), (2, 1), (3, 3)}
