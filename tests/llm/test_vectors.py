"""Centroid clustering and whitening."""

import hashlib
import math

import duckdb
import numpy as np
import pytest

from docloom.llm import clustering, registry, whitening

SCHEMA = "vec_id long, embedding array<float>, label string, x int, cluster string"


def lloyd(rows, k, rounds):
    """The contract row by row in Python's integers."""
    kept = [(i, [math.floor(1024 * c) for c in v]) for i, v in rows]
    hashed = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centroids = [v for _, v in hashed[:k]]
    square = lambda a, b: sum((s - t) ** 2 for s, t in zip(a, b, strict=True))
    nearest = lambda v: min((square(v, c), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        own = [[v for _, v in kept if nearest(v)[1] == j] for j in range(len(centroids))]
        centroids = [[sum(c) // len(vs) for c in zip(*vs, strict=True)] if vs else old for vs, old in zip(own, centroids, strict=True)]
    found = [(i, *reversed(nearest(v))) for i, v in kept]
    inertia = [sum(d for _, c, d in found if c == j) for j in range(len(centroids))]
    return sorted((str(i), c, d, inertia[c], sum(inertia), centroids[c]) for i, c, d in found)


def vectors(n, dims, seed, spread=1.0):
    r = np.random.default_rng(seed)
    return [(i, [float(c) for c in np.float32(r.normal(size=dims) * spread + (i % 5))]) for i in range(n)]


def test_clusters_against_python(spark):
    rows = vectors(200, 6, 1)
    rows += [rows[3]] * 9 + [(None, rows[7][1])] * 3 + [(1000 + i, rows[5][1]) for i in range(20)]
    df = spark.createDataFrame([(*r, "l", 1, "c") for r in rows], SCHEMA).repartition(7)
    for k, rounds in ((8, 10), (3, 2), (1, 1)):
        got = clustering.cluster(df, k=k, rounds=rounds, dims=6).collect()
        assert sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid) for r in got) == lloyd(rows, k, rounds)


def test_ties_and_empty_clusters(spark):
    rows = [(i, [0.25, -0.75]) for i in range(12)] + [(20, [1.0, 1.0])]
    df = spark.createDataFrame([(*r, "l", 1, "c") for r in rows], SCHEMA)
    got = clustering.cluster(df, k=4, rounds=3, dims=2).collect()
    assert sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid) for r in got) == lloyd(rows, 4, 3)


def test_vectors_that_are_left_out(spark):
    nan, inf = float("nan"), float("inf")
    bad = [None, [], [1.0], [1.0, None], [nan, 1.0], [1.0, -inf], [1.0, 2.0, 3.0]]
    df = spark.createDataFrame([(i, v, None, None, None) for i, v in enumerate(bad)], SCHEMA)
    assert clustering.cluster(df, dims=2).count() == 0
    assert clustering.cluster(df.limit(0), dims=2).count() == 0
    one = df.union(spark.createDataFrame([(9, [0.5, 0.5], None, None, None)], SCHEMA))
    assert [tuple(r) for r in clustering.cluster(one, dims=2).collect()] == [(9, 0, 0, 0, 0, [512, 512])]
    no_ids = spark.createDataFrame([(None, [0.5, 0.5], None, None, None)], SCHEMA)
    assert clustering.cluster(no_ids, dims=2).count() == 0


def test_very_large_components_and_ids(spark):
    big = (1 << 62) + 1
    df = spark.createDataFrame([(big, [3e38, 0.0], "", 1, ""), (None, [-3e38, 0.0], "", 1, ""), (3, [0.0, 0.0], "", 1, "")], SCHEMA)
    got = clustering.cluster(df, dims=2, k=1, rounds=1).collect()
    assert {r.vec_id for r in got} == {big, None, 3}
    assert {r.distance for r in got} == {0, clustering.BOUND**2}


def test_clusters_by_sql(spark, sf):
    got = clustering.op12_clusters(spark, sf).toPandas()
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = duck.execute(registry.ORACLE_SQL["op12_clusters"]).df()
    key = list(got.columns)
    assert got.sort_values(key).values.tolist() == want[key].sort_values(key).values.tolist()


@pytest.mark.parametrize("shape", [(40, 5), (5, 5), (3, 8), (1, 1), (30, 64)])
def test_jacobi_against_lapack(shape):
    r = np.random.default_rng(2).normal(size=shape) * np.logspace(0, -6, shape[1])
    sigma, v = whitening.jacobi(np.linalg.qr(r, mode="r"))
    want = np.linalg.svd(r, compute_uv=False)
    assert np.allclose(sigma[: len(want)], want, rtol=1e-10)
    assert np.allclose(v.T @ v, np.eye(shape[1]), atol=1e-13)


def whitened_of(rows):
    """(whitened, deviations, explained) by an eigendecomposition."""
    x = np.floor(1024 * np.array([v for _, v in rows], float)) + 100_000
    n, sums = len(x), [int(s) for s in x.sum(axis=0)]
    values, axes = np.linalg.eigh(np.cov(x.T, bias=True))
    values, axes = values[::-1], axes[:, ::-1]
    w = (x - x.mean(axis=0)) @ axes[:, :8] / np.sqrt(values[:8])
    return w, [sum((n * int(c) - s) ** 2 for c, s in zip(r, sums, strict=True)) for r in x], values[:8] / values.sum()


def check_whitened(df, rows):
    got = df.toPandas().sort_values(["vec_id", "component"])
    w, deviation, explained = whitened_of(rows)
    k = w.shape[1]
    mine = got["whitened"].to_numpy().reshape(-1, k)
    assert np.allclose(mine * np.sign((mine * w).sum(axis=0)), w, atol=1e-8)
    assert got["deviation"].to_numpy().reshape(-1, k)[:, 0].tolist() == deviation
    assert np.allclose(got["explained"].to_numpy()[:k], explained, rtol=1e-9)
    assert got["identity_error"].unique().size == 1 and got["identity_error"].iloc[0] < 1e-9
    assert np.abs(np.cov(mine.T, bias=True) - np.eye(k)).max() < 1e-9


def test_whitening_of_the_table(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()]
    check_whitened(whitening.op13_whitening(spark, sf), rows)


def test_triangles_in_levels(spark):
    rows = vectors(300, 12, 4, spread=0.01)
    df = spark.createDataFrame([(*r, "l", 1, "c") for r in rows], SCHEMA).repartition(13)
    check_whitened(whitening.whiten(df, merge_bytes=1), rows)


def test_small_deviations_far_from_zero(spark):
    rows = [(i, [1000 + v / 1024, 2 * v / 1024, (v % 3) / 1024]) for i, v in enumerate(range(50))]
    df = spark.createDataFrame([(*r, "l", 1, "c") for r in rows], SCHEMA)
    assert df.count() == 50
    got = whitening.whiten(df).toPandas()
    assert set(got["component"]) == {1, 2}  # the second dimension is twice the first
    assert got["identity_error"].max() < 1e-9


def test_whitening_edges(spark):
    nan = float("nan")
    bad = [(1, None), (2, []), (3, [1.0, None]), (4, [nan, 1.0]), (5, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame([(*r, None, None, None) for r in bad], SCHEMA)
    assert whitening.whiten(df.limit(0)).count() == 0
    assert whitening.whiten(df).count() == 0  # one row has no variance
    same = spark.createDataFrame([(7, [1.0, 2.0], None, None, None)] * 5, SCHEMA).repartition(5)
    assert whitening.whiten(same, merge_bytes=1).count() == 0
    big = (1 << 62) + 1
    good = [(big, [0.0, 1.0]), (None, [1.0, 0.0]), (None, [1.0, 0.0]), (8, [2.0, 5.0])]
    got = whitening.whiten(df.union(spark.createDataFrame([(*r, "", 1, "") for r in good], SCHEMA))).collect()
    assert sorted(str(r.vec_id) for r in got) == sorted([str(big)] * 2 + ["8"] * 2 + ["None"] * 4)
    assert {r.n for r in got} == {4}
    huge = spark.createDataFrame([(i, [v, -v], "", 1, "") for i, v in enumerate([3e38, 1.0, 0.0])], SCHEMA)
    got = whitening.whiten(huge).collect()
    assert {r.deviation is None for r in got} == {True} and all(math.isfinite(r.whitened) for r in got)
