r"""Embedding whitening by TSQR and a one-sided Jacobi SVD (operator 13).

Centred rows are compressed block by block: each batch is stacked under the R of
the batches before it and factored again, so a task ends with one d x d triangle.
Triangles of many tasks meet in groups of ``fan``, level by level, each level
written to the shared folder, until few enough are left for one more factoring.
Plane rotations then make the columns of R orthogonal; their lengths over
sqrt(n) are the standard deviations, the accumulated rotations are the
components.  No covariance is formed, so small deviations keep their digits.

* Sums are exact: entries become integers, sums are decimals, and a row is centred
  as (n * x - S) / n, with the numerator in integers.
* What leaves a task, and what reaches the driver, is bounded by the dimensions: a
  triangle of d * d numbers, d sums, and the products of eight components.
* There are four passes over the source: lengths and sums, triangles, products of
  the whitened rows, and the result.  A lost executor costs its own tasks.

Vectors that are null or hold a null, NaN or infinite entry are left out.  Vectors
of another length than the most frequent one (of equally frequent ones the longer)
have no place in a covariance and are left out too, as are empty ones.  Entries
beyond +-2**30 count as that bound.  A deviation that doesn't fit a long is null.
Components without variance (``e`` under 1e-20 of the largest, as with equal rows or fewer
rows than dimensions) can't be whitened and have no rows; so a single row, or none,
gives none.  Ties between eigenvalues leave a component's direction open, as the
data do.  Null ids stay null; repeated rows count and come as often as they are
there.  The sign makes a component's largest entry positive.  Other columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType

from docloom.llm.clustering import finite
from docloom.llm.common import discard, small_batches, table, with_fields, written

COMPONENTS = 8
SCALE = 1024
OFFSET = 100_000
#: Entries are held within this bound before they are scaled.
BOUND = 1 << 30
#: Bytes of triangles that one task, or the driver, factors together.
MERGE_BYTES = 16 << 20
#: A component whose eigenvalue is less than this share of the largest has no variance but that of rounding.
NEGLIGIBLE = 1e-20


def _integers(vector: str) -> Column:
    held = lambda e: F.greatest(F.least(e.cast("double"), F.lit(float(BOUND))), F.lit(-float(BOUND)))
    return F.transform(F.col(vector), lambda e: F.floor(held(e) * SCALE).cast("long") + OFFSET)


def sums_of(vectors: DataFrame) -> tuple[int, list[int]]:
    """(rows, sums by dimension) of the most frequent length of ``vectors`` (x); (0, []) without any."""
    lengths = vectors.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    if not lengths:
        return 0, []
    n, d = lengths[0].n, lengths[0].d

    def partial_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(d, object)
        for b in batches:
            if len(b):
                total = total + _matrix(b["x"]).sum(axis=0).astype(object)
        yield pd.DataFrame({"p": np.arange(d), "s": [str(s) for s in total]})

    rows = vectors.filter(F.size("x") == d).select("x").mapInPandas(partial_sums, "p int, s string").groupBy("p").agg(F.sum(F.col("s").cast("decimal(28,0)")).alias("s")).collect()
    return n, [int(r.s) for r in sorted(rows)]


def _matrix(x: pd.Series) -> np.ndarray:
    return np.stack(x.to_numpy()).astype(np.int64, copy=False)


def _numerators(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exact: as longs if they fit, else as Python's integers."""
    if max([n * int(np.abs(x).max(initial=0)), *map(abs, sums)]) < 1 << 61:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    return (_numerators(x, n, sums) / n).astype(np.float64)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum of (n * x - S) ** 2 of each row, None if it doesn't fit a long."""
    y = _numerators(x, n, sums)
    most = int(np.abs(y).max(initial=0))
    if most * most * y.shape[1] >= 1 << 63:
        y = y.astype(object)
    return [int(v) if v < 1 << 63 else None for v in (y * y).sum(axis=1)]


def _packed(r: np.ndarray) -> bytes:
    return np.ascontiguousarray(r, np.float64).tobytes()


def _unpacked(r: bytes, d: int) -> np.ndarray:
    return np.frombuffer(r, np.float64).reshape(-1, d)


def triangle(blocks: Iterator[np.ndarray], d: int) -> np.ndarray:
    """R of all rows of the blocks, a block at a time."""
    r = np.zeros((0, d))
    for b in blocks:
        r = np.linalg.qr(np.vstack([r, b]), mode="r")
    return r


def tsqr(vectors: DataFrame, n: int, sums: list[int], *, merge_bytes: int = MERGE_BYTES) -> np.ndarray:
    """R of the centred rows of ``vectors`` (x), by as many levels as there are triangles for."""
    d = len(sums)
    fan = max(2, merge_bytes // (8 * d * d))

    def of_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = triangle((centred(_matrix(b["x"]), n, sums) for b in batches if len(b)), d)
        yield pd.DataFrame({"r": [_packed(r)] if len(r) else []})

    def of_group(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"g": [group["g"].iloc[0]], "r": [_packed(triangle((_unpacked(r, d) for r in group["r"]), d))]})

    level = written(vectors.select("x").mapInPandas(of_task, "r binary").withColumn("g", F.spark_partition_id()))
    while level.count() > fan:
        dealt = level.withColumn("g", F.floor(F.col("g") / fan).cast("int"))  # a task has one triangle, so a group has fan at most
        merged = written(dealt.groupBy("g").applyInPandas(of_group, "g int, r binary"))
        discard(level)
        level = merged
    out = triangle((_unpacked(bytes(x.r), d) for x in level.collect()), d)
    discard(level)
    return out


def jacobi(r: np.ndarray, *, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(singular values, right vectors as columns), falling: plane rotations of pairs of columns until all are orthogonal.

    The pairs of a step share no column (a round robin of all columns), so a step is one array operation.
    """
    d = r.shape[1]
    a, v = r.T.copy(), np.eye(d)  # a row of a is a column of R
    players = list(range(d + d % 2))
    eps, tiny = 1e-15, np.finfo(float).tiny * 1e16  # products under this have lost their digits
    for _ in range(sweeps):
        worst = 0.0
        for _ in range(max(1, len(players) - 1)):
            pairs = [(p, q) for p, q in zip(players[: len(players) // 2], reversed(players), strict=False) if p < d and q < d]
            players = [players[0], players[-1], *players[1:-1]]
            if not pairs:
                continue
            p, q = np.array(pairs).T
            x, y = a[p], a[q]
            alpha, beta, gamma = (np.einsum("ij,ij->i", s, t) for s, t in ((x, x), (y, y), (x, y)))
            size = np.sqrt(alpha) * np.sqrt(beta)
            turn = (np.abs(gamma) > eps * size) & (size > tiny)
            if not turn.any():
                continue
            worst = max(worst, float((np.abs(gamma[turn]) / size[turn]).max()))
            p, q, x, y = p[turn], q[turn], x[turn], y[turn]
            zeta = np.clip((beta[turn] - alpha[turn]) / (2 * gamma[turn]), -1e150, 1e150)
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1, zeta))  # 0 for columns of very different length
            c = 1 / np.hypot(1, t)
            c, s = c[:, None], (c * t)[:, None]
            a[p], a[q] = c * x - s * y, s * x + c * y
            v[p], v[q] = c * v[p] - s * v[q], s * v[p] + c * v[q]
        if worst <= 1e-14:
            break
    sigma = np.sqrt(np.einsum("ij,ij->i", a, a))
    order = np.argsort(-sigma, kind="stable")
    sigma, v = sigma[order], v[order]
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v *= np.sign(v[np.arange(d), np.abs(v).argmax(axis=1)])[:, None]
    return sigma, v.T


class Whitening:
    """A fitted whitening: rows, sums, standard deviations and components."""

    def __init__(self, n: int, sums: list[int], sigma: np.ndarray, axes: np.ndarray, components: int):
        values = sigma**2 / max(n, 1)
        k = min(components, int((values > NEGLIGIBLE * values.max(initial=0)).sum()))
        self.n, self.sums, self.trace = n, sums, float(values.sum())
        self.values, self.axes = values[:k], axes[:, :k]

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return centred(x, self.n, self.sums) @ self.axes / np.sqrt(self.values)


def fit(vectors: DataFrame, *, components: int = COMPONENTS, merge_bytes: int = MERGE_BYTES) -> Whitening | None:
    """The whitening of ``vectors`` (x: longs, of one length or more); None without any."""
    n, sums = sums_of(vectors)
    if not n:
        return None
    sigma, axes = jacobi(tsqr(vectors.filter(F.size("x") == len(sums)), n, sums, merge_bytes=merge_bytes))
    return Whitening(n, sums, sigma, axes, components)


def identity_error(vectors: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity, over all rows."""
    k = len(model.values)

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((k + 1, k))
        for b in batches:
            if len(b):
                w = model.whitened(_matrix(b["x"]))
                total += np.vstack([w.T @ w, w.sum(axis=0)])
        yield pd.DataFrame({"p": np.arange(total.size), "s": total.ravel()})

    rows = vectors.select("x").mapInPandas(products, "p int, s double").groupBy("p").agg(F.sum("s").alias("s")).collect()
    total = np.array([r.s for r in sorted(rows)]).reshape(k + 1, k) / model.n
    return float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())


def _rows(batches: Iterator[pa.RecordBatch], model: Whitening, error: float) -> Iterator[pa.RecordBatch]:
    k = len(model.values)
    for b in batches:
        if b.num_rows:
            x = _matrix(b.column("x").to_pandas())
            each = np.repeat(np.arange(len(x)), k)
            columns = {
                "vec_id": b.column("vec_id").take(pa.array(each)),
                "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                "n": pa.array(np.full(len(each), model.n)),
                "deviation": pa.array(deviations(x, model.n, model.sums), pa.int64()).take(pa.array(each)),
                "whitened": pa.array(model.whitened(x).ravel()),
                "explained": pa.array(np.tile(model.values / model.trace, len(x))),
                "identity_error": pa.array(np.full(len(each), error)),
            }
            yield pa.RecordBatch.from_pydict(columns)


def whiten(vectors: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, merge_bytes: int = MERGE_BYTES) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every vector that is kept and each of its first components."""
    small_batches(vectors.sparkSession)
    kept = vectors.filter(finite(vector)).filter(F.size(vector) > 0).select(F.col(vec_id).alias("vec_id"), _integers(vector).alias("x"))
    kinds = {"component": IntegerType(), "n": LongType(), "deviation": LongType(), "whitened": DoubleType(), "explained": DoubleType(), "identity_error": DoubleType()}
    schema = with_fields(kept.select("vec_id").schema, **kinds)
    model = fit(kept, components=components, merge_bytes=merge_bytes)
    if model is None or not len(model.values):
        return vectors.sparkSession.createDataFrame([], schema)
    kept = kept.filter(F.size("x") == len(model.sums))
    return kept.mapInArrow(partial(_rows, model=model, error=identity_error(kept, model)), schema)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
