r"""Cosine search without loss: an inverted file whose cells are pruned by the triangle inequality.

Angles between vectors are a metric.  Each vector lies in the cell of its nearest
centroid, at an angle from it.  A match of a query lies
within ``acos(least)`` of it, so its angle from a centroid differs from the query's by
no more than that.  Which centroids there are changes what is skipped, not what is found.

Centroids come from at most ``SAMPLE`` vectors, those of the least hashes, by a few
rounds of k-means in the driver; they, and the range of angles of each cell, are all that
is ever collected.  The index holds every vector.  A search packs vectors of one cell and
neighbouring angles into blocks, and queries into blocks too; every block of vectors meets every block of
queries, queries whose angle is out of a block's range are dropped, and the rest are
compared as products of matrices, so that where nothing can be skipped (low cosines in many
dimensions) a pair costs some nanoseconds.  The pairs compared grow with vectors times
queries; what a task holds is two blocks and the products of one with a part of the other.

Null vectors, those with a null, NaN or infinite entry, and those of length zero match
nothing and are left out.  Vectors of different dimensions do not match.  Repeated rows
match as often as they are there; a row does not match a query of its own key.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators.state import written
from docloom.operators.trees import let

CELLS = 32
SAMPLE = 8_192
ROUNDS = 6
#: Vectors side by side, and queries that are held against them at a time.
BLOCK = 2048
QUERIES = 256
#: More than the rounding of an angle.
SLACK = 1e-6


class Index(NamedTuple):
    rows: DataFrame  # key, unit, cell, angle
    centroids: np.ndarray


def unit(vector: str) -> Column:
    """The vector at length one, as doubles; null where it has none."""
    fine = F.forall(vector, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    divided = lambda x, by: F.when(by > 0, F.transform(x, lambda e: e / by))
    norm = lambda x: F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, e: s + e * e))
    most = F.array_max(F.transform(vector, lambda e: F.abs(e.cast("double"))))  # scaled first, so that squares stay in range
    scaled = let(most, lambda m: divided(F.transform(vector, lambda e: e.cast("double")), m))
    return F.when(F.coalesce(fine, F.lit(False)), let(scaled, lambda x: let(norm(x), lambda n: divided(x, n))))


def _fit(sample: np.ndarray, cells: int) -> np.ndarray:
    """Centroids of length one: spread seeds, then rounds of means."""
    chosen, nearest = [0], sample @ sample[0]
    while len(chosen) < min(cells, len(sample)):
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, sample @ sample[chosen[-1]])
    centroids = sample[chosen]
    for _ in range(ROUNDS):
        own = (sample @ centroids.T).argmax(axis=1)
        sums = np.stack([sample[own == c].sum(axis=0) if (own == c).any() else centroids[c] for c in range(len(centroids))])
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norms > 1e-12, sums / np.maximum(norms, 1e-12), centroids)
    return centroids


def _angles(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ centroids.T, -1, 1))


def _stacked(units: pd.Series) -> np.ndarray:
    return np.stack(units.to_numpy())


def indexed(vectors: DataFrame, key: str, vector: str, *, cells: int = CELLS, sample: int = SAMPLE) -> Index:
    """The index of all vectors, written to the shared folder."""
    units = vectors.select(F.col(key).alias("key"), unit(vector).alias("unit")).filter("unit IS NOT NULL")
    seen = units.select(F.col("unit").alias("u"), F.xxhash64("unit").alias("h")).orderBy("h").limit(sample).collect()
    size = max((len(r.u) for r in seen), default=0)
    points = np.array([r.u for r in seen if len(r.u) == size])
    centroids = _fit(points, cells) if size else np.zeros((0, 0))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                angles = _angles(_stacked(b["unit"]), centroids)
                cell = angles.argmin(axis=1).astype(np.int32)
                angle = angles[np.arange(len(b)), cell]
                yield b.assign(key=b["key"], cell=cell, angle=angle)

    kind = units.schema["key"].dataType
    whole = units.filter(F.size("unit") == size).withColumn("key", F.col("key").cast("string")).mapInPandas(place, "key string, unit array<double>, cell int, angle double")
    return Index(written(whole.withColumn("key", F.col("key").cast(kind))), centroids)


def _packed(keys: pa.Array, units: pa.ListArray, cell: int, low: float, high: float) -> pa.RecordBatch:
    one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
    return pa.RecordBatch.from_arrays([one(keys), one(units.flatten()), pa.array([cell], pa.int32()), pa.array([low]), pa.array([high])], ["keys", "units", "cell", "low", "high"])


def _blocks(rows: DataFrame) -> DataFrame:
    """(keys, units, cell, low, high) of at most ``BLOCK`` rows (key, unit, cell, angle) of one cell, side by side; written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells, angles = (b.column(c).to_numpy(zero_copy_only=False) for c in (2, 3))
            starts = [*np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]]).tolist(), b.num_rows] if b.num_rows else []
            for start, stop in itertools.pairwise(starts):
                for at in range(start, stop, BLOCK):
                    n = min(BLOCK, stop - at)
                    yield _packed(b.column(0).slice(at, n), b.column(1).slice(at, n), int(cells[at]), float(angles[at : at + n].min()), float(angles[at : at + n].max()))

    kind = rows.schema["key"].dataType.simpleString()
    sorted_ = rows.repartitionByRange("cell", "angle").sortWithinPartitions("cell", "angle").select("key", "unit", "cell", "angle")
    return written(sorted_.mapInArrow(run, f"keys array<{kind}>, units array<double>, cell int, low double, high double"))


def _keys(x: pa.Array) -> np.ndarray:
    return np.array(x.to_pylist() + [None], object)[:-1] if x.null_count or not pa.types.is_integer(x.type) else x.to_numpy(zero_copy_only=False)


def _near(u: np.ndarray, q: np.ndarray, same: np.ndarray, least: float, most: int | None, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in u, place in q, cosine) of pairs that are not ``same``, with ``most`` only those of each row of q that come first.

    Whole products say what may be near; those are then summed in one order, so that equal vectors are equally near wherever they stand.
    """
    s = u @ q.T
    s[same] = -np.inf
    bound = np.full(len(q), least)
    if most is not None and len(u) > most:
        bound = np.maximum(bound, np.partition(s, -most, axis=0)[-most])
    i, j = np.nonzero(s >= bound - SLACK)
    exact = np.zeros(len(i))
    for d in range(u.shape[1]):
        exact += u[i, d] * q[j, d]
    kept = exact >= least
    i, j, exact = i[kept], j[kept], exact[kept]
    if most is not None and len(i):
        order = np.lexsort((rank[i], -exact, j))
        i, j, exact = i[order], j[order], exact[order]
        begin = np.flatnonzero(np.r_[True, j[1:] != j[:-1]])
        kept = np.arange(len(j)) - np.repeat(begin, np.diff(np.r_[begin, len(j)])) < most
        i, j, exact = i[kept], j[kept], exact[kept]
    return i, j, exact


def _found(index: Index, queries: DataFrame, key: str, vector: str, least: float, most: int | None) -> DataFrame:
    rows, centroids = index
    reach = math.acos(max(-1.0, min(1.0, least))) + SLACK
    size = centroids.shape[1]
    asked = queries.select(F.col(key).alias("key"), unit(vector).alias("unit"), F.lit(0).alias("cell"), F.rand(0).alias("angle")).filter(F.col("unit").isNotNull() & (F.size("unit") == size))
    kind, own = asked.schema["key"].dataType.simpleString(), rows.schema["key"].dataType.simpleString()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                ks, qs = b.column(0)[r].values, b.column(5)[r].values
                u, q = (b.column(c)[r].values.to_numpy(zero_copy_only=False).reshape(-1, size) for c in (1, 6))
                away = _angles(q, centroids[[b.column(2)[r].as_py()]])[:, 0]
                near = np.flatnonzero((away >= b.column(3)[r].as_py() - reach) & (away <= b.column(4)[r].as_py() + reach))
                names, others = _keys(ks), _keys(qs)
                rank = np.empty(len(names), np.int64)
                rank[sorted(range(len(names)), key=lambda i: (names[i] is not None, names[i]))] = np.arange(len(names))
                for at in range(0, len(near), QUERIES):
                    some = near[at : at + QUERIES]
                    i, j, s = _near(u, q[some], names[:, None] == others[some][None, :], least, most, rank)
                    if len(i):
                        yield pa.RecordBatch.from_arrays([qs.take(pa.array(some[j])), ks.take(pa.array(i)), pa.array(s)], ["query", "key", "similarity"])

    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    told = _blocks(asked).select(F.col("keys").alias("asked"), F.col("units").alias("qs"))
    met = _blocks(rows).repartition(tasks).crossJoin(told)
    return met.mapInArrow(meet, f"query {kind}, key {own}, similarity double")


def search(index: Index, queries: DataFrame, key: str, vector: str, least: float) -> DataFrame:
    """(query, key, similarity) of every vector of the index whose cosine with a query is ``least`` or more."""
    return _found(index, queries, key, vector, least, None)


def nearest(index: Index, queries: DataFrame, key: str, vector: str, least: float, most: int) -> DataFrame:
    """(query, key, similarity, rank): the ``most`` nearest vectors of each query of those that ``search`` finds; ties by the key.

    Only as many of each block of vectors are kept to be ranked.
    """
    w = Window.partitionBy("query").orderBy(F.desc("similarity"), "key")
    return _found(index, queries, key, vector, least, most).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)
