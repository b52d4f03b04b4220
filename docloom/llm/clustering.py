r"""Centroid clustering by plain Lloyd rounds in integers (operator 12).

Vectors become integers ``floor(1024 * x)``, so distances and sums are exact and
do not depend on how rows are dealt.  Each round broadcasts the centroids;
``mapInPandas`` computes the squared differences to every centroid in NumPy, the
lowest index among the least wins, and each task returns the integer sums of its
own vectors, which ``groupBy`` adds up.

* What a task sends is one row a cluster and dimension, whatever it has read, and
  what reaches the driver is one number a cluster and dimension: bounded by
  ``k`` and ``dims``, not by the rows.  A cluster with most of the vectors is only
  added up by more tasks.
* A round reads the vectors from their source again: nothing is kept between rounds
  but the centroids, so a lost executor costs its own tasks.
* Batches are cut by bytes; a worker holds one batch and its distances.

Vectors that are null, of other than ``dims`` components, or with a null, NaN or
infinite component are left out.  Components beyond +-2**18 (262,144) count as that
bound, so that a distance fits a long; a sum of distances that doesn't fit one is
null.  The first centroids are the ``k`` vectors whose ids have the least hashes;
rows without an id are clustered, but don't start a cluster.  Rows that repeat count
as often as they are there, also as first centroids (equal hashes: by the vectors);
of equal centroids the first takes all, the others stay as they are.  With fewer
than ``k`` vectors there are fewer clusters, with none no rows.  Other columns are
not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType

from docloom.llm.common import small_batches, table, with_fields

K = 8
ROUNDS = 10
DIMS = 64
SCALE = 1024
#: Components, as integers, are held within this bound: 64 squares of twice of it fit a long.
BOUND = 1 << 28


def finite(vector: str) -> Column:
    """True for arrays without null, NaN or infinite entries; null for null."""
    x = F.col(vector)
    return F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))


def _integers(vector: str) -> Column:
    return F.transform(F.col(vector), lambda e: F.greatest(F.least(F.floor(e.cast("double") * SCALE), F.lit(BOUND)), F.lit(-BOUND)).cast("long"))


def integer_vectors(vectors: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", dims: int = DIMS) -> DataFrame:
    """(vec_id, x) of the vectors that are kept, x as longs."""
    whole = F.when(F.size(vector) == dims, finite(vector))
    return vectors.filter(whole).select(F.col(vec_id).alias("vec_id"), _integers(vector).alias("x"))


def first_centroids(kept: DataFrame, k: int = K, salt: str = "3:") -> np.ndarray:
    """The vectors of the ``k`` least hashes of salt and id, in ascending order."""
    hashed = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    rows = kept.filter("vec_id IS NOT NULL").select(hashed.alias("h"), "x").orderBy("h", "x").limit(k).collect()
    return np.array([r.x for r in rows], np.int64)


def assign(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest centroid, squared distance) of each row; of equally near ones the lowest index."""
    distances = np.empty((len(centroids), len(x)), np.int64)
    for i, c in enumerate(centroids):
        d = x - c
        distances[i] = np.einsum("ij,ij->i", d, d)
    nearest = distances.argmin(axis=0)
    return nearest, distances[nearest, np.arange(len(x))]


def _matrix(x: pd.Series) -> np.ndarray:
    return np.stack(x.to_numpy()).astype(np.int64, copy=False)


def sums_of(kept: DataFrame, centroids: np.ndarray) -> tuple[list[int], list[int], list[list[int]]]:
    """(vectors, summed distance, summed components) of each centroid's own vectors."""
    sent = kept.sparkSession.sparkContext.broadcast(centroids)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = sent.value
        n, d, s = ([0] * len(own) for _ in range(3))
        for b in batches:
            if len(b):
                x = _matrix(b["x"])
                nearest, distance = assign(x, own)
                for c in np.unique(nearest):
                    mine = nearest == c
                    n[c] += int(mine.sum())
                    d[c] += sum(map(int, distance[mine]))
                    s[c] = s[c] + x[mine].sum(axis=0).astype(object)
        rows = [(c, p, v) for c in range(len(own)) if n[c] for p, v in enumerate([n[c], d[c], *s[c]])]
        yield pd.DataFrame([(c, p, str(v)) for c, p, v in rows], columns=["c", "p", "v"])

    added = kept.select("x").mapInPandas(partial, "c int, p int, v string").groupBy("c", "p").agg(F.sum(F.col("v").cast("decimal(28,0)")).alias("v")).collect()
    sent.destroy()
    out = np.zeros((len(centroids), centroids.shape[1] + 2), object)
    for r in added:
        out[r.c, r.p] = int(r.v)
    return list(out[:, 0]), list(out[:, 1]), [list(r) for r in out[:, 2:]]


def lloyd(kept: DataFrame, *, k: int = K, rounds: int = ROUNDS) -> np.ndarray:
    """The centroids after ``rounds`` rounds; an empty cluster's centroid stays."""
    centroids = first_centroids(kept, k)
    for _ in range(rounds if len(centroids) else 0):
        n, _, sums = sums_of(kept, centroids)
        centroids = np.array([[s // count for s in own] if count else old for count, own, old in zip(n, sums, centroids.tolist(), strict=True)], np.int64)
    return centroids


def clustered(kept: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``kept`` with cluster and distance, the vectors left out."""
    small_batches(kept.sparkSession)
    kind = kept.schema["vec_id"].dataType
    kept = kept.withColumn("vec_id", F.col("vec_id").cast("string"))  # pandas would make floats of longs with nulls

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                nearest, distance = assign(_matrix(b.pop("x")), centroids)
                yield b.assign(cluster=nearest.astype(np.int32), distance=distance)

    return kept.mapInPandas(look, with_fields(kept.drop("x").schema, cluster=IntegerType(), distance=LongType())).withColumn("vec_id", F.col("vec_id").cast(kind))


def centroid_digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(c)) for c in centroid).encode()).hexdigest()


def cluster(vectors: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", k: int = K, rounds: int = ROUNDS, dims: int = DIMS) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid) of every vector that is kept."""
    small_batches(vectors.sparkSession)
    kept = integer_vectors(vectors, vec_id=vec_id, vector=vector, dims=dims)
    centroids = lloyd(kept, k=k, rounds=rounds)
    if not len(centroids):
        empty = kept.limit(0).select("vec_id")
        return empty.selectExpr("vec_id", "0 AS cluster", "0L AS distance", "0L AS cluster_inertia", "0L AS inertia", "array(0L) AS centroid")
    _, inertia, _ = sums_of(kept, centroids)
    fits = [v if v < 1 << 63 else None for v in (*inertia, sum(inertia))]
    rows = [(i, fits[i], fits[-1], c) for i, c in enumerate(centroids.tolist())]
    about = vectors.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return clustered(kept, centroids).join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cluster(table(spark, sf_dir, "embeddings"))
    digest = F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256)
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))


def _sql() -> str:
    """Each round as a table of assignments and a table of centroids."""
    nearest = """SELECT * EXCLUDE r FROM (
    SELECT k.rn, k.vec_id, k.x, c.c, list_sum(list_transform(list_zip(k.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d, row_number() OVER (PARTITION BY k.rn ORDER BY d, c.c) AS r
    FROM kept k, c{i} c) WHERE r = 1"""
    mean = "CAST((s - ((s % n) + n) % n) // n AS BIGINT)"
    rounds = "".join(
        f"""), a{i} AS MATERIALIZED ({nearest.format(i=i)}
), c{i + 1} AS MATERIALIZED (
  SELECT c, list(v ORDER BY p) AS x FROM (
    SELECT c, p, {mean} AS v FROM (SELECT c, p, sum(v) AS s, count(*) AS n FROM (SELECT c, unnest(x) AS v, unnest(range({DIMS})) AS p FROM a{i}) GROUP BY c, p)) GROUP BY c
  UNION ALL SELECT c, x FROM c{i} WHERE c NOT IN (SELECT c FROM a{i})
"""
        for i in range(ROUNDS)
    )
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS rn, vec_id, list_transform(embedding, lambda e: CAST(least(greatest(floor(CAST(e AS DOUBLE) * {SCALE}), -{BOUND}), {BOUND}) AS BIGINT)) AS x
  FROM embeddings WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {DIMS}
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, x) - 1 AS c, x FROM (SELECT sha256('3:' || vec_id) AS h, x FROM kept WHERE vec_id IS NOT NULL ORDER BY h, x LIMIT {K})
{rounds}), last AS MATERIALIZED ({nearest.format(i=ROUNDS)})
SELECT vec_id, CAST(last.c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY last.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(f.x, ',')) AS centroid_sha256
FROM last JOIN c{ROUNDS} f ON f.c = last.c
"""


SQL = _sql()
