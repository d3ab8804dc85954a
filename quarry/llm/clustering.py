"""Centroid clustering on whole numbers, with Ptolemy's inequality over fixed pivot pairs in front of exact distances.

Every component x of a vector becomes floor(256 * x), so sums, means and squared distances are exact and do not depend
on how rows are dealt. The first centroids are the ``k`` vectors of smallest SHA-256 of ``2:<vec_id>``.

Pivots: the centroids of the rounds ``ANCHORS`` become pivots and stay them until the next such round. The
squared distance of every vector to every pivot is computed once, stored beside the vector, and is that
round's assignment as well. Each pivot is paired with the pivot farthest from it. For a vector x, a centroid c
and a pair (p, s), Ptolemy's inequality gives

    d(x, c) >= |d(x, p) d(c, s) - d(x, s) d(c, p)| / d(p, s)

from stored distances of x and those of c, of which there are k. A centroid is tried with the ``PAIRS`` pairs
whose first pivot is nearest to it. Bounds are lowered by a margin above all rounding errors of double arithmetic, the
centroid of least bound is measured exactly, and every centroid whose bound does not exceed that distance as well. The
result is that of measuring all; ties go to the smaller number.

Spark: vectors and pivot distances are Parquet tables in the shared folder; a round is one pass without a shuffle
of vectors, each task sends one row of counts and sums per cluster, and the k centroids go back by broadcast.

Kept are vectors with exactly ``dims`` components, none null or non-finite. Components beyond 2**27 after scaling
are set to that limit, so that no distance exceeds a long. A null vec_id sorts behind all others for the first centroids and
is carried through. Repeated rows are vectors of their own; equal hashes are ordered by vec_id and vector. With fewer than
``k`` vectors each is a centroid. Sums of distances beyond a long are null. Empty tables give no rows; extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.shared import cut

K, DIMS, ROUNDS, SCALE = 40, 64, 5, 256
ANCHORS, PAIRS = (0, 2), 2
LIMIT, TEXTS = 1 << 27, 2048
#: Above the relative error of a product, quotient and difference of correctly rounded roots.
ROUNDING = 64 * np.finfo(np.float64).eps
SCHEMA = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def kept_vectors(rows: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """vec_id, no_id (its vec_id is null; 0 stands in for it) and x (whole numbers) of the usable rows of ``rows(vec_id, embedding)``."""
    finite = F.forall("e", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = F.transform("e", lambda c: F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.floor(c * scale))).cast("long"))
    typed = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    return typed.filter((F.size("e") == dims) & finite).select(F.coalesce("vec_id", F.lit(0)).alias("vec_id"), F.col("vec_id").isNull().alias("no_id"), whole.alias("x"))


def first_centroids(vectors: DataFrame, k: int = K) -> np.ndarray:
    """At most ``k`` rows; Spark keeps ``k`` per task."""
    ordered = vectors.orderBy("no_id", F.sha2(F.concat(F.lit("2:"), F.col("vec_id").cast("string")), 256), "vec_id", "x").limit(k)
    return np.array([r.x for r in ordered.collect()], np.int64)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.stack([((x - one) ** 2).sum(axis=1) for one in c], axis=1)


class Pivots:
    """Fixed pivots in pairs, for one set of centroids."""

    def __init__(self, pivots: np.ndarray, centroids: np.ndarray):
        self.centroids = centroids
        between = np.sqrt(squared(pivots, pivots).astype(np.float64))
        far = between.argmax(axis=1)  # the partner of each pivot
        to = np.sqrt(squared(centroids, pivots).astype(np.float64))
        near = np.argsort(to, axis=1, kind="stable")[:, :PAIRS]
        # (first pivot, second pivot, distances of the centroid to both, distance of the pair) per centroid; equal pivots bound nothing.
        self.pairs = [[(p, s, to[k, p], to[k, s], between[p, s]) for p in near[k] for s in [far[p]] if between[p, s] > 0] for k in range(len(centroids))]

    def bounds(self, pivot_distances: np.ndarray) -> np.ndarray:
        """Lower bounds of the distances, from the squared pivot distances of vectors."""
        d = np.sqrt(pivot_distances.astype(np.float64))
        out = np.zeros((len(d), len(self.centroids)))
        for k, pairs in enumerate(self.pairs):
            for p, s, cp, cs, ps in pairs:
                a, b = d[:, p] * cs, d[:, s] * cp
                np.maximum(out[:, k], (np.abs(a - b) - ROUNDING * (a + b)) / ps * (1 - ROUNDING), out=out[:, k])
        return out

    def nearest(self, x: np.ndarray, pivot_distances: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(cluster, squared distance) of every vector and how many distances were measured."""
        low = self.bounds(pivot_distances)
        first = low.argmin(axis=1)
        best = ((x - self.centroids[first]) ** 2).sum(axis=1)
        survives = low * low * (1 - ROUNDING) <= best[:, None] * (1 + ROUNDING)
        exact = np.full(low.shape, np.iinfo(np.int64).max)
        for k, c in enumerate(self.centroids):
            own = np.flatnonzero(survives[:, k])
            exact[own, k] = ((x[own] - c) ** 2).sum(axis=1)
        cluster = exact.argmin(axis=1)
        return cluster, exact[np.arange(len(x)), cluster], int(survives.sum())


def _parts(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for at in range(0, len(b), TEXTS):
            yield b.iloc[at : at + TEXTS]


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.int64, copy=False)


def anchored(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``vectors`` with ``near``, the squared distances to the pivots."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _parts(batches):
            yield b.assign(near=list(squared(_matrix(b["x"]), pivots)))

    return vectors.mapInPandas(run, "vec_id long, no_id boolean, x array<bigint>, near array<bigint>")


def next_centroids(vectors: DataFrame, pivots: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact floor of the mean of every non-empty cluster; an empty one keeps its centroid."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Pivots(pivots, centroids)
        n, sums = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for b in _parts(batches):
            x = _matrix(b["x"])
            cluster, _, _ = known.nearest(x, _matrix(b["near"]))
            n += np.bincount(cluster, minlength=len(n))
            for k in np.unique(cluster):
                sums[k] += x[cluster == k].sum(axis=0)
        own = np.flatnonzero(n)
        yield pd.DataFrame({"cluster": own.astype(np.int32), "n": n[own], "sums": list(sums[own])})

    found = vectors.select("x", "near").mapInPandas(run, "cluster int, n long, sums array<bigint>")
    long = found.select("cluster", "n", F.posexplode("sums").alias("dim", "part"))
    total = long.groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum(F.col("part").cast("decimal(38,0)")).alias("total")).collect()  # k * dims rows
    out = centroids.copy()
    for r in total:
        out[r.cluster, r.dim] = int(r.total) // r.n
    return out


def cluster_vectors(rows: DataFrame, k: int = K, rounds: int = ROUNDS, dims: int = DIMS) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of the usable rows of ``rows(vec_id, embedding)``."""
    spark = rows.sparkSession
    vectors = cut(kept_vectors(rows, dims), "vectors")
    centroids = first_centroids(vectors, k)
    if not len(centroids):
        return spark.createDataFrame([], SCHEMA)
    pivots = near = None
    for t in range(rounds):
        if t in ANCHORS:
            pivots = centroids
            near = cut(anchored(vectors, pivots), "pivot-distances")
        centroids = next_centroids(near, pivots, centroids)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Pivots(pivots, centroids)
        for b in _parts(batches):
            cluster, distance, _ = known.nearest(_matrix(b["x"]), _matrix(b["near"]))
            yield pd.DataFrame({"vec_id": b["vec_id"], "no_id": b["no_id"], "cluster": cluster.astype(np.int32), "distance": distance})

    if near is None:
        pivots, near = centroids, anchored(vectors, centroids)
    placed = cut(near.mapInPandas(run, "vec_id long, no_id boolean, cluster int, distance long"), "placed")
    inertia = {r.cluster: int(r.s) for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # k rows
    fits = lambda n: n if n < 1 << 63 else None
    digest = lambda c: hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()
    known = [(i, fits(s), fits(sum(inertia.values())), digest(centroids[i])) for i, s in inertia.items()]
    table = spark.createDataFrame(known, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    named = placed.withColumn("vec_id", F.when(~F.col("no_id"), F.col("vec_id")))
    return named.join(F.broadcast(table), "cluster").select(*[c.split()[0] for c in SCHEMA.split(", ")])
