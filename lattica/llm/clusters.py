"""Centroid clustering with block-norm screening.

A vector v is compressed, once, into one byte a component, q, times a step of its own; what is left, r = v - step * q, is
known by the norms of its segments only. By the inequality of Cauchy and Schwarz, segment by segment,
|v - c|^2 = |v|^2 + |c|^2 - 2 * step * q.c - 2 * r.c is at least that with the product of both lists of norms for r.c, so a
centroid whose bound is above a distance already found is out; only the others get exact whole-number distances.
Vectors stay where they are read: a round sends one row of sums for each task and cluster.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _base as B
from .whitening import finite

SCALE, DIMS, SEGMENT = 1_024, 64, 8
#: Squared distances of 64 components within this fit a long.
MOST_COMPONENT = 1 << 27


def segment_norms(x: np.ndarray) -> np.ndarray:
    """The norm of each segment of SEGMENT components, for each row."""
    return np.sqrt((x.astype(np.float64) ** 2).reshape(len(x), -1, SEGMENT).sum(axis=2))


def compressed(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of one byte, steps, and the norms of the segments of what the codes leave."""
    step = np.maximum(np.abs(x).max(axis=1), 1) / 127
    codes = np.rint(x / step[:, None]).astype(np.int8)
    return codes, step, segment_norms(x - step[:, None] * codes)


def lower_bounds(square: np.ndarray, codes: np.ndarray, step: np.ndarray, norms: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """For each vector and centroid a number that their squared distance is not below."""
    c = centroids.astype(np.float64)
    both = square[:, None] + (c**2).sum(axis=1)[None, :]
    return both - 2 * (step[:, None] * (codes.astype(np.float64) @ c.T) + norms @ segment_norms(c).T) - 1e-9 * both - 1e-6  # the last two exceed all rounding


def nearest(x: np.ndarray, bounds: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number and exact squared distance of the nearest centroid of each row (ties: the smaller number), and how many distances that took.

    The centroid with the least bound is measured first; then those that its distance, or a smaller one, does not rule out.
    """
    exact = lambda rows, k: ((x[rows] - centroids[k]) ** 2).sum(axis=1)
    first, every = bounds.argmin(axis=1), np.arange(len(x))
    best, cluster, measured = exact(every, first), first.copy(), len(x)
    for k in range(len(centroids)):
        rows = np.flatnonzero((first != k) & (bounds[:, k] <= best))
        d = exact(rows, k)
        nearer = (d < best[rows]) | ((d == best[rows]) & (k < cluster[rows]))
        best[rows[nearer]], cluster[rows[nearer]] = d[nearer], k
        measured += len(rows)
    return cluster.astype(np.int32), best, measured


def matrix(column: pa.Array, width: int, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(-1, width)


def quantised(vectors: DataFrame, id_col: str, vector_col: str, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """id, x (whole numbers floor(scale * c)), square, codes, step and norms of the vectors of `dims` components that are all finite numbers."""
    v = F.col(f"`{vector_col}`")
    whole = F.transform(v, lambda c: F.floor(c.cast("double") * scale))
    fits = F.when(F.exists(whole, lambda c: F.abs(c) > MOST_COMPONENT), F.raise_error(F.lit("a component is too large for distances in a long"))).otherwise(whole)
    rows = vectors.filter(finite(v) & (F.size(v) == dims)).select(F.col(f"`{id_col}`").alias("id"), fits.cast("array<int>").alias("x"))
    out = B.schema_with(rows, "square long, codes binary, step double, norms array<double>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column(1), dims, np.int64)
            codes, step, norms = compressed(x)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(norms) + 1) * norms.shape[1], pa.int32()), pa.array(norms.ravel()))
            made = [pa.array((x**2).sum(axis=1)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(step), lists]
            yield pa.RecordBatch.from_arrays([*b.columns, *made], names=out.names)

    return B.materialize(B.bounded_batches(rows, 10_000).mapInArrow(run, out), "quantised")


def screened(b: pa.RecordBatch, centroids: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, int]]:
    """The vectors of a batch of `quantised` rows, and their nearest centroids."""
    width = centroids.shape[1]
    x = matrix(b.column("x"), width, np.int64)
    codes = np.frombuffer(b"".join(b.column("codes").to_pylist()), np.int8).reshape(-1, width)
    bounds = lower_bounds(b.column("square").to_numpy(), codes, b.column("step").to_numpy(), matrix(b.column("norms"), width // SEGMENT, np.float64), centroids)
    return x, nearest(x, bounds, centroids)


def seeds(x: DataFrame, k: int, salt: str = "3:") -> np.ndarray:
    """The k vectors whose ids have the smallest salted digests, null ids last, equal digests by the vector itself."""
    hashed = x.select(F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256).alias("h"), "x")
    return np.array([r["x"] for r in hashed.orderBy(F.asc_nulls_last("h"), "x").limit(k).collect()], np.int64)


def assigned(x: DataFrame, centroids: np.ndarray) -> DataFrame:
    """id, cluster, distance of every vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cluster, distance, _ = screened(b, centroids)[1]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cluster), pa.array(distance)], names=["id", "cluster", "distance"])

    return x.mapInArrow(run, B.schema_with(x.select("id"), "cluster int, distance long"))


def gathered(x: DataFrame, centroids: np.ndarray) -> list[tuple[int, int, list[int], int]]:
    """Cluster, count, sums of the components and distances measured of every cluster that has vectors."""
    width = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums, taken = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), width), np.int64), 0
        for b in batches:
            own, (cluster, _, measured) = screened(b, centroids)
            taken += measured
            count += np.bincount(cluster, minlength=len(centroids))
            for k in np.unique(cluster):
                sums[k] += own[cluster == k].sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(count), dtype=np.int32)), pa.array(count), pa.array(sums.tolist(), pa.list_(pa.int64())), pa.array([taken, *[0] * (len(count) - 1)], pa.int64())], names=["cluster", "n", "sums", "measured"])

    parts = x.drop("id").mapInArrow(run, "cluster int, n long, sums array<long>, measured long")
    total = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("measured").alias("measured"), *(F.sum(F.col("sums")[d].cast("decimal(38,0)")).alias(f"s{d}") for d in range(width)))
    return [(r["cluster"], r["n"], [int(r[f"s{d}"]) for d in range(width)], r["measured"]) for r in total.collect()]


def fit(x: DataFrame, k: int = 8, rounds: int = 10, salt: str = "3:") -> np.ndarray:
    """The centroids after so many rounds: each takes the floor of the mean of its vectors, an empty one stays."""
    centroids = seeds(x, k, salt)
    if not len(centroids):
        return centroids
    for _ in range(rounds):
        new = centroids.copy()
        for cluster, n, sums, _ in gathered(x, centroids):
            if n:
                new[cluster] = [s // n for s in sums]
        if (new == centroids).all():
            break  # nothing changes any more
        centroids = new
    return centroids


def centroid_digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, cluster, distance, cluster_inertia, inertia, centroid_sha256: one row for every vector kept.

    Kept are vectors of 64 components without null or non-finite ones. Repeated rows count as often as they stand,
    null ids as any other (they come last as first centroids); vectors as near to two centroids go to the smaller
    number; fewer than k vectors give as many centroids; an empty table gives an empty one. Other columns are ignored.
    Components beyond 2^27 and sums of distances beyond a long are an error, as no result could hold them.
    """
    x = quantised(vectors, id_col, vector_col)
    centroids = fit(x, k, rounds)
    if not len(centroids):
        return x.select(F.col("id").alias(id_col), *(F.lit(None).cast(t).alias(c) for c, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))))
    rows = B.materialize(assigned(x, centroids), "assigned")
    sums = {r["cluster"]: int(r["s"]) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}

    def each(values: list, kind: str) -> Column:
        return F.array(*(F.lit(v).cast(kind) for v in values))[F.col("cluster")]

    of = [sums.get(c, 0) for c in range(len(centroids))]
    return rows.select(F.col("id").alias(id_col), "cluster", "distance", each(of, "long").alias("cluster_inertia"), F.lit(sum(of)).cast("long").alias("inertia"), each(list(map(centroid_digest, centroids)), "string").alias("centroid_sha256"))
