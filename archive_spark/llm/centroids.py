"""Integer k-means whose assignment is an equal-average equal-variance nearest neighbour search.

Vectors become integers, floor(scale * component). Centroids stand sorted by the sum of their components. A vector's
search starts where its own sum would stand and goes outward, always to the side whose sum is nearer, so the gaps grow:

- by the means, dims * distance >= (difference of the sums) squared; once that exceeds dims * the best distance, the
  search of this vector ends;
- by means and deviations, distance >= (difference of sums)^2 / dims + (difference of the norms about the mean)^2; a
  centroid beyond the best distance is passed over;
- for the others the squared distance is computed exactly, in integers. Of equal distances the smaller number wins.

The inequalities are taken in floating point with a margin, so they never rule out a centroid that could win or tie.

A round adds up each cluster's components in the task that reads the vectors, at most k rows a task, and these by cluster;
a new centroid is the exact floor of the mean. An empty cluster keeps its centroid. Only k rows reach the driver.

Defined results: kept are vectors of exactly `dims` components, none null, NaN or infinite; others are left out. Null or
repeated ids are kept row by row; a null id counts as empty text in the hash that draws the first centroids, and equal
hashes go by the vectors. With fewer kept vectors than k, all are first centroids. An empty table gives an empty result.
An integer beyond 2^27 stops the job with an error, as distances would not fit 64 bits. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back

#: Components beyond this make distances that 64 bits cannot hold (of up to 64 components).
LARGEST = 1 << 27
#: Vectors worked on at once; with 64 components some 8 MB.
BLOCK_ROWS = 1 << 14


@dataclass
class Search:
    """Centroids in ascending order of their sums, ready to be searched."""

    rows: np.ndarray  # int64, k x dims, by sum, then number
    number: np.ndarray
    sums: np.ndarray
    spread: np.ndarray

    @classmethod
    def of(cls, centroids: np.ndarray) -> Search:
        sums = centroids.sum(axis=1)
        order = np.argsort(sums, kind="stable")
        rows = centroids[order]
        return cls(rows, order.astype(np.int64), sums[order], spread(rows))

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Each vector's centroid and squared distance, and how many distances were computed."""
        n, dims = vectors.shape
        k, sums, about = len(self.rows), vectors.sum(axis=1), spread(vectors)
        up = np.searchsorted(self.sums, sums)
        down = up - 1
        best = np.full(n, np.iinfo(np.int64).max, dtype=np.int64)
        number = np.full(n, -1, dtype=np.int64)
        active, computed = np.arange(n), 0
        far = np.iinfo(np.int64).max
        while len(active):
            u, d, s = up[active], down[active], sums[active]
            above = np.where(u < k, self.sums[np.minimum(u, k - 1)] - s, far)
            below = np.where(d >= 0, s - self.sums[np.maximum(d, 0)], far)
            rise = above <= below
            at, gap = np.where(rise, u, d), np.minimum(above, below)
            by_mean = gap.astype(np.float64) ** 2 / dims
            limit = best[active] * (1 + 1e-9) + 1e-6
            on = (gap != far) & (by_mean <= limit)
            active, at, rise, by_mean, limit = active[on], at[on], rise[on], by_mean[on], limit[on]
            up[active[rise]] += 1
            down[active[~rise]] -= 1
            near = by_mean + np.maximum(np.abs(about[active] - self.spread[at]) - 1e-6 * (about[active] + self.spread[at] + 1), 0) ** 2 <= limit
            rows, at = active[near], at[near]
            computed += len(rows)
            difference = vectors[rows] - self.rows[at]
            distance = np.einsum("ij,ij->i", difference, difference)
            won = (distance < best[rows]) | ((distance == best[rows]) & (self.number[at] < number[rows]))
            best[rows[won]], number[rows[won]] = distance[won], self.number[at[won]]
        return number, best, computed


def spread(vectors: np.ndarray) -> np.ndarray:
    """The norm of each vector about its mean."""
    x = vectors.astype(np.float64)
    return np.sqrt(((x - x.mean(axis=1, keepdims=True)) ** 2).sum(axis=1))


def _kept(vector: Column, dims: int) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (F.size(vector) == dims) & finite


def _integers(column: pa.Array, dims: int, scale: float) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return _floors(flat, scale).reshape(-1, dims)


def _floors(values: np.ndarray, scale: float) -> np.ndarray:
    found = np.floor(scale * values)
    if found.size and np.abs(found).max() > LARGEST:
        raise ValueError(f"a component is beyond {LARGEST} in magnitude, distances would not fit 64 bits")
    return found.astype(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK_ROWS):
            yield batch.slice(at, BLOCK_ROWS)


def first_centroids(kept: DataFrame, k: int, scale: float, seed: int) -> np.ndarray:
    """The k vectors with the smallest hash of their id, in the order of the hashes."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    rows = kept.select(key.alias("key"), "vector").orderBy("key", "vector").limit(k).collect()
    return _floors(np.array([r["vector"] for r in rows], dtype=np.float64), scale)


def _totals(kept: DataFrame, centroids: np.ndarray, scale: float) -> list:
    """For each cluster that has vectors: its number, how many, their distances' sum and the sums of their components."""
    search = kept.sparkSession.sparkContext.broadcast(Search.of(centroids))
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, inertia, sums = np.zeros(k, dtype=np.int64), np.zeros(k, dtype=np.int64), np.zeros((k, dims), dtype=np.int64)
        for batch in _blocks(batches):
            vectors = _integers(batch.column("vector"), dims, scale)
            number, distance, _ = search.value.nearest(vectors)
            order = np.argsort(number, kind="stable")
            found, at = np.unique(number[order], return_index=True)
            if len(found):
                n[found] += np.diff(np.concatenate((at, [len(order)])))
                inertia[found] += np.add.reduceat(distance[order], at)
                sums[found] += np.add.reduceat(vectors[order], at, axis=0)
        some = np.flatnonzero(n)
        offsets = pa.array(np.arange(len(some) + 1, dtype=np.int32) * dims)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some]), pa.array(inertia[some]), pa.ListArray.from_arrays(offsets, pa.array(sums[some].ravel()))], names=["cluster", "n", "inertia", "sums"])

    parts = kept.select("vector").mapInArrow(give_back(run), "cluster long, n long, inertia long, sums array<long>")
    total = [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(dims)]
    return parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("inertia").alias("inertia"), *total).collect()


def fit(kept: DataFrame, k: int, rounds: int, scale: float, seed: int) -> np.ndarray:
    centroids = first_centroids(kept, k, scale, seed)
    for _ in range(rounds if len(centroids) else 0):
        for row in _totals(kept, centroids, scale):
            sums = [row[f"s{i}"] for i in range(centroids.shape[1])]
            centroids[row["cluster"]] = [s // row["n"] for s in sums]
    return centroids


def cluster_vectors(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 16, rounds: int = 3, dims: int = 64, scale: float = 64.0, seed: int = 1) -> DataFrame:
    """Per kept vector: id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256 (of the components of the
    final centroid in decimal, joined by commas).

    k * dims numbers are sent to all tasks; dims is at most 64."""
    if not 1 <= dims <= 64 or not 1 <= k * dims <= 1 << 22:
        raise ValueError("at most 64 components and 4 million numbers in all centroids")
    spark = vectors.sparkSession
    kept = vectors.where(_kept(F.col(vector_col), dims)).select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
    schema = T.StructType([T.StructField(id_col, vectors.schema[id_col].dataType), *T.StructType.fromDDL("cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string").fields])
    centroids = fit(kept, k, rounds, scale, seed)
    if not len(centroids):
        return spark.createDataFrame([], schema)
    of = np.zeros(len(centroids), dtype=np.int64)
    for row in _totals(kept, centroids, scale):
        of[row["cluster"]] = row["inertia"]
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    total = int(of.sum())
    model = spark.sparkContext.broadcast((Search.of(centroids), of, pa.array(digests)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, inertia, names = model.value
        for batch in _blocks(batches):
            number, distance, _ = search.nearest(_integers(batch.column("vector"), dims, scale))
            columns = [pa.array(number.astype(np.int32)), pa.array(distance), pa.array(inertia[number]), pa.array(np.full(len(number), total, dtype=np.int64)), names.take(pa.array(number))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], names=schema.names)

    return kept.mapInArrow(give_back(run), schema)
