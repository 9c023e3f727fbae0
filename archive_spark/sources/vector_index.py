"""A vector index on disk: cells around centroids, in blocks with the angles that they span, and searches that skip cells.

Centroids are fitted to a bounded sample (SAMPLE_NUMBERS numbers, the rows with the smallest hash of their vector); every row
is then in the cell of its nearest centroid. A cell is written in blocks of at most BLOCK_ROWS rows, in order of their angle
to the centroid, so that a hot cell is many blocks in many tasks. Tables under the path of the index:

- cells: cell, centroid, n, low and high (least and greatest angle of its rows to the centroid);
- blocks: cell, low, high, ids, numbers (the vectors one after another);
- stats: one row, dims and probes.

A search reads the `probes` nearest cells of each query; as many as find RECALL of the sample's own neighbours, unless given.
That is approximate. An exact search takes the k-th best score found
there as a bound: a row at angle a to a centroid is at least |a - t| from a query at angle t to it, so cells and blocks that
can't reach the bound are skipped, and the others are read. It returns what a scan of all rows returns.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..operators.retrieval import _top, _unit, best
from ..session import bound_batches

#: Numbers in the sample that centroids are fitted to (about 31,000 vectors of 64), and in all centroids together.
SAMPLE_NUMBERS, CENTROID_NUMBERS = 2_000_000, 2_000_000
ROUNDS, MAX_CELLS = 8, 4096
BLOCK_ROWS, QUERY_BLOCK = 512, 512
#: Numbers in the vectors of all pairs of query and cell that may be sent to every task; more are joined by shuffle.
BROADCAST_NUMBERS = 4_000_000
#: The part of the NEIGHBOURS nearest sampled rows of each of TRIALS sampled rows that lies in the cells that a search reads.
RECALL, NEIGHBOURS, TRIALS = 0.95, 10, 512
#: Scores are rounded to six places and angles are computed from rounded cosines; bounds are looser by this.
SLACK = 2e-6


@dataclass(frozen=True)
class VectorIndex:
    spark: SparkSession
    path: str
    dims: int
    probes: int

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def centroids(self) -> np.ndarray:
        rows = self.table("cells").select("cell", "centroid").orderBy("cell").collect()
        return np.array([r["centroid"] for r in rows], float).reshape(len(rows), self.dims)


def _angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1.0, 1.0))


def _fit(sample: np.ndarray, cells: int) -> np.ndarray:
    """Spherical k-means from the first distinct vectors of the sample; a centroid without rows stays where it is."""
    _, first = np.unique(np.round(sample, 9), axis=0, return_index=True)
    centres = sample[np.sort(first)[:cells]].copy()
    for _ in range(ROUNDS):
        near = np.concatenate([(sample[i : i + 4096] @ centres.T).argmax(axis=1) for i in range(0, len(sample), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        norm = np.sqrt((sums * sums).sum(axis=1))
        moved = norm > 1e-9
        centres[moved] = sums[moved] / norm[moved, None]
    return centres


def _probes(sample: np.ndarray, centres: np.ndarray) -> int:
    """How many cells hold RECALL of the sample's neighbours; neighbours in all rows are nearer, and so easier to find."""
    near = np.concatenate([(sample[i : i + 4096] @ centres.T).argmax(axis=1) for i in range(0, len(sample), 4096)])
    asked = sample[:: max(1, len(sample) // TRIALS)][:TRIALS]
    place = np.argsort(np.argsort(-(asked @ centres.T), axis=1, kind="stable"), axis=1)
    k = min(NEIGHBOURS + 1, len(sample))
    cells = near[np.argsort(-(asked @ sample.T), axis=1)[:, :k]]
    ranks = np.take_along_axis(place, cells, axis=1)[:, 1:]  # the first is the row itself
    return int(np.quantile(ranks, RECALL, method="higher")) + 1 if ranks.size else len(centres)


def open_vector_index(spark: SparkSession, path: str) -> VectorIndex:
    stats = spark.read.parquet(f"{path}/stats").first()
    return VectorIndex(spark, path, stats["dims"], stats["probes"])


def _blocks(id_type: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows sorted by cell and angle become blocks; only the rows of an open block are kept between batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(rows: pa.Table) -> pa.RecordBatch:
            angle, ids = rows.column("angle"), rows.column("id").combine_chunks()
            numbers = rows.column("vector").combine_chunks().flatten()
            n = [0, len(ids)]
            one = [pa.array([rows.column("cell")[0].as_py()], pa.int32()), pa.array([angle[0].as_py()]), pa.array([angle[len(ids) - 1].as_py()])]
            lists = [pa.ListArray.from_arrays(pa.array(n, pa.int32()), ids.cast(id_type)), pa.ListArray.from_arrays(pa.array([0, len(numbers)], pa.int32()), numbers)]
            return pa.RecordBatch.from_arrays(one + lists, names=["cell", "low", "high", "ids", "numbers"])

        held: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            cell = rows.column("cell").to_numpy()
            ends = np.flatnonzero(np.diff(cell)) + 1
            starts = [0, *ends.tolist(), len(cell)]
            cuts = sorted({c for a, b in zip(starts, starts[1:]) for c in range(a, b, BLOCK_ROWS)} | {len(cell)})
            for a, b in zip(cuts[:-2], cuts[1:-1]):
                yield close(rows.slice(a, b - a))
            held = rows.slice(cuts[-2]) if len(cuts) > 1 else None
        if held is not None and held.num_rows:
            yield close(held)

    return run


def write_vector_index(vectors: DataFrame, path: str, cells: int | None = None, sample_numbers: int = SAMPLE_NUMBERS) -> VectorIndex:
    """vectors: id, vector; other columns stay out. Rows whose vector is null, has a null or non-finite number, has no length, or is not of the
    commonest size (of equally common ones the smaller) are not indexed, as no cosine is defined for them or with most queries.

    cells: as many as the square root of the rows, at most MAX_CELLS and so many that all centroids hold CENTROID_NUMBERS numbers."""
    spark = vectors.sparkSession
    rows = vectors.select("id", F.col("vector").cast("array<double>").alias("vector"))
    sizes = rows.where("size(vector) > 0").groupBy(F.size("vector").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    dims, total = (sizes["dims"], sizes["count"]) if sizes else (0, 0)
    limit = max(1, sample_numbers // max(dims, 1))
    drawn = rows.where(F.size("vector") == dims).select("vector").orderBy(F.xxhash64("vector")).limit(limit).toArrow() if dims else None
    sample = _unit(drawn.column("vector").combine_chunks(), dims)[0] if dims else np.zeros((0, 0))
    wanted = cells or min(MAX_CELLS, max(1, math.isqrt(total)))
    centres = _fit(sample, max(1, min(wanted, CENTROID_NUMBERS // max(dims, 1)))) if len(sample) else np.zeros((0, dims))
    id_type = vectors.schema["id"].dataType
    placed = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("angle", T.DoubleType()), T.StructField("id", id_type), T.StructField("vector", T.ArrayType(T.DoubleType()))])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches if len(centres) else ():
            unit, at = _unit(batch.column("vector"), dims)
            for i in range(0, len(unit), 1024):
                cosine = unit[i : i + 1024] @ centres.T
                near = cosine.argmax(axis=1)
                where = pa.array(at[i : i + 1024])
                yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), pa.array(_angle(cosine[np.arange(len(near)), near])), batch.column("id").take(where), batch.column("vector").take(where)], names=placed.names)

    schema = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType()), T.StructField("ids", T.ArrayType(id_type)), T.StructField("numbers", T.ArrayType(T.DoubleType()))])
    # ranges of cell, angle and a hash of the vector: a hot cell, and even one angle in it, is cut into several tasks
    spread = rows.mapInArrow(place, placed).withColumn("salt", F.xxhash64("id"))
    spread = spread.repartitionByRange("cell", "angle", "salt").sortWithinPartitions("cell", "angle").drop("salt")
    spread.mapInArrow(_blocks(to_arrow_type(id_type)), schema).write.mode("overwrite").parquet(f"{path}/blocks")
    spans = spark.read.parquet(f"{path}/blocks").groupBy("cell").agg(F.sum(F.size("ids")).alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    named = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centroid array<double>")
    named.join(spans, "cell", "left").withColumn("n", F.coalesce("n", F.lit(0))).coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")
    probes = _probes(sample, centres) if len(sample) else 1
    spark.createDataFrame([(dims, probes)], "dims int, probes int").coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")
    return VectorIndex(spark, path, dims, probes)


def _near(queries: DataFrame, index: VectorIndex, probes: int | None) -> DataFrame:
    """query_id, vector, cell, angle: the nearest cells of each query, or all of them."""
    centres, dims = index.centroids(), index.dims
    out = T.StructType([queries.schema["query_id"], T.StructField("vector", T.ArrayType(T.DoubleType())), T.StructField("cell", T.IntegerType()), T.StructField("angle", T.DoubleType())])
    take = min(probes or len(centres), len(centres))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches if take else ():
            unit, at = _unit(batch.column("vector"), dims)
            for i in range(0, len(unit), 256):
                cosine = unit[i : i + 256] @ centres.T
                cell = np.argsort(-cosine, axis=1, kind="stable")[:, :take]
                row = np.repeat(np.arange(len(cosine)), take)
                where = pa.array(at[i + row])
                yield pa.RecordBatch.from_arrays([batch.column("query_id").take(where), batch.column("vector").take(where), pa.array(cell.ravel().astype(np.int32)), pa.array(_angle(cosine[row, cell.ravel()]))], names=out.names)

    return queries.select("query_id", F.col("vector").cast("array<double>").alias("vector")).mapInArrow(near, out)


def _reach(angle: Column) -> Column:
    """The best cosine that rows between `low` and `high` from a centroid can have with a query at `angle` from it."""
    return F.cos(F.greatest(F.lit(0.0), angle - F.col("high"), F.col("low") - angle))


def _scores(near: DataFrame, index: VectorIndex, n_queries: int, per_query: int, k: int) -> DataFrame:
    """near: query_id, vector, cell, angle, floor. The best k rows of each query in each block that may reach its floor.

    Queries of a cell are packed into blocks, so that a pair of joined rows is one product of two bounded matrices."""
    dims = index.dims
    id_type = index.table("blocks").schema["ids"].dataType.elementType
    out = T.StructType([near.schema["query_id"], T.StructField("id", id_type), T.StructField("score", T.DoubleType())])
    block = F.pmod(F.xxhash64("query_id", "vector"), F.lit(max(1, -(-n_queries // QUERY_BLOCK))))
    asked = near.groupBy("cell", block.alias("qb")).agg(F.collect_list(F.struct("query_id", "vector", "angle", "floor")).alias("q"))
    asked = asked.select("cell", *[F.col(f"q.{c}").alias(f"q_{c}") for c in ("query_id", "angle", "floor")], F.flatten("q.vector").alias("q_numbers"))
    few = n_queries * per_query * dims <= BROADCAST_NUMBERS
    pairs = index.table("blocks").join(F.broadcast(asked) if few else asked, "cell").drop("qb")

    def unit(column: pa.ListArray, i: int) -> np.ndarray:
        m = column[i].values.to_numpy(zero_copy_only=False).reshape(-1, dims)
        return m / np.sqrt((m * m).sum(axis=1))[:, None]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            low, high = b.column("low").to_numpy(), b.column("high").to_numpy()
            for i in range(b.num_rows):
                angle, floor = (b.column(f"q_{c}")[i].values.to_numpy(zero_copy_only=False) for c in ("angle", "floor"))
                reach = np.cos(np.maximum(0.0, np.maximum(angle - high[i], low[i] - angle)))
                alive = np.flatnonzero(reach + SLACK >= floor)
                if not len(alive):
                    continue
                scores = np.round(unit(b.column("numbers"), i) @ unit(b.column("q_numbers"), i)[alive].T, 6)
                r, q = _top(scores, k)
                at = scores[r, q] >= floor[alive[q]]
                yield pa.RecordBatch.from_arrays([b.column("q_query_id")[i].values.take(pa.array(alive[q[at]])), b.column("ids")[i].values.take(pa.array(r[at])), pa.array(scores[r[at], q[at]])], names=out.names)

    return pairs.mapInArrow(score, out)


def vector_search(queries: DataFrame, index: VectorIndex, k: int, probes: int | None = None, exact: bool = False) -> DataFrame:
    """queries: query_id (one row each), vector. query_id, id, score, rank as retrieval.vector_topk gives them; queries without a cosine have no row.

    With exact, cells beyond the probed ones are read where their angles do not rule them out."""
    bound_batches(index.spark)  # a pair of blocks is some 0.5 MB, so thousands in a batch would be gigabytes
    n = queries.count()
    probes = probes or index.probes
    first = _near(queries, index, probes).withColumn("floor", F.lit(-2.0))
    found = best(_scores(first, index, n, probes, k), k)
    if not exact:
        return found
    floors = found.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("kth"))
    spans = index.table("cells").where("n > 0").select("cell", "low", "high")
    rest = _near(queries, index, None).join(first.select("query_id", "cell"), ["query_id", "cell"], "left_anti").join(F.broadcast(spans), "cell")
    rest = rest.join(floors, "query_id", "left").withColumn("floor", F.coalesce("kth", F.lit(-2.0)))
    rest = rest.where(_reach(F.col("angle")) + SLACK >= F.col("floor")).select("query_id", "vector", "cell", "angle", "floor")
    return best(found.drop("rank").unionByName(_scores(rest, index, n, index.table("cells").count(), k)), k)


def work(queries: DataFrame, index: VectorIndex, k: int, probes: int | None = None) -> DataFrame:
    """One row: pairs of query and row in all, in the probed cells, and in the cells that an exact search reads besides."""
    n = F.col("n")
    spans = index.table("cells").where("n > 0").select("cell", "low", "high", "n")
    near = _near(queries, index, probes or index.probes).join(F.broadcast(spans), "cell")
    floors = vector_search(queries, index, k, probes).groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("kth"))
    every = _near(queries, index, None).join(F.broadcast(spans), "cell").join(floors, "query_id", "left")
    reached = every.where(_reach(F.col("angle")) + SLACK >= F.coalesce("kth", F.lit(-2.0))).join(near.select("query_id", "cell"), ["query_id", "cell"], "left_anti")
    return every.agg(F.sum(n).alias("all_pairs")).crossJoin(near.agg(F.sum(n).alias("probed"))).crossJoin(reached.agg(F.coalesce(F.sum(n), F.lit(0)).alias("read_besides")))
