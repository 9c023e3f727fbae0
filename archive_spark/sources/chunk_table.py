"""The chunk table: Parquet in buckets by hash of the file, in versions; and its continuous feed.

Each change writes the buckets that it touches under a new version and then publishes a manifest, one small file that says
which version of each bucket holds. Readers take the newest manifest, so they see all of a change or none, and a bucket
without rows is simply not in it. A change that fails before it publishes leaves nothing that is read. There is one writer
at a time; a second one that publishes the same version fails.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators import archive

BUCKET, BUCKETS, VERSION = "file_bucket", 64, "table_version"


@dataclass(frozen=True)
class Manifest:
    version: int
    buckets: int
    schema: T.StructType
    held: dict[int, int]  # bucket to version


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, at = _fs(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []


def versions(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(n[:-5]) for n in _names(spark, f"{path}/manifests") if n.endswith(".json") and n[:-5].isdigit())


def manifest(spark: SparkSession, path: str, version: int | None = None) -> Manifest | None:
    """The newest manifest, or that of a version; none where there is no table."""
    known = versions(spark, path)
    if not known:
        return None
    m = json.loads(spark.read.option("wholetext", True).text(f"{path}/manifests/{known[-1] if version is None else version}.json").first()[0])
    return Manifest(m["version"], m["buckets"], T.StructType.fromJson(m["schema"]), {int(b): v for b, v in m["held"].items()})


def _publish(spark: SparkSession, path: str, m: Manifest) -> None:
    fs, at = _fs(spark, f"{path}/manifests/{m.version}.json")
    draft = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifests/_{uuid.uuid4().hex}")
    out = fs.create(draft, True)
    out.write(bytearray(json.dumps({"version": m.version, "buckets": m.buckets, "schema": m.schema.jsonValue(), "held": m.held}).encode()))
    out.close()
    if fs.exists(at) or not fs.rename(draft, at):
        raise RuntimeError(f"version {m.version} of {path} was published by another writer")


def read_chunks(spark: SparkSession, path: str, version: int | None = None, only: list[int] | None = None) -> DataFrame:
    """All chunks, of the newest version or of a given one; only: of these buckets."""
    m = manifest(spark, path, version)
    if m is None:
        raise ValueError(f"no chunk table at {path}")
    paths = [f"{path}/data/{VERSION}={v}/{BUCKET}={b}" for b, v in sorted(m.held.items()) if only is None or b in only]
    if not paths:
        return spark.createDataFrame([], m.schema)
    return spark.read.schema(m.schema).option("basePath", f"{path}/data").parquet(*paths).select(*m.schema.names)


def _placed(chunks: DataFrame, buckets: int) -> DataFrame:
    return chunks.withColumn(BUCKET, F.pmod(F.xxhash64("file_id"), F.lit(buckets)).cast("int"))


def _change(chunks: DataFrame, path: str, before: Manifest | None, buckets: int, touched: list[int] | None) -> None:
    """Writes the touched buckets (all, if none are given) anew and publishes them."""
    spark = chunks.sparkSession
    version = before.version + 1 if before else 1
    at = f"{path}/data/{VERSION}={version}"
    # rows are gathered by bucket; adaptive execution splits a large one among tasks. What an unpublished try left goes
    _placed(chunks, buckets).hint("rebalance", BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(at)
    held = {} if touched is None or before is None else {b: v for b, v in before.held.items() if b not in touched}
    written = [int(n.split("=")[1]) for n in _names(spark, at) if n.startswith(f"{BUCKET}=")]
    _publish(spark, path, Manifest(version, buckets, before.schema if before else chunks.schema, held | {b: version for b in written}))


def write_chunks(chunks: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """A new table, or all of its rows anew; buckets are fixed for the life of the table."""
    before = manifest(chunks.sparkSession, path)
    _change(chunks, path, before, before.buckets if before else buckets, None)


def replace_files(fresh: DataFrame, path: str, gone: DataFrame | None = None) -> None:
    """All rows of the files in `fresh`, and of those in `gone` (file_id), are replaced; only their buckets are read and written."""
    spark = fresh.sparkSession
    before = manifest(spark, path)
    if before is None:
        raise ValueError(f"no chunk table at {path}")
    files = fresh.select("file_id") if gone is None else fresh.select("file_id").unionByName(gone.select("file_id"))
    files = files.distinct()
    touched = [r[0] for r in _placed(files, before.buckets).select(BUCKET).distinct().collect()]  # no more than there are buckets
    kept = read_chunks(spark, path, before.version, touched).join(files, "file_id", "left_anti")
    _change(kept.select(*before.schema.names).unionByName(fresh.select(*before.schema.names)), path, before, before.buckets, touched)


def delete_files(gone: DataFrame, path: str) -> None:
    """gone: file_id. Their rows go."""
    m = manifest(gone.sparkSession, path)
    replace_files(gone.sparkSession.createDataFrame([], m.schema), path, gone)


def clear(spark: SparkSession, path: str) -> None:
    """The table is empty from now on; earlier versions stay until they are vacuumed."""
    m = manifest(spark, path)
    _publish(spark, path, Manifest(m.version + 1, m.buckets, m.schema, {}))


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Deletes what none of the last `keep` versions holds. Readers of older versions must be done."""
    known = versions(spark, path)
    stay = {f"{VERSION}={v}/{BUCKET}={b}" for n in known[-keep:] for b, v in manifest(spark, path, n).held.items()}
    for n in known[:-keep]:
        fs, at = _fs(spark, f"{path}/manifests/{n}.json")
        fs.delete(at, False)
    for v in _names(spark, f"{path}/data"):
        for b in _names(spark, f"{path}/data/{v}"):
            if b.startswith(BUCKET) and f"{v}/{b}" not in stay:
                fs, at = _fs(spark, f"{path}/data/{v}/{b}")
                fs.delete(at, True)


def ingest(items: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """items: a stream of structured items, those of one file in one arrival. Each micro-batch is cut into chunks that replace
    their files; a file of which no chunk is made any more goes.

    Replacing a file twice gives the same table, so a repeated batch leaves nothing behind."""

    def replace(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            replace_files(archive.chunk_chain(archive.headings(batch)), path, batch.select("file_id").distinct())

    return items.writeStream.foreachBatch(replace).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
