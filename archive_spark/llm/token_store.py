"""Token-id store: blocks of separately compressed documents with a shared zstandard dictionary and an offset index.

The dictionary is trained on the serialized ids of a bounded sample of documents. Each document's ids (little-endian
unsigned 32-bit) are compressed by themselves. A block holds neighbouring documents in ascending id order:

    magic b"TIDS1\0", 32 bytes SHA-256 of the dictionary, unsigned 32-bit number of documents n,
    n + 1 unsigned 64-bit frame offsets (from the end of the index), n unsigned 32-bit token counts, then the frames.

Blocks are rows of a Parquet table (part, number, ids, n_tokens, data), and an index has where each starts, so that Spark's own writers commit
them to any store; `data` is written uncompressed as it is. The dictionary lies beside it in a table of one row.

Defined results: a null text is empty, and every document has its end id; documents with equal or null ids follow one
another in the order of their ids' bytes (null first); an empty table gives an empty store.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, give_back, shared_path, slices
from .tokens import ENCODE_BYTES, encoder

MAGIC = b"TIDS1\0"
#: Bounds of the sample for the dictionary (documents, and bytes of each one's ids) and of the dictionary itself.
SAMPLE_DOCUMENTS, SAMPLE_BYTES, DICTIONARY_BYTES, LEVEL = 1000, 16 << 10, 64 << 10, 1
#: Frame bytes after which a block ends.
BLOCK_BYTES = 4 << 20


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """Empty if the samples are too few or too small to train on."""
    samples = [x for x in samples if len(x) >= 8]
    if len(samples) < 16 or sum(map(len, samples)) < 4 * size:
        size = max(256, sum(map(len, samples)) // 8)
    try:
        return zstandard.train_dictionary(size, samples).as_bytes() if len(samples) >= 16 else b""
    except zstandard.ZstdError:
        return b""


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    if data:
        data.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_checksum=False, write_dict_id=False)


def _decompressor(dictionary: bytes) -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdDecompressor()


def pack_block(frames: list[bytes], counts: list[int], dictionary_hash: bytes) -> bytes:
    offsets = np.concatenate(([0], np.cumsum([len(f) for f in frames]))).astype("<u8")
    return b"".join((MAGIC, dictionary_hash, struct.pack("<I", len(frames)), offsets.tobytes(), np.array(counts, dtype="<u4").tobytes(), *frames))


class Block:
    """Reads one block; any document is found by the offset index alone."""

    def __init__(self, data: bytes, dictionary: bytes):
        if data[:6] != MAGIC or data[6:38] != hashlib.sha256(dictionary).digest():
            raise ValueError("no block of this store, or written with another dictionary")
        n = struct.unpack_from("<I", data, 38)[0]
        self.data, self.base = data, 42 + 8 * (n + 1) + 4 * n
        self.offsets = np.frombuffer(data, dtype="<u8", count=n + 1, offset=42)
        self.counts = np.frombuffer(data, dtype="<u4", count=n, offset=42 + 8 * (n + 1))
        self.decompress = _decompressor(dictionary).decompress

    def __len__(self) -> int:
        return len(self.counts)

    def raw(self, i: int) -> bytes:
        frame = self.data[self.base + int(self.offsets[i]) : self.base + int(self.offsets[i + 1])]
        return self.decompress(frame, max_output_size=4 * int(self.counts[i]))

    def ids(self, i: int) -> np.ndarray:
        return np.frombuffer(self.raw(i), dtype="<u4")


def _serialized(texts: list[str], tokenizer: str, keeps_space: bool, end_id: int) -> list[bytes]:
    end = np.array([end_id], dtype="<u4").tobytes()
    return [x.astype("<u4", copy=False).tobytes() + end for x in encoder(tokenizer, keeps_space).encode(texts)]


def write_store(documents: DataFrame, path: str, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, keeps_space: bool = False, sample: int = SAMPLE_DOCUMENTS, block_bytes: int = BLOCK_BYTES) -> None:
    """Encode once, compress where the text is read, then move only frames to their place in the order of ids."""
    spark = documents.sparkSession
    bound_batches(spark)
    base = documents.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    chosen = base.select("id").orderBy(F.xxhash64("id"), "id").limit(sample)  # a top-k of ids
    picked = base.join(F.broadcast(chosen.distinct()), "id").orderBy(F.xxhash64("id"), "id", "text").limit(sample)

    def serialize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", ENCODE_BYTES):
            raw = [x[:SAMPLE_BYTES] for x in _serialized(batch.column("text").to_pylist(), tokenizer, keeps_space, end_id)]
            yield pa.RecordBatch.from_arrays([pa.array(raw, pa.binary())], names=["raw"])

    dictionary = train_dictionary([bytes(r["raw"]) for r in picked.mapInArrow(serialize, "raw binary").collect()])
    spark.createDataFrame([(bytearray(dictionary), hashlib.sha256(dictionary).hexdigest())], "dictionary binary, sha256 string").coalesce(1).write.parquet(f"{path}/dictionary")
    shared = spark.sparkContext.broadcast(dictionary)  # at most DICTIONARY_BYTES

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = _compressor(shared.value).compress
        for batch in slices(batches, "text", ENCODE_BYTES):
            raw = _serialized(batch.column("text").to_pylist(), tokenizer, keeps_space, end_id)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([len(x) // 4 for x in raw], pa.int64()), pa.array([compress(x) for x in raw], pa.binary())], names=["id", "n", "frame"])

    id_field = T.StructField("id", base.schema["id"].dataType)
    encoded_path = shared_path(spark, "token-frames")
    base.mapInArrow(give_back(frames), T.StructType([id_field, T.StructField("n", T.LongType()), T.StructField("frame", T.BinaryType())])).write.option("compression", "none").parquet(encoded_path)
    # the range shuffle samples its input first, so that input is a written table
    ordered = spark.read.parquet(encoded_path).repartitionByRange(F.col("id").asc_nulls_first(), F.xxhash64("frame")).sortWithinPartitions(F.col("id").asc_nulls_first(), F.xxhash64("frame"))
    digest = hashlib.sha256(dictionary).digest()

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, counts, held, size, number = [], [], [], 0, 0
        part = _partition()

        def flush() -> pa.RecordBatch:
            data = pack_block(held, counts, digest)
            columns = [pa.array([part]), pa.array([number]), pa.array([ids], pa.list_(kind)), pa.array([sum(counts)], pa.int64()), pa.array([data], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["part", "number", "ids", "n_tokens", "data"])

        for batch in batches:
            kind = batch.column("id").type
            for i, n, frame in zip(batch.column("id").to_pylist(), batch.column("n").to_pylist(), batch.column("frame").to_pylist()):
                ids.append(i), counts.append(n), held.append(frame)
                size += len(frame)
                if size >= block_bytes:
                    yield flush()
                    ids, counts, held, size, number = [], [], [], 0, number + 1
        if ids:
            yield flush()

    schema = T.StructType([T.StructField("part", T.LongType()), T.StructField("number", T.LongType()), T.StructField("ids", T.ArrayType(id_field.dataType)), T.StructField("n_tokens", T.LongType()), T.StructField("data", T.BinaryType())])
    ordered.mapInArrow(blocks, schema).write.option("compression", "none").parquet(f"{path}/blocks")
    # one row a block: where each block's tokens start in the whole. Sums of the parts are few, one for each task that wrote
    index = spark.read.parquet(f"{path}/blocks").select("part", "number", "n_tokens", F.size("ids").alias("n_documents"))
    before, total = [], 0
    for r in index.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect():
        before.append((r["part"], total))
        total += r["n"]
    starts = spark.createDataFrame(before, "part long, part_start long")
    within = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("number")) - F.col("n_tokens")
    index.join(F.broadcast(starts), "part").withColumn("start", within + F.col("part_start")).drop("part_start").write.parquet(f"{path}/index")


def _partition() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def read_store(spark: SparkSession, path: str, id_type: T.DataType | None = None) -> DataFrame:
    """Per document: id, start (ids of all documents before it), n_tokens, ids (bytes), ids_crc32."""
    row = spark.read.parquet(f"{path}/dictionary").first()
    shared = spark.sparkContext.broadcast(bytes(row["dictionary"]))
    blocks = spark.read.parquet(f"{path}/blocks").drop("n_tokens")
    starts = spark.read.parquet(f"{path}/index").select("part", "number", "start")
    id_type = blocks.schema["ids"].dataType.elementType
    schema = T.StructType([T.StructField("id", id_type), *T.StructType.fromDDL("start long, n_tokens long, ids binary, ids_crc32 long").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block = Block(batch.column("data")[i].as_py(), shared.value)
                raw = [block.raw(k) for k in range(len(block))]
                counts = block.counts.astype(np.int64)
                begin = batch.column("start")[i].as_py() + np.cumsum(counts) - counts
                columns = [batch.column("ids")[i].values, pa.array(begin), pa.array(counts), pa.array(raw, pa.binary()), pa.array([zlib.crc32(x) for x in raw], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return blocks.join(F.broadcast(starts) if starts.count() <= 100_000 else starts, ["part", "number"]).mapInArrow(run, schema)


def read_documents(spark: SparkSession, path: str, ids: list) -> dict:
    """Short-document access: the ids of a few documents, by the offset index of the blocks that hold them."""
    dictionary = bytes(spark.read.parquet(f"{path}/dictionary").first()["dictionary"])
    found = {}
    wanted = F.array(*[F.lit(i) for i in ids])
    for row in spark.read.parquet(f"{path}/blocks").where(F.arrays_overlap("ids", wanted)).toLocalIterator():
        block = Block(bytes(row["data"]), dictionary)
        found.update((i, block.ids(k)) for k, i in enumerate(row["ids"]) if i in ids)
    return found
