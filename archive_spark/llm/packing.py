"""Sum-of-squares packing of tokenised documents into sequences of bounded length.

Documents become token pieces: one that is longer than a sequence is cut, its first piece taking the remainder, so all
later pieces fill a sequence each. The other pieces go longest first, each into the open sequence that makes the sum,
over all residual gaps, of the squared number of open sequences with that gap smallest; a sequence is opened only where
no open one has room, as sequences are to be few and none comes later that could use the gaps. Pieces are dealt into shards by a hash of their document, each packed by itself; a shard costs at most its last open sequences.

Defined results: a null text is empty and a document always ends with the end id, so every document has a piece;
repeated rows are packed one by one; an empty table gives an empty result; null ids are kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, bound_batches, fresh, give_back, release_memory, slices
from .tokens import ENCODE_BYTES, MAX_PIECES, PieceEncoder, encoder

CAPACITY = 1024
#: Rows of a shard that is packed by itself.
SHARD_ROWS = 20_000


def token_pieces(documents: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, capacity: int = CAPACITY, keeps_space: bool = True, max_pieces: int = MAX_PIECES, per_task: bool = False) -> DataFrame:
    """Per piece: id, piece (from 0), start (the document's ids before it), length, ids (little-endian unsigned 32-bit).

    per_task: each task has an encoder of its own, which goes with it; else workers keep theirs for later tasks, which
    is faster and takes memory from the jobs that follow.
    """
    schema = T.StructType([documents.schema[id_col], *T.StructType.fromDDL("piece int, start long, length long, ids binary").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = (PieceEncoder if per_task else encoder)(tokenizer, keeps_space, max_pieces).encode
        end = np.array([end_id], dtype="<u4")
        for batch in slices(batches, text_col, ENCODE_BYTES):
            texts = [x or "" for x in batch.column(text_col).to_pylist()]
            row, piece, start, length, ids = [], [], [], [], []
            for i, found in enumerate(encode(texts)):
                found = np.concatenate((found, end)).astype("<u4", copy=False)
                raw, at, to = found.tobytes(), 0, len(found) % capacity or capacity
                n = 0
                while at < len(found):
                    row.append(i), piece.append(n), start.append(at), length.append(to - at), ids.append(raw[4 * at : 4 * to])
                    n, at, to = n + 1, to, to + capacity
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_col).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())], names=schema.names
            )

    return documents.select(F.col(id_col), F.col(text_col)).mapInArrow(give_back(run), schema)


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """The sequence and the offset of each piece, pieces being placed in the given order.

    With N(g) open sequences of gap g, moving one from gap g to g - s adds 2 (N(g - s) - N(g) + 1) to the sum of
    squares; a gap of 0 counts as nothing.
    """
    counts = np.zeros(capacity + 1, dtype=np.int64)
    open_by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    sequence, offset = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    made = 0
    for i, s in enumerate(lengths.tolist()):
        gaps, gap = counts[s:capacity], capacity  # gaps s .. capacity - 1
        if gaps.any():
            gain = 2 * (counts[: capacity - s] - gaps) + 2
            gain[0] = 1 - 2 * counts[s]  # closed: nothing is added at gap 0
            gain[gaps == 0] = np.iinfo(np.int64).max
            gap = s + int(np.argmin(gain))
        if gap == capacity:
            bin_, made = made, made + 1
        else:
            bin_ = open_by_gap[gap].pop()
            counts[gap] -= 1
        sequence[i], offset[i] = bin_, capacity - gap
        if left := gap - s:
            counts[left] += 1
            open_by_gap[left].append(bin_)
    return sequence, offset


def pack_pieces(pieces: DataFrame, *, id_col: str = "doc_id", capacity: int = CAPACITY, shards: int = 1) -> DataFrame:
    """Adds sequence_id and offset; carries every other column of the pieces.

    A full piece gets a sequence of its own.
    """
    fields = pieces.schema.fields
    schema = T.StructType([*fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    shard = F.pmod(F.xxhash64(F.col(id_col), F.col("piece"), F.lit(11)), F.lit(shards))
    ties = [c for c in (id_col, "start", "ids_crc32") if c in pieces.columns]

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        # places only: rows, which may hold ids, stay where they are
        order = pc.sort_indices(table.select(ties), sort_keys=[(c, "ascending") for c in ties]).to_numpy()
        lengths = table.column("length").to_numpy()
        order = order[np.argsort(-lengths[order], kind="stable")]  # longest first
        sequence, offset = np.empty(len(order), dtype=np.int64), np.empty(len(order), dtype=np.int64)
        sequence[order], offset[order] = sum_of_squares(lengths[order], capacity)
        base = key[0].as_py() << 32
        table = table.drop_columns(["_shard"])
        release_memory()
        return table.append_column("sequence_id", pa.array(sequence + base)).append_column("offset", pa.array(offset))

    return pieces.withColumn("_shard", shard).groupBy("_shard").applyInArrow(run, schema)


def pack_documents(documents: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS, keep_ids: bool = True, keeps_space: bool = True, max_pieces: int = MAX_PIECES, per_task: bool = False) -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32, sequence_id, offset, and the ids themselves if keep_ids."""
    bound_batches(documents.sparkSession)
    pieces = token_pieces(documents, tokenizer, id_col=id_col, text_col=text_col, end_id=end_id, capacity=capacity, keeps_space=keeps_space, max_pieces=max_pieces, per_task=per_task).withColumn("ids_crc32", F.crc32("ids"))
    shards = max(1, math.ceil(documents.count() / shard_rows))
    if not keep_ids:
        return pack_pieces(pieces.drop("ids"), id_col=id_col, capacity=capacity, shards=shards)
    # ids are written once and wait; only lengths are packed, and places come back by the number of the written row
    key = fresh([id_col], "_row")[0]
    scratch = Scratch(documents.sparkSession)
    pieces = scratch.table(pieces.withColumn(key, F.monotonically_increasing_id()), "token-pieces")
    placed = pack_pieces(pieces.drop("ids"), id_col=id_col, capacity=capacity, shards=shards)
    return pieces.join(scratch.small(placed.select(key, "sequence_id", "offset"), "places"), key).drop(key)


def sequences(packed: DataFrame) -> DataFrame:
    """Training rows: sequence_id, ids of the whole sequence (little-endian unsigned 32-bit), n_tokens."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return packed.groupBy("sequence_id").agg(joined.alias("ids"), F.sum("length").alias("n_tokens"))
