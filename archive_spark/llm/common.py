"""Shared helpers: the shared folder, Arrow batches, and byte-level text arithmetic.

Text helpers work on the UTF-8 bytes of many texts at once. Separators in all the word definitions used here are
ASCII, so cutting bytes cuts code points correctly.
"""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import bound_batches  # noqa: F401

#: The separators of `[^\x20\x09-\x0D]+`.
SPACES = b"\t\n\v\f\r "
#: About this many bytes of text are worked on at once.
SLICE_BYTES = 1 << 18
#: Rows up to which a table of numbers (up to some 32 bytes each) is broadcast; longer ones are joined by shuffle.
BROADCAST_ROWS = 500_000

_own_dir: dict[str, str] = {}


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share, `spark.checkpoint.dir`. Only a local session may do without it; it
    gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        base = _own_dir.setdefault(app, "file://" + tempfile.mkdtemp(prefix="archive-spark-"))
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, path: str) -> None:
    """Row groups are small, as a writer holds one in memory, and hashes gain nothing from dictionaries."""
    df.write.option("parquet.block.size", 16 << 20).option("parquet.enable.dictionary", False).parquet(path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back, which cuts the lineage."""
    path = shared_path(df.sparkSession, name)
    write_table(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Written intermediate tables of one call, deleted together once nothing reads them any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write a table to the shared folder and read it back, which cuts the lineage."""
        path = shared_path(self.spark, name)
        self.paths.append(path)
        write_table(df, path)
        return self.spark.read.schema(df.schema).parquet(path)

    def small(self, df: DataFrame, name: str) -> DataFrame:
        """The same, to be broadcast if its rows were counted and are few. Rows must be a few numbers or short keys."""
        df = self.table(df, name)
        return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df

    def clear(self) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsparkSession.sessionState().newHadoopConf()
        for path in self.paths:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)
        self.paths.clear()


def fresh(columns: list[str], *names: str) -> list[str]:
    """Names for internal columns that none of the given columns has (case does not count)."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def give_back(run):
    """Wraps a function over Arrow batches: when a task ends, its worker returns freed memory to the system."""

    def wrapped(batches):
        yield from run(batches)
        release_memory()

    return wrapped


def release_memory() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not every C library has it
        pass


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each piece holds about `limit` bytes of the text column, one row at least."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends, at = np.cumsum(sizes, dtype=np.int64), 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes with a newline after each text, and where each text starts and ends."""
    buffer = np.frombuffer(b"\n".join([*texts, b""]), dtype=np.uint8)
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    starts = np.cumsum(lengths + 1) - lengths - 1
    return buffer, starts, starts + lengths


def byte_table(chars: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[np.frombuffer(chars, dtype=np.uint8)] = True
    return table


def word_spans(buffer: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that are no separators, and the mask of those bytes."""
    inside = ~separators[buffer]
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    return edges[0::2], edges[1::2], inside


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_random = np.random.default_rng(20240229)
_BYTE = _random.integers(1, 1 << 63, size=256, dtype=np.uint64) | np.uint64(1)
_FACTORS = _random.integers(1, 1 << 63, size=64, dtype=np.uint64) | np.uint64(1)
_SIZES = np.arange(64, dtype=np.uint64) * _FACTORS[62]
_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, dtype=np.uint64)


def _power_table(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.cumprod(np.concatenate(([np.uint64(1)], np.full(max(n, 64), _BASE))), dtype=np.uint64)
    return _powers


def word_hashes(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray, inside: np.ndarray, fold: bool = False) -> np.ndarray:
    """A 64-bit hash of each word; fold: A-Z count as a-z."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    table = _BYTE.copy()
    if fold:
        table[65:91] = table[97:123]
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum()), dtype=np.int64) - np.repeat(first, lengths)
    terms = table[buffer[inside]] * _power_table(int(lengths.max()))[place]
    return mix(np.add.reduceat(terms, first) + lengths.astype(np.uint64) * _FACTORS[63])


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of `size` neighbouring words, wherever texts end."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(n, dtype=np.uint64)
    for i in range(size):
        total += hashes[i : i + n] * _FACTORS[i]
    return mix(total + _SIZES[size])


def text_of(positions: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which text each byte position is in."""
    return np.searchsorted(starts, positions, "right") - 1


def arrays(type_: pa.DataType, counts: np.ndarray, values: np.ndarray) -> pa.ListArray:
    """A list column from flat values and the length of each list."""
    offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=type_))
