"""WARC archives of web captures, read back into a globally ordered capture index.

Writing: one record per page, in plain DataFrame functions. Captures with equal payloads share one `response` record
(the one with the smallest id); the others become `revisit` records. A record is text ending in two line ends, so
Spark's own text writer lays the archives out (`part-*.txt.gz`, gzip-compressed WARC/1.1) and commits them to any store.

Reading: each archive is inflated as a stream and cut by its Content-Length fields; its captures, sorted by URL key and
timestamp, are one locally sorted run, kept as a table. The external merge deals the runs into ranges of
(URL key, timestamp, id), so that one hot URL is spread over ranges too, and merges the runs' parts in each range by a
loser tree; ranges are as many as keep each to about RANGE_ROWS captures, so a task's memory does not grow with the
table. Ranges are in order, so captures by (shard, position) are in global order: the capture history of each URL.

Defined results: null html is an empty payload, a null URL is an empty one; null ids are written as `null`, never serve
as the response of others and are read back as null; repeated rows are written one by one; an empty table gives an
empty result.
"""

from __future__ import annotations

import base64
import hashlib
import math
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_path

#: The digits of base 32 as conv() writes them, and of RFC 4648.
_CONV_DIGITS, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Records in an archive file at most, and payload bytes from which a copy may be a revisit.
MAX_RECORDS, MIN_REVISIT_BYTES = 20_000, 0
#: Capture date where the table has none: this time and the id in seconds, from 0 again after so many.
EPOCH, DATE_SECONDS = 1_700_000_000, 10**9
#: Captures that are merged in one task, about.
RANGE_ROWS = 100_000

CAPTURE = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url_key string, captured_at long, archive string, record_offset long, record_length long"
_NAMES = [x.split()[0] for x in CAPTURE.split(", ")]
_TYPES = [pa.string() if x.endswith("string") else pa.int64() for x in CAPTURE.split(", ")]


def base32_sha1(text: Column) -> Column:
    """Bare upper-case base-32 SHA-1 of a text's UTF-8 bytes: 10 hex digits make 8 base-32 digits."""
    digest = F.sha1(text)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), _CONV_DIGITS, _BASE32)


def records(pages: DataFrame, *, min_revisit_bytes: int = MIN_REVISIT_BYTES, date_col: str | None = None) -> DataFrame:
    """A column `value`: the records without their last two line ends."""
    date = F.col(date_col).cast("timestamp") if date_col else F.timestamp_seconds(F.lit(EPOCH) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(DATE_SECONDS)))
    base = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("payload"), date.alias("_date"))
    sized = base.withColumns({"_bytes": F.octet_length("payload"), "_digest": base32_sha1(F.col("payload"))})
    # equal payloads are counted before the shuffle; only digests met twice can have a revisit
    shared = (
        pages.select("page_id", F.coalesce("html", F.lit("")).alias("payload")).where(F.octet_length("payload") >= min_revisit_bytes)
        .select("page_id", base32_sha1(F.col("payload")).alias("_digest")).groupBy("_digest")
        .agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    )
    both = sized.join(shared, "_digest", "left")
    refers = F.when((F.col("_bytes") >= min_revisit_bytes) & (F.col("page_id") > F.col("_first")), F.col("_first"))
    end = "\r\n"
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{end}Content-Type: text/html; charset=utf-8{end}Content-Length: "), F.col("_bytes").cast("string"), F.lit(end + end))
    block = F.when(F.col("_refers").isNull(), F.concat(F.col("_http"), F.col("payload"))).otherwise(F.col("_http"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    head = F.concat(
        F.lit(f"WARC/1.1{end}WARC-Type: "), F.when(F.col("_refers").isNull(), "response").otherwise("revisit"),
        F.lit(f"{end}WARC-Record-ID: "), name(F.col("page_id")),
        F.lit(f"{end}WARC-Target-URI: "), F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A"),
        F.lit(f"{end}WARC-Date: "), F.date_format("_date", "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        F.lit(f"{end}WARC-Payload-Digest: sha1:"), F.col("_digest"),
        F.when(F.col("_refers").isNull(), "").otherwise(F.concat(F.lit(f"{end}WARC-Refers-To: "), name(F.col("_refers")), F.lit(f"{end}WARC-Profile: {PROFILE}"))),
        F.lit(f"{end}Content-Type: application/http;msgtype=response{end}Content-Length: "),
    )
    block_bytes = F.octet_length("_http") + F.when(F.col("_refers").isNull(), F.col("_bytes")).otherwise(0)
    return both.withColumns({"_refers": refers, "_http": http}).select(F.concat(head, block_bytes.cast("string"), F.lit(end + end), block).alias("value"))


def write_archives(pages: DataFrame, path: str, *, max_records: int = MAX_RECORDS, **options) -> None:
    records(pages, **options).write.options(lineSep="\r\n\r\n", compression="gzip", maxRecordsPerFile=max_records).text(path)


def parse_records(chunks: Iterator[bytes]) -> Iterator[tuple[int, dict[str, str], bytes, int]]:
    """Offset (in the inflated archive), header fields, block and whole length of each record; holds one record at a time."""
    buffer, offset = bytearray(), 0

    def fill(n: int) -> bool:
        while len(buffer) < n:
            if (more := next(chunks, None)) is None:
                return False
            buffer.extend(more)
        return True

    while True:
        at, need = -1, 4
        while (at := buffer.find(b"\r\n\r\n", max(0, need - 4))) < 0:
            need = len(buffer) + 1
            if not fill(need):
                if buffer.strip():
                    raise ValueError("an archive ends inside a record's header")
                return
        lines = buffer[:at].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at {offset}")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        size = int(fields["Content-Length"])
        end = at + 4 + size
        if not fill(end + 4) or buffer[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at {offset} is cut short")
        yield offset, fields, bytes(buffer[at + 4 : end]), end + 4
        del buffer[: end + 4]
        offset += end + 4


def inflate(data: bytes, step: int = 1 << 18) -> Iterator[bytes]:
    """The bytes of a gzip file (of one member or more), piece by piece."""
    stream = zlib.decompressobj(31)
    for i in range(0, len(data), step):
        rest = data[i : i + step]
        while rest:
            if out := stream.decompress(rest):
                yield out
            rest = stream.unused_data
            if stream.eof:
                stream = zlib.decompressobj(31)
    if out := stream.flush():
        yield out


def url_key(url: str) -> str:
    """Sort-friendly form: host labels reversed, then the rest (`com,example)/a?b`), without scheme and `www.`."""
    rest = url.partition("://")[2] or url
    cut = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    host = rest[:cut].lower().removeprefix("www.")
    return ",".join(reversed(host.split("."))) + ")" + (rest[cut:] or "/")


def _number(urn: str) -> int | None:
    text = urn.removeprefix("<urn:page:").removesuffix(">")
    return None if text == "null" else int(text)


def read_archive(name: str, data: bytes) -> list[tuple]:
    """The captures of one archive, sorted by URL key, timestamp and id."""
    from datetime import datetime, timezone

    out = []
    for offset, fields, block, length in parse_records(inflate(data)):
        http, _, payload = block.partition(b"\r\n\r\n")
        revisit = fields["WARC-Type"] == "revisit"
        if revisit:
            size = int(next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
            digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
        else:
            size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
            if fields["WARC-Payload-Digest"] != f"sha1:{digest}":
                raise ValueError(f"{name}: the payload at {offset} is damaged")
        at = int(datetime.strptime(fields["WARC-Date"], "%Y-%m-%dT%H:%M:%SZ").replace(tzinfo=timezone.utc).timestamp())
        refers = _number(fields["WARC-Refers-To"]) if revisit else None
        out.append((_number(fields["WARC-Record-ID"]), size, digest, fields["WARC-Type"], refers, url_key(fields["WARC-Target-URI"]), at, name, offset, length))
    return sorted(out, key=_order)


def _order(c: tuple) -> tuple:
    return c[5], c[6], -1 if c[0] is None else c[0], c[7], c[8]


def capture_runs(spark: SparkSession, path: str) -> DataFrame:
    """One sorted run per archive; `run` names it."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content")):
                if run := read_archive(name.rsplit("/", 1)[-1], data.as_py()):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*run), _TYPES)], names=_NAMES)

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content").mapInArrow(read, CAPTURE)


class LoserTree:
    """k-way merge of sorted sequences: each step replays one path from a leaf to the root."""

    def __init__(self, runs: list[Iterator], key):
        self.runs, self.key = runs, key
        self.heads = [self._next(i) for i in range(len(runs))]
        self.tree = [-1] * max(1, len(runs))  # tree[0] is the winner, the others hold losers
        for i in range(len(runs)):
            self._replay(i)

    def _next(self, i: int):
        item = next(self.runs[i], None)
        return None if item is None else (self.key(item), i, item)

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and x[:2] < y[:2])

    def _replay(self, i: int) -> None:
        node = (i + len(self.runs)) // 2
        while node:
            if self.tree[node] < 0:  # the first to come here while the tree is filled waits for its rival
                self.tree[node] = i
                return
            if self._before(self.tree[node], i):
                self.tree[node], i = i, self.tree[node]
            node //= 2
        self.tree[0] = i

    def __iter__(self):
        while self.runs and self.heads[w := self.tree[0]] is not None:
            yield self.heads[w][2]
            self.heads[w] = self._next(w)
            self._replay(w)


def merge_runs(runs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """runs: captures as a written table, which is counted for the number of ranges. Adds shard and position; by these, captures are in the order of URL key, timestamp and id."""
    schema = f"{CAPTURE}, shard int, position long"

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        parts: dict[str, list[tuple]] = {}
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                parts.setdefault(row[7], []).append(row)
        # rows of a run come in order, unless a shuffle block was fetched out of turn
        for run in parts.values():
            run.sort(key=_order)
        shard, out, n = TaskContext.get().partitionId(), [], 0
        for row in LoserTree([iter(r) for _, r in sorted(parts.items())], _order):
            out.append((*row, shard, n))
            n += 1
            if len(out) == 10_000:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [*_TYPES, pa.int32(), pa.int64()])], names=[*_NAMES, "shard", "position"])

    order = [F.col("url_key"), F.col("captured_at"), F.col("page_id").asc_nulls_first(), F.col("archive"), F.col("record_offset")]
    rows = runs.count()
    ranges = max(math.ceil(rows / range_rows), min(runs.sparkSession.sparkContext.defaultParallelism, 1 + rows // 1000))
    return runs.repartitionByRange(ranges, *order).mapInArrow(merge, schema)


def archive_and_index(pages: DataFrame, **options) -> DataFrame:
    """Write the archives, read them back, merge their runs: one row per capture, in global order by (shard, position)."""
    spark = pages.sparkSession
    path, index = shared_path(spark, "warc"), shared_path(spark, "warc-runs")
    write_archives(pages, path, **options)
    capture_runs(spark, path).write.parquet(index)
    return merge_runs(spark.read.parquet(index))
