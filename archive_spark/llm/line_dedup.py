"""Line dedup by passages shared with earlier documents.

A passage is a run of neighbouring lines with at least `min_block_words` words. Its lines are deleted from every document
that is not the first to hold it, wherever it stands in either document and however often. No pair of documents is
formed: a passage is covered by its shortest windows of `min_block_words` words, one to begin and one to end at each
line, so a line goes if one of its windows has an earlier holder. A window is a hash; windows meet by hash, so the work
grows with the number of lines, however common one is.

`patience` and `common_blocks` align one pair of documents; what they find is always part of what goes here.

Lines are compared without the white space at their ends; blank lines are skipped. Documents are
ordered by id, then by a hash of their text. Only hashes and numbers of lines are moved, not text.

Defined results: a null or blank text loses nothing; a null id counts as the earliest; rows with equal id and text are
one document, so repeated rows lose nothing to each other; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACES, bound_batches, fresh, give_back, materialize, raw_texts, slices

MIN_BLOCK_WORDS = 20
#: Bytes up to which the list of deleted lines is broadcast; a longer one is joined by shuffle.
BROADCAST_BYTES = 16 << 20


def line_keys(raw: bytes) -> tuple[list[int], list[int], list[int]]:
    """Of each line that is not blank: its number, hash and words."""
    at, keys, words = [], [], []
    for i, line in enumerate(raw.split(b"\n")):
        if line := line.strip(SPACES):
            at.append(i), keys.append(xxhash.xxh3_64_intdigest(line) - (1 << 63)), words.append(len(line.split()))
    return at, keys, words


def _increasing(values: list[int]) -> list[int]:
    """Places of a longest strictly increasing subsequence (patience piles)."""
    tops, top_at, back = [], [], []
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        if k == len(tops):
            tops.append(v), top_at.append(i)
        else:
            tops[k], top_at[k] = v, i
        back.append(top_at[k - 1] if k else -1)
    out, i = [], top_at[-1] if top_at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned (place in a, place in b), both ascending. Works on a stack, not by recursion."""
    out: list[tuple[int, int]] = []
    work = [(0, len(a), 0, len(b))]
    while work:
        a0, a1, b0, b1 = work.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        in_a: dict[int, int] = {}
        for i in range(a0, a1):
            in_a[a[i]] = i if a[i] not in in_a else -1
        in_b: dict[int, int] = {}
        for j in range(b0, b1):
            in_b[b[j]] = j if b[j] not in in_b else -1
        unique = [(i, in_b[v]) for v, i in in_a.items() if i >= 0 and in_b.get(v, -1) >= 0]
        unique.sort(key=lambda x: x[1])
        anchors = [unique[k] for k in _increasing([i for i, _ in unique])]
        if not anchors:
            continue
        p, q = a0, b0
        for i, j in anchors:
            out.append((i, j))
            work.append((p, i, q, j))
            p, q = i + 1, j + 1
        work.append((p, a1, q, b1))
    return sorted(out)


def common_blocks(a: list[int], b: list[int], words: list[int], min_words: int) -> list[int]:
    """Places in b of aligned runs, neighbouring in both, with min_words words or more."""
    out, run, total, last = [], [], 0, (-2, -2)
    for pair in [*patience(a, b), (-9, -9)]:
        if pair != (last[0] + 1, last[1] + 1):
            if total >= min_words:
                out += run
            run, total = [], 0
        if pair[1] >= 0:
            run.append(pair[1])
            total += words[pair[1]]
        last = pair
    return out


def windows(words: list[int], min_words: int) -> list[tuple[int, int]]:
    """The shortest runs (first, last) of min_words words or more that begin or that end at each line. Together they cover
    every run of that many words, as each of its lines has its first or its second window within the run."""
    found, first, total = set(), 0, 0
    for last, n in enumerate(words):
        total += n
        while total - words[first] >= min_words:
            total -= words[first]
            first += 1
        if total >= min_words:
            found.add((first, last))
    last, total = len(words) - 1, 0
    for first in range(len(words) - 1, -1, -1):
        total += words[first]
        while total - words[last] >= min_words:
            total -= words[last]
            last -= 1
        if total >= min_words:
            found.add((first, last))
    return sorted(found)


def document_windows(documents: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """Per window of a document: did, th (hash of the text), key, and the numbers of its lines."""
    schema = "did long, th long, windows array<struct<key:long,lines:array<int>>>"
    kind = pa.list_(pa.struct([("key", pa.int64()), ("lines", pa.list_(pa.int32()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out = []
            for raw in raw_texts(batch.column("text")):
                at, keys, words = line_keys(raw)
                packed = np.array(keys, dtype=np.int64).tobytes()
                out.append([(xxhash.xxh3_64_intdigest(packed[8 * i : 8 * j + 8]) - (1 << 63), at[i : j + 1]) for i, j in windows(words, min_words)])
            yield pa.RecordBatch.from_arrays([batch.column("did"), batch.column("th"), pa.array([[{"key": k, "lines": x} for k, x in w] for w in out], kind)], names=["did", "th", "windows"])

    return _keyed(documents, id_col, text_col).mapInArrow(give_back(run), schema)


def _id(id_col: str):
    return F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))


def _keyed(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return documents.select(_id(id_col).alias("did"), F.xxhash64(F.col(text_col)).alias("th"), F.col(text_col).alias("text"))


def duplicate_lines(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_block_words: int = MIN_BLOCK_WORDS) -> DataFrame:
    """did, th, gone (numbers of the lines to delete, ascending) for each document that loses lines."""
    bound_batches(documents.sparkSession)
    held = materialize(document_windows(documents, id_col, text_col, min_block_words), "document-windows")
    found = held.select(F.struct("did", "th").alias("doc"), F.inline("windows"))
    # counted before the shuffle; only shared windows go on
    holders = found.groupBy("key").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").drop("last")
    again = found.join(holders, "key").where("first < doc")
    # at most the lines of one document
    return again.select("doc.did", "doc.th", F.explode("lines").alias("line")).distinct().groupBy("did", "th").agg(F.array_sort(F.collect_list("line")).alias("gone"))


def dedup_lines(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", drop_emptied: bool = False, count_col: str | None = None, **options) -> DataFrame:
    """The documents with their duplicate lines deleted; other columns stay.

    drop_emptied: documents of which no word is left go (those without a word before stay). count_col: adds the number
    of deleted lines under this name.
    """
    gone = duplicate_lines(documents, id_col=id_col, text_col=text_col, **options)
    gone = materialize(gone, "gone-lines")
    size = gone.agg(F.sum(F.size("gone") * 4 + 32)).first()[0] or 0
    gone = F.broadcast(gone) if size <= BROADCAST_BYTES else gone
    did, th, lines, new = fresh([*documents.columns, count_col or ""], "did", "th", "gone", "new")
    keyed = documents.withColumns({did: _id(id_col), th: F.xxhash64(F.col(text_col))})
    joined = keyed.join(gone.select(F.col("did").alias(did), F.col("th").alias(th), F.col("gone").alias(lines)), [did, th], "left")
    # line numbers are from 0, and the text is split as it was for the windows
    kept = F.filter(F.split(F.col(text_col), "\n", -1), lambda line, i: ~F.array_contains(lines, i))
    text = F.when(F.col(lines).isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    out = joined.withColumn(new, text)
    if drop_emptied:
        out = out.where(F.col(lines).isNull() | F.col(new).rlike(r"[^\x20\x09-\x0D]"))
    columns = [F.col(new).alias(c) if c == text_col else F.col(c) for c in documents.columns]
    if count_col:
        columns.append(F.when(F.col(lines).isNull(), 0).otherwise(F.size(lines)).alias(count_col))
    return out.select(*columns)
