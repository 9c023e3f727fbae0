"""Runs of periodically repeated words, found with a dictionary of basic factors.

For each power of two L the dictionary names the factors of L words: equal factors of one document have equal names, made
of the names of their halves. The next place of an equal factor within 2 L words is its successor. Where a place and its
successor have the same distance q to their successors, three occurrences form an arithmetic progression, which proposes
the period q. A stretch with smallest period q and at least 4 q words has such a progression at its first word for the
least L >= q, and a distance that is no smallest period cannot be that of a successor; so every proposal, extended to
both sides by comparing names from the longest factors down, is a maximal run of smallest period q, and none is missed.
The same run proposed at several lengths or places counts once.

Documents are worked on many at once, as arrays; a factor never reaches over the end of a document, and names are those
of one document. Factors that occur once are left out of all longer ones. Memory grows with the words of a slice of
texts (or of one long text) times the number of lengths at which factors still recur. Words are told apart by 64-bit
hashes.

Defined results: a null, empty or wordless text has no words and no runs, and its collapsed text is empty; repeated rows
and null ids are judged row by row; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACES, bound_batches, byte_table, fresh, give_back, joined, mix, raw_texts, slices, text_of, word_hashes, word_spans

#: A run has at least this many words, and at least this many times its period.
MIN_WORDS, MIN_EXPONENT = 6, 4

_SPACE = byte_table(SPACES)
_DOCUMENT = np.uint64(0xD6E8FEB86659FD93)


def _names(keys: np.ndarray, places: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names of the places with equal keys (-1 elsewhere and where a key occurs once); those places by name, then place;
    and where the next of them is the same."""
    order = np.argsort(keys, kind="stable")
    keys, places = keys[order], places[order]
    same = keys[1:] == keys[:-1]
    often = np.zeros(len(keys), dtype=bool)
    often[1:][same] = True
    often[:-1][same] = True
    names = np.full(n, -1, dtype=np.int64)
    group = np.cumsum(np.concatenate(([True], ~same)))[often] if len(keys) else np.zeros(0, dtype=np.int64)
    names[places[often]] = group
    return names, places[often], group[1:] == group[:-1]


def _proposals(names: np.ndarray, places: np.ndarray, same: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and periods of arithmetic progressions of three occurrences; of neighbouring places with one period the first."""
    after = np.zeros(len(names) + 1, dtype=np.int64)
    distance = np.diff(places)
    near = same & (distance <= 2 * length)
    after[places[:-1][near]] = distance[near]
    at = np.flatnonzero(after)
    at = at[after[at + after[at]] == after[at]]
    head = np.ones(len(at), dtype=bool)
    head[1:] = (np.diff(at) > 1) | (after[at[1:]] != after[at[:-1]])
    return at[head], after[at[head]]


def _equal(level: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (level[a] == level[b]) & (level[a] >= 0)


def find_runs(hashes: np.ndarray, owner: np.ndarray, first: np.ndarray, last: np.ndarray, min_words: int = MIN_WORDS, exponent: int = MIN_EXPONENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and periods of all runs, by start, then period. hashes and owner: each word's hash and document
    (ascending); first and last: where each document's words begin and end. exponent is 4 or more."""
    n = len(hashes)
    names, places, same = _names(mix(hashes + (owner.astype(np.uint64) + np.uint64(1)) * _DOCUMENT), np.arange(n), n)
    levels, length, starts, periods = [], 1, [], []
    while len(places):
        levels.append(names)
        at, period = _proposals(names, places, same, length)
        starts.append(at), periods.append(period)
        # a factor of twice the length occurs often only if both halves do
        left = np.flatnonzero(names[: n - length] >= 0) if n > length else np.zeros(0, dtype=np.int64)
        left = left[(names[left + length] >= 0) & (owner[left] == owner[np.minimum(left + 2 * length - 1, n - 1)]) & (left + 2 * length <= n)]
        names, places, same = _names(names[left] * (n + 1) + names[left + length], left, n)
        length *= 2
    if not starts:
        return (np.zeros(0, dtype=np.int64),) * 3
    a, q = np.concatenate(starts), np.concatenate(periods)
    low, high = first[owner[a]], last[owner[a]]
    b = a + q
    for k in range(len(levels) - 1, -1, -1):  # no factor of twice the greatest length recurs, so each length fits once at most
        step = 1 << k
        go = b + step <= high
        go[go] = _equal(levels[k], (b - q)[go], b[go])
        b = b + step * go
        go = a - step >= low
        go[go] = _equal(levels[k], (a - step)[go], (a - step + q)[go])
        a = a - step * go
    size = b - a
    keep = size >= np.maximum(min_words, exponent * q)
    found = np.unique(np.stack((a[keep], q[keep], b[keep]), axis=1), axis=0)
    return found[:, 0], found[:, 2], found[:, 1]


def _read(texts: list[bytes]):
    buffer, begin, _ = joined(texts)
    starts, ends, inside = word_spans(buffer, _SPACE)
    owner = text_of(starts, begin)
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    return word_hashes(buffer, starts, ends, inside), owner, bounds


def periodic_runs(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, exponent: int = MIN_EXPONENT) -> DataFrame:
    """Per document: id, n_words, runs (start, length, period; words numbered from 0; by start, then period), and
    collapsed: its words joined by one space, without those that follow the first period of a run they lie in."""
    if exponent < 4:
        raise ValueError("runs of less than four periods are not found by progressions of three")
    bound_batches(documents.sparkSession)
    run_type = "array<struct<start:long,length:long,period:long>>"
    schema = T.StructType([documents.schema[id_col], *T.StructType.fromDDL(f"n_words long, runs {run_type}, collapsed string").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            texts = raw_texts(batch.column(text_col))
            hashes, owner, bounds = _read(texts)
            start, end, period = find_runs(hashes, owner, bounds[:-1], bounds[1:], min_words, exponent)
            step = np.zeros(len(hashes) + 1, dtype=np.int64)
            np.add.at(step, start + period, 1)
            np.add.at(step, end, -1)
            stays = np.cumsum(step[:-1]) == 0
            of = owner[start] if len(start) else np.zeros(0, dtype=np.int64)
            lists = np.searchsorted(of, np.arange(len(texts) + 1)).astype(np.int32)
            collapsed = []
            for i, text in enumerate(texts):
                words = text.split()
                if lists[i] < lists[i + 1]:
                    words = [w for w, s in zip(words, stays[bounds[i] : bounds[i + 1]].tolist()) if s]
                collapsed.append(b" ".join(words))
            runs = pa.StructArray.from_arrays([pa.array(start - bounds[of]), pa.array(end - start), pa.array(period)], names=["start", "length", "period"])
            columns = [pa.array(np.diff(bounds).astype(np.int64)), pa.ListArray.from_arrays(pa.array(lists), runs), pa.array(collapsed, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), *columns], names=schema.names)

    return documents.select(F.col(id_col), F.col(text_col)).mapInArrow(give_back(run), schema)


def run_digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """What periodic_runs found, in numbers and digests: the number of runs, the one of greatest exponent (ties: the first),
    and hashes of the list of runs and of the collapsed text."""
    better = lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)
    best = F.reduce("runs", F.lit(None).cast("struct<start:long,length:long,period:long>"), better)
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    (top,) = fresh(found.columns, "top")
    return found.withColumn(top, best).select(
        id_col,
        F.size("runs").cast("long").alias("n_runs"),
        F.col(f"{top}.start").alias("start"),
        F.col(f"{top}.length").alias("length"),
        F.col(f"{top}.period").alias("period"),
        F.expr(f"1000 * {top}.length div {top}.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
