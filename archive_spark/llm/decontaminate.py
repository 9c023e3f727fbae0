r"""Benchmark decontamination by one Aho-Corasick automaton over normalised test items.

Texts are normalised to lower-case (A-Z) words of letters, digits and non-ASCII characters. A window is 13 neighbouring
words of an item; a shorter item is one window. The automaton's letters are words, and its patterns are the pieces of
seven words that an item falls into, one after another: every window holds a whole piece, so the automaton has no more
nodes than the benchmark has words. Each text is scanned once; where a piece is found, the run of equal words around it
in the item and in the text is measured, and the windows in that run are hits. Hits are ranges of word numbers, which
`hit_offsets` maps to offsets in the original text.

Defined results: a null or wordless text has no words, no hits and is clean; a null or wordless item matches nothing;
repeated items count once by id, a null id counts as 'null'; repeated documents are judged one by one; an empty
benchmark makes every document clean; a text of any length is scanned as a whole. The benchmark's distinct texts are
sent to the tasks if they have at most MAX_ITEM_BYTES together, which is far beyond public benchmarks. A larger one is
read in blocks of that size, one automaton each; documents pass through the blocks one after another and are written in
between.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, fresh, give_back, materialize, raw_texts, slices

WINDOW = 13
#: Bound of the benchmark text in one automaton, which has a node for each word at most.
MAX_ITEM_BYTES = 16 << 20

#: Bytes of words stay (A-Z folded), all others become blanks.
_WORD = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def normal_words(raw: bytes) -> list[bytes]:
    # split(b" ") would keep empty words; only blanks are left as white space
    return raw.translate(_WORD).split()


class Items:
    """The automaton over items (id, raw text), and the words of each item for the check around a match."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.window, self.number = window, {}
        self.ids: list[str] = []
        self.words: list[list[int]] = []
        piece = (window + 1) // 2
        places: dict[tuple[int, ...], list[tuple[int, int]]] = defaultdict(list)
        for item, words in {(i, tuple(normal_words(raw))): None for i, raw in items}:
            if not words:
                continue
            at = [self.number.setdefault(w, len(self.number) + 1) for w in words]
            size = len(at) if len(at) < window else piece
            for start in range(0, len(at) - size + 1, size):
                places[tuple(at[start : start + size])].append((len(self.ids), start))
            self.ids.append(item), self.words.append(at)
        self.automaton = None
        if places:
            self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
            for key, found in places.items():
                self.automaton.add_word(key, (len(key), tuple(found)))
            self.automaton.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit word ranges (end exclusive), joined and in order, and the ids of the items found."""
        if self.automaton is None or not words:
            return [], set()
        text = tuple(map(self.number.get, words, repeat(0)))
        hits: list[tuple[int, int]] = []
        ids: set[str] = set()
        runs: dict[tuple[int, int], int] = {}  # of an item and its shift against the text: where the last run ends
        for last, (size, found) in self.automaton.iter(text):
            for item, start in found:
                other, shift = self.words[item], last + 1 - size - start
                if runs.get((item, shift), -1) > last:  # within a run that is known
                    continue
                a, b = last + 1 - size, last + 1
                while a > 0 and a > shift and text[a - 1] == other[a - 1 - shift]:
                    a -= 1
                while b < len(text) and b - shift < len(other) and text[b] == other[b - shift]:
                    b += 1
                runs[item, shift] = b
                if b - a >= min(self.window, len(other)):
                    hits.append((a, b))
                    ids.add(self.ids[item])
        ranges: list[tuple[int, int]] = []
        for a, b in sorted(hits):
            if ranges and a <= ranges[-1][1]:
                ranges[-1] = (ranges[-1][0], max(b, ranges[-1][1]))
            else:
                ranges.append((a, b))
        return ranges, ids


_built: dict[str, Items] = {}


def _items_of(block, window: int) -> Items:
    """Built once in each worker, which keeps the last. block: a broadcast pair of a key and items."""
    key, items = block.value
    if key not in _built:
        _built.clear()
        _built[key] = Items(items, window)
    return _built[key]


def _scanner(block, window: int, text_col: str, names: tuple[str, str, str], first: bool, finish):
    """finish: makes the batch to return from a batch, and of each text the number of words, hit ranges and item ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = _items_of(block, window)
        for batch in slices(batches, text_col):
            texts = raw_texts(batch.column(text_col))
            old = [None] * len(texts) if first else batch.column(names[1]).to_pylist()
            old_ids = [None] * len(texts) if first else batch.column(names[2]).to_pylist()
            n, ranges, found = [], [], []
            for raw, had, had_ids in zip(texts, old, old_ids):
                words = normal_words(raw)
                got, ids = items.scan(words)
                n.append(len(words))
                ranges.append([*(had or []), *(x for r in got for x in r)])
                found.append(sorted({*(had_ids or []), *ids}))
            yield finish(batch, n, ranges, found)

    return give_back(run)


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, max_bytes: int) -> Iterator[list[tuple[str, bytes]]]:
    """The items in blocks, each of a checked size; one block is in the driver at a time."""
    rows = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("id"), F.col(text_col).alias("text")).where("text is not null").distinct()
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total * 2 // max_bytes) if total > max_bytes else 1
    for b in range(blocks):
        yield [(r["id"], r["text"].encode()) for r in rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b).orderBy("id", "text").collect()]


def find_contamination(
    documents: DataFrame, benchmark: DataFrame, schema: T.StructType, finish, *, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, max_bytes: int = MAX_ITEM_BYTES
) -> DataFrame:
    """What `finish` makes of each Arrow batch of documents, their numbers of words, hit word ranges (flat, start and end in
    turn, of each block) and item ids. schema: of its batches."""
    spark, keep = documents.sparkSession, documents.columns
    bound_batches(spark)
    names = tuple(fresh(keep, "_n_words", "_ranges", "_items"))
    wider = T.StructType([*documents.schema.fields, T.StructField(names[0], T.LongType()), T.StructField(names[1], T.ArrayType(T.IntegerType())), T.StructField(names[2], T.ArrayType(T.StringType()))])

    def carry(batch: pa.RecordBatch, n, ranges, found) -> pa.RecordBatch:
        columns = [pa.array(n, pa.int64()), pa.array(ranges, pa.list_(pa.int32())), pa.array(found, pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *columns], names=[*keep, *names])

    out, held = documents, None
    for i, block in enumerate(item_blocks(benchmark, item_id, item_text, max_bytes)):
        if held is not None:
            out = materialize(out.mapInArrow(_scanner(held, window, text_col, names, i == 1, carry), wider), "hits")
        held = spark.sparkContext.broadcast((uuid.uuid4().hex, block))
    return out.mapInArrow(_scanner(held, window, text_col, names, out is documents, finish), schema)


def hit_offsets(raw: bytes, ranges: list[int] | None) -> list[int]:
    """Flat word ranges (start and end in turn) as code points of the original text, end exclusive."""
    if not ranges:
        return []
    normal = np.frombuffer(b" " + raw.translate(_WORD) + b" ", dtype=np.uint8) != 32
    edges = np.flatnonzero(normal[1:] != normal[:-1])
    points = np.concatenate(([0], np.cumsum((np.frombuffer(raw, dtype=np.uint8) & 0xC0) != 0x80)))
    return [int(points[edges[2 * at if k % 2 == 0 else 2 * at - 1]]) for k, at in enumerate(ranges)]


def contaminated_spans(documents: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per document with hits: id, spans (starts and ends of the hit passages in the original, in code points, in turn)."""
    schema = T.StructType([documents.schema[id_col], T.StructField("spans", T.ArrayType(T.IntegerType()))])

    def finish(batch: pa.RecordBatch, n, ranges, found) -> pa.RecordBatch:
        spans = [hit_offsets(x, r) for x, r in zip(raw_texts(batch.column(text_col)), ranges)]
        hit = pa.array([bool(r) for r in ranges], pa.bool_())
        return pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(spans, pa.list_(pa.int32()))], names=schema.names).filter(hit)

    return find_contamination(documents.select(F.col(id_col), F.col(text_col)), benchmark, schema, finish, text_col=text_col, **options)


def union_length(ranges: list[int] | None) -> int:
    """Length of the union of ranges given as start and end in turn."""
    total, to = 0, -1
    for a, b in sorted(zip(ranges[0::2], ranges[1::2])) if ranges else ():
        total += max(0, b - max(a, to))
        to = max(to, b)
    return total


def _judged(n: list[int], ranges: list[list[int]]) -> tuple[list[int], list[bool]]:
    """Hit words, and whether they make a text contaminated."""
    hit = [union_length(r) for r in ranges]
    return hit, [h > 0 and 20 * h >= w for h, w in zip(hit, n)]


def contamination(documents: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per document: id, n_words, n_hit, n_items, items_sha256, contaminated (n_hit > 0 and 20 * n_hit >= n_words)."""
    schema = T.StructType([documents.schema[id_col], *T.StructType.fromDDL("n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean").fields])

    def finish(batch: pa.RecordBatch, n, ranges, found) -> pa.RecordBatch:
        hit, bad = _judged(n, ranges)
        digests = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in found]
        columns = [pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array([len(x) for x in found], pa.int64()), pa.array(digests, pa.string()), pa.array(bad, pa.bool_())]
        return pa.RecordBatch.from_arrays([batch.column(id_col), *columns], names=schema.names)

    return find_contamination(documents.select(F.col(id_col), F.col(text_col)), benchmark, schema, finish, text_col=text_col, **options)


def remove_contaminated(documents: DataFrame, benchmark: DataFrame, *, text_col: str = "text", **options) -> DataFrame:
    """The documents that are not contaminated, with all their columns. documents: no two columns of one name."""
    keep = documents.columns

    def finish(batch: pa.RecordBatch, n, ranges, found) -> pa.RecordBatch:
        return batch.select(keep).filter(pa.array([not x for x in _judged(n, ranges)[1]], pa.bool_()))

    return find_contamination(documents, benchmark, documents.schema, finish, text_col=text_col, **options)
