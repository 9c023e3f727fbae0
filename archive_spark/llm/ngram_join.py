r"""N-gram Jaccard self-join by grouped prefixes.

A document's set is its distinct shingles of five neighbouring words (`[^\x20\x09-\x0D]+`, A-Z folded), held as 64-bit
hashes. Two sets link when 100 * |intersection| >= 75 * |union|. Results are connected components.

1. One pass counts all shingles into a sketch of fixed size (a row of a count-min sketch). Shingles are ordered by that
   count, then by hash: rare ones first. Any common order gives exact results; this one keeps frequent passages out of
   prefixes.
2. A set's prefix is its first n - ceil(0.75 n) + 1 shingles in that order; linked sets share a prefix shingle. Sets
   with identical prefixes and sizes collapse into one group, for which its set of smallest fingerprint stands; copies
   have one fingerprint anyway. From here on a set's node is its group if it stands for it, else its fingerprint.
3. Prefix entries of groups meet by shingle in buckets of packed arrays. An entry names its group only, and its shingle by
   32 bits within the bucket: shingles taken for one another give more candidates, never fewer. Lists are sorted by position; pairs are filtered
   by size and by the positions of the shared shingle. A short list gives all its pairs; a long one only a star, and is
   kept. A shingle that is hot by the sketch is thinned to one entry for each group and task before the shuffle.
4. The sets of all candidates are read once and a bit set of each is written: a shingle flips one bit, so two sets differ
   in as many shingles as bits at least. Star pairs, and groups with their members, are held against bit sets, and only
   pairs that can still link against whole sets, which are read for these alone. Links give components.
5. Only pairs between different components can still matter: those of short lists, and of long lists with more than one
   component. The latter are compared in blocks of bounded size, so that a hot list is split over tasks, by bit sets in
   place; no pair is written that they rule out. Members of a group that did not link with it take part by themselves.
   What is left is verified by whole sets. So no link between components is lost, while a large group of near copies
   costs a few pairs for each member.

Defined results: null, empty and wordless texts have no shingle and stand alone; a text of one to four words has its
whole sequence as one shingle; repeated rows link with each other; documents with a null id link as all others do; the
component's id is the smallest that is not null; an empty table gives an empty result; a text of any length is one set,
held by one task at a time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACES, Scratch, byte_table, fresh, give_back, joined, mix, raw_texts, slices, text_of, window_hashes, word_hashes, word_spans

WORDS, PERCENT = 5, 75
#: Counters of the sketch; prefix entries of a bucket; lists up to this length give all pairs; count from which a shingle is hot,
#: if it is also HOT_TIMES the mean of the counters.
SKETCH_BITS, BUCKET_ENTRIES, SHORT_LIST, HOT, HOT_TIMES = 18, 1 << 18, 16, 100_000, 4
#: Prefix entries that a task holds before it sends them on, and parts in which the sketch is summed.
FLUSH_ENTRIES, SKETCH_PARTS = 1 << 17, 8
#: Rows and bytes of an Arrow batch, and bytes of text hashed at once.
ARROW_ROWS, ARROW_BYTES, HASH_BYTES = 2000, 4 << 20, 1 << 18
#: Least and most bits of a set's bit set.
LEAST_BITS, MOST_BITS = 1 << 10, 1 << 16
#: Entries of a block of a long list.
BLOCK = 4096
_SPACE = byte_table(SPACES)


def least_overlap(a, b):
    """The smallest intersection of linked sets of sizes a and b."""
    return -(-PERCENT * (a + b) // (100 + PERCENT))


def prefix_size(n: int) -> int:
    return n - -(-PERCENT * n // 100) + 1


def shingle_sets(texts: list[bytes], size: int = WORDS) -> list[np.ndarray]:
    """The sorted hashes of each text's set."""
    buffer, begin, _ = joined(texts)
    starts, ends, inside = word_spans(buffer, _SPACE)
    hashes, owner = word_hashes(buffer, starts, ends, inside, fold=True), text_of(starts, begin)
    words = np.bincount(owner, minlength=len(texts))
    first = np.cumsum(words) - words
    windows = window_hashes(hashes, size)
    out = []
    for n, at in zip(words.tolist(), first.tolist()):
        if n >= size:
            out.append(np.unique(windows[at : at + n - size + 1]))
        else:
            out.append(window_hashes(hashes[at : at + n], n) if n else hashes[:0])
    return out


def fingerprint(shingles: np.ndarray) -> int:
    """Of a whole set (0 for an empty one), as a signed long."""
    if not len(shingles):
        return 0
    total = np.array([np.sum(mix(shingles ^ np.uint64(0xA5A5A5A5A5A5A5A5)))], dtype=np.uint64) + np.uint64(len(shingles))
    return int(mix(total).view(np.int64)[0])


def bit_set(shingles: np.ndarray) -> bytes:
    """The set's size, then the parity of its shingles at each bit (at least two bits a shingle, up to MOST_BITS)."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (2 * len(shingles) - 1).bit_length())) if len(shingles) else LEAST_BITS
    at = ((shingles >> np.uint64(20)) % np.uint64(bits)).astype(np.int64)
    odd = np.bincount(at, minlength=bits) & 1
    return np.array([len(shingles)], dtype="<u8").tobytes() + np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _folded(words: np.ndarray, n: int) -> np.ndarray:
    """A bit set cut down to n words of 64 bits."""
    while len(words) > n:
        words = words[: len(words) // 2] ^ words[len(words) // 2 :]
    return words


def near(x: bytes, y: bytes) -> bool:
    """False only if the sets behind two bit sets cannot link."""
    x, y = np.frombuffer(x, dtype="<u8"), np.frombuffer(y, dtype="<u8")
    n = min(len(x), len(y)) - 1
    apart = int(np.bitwise_count(_folded(x[1:], n) ^ _folded(y[1:], n)).sum())
    total = int(x[0]) + int(y[0])
    return (100 + PERCENT) * (total - apart) >= 2 * PERCENT * total


def linked(x: bytes, y: bytes) -> bool:
    """Whether two sets of sorted shingles link."""
    x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
    both = np.concatenate((x, y))
    both.sort()
    return int(np.count_nonzero(both[1:] == both[:-1])) >= least_overlap(len(x), len(y))


def _measure(text_col: str, keep: list[str]):
    """Rows of documents (id, th, n, fp), then the parts of the task's sketch."""
    names = [*keep, "n", "fp", "part", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, types = np.zeros(1 << SKETCH_BITS, dtype=np.int64), None
        for batch in slices(batches, text_col, HASH_BYTES):
            sets = shingle_sets(raw_texts(batch.column(text_col)))
            types = [batch.column(c).type for c in keep]
            if any(map(len, sets)):
                sketch += np.bincount((np.concatenate(sets) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(sketch))
            columns = [pa.array([len(s) for s in sets], pa.int64()), pa.array([fingerprint(s) for s in sets], pa.int64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *columns, pa.nulls(len(sets), pa.int32()), pa.nulls(len(sets), pa.binary())], names=names)
        if sketch.any():
            parts = [p.tobytes() for p in np.split(sketch, SKETCH_PARTS)]
            empty = [pa.nulls(SKETCH_PARTS, t) for t in (*types, pa.int64(), pa.int64())]
            yield pa.RecordBatch.from_arrays([*empty, pa.array(range(SKETCH_PARTS), pa.int32()), pa.array(parts, pa.binary())], names=names)

    return give_back(run)


def _sum_sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, counts in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist()):
            counts = np.frombuffer(counts, dtype=np.int64)
            total[part] = total[part] + counts if part in total else counts
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["part", "counts"])


def _sketch(measured: DataFrame) -> np.ndarray:
    """Always 2**SKETCH_BITS counters, so it may be collected and broadcast."""
    parts = measured.where("part is not null").select("part", "counts").repartition(SKETCH_PARTS, "part").mapInArrow(_sum_sketches, "part int, counts binary").collect()
    out = np.zeros((SKETCH_PARTS, (1 << SKETCH_BITS) // SKETCH_PARTS), dtype=np.int64)
    for row in parts:
        out[row["part"]] += np.frombuffer(bytes(row["counts"]), dtype=np.int64)
    return out.reshape(-1)


# Kinds of packed rows, and of candidates. _GROUP: a group (a) and the fingerprint that stands for it (b).
_ENTRIES, _STAR, _OTHER, _LIST, _MEMBER, _GROUP = range(6)
#: Columns of packed rows. Entries: low bits of the shingle's name, group, size of the set, position of the shingle. Stars: two
#: groups. Lists: name, group, size, entries from the shingle on. Members: group, fingerprint, size.
_WIDTHS = {_ENTRIES: ("<u4", "<i8", "<u4", "<u4"), _STAR: ("<i8", "<i8"), _LIST: ("<u8", "<i8", "<u4", "<u4"), _MEMBER: ("<i8", "<i8", "<u4")}


def _pack(kind: int, *columns) -> bytes:
    # byte by byte, so that the high bytes of small numbers lie together and compress to nothing
    return b"".join(np.asarray(c).astype(w, copy=False).view(np.uint8).reshape(len(c), -1).T.tobytes() for c, w in zip(columns, _WIDTHS[kind]))


def _unpack(kind: int, raw: bytes) -> tuple[np.ndarray, ...]:
    widths = [int(w[2]) for w in _WIDTHS[kind]]
    n, out, at = len(raw) // sum(widths), [], 0
    for w, width in zip(_WIDTHS[kind], widths):
        out.append(np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8, count=n * width, offset=at).reshape(width, n).T).view(w).reshape(n))
        at += n * width
    return tuple(out)


def _names(shingles: np.ndarray, buckets: int) -> np.ndarray:
    """Names of shingles: the bucket, then 32 bits."""
    return (shingles % np.uint64(buckets)) << np.uint64(32) | shingles >> np.uint64(32)


def possible(n1, rest1, n2, rest2):
    """Size and position filters; rest: entries of the set from the shared one on."""
    need = least_overlap(n1.astype(np.int64), n2.astype(np.int64))
    return (np.minimum(n1, n2) >= need) & (np.minimum(rest1, rest2) >= need)


def _distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low, high = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((high, low))
    low, high = low[order], high[order]
    keep = (low != high) & np.concatenate(([True], (low[1:] != low[:-1]) | (high[1:] != high[:-1])))[: len(low)]
    return low[keep], high[keep]


def _lists(token, group, fp, n, rest):
    """Entries sorted by token, position and size, each group once a token (its smallest fingerprint, which is the same in
    all its lists); and where each entry's list starts and its length. A list is headed by the set with the fewest shingles
    of its own before the shared one: of a group of near copies, the one that most others are near to."""
    order = np.lexsort((fp, group, n, n - rest, token))
    token, group, fp, n, rest = (x[order] for x in (token, group, fp, n, rest))
    keep = np.ones(len(token), dtype=bool)
    keep[1:] = (token[1:] != token[:-1]) | (group[1:] != group[:-1])
    token, group, fp, n, rest = (x[keep] for x in (token, group, fp, n, rest))
    edge = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1]))) if len(token) else np.zeros(0, dtype=np.int64)
    sizes = np.diff(np.append(edge, len(token)))
    return token, group, fp, n, rest, np.repeat(edge, sizes), np.repeat(sizes, sizes)


def star_pairs(fp, n, rest, head):
    """Each entry with the head of its list."""
    j = np.flatnonzero(np.arange(len(head)) != head)
    i = head[j]
    ok = possible(n[i], rest[i], n[j], rest[j])
    return _distinct(fp[i[ok]], fp[j[ok]])


def _deal(sketch, text_col: str, buckets: int, hot: float):
    """Prefix entries of each set, packed by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sketch.value
        held: list[tuple] = []
        size, known = 0, set()

        def flush() -> Iterator[pa.RecordBatch]:
            rows: list[tuple[int, int, bytes]] = []
            lengths = [len(h[0]) for h in held]
            token = np.concatenate([h[0] for h in held])
            group, fp, n = (np.array([h[k] for h in held], dtype=np.int64) for k in (1, 2, 3))
            members = (group, fp, n)
            group, n = np.repeat(group, lengths), np.repeat(n, lengths)
            rest = n - (np.arange(len(token)) - np.repeat(np.cumsum(lengths) - lengths, lengths))

            def send(kind: int, where: np.ndarray, *columns: np.ndarray) -> None:
                where = (where.view(np.uint64) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(where, kind="stable")
                edges = np.searchsorted(where[order], np.arange(buckets + 1))
                for b in np.flatnonzero(np.diff(edges)).tolist():
                    at = order[edges[b] : edges[b + 1]]
                    rows.append((b, kind, _pack(kind, *(c[at] for c in columns))))

            is_hot = counts[(token >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)] > hot
            token = _names(token, buckets)
            if is_hot.any():
                t, g, _, m, r, head, _ = _lists(*(x[is_hot] for x in (token, group, group, n, rest)))
                a, b = star_pairs(g, m, r, head)
                send(_STAR, a, a, b)
                send(_LIST, g, t, g, m, r)
                first = np.flatnonzero(np.arange(len(head)) == head)
                token, group, n, rest = (np.concatenate((x[~is_hot], y[first])) for x, y in zip((token, group, n, rest), (t, g, m, r)))
            send(_ENTRIES, token >> np.uint64(32), token & np.uint64(0xFFFFFFFF), group, n, n - rest)
            send(_MEMBER, members[0], *members)
            held.clear()
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=["bucket", "kind", "data"])

        for batch in slices(batches, text_col, HASH_BYTES):
            for shingles in shingle_sets(raw_texts(batch.column(text_col))):
                if not (n := len(shingles)) or (fp := fingerprint(shingles)) in known:
                    continue
                if len(known) < 1_000_000:  # copies met again in a task add nothing; past this many they may come again
                    known.add(fp)
                weight = counts[(shingles >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                prefix = shingles[np.lexsort((shingles, weight))[: prefix_size(n)]]
                # order matters here, so identical prefixes only
                key = mix(np.array([np.sum(mix(prefix + np.arange(1, len(prefix) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)))], dtype=np.uint64) + np.uint64(n))
                held.append((prefix, int(key.view(np.int64)[0]), fp, n))
                size += len(prefix)
                if size >= FLUSH_ENTRIES:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()

    return give_back(run)


def _meet(short: int):
    """Candidates of one bucket: pairs of nodes (a, b), or entries of long lists (a: the node) with token, n and rest; and its groups."""

    def run(table: pa.Table) -> pa.Table:
        packed: dict[int, list[bytes]] = {}
        for kind, data in zip(table.column("kind").to_pylist(), table.column("data").to_pylist()):
            packed.setdefault(kind, []).append(data)
        columns: list[tuple] = []

        def add(kind: int, a, b, token=None, n=None, rest=None) -> None:
            zero = np.zeros(len(a), dtype=np.int64)
            columns.append((np.full(len(a), kind, dtype=np.int32), a, b, *(zero if x is None else x.astype(np.int64) for x in (token, n, rest))))

        def read(kind: int) -> tuple[np.ndarray, ...]:
            return tuple(np.concatenate(c) for c in zip(*(_unpack(kind, x) for x in packed[kind])))

        if _ENTRIES in packed:
            low, group, n, position = read(_ENTRIES)
            token = np.uint64(table.column("bucket")[0].as_py() << 32) | low.astype(np.uint64)
            token, node, _, n, rest, head, size = _lists(token, group, group, n, n - position)
            add(_STAR, *star_pairs(node, n, rest, head))
            found = []
            for step in range(1, short):  # all other pairs of short lists
                i = np.flatnonzero((head[:-step] == head[step:]) & (size[step:] <= short)) if len(head) > step else []
                if not len(i):
                    break
                j = i + step
                ok = possible(n[i], rest[i], n[j], rest[j])
                found.append((node[i[ok]], node[j[ok]]))
            if found:
                add(_OTHER, *_distinct(*(np.concatenate(c) for c in zip(*found))))
            long = size > short
            add(_LIST, node[long], node[long], token[long].view(np.int64), n[long], rest[long])
        if _LIST in packed:
            token, node, n, rest = read(_LIST)
            add(_LIST, node, node, token.view(np.int64), n, rest)
        if _STAR in packed:
            add(_STAR, *_distinct(*read(_STAR)))
        if _MEMBER in packed:  # which set stands for a group, and its other members, if there are any
            group, fp, n = read(_MEMBER)
            order = np.lexsort((fp, group))
            group, fp, n = group[order], fp[order], n[order]
            begins = np.concatenate(([True], group[1:] != group[:-1]))
            first = np.maximum.accumulate(np.where(begins, np.arange(len(group)), 0))
            other = fp != fp[first]
            other[1:] &= fp[1:] != fp[:-1]
            add(_GROUP, group[begins], fp[begins])
            add(_MEMBER, group[other], fp[other], None, n[other])
        names = ["kind", "a", "b", "token", "n", "rest"]
        return pa.table({name: pa.array(np.concatenate(c) if c else [], pa.int32() if name == "kind" else pa.int64()) for name, c in zip(names, zip(*columns) if columns else [()] * 6)})

    return run


def _passing(pairs: DataFrame, sets: DataFrame, column: str, test) -> DataFrame:
    """The pairs (a, b) whose two values of a column pass. pairs: no pair twice."""
    ends = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("node"))
    value = lambda end: F.max(F.when(F.col("node") == F.col(end), F.col(column)))
    both = sets.select("node", column).join(ends, "node").groupBy("a", "b").agg(value("a").alias("x"), value("b").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [test(x.as_buffer(), y.as_buffer()) for x, y in zip(batch.column("x"), batch.column("y"))]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return both.where("x is not null and y is not null").mapInArrow(give_back(run), "a long, b long")


def _links(scratch: Scratch, pairs: DataFrame, sets: DataFrame, base: DataFrame, owners: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pairs that bit sets leave, and those of them whose sets link, both as tables. pairs: a small() table.

    Whole sets are far larger than bit sets, so only those of pairs that are left are read and written."""
    some = scratch.small(_passing(pairs, sets, "bits", near), "near-pairs")
    ends = some.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    whole = _read_sets(scratch, base, scratch.small(owners.join(ends, "node", "left_semi"), "near-owners"), "items", np.ndarray.tobytes)
    return some, scratch.small(_passing(some, whole, "items", linked), "links")


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """node, root (the smallest node of its component) for each node of a link (a, b), as a table.

    Large-star and small-star steps, by running minima, until edges form stars: until no node has two smaller neighbours, or
    a smaller and a larger one."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
    least = lambda: F.min("v").over(Window.partitionBy("u")).alias("m")
    while True:
        for _ in range(2):
            both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
            large = both.select("u", "v", F.least("u", least()).alias("m"))
            # larger neighbours, and the node itself, go to the smallest
            edges = large.select(F.greatest("u", "v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
            small = edges.select("u", "v", least())
            edges = small.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        edges = scratch.table(edges, "components")
        ends = edges.select(F.col("u").alias("node"), "v", F.lit(1).alias("child")).unionByName(edges.select(F.col("v").alias("node"), F.lit(None).cast("long").alias("v"), F.lit(0).alias("child")))
        ends = ends.groupBy("node").agg(F.min("child").alias("x"), F.max("child").alias("y"), F.min("v").alias("p"), F.max("v").alias("q"))
        if ends.where("x < y or p < q").isEmpty():
            break
    ends = edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")))
    return ends.distinct()


def _with_root(df: DataFrame, roots: DataFrame, *columns: str) -> DataFrame:
    """Adds r_<column>, the root of each."""
    for c in columns:
        df = df.join(roots.select(F.col("node").alias(c), F.col("root").alias(f"_{c}")), c, "left").withColumn(f"r_{c}", F.coalesce(f"_{c}", c)).drop(f"_{c}")
    return df


def _across(scratch: Scratch, entries: DataFrame, sets: DataFrame, block: int) -> DataFrame:
    """Pairs (a, b) of long lists' entries (token, node, n, rest, r_node) with different roots that sizes, positions and bit sets let pass.

    In each list, the entries outside its largest component are held against all. Both are dealt into blocks by hash, and
    each block of the one meets each block of the other in a group of its own."""
    sizes = entries.groupBy("token", "r_node").agg(F.count(F.lit(1)).alias("size"))
    lists = sizes.groupBy("token").agg(F.max_by("r_node", F.struct("size", "r_node")).alias("main"), F.max("size").alias("most"), F.sum("size").alias("size")).where("most < size")
    blocks = lambda c: F.ceil(c / block).cast("int")
    lists = lists.select("token", "main", blocks(F.col("size") - F.col("most")).alias("rows"), blocks(F.col("size")).alias("columns"))
    mixed = entries.join(scratch.small(lists, "mixed-lists"), "token")
    own = lambda c: F.pmod(F.xxhash64("node", F.lit(c)), F.col(c)).cast("int")
    every = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    place = lambda side, i, j: F.struct(F.lit(side).alias("side"), i.alias("i"), j.alias("j"))
    major = F.transform(every("rows"), lambda i: place(0, i, own("columns")))
    minor = F.when(F.col("r_node") != F.col("main"), F.transform(every("columns"), lambda j: place(1, own("rows"), j))).otherwise(F.array().cast("array<struct<side:int,i:int,j:int>>"))
    wanted = scratch.small(mixed.select("node").distinct(), "mixed-sets")
    dealt = mixed.join(sets.select("node", "bits").join(wanted, "node"), "node").select("token", "node", "n", "rest", "r_node", "bits", F.inline(F.concat(major, minor)))
    dealt = dealt.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j")

    def pairs_of(table: pa.Table) -> np.ndarray:
        node, n, rest, root, side = (table.column(c).to_numpy() for c in ("node", "n", "rest", "r_node", "side"))
        bits = table.column("bits").to_pylist()
        short = np.stack([_folded(np.frombuffer(x, dtype="<u8")[1:], LEAST_BITS // 64) for x in bits])
        major, out = np.flatnonzero(side == 0), []
        for i in np.flatnonzero(side == 1).tolist():
            j = major[(root[major] != root[i]) & possible(n[major], rest[major], n[i : i + 1], rest[i : i + 1])]
            total = n[j] + n[i]
            j = j[(100 + PERCENT) * (total - np.bitwise_count(short[j] ^ short[i]).sum(axis=1, dtype=np.int64)) >= 2 * PERCENT * total]
            out += [(node[i], node[k]) for k in j.tolist() if near(bits[i], bits[k])]
        return np.array(out, dtype=np.int64).reshape(-1, 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        found: list[np.ndarray] = []

        def send() -> pa.RecordBatch:  # pairs share many lists
            a, b = _distinct(*np.concatenate(found).T)
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        last = None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("token", "i", "j")], axis=1)
            edges = (np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist()
            for start, end in zip([0, *edges], [*edges, len(keys)]):
                if held and tuple(keys[start]) != last:
                    found.append(pairs_of(pa.Table.from_batches(held)))
                    held.clear()
                last = tuple(keys[start])
                held.append(batch.slice(start, end - start))
            if sum(map(len, found)) > 100_000:
                yield send()
        if held:
            found.append(pairs_of(pa.Table.from_batches(held)))
        if found:
            yield send()

    return dealt.mapInArrow(give_back(run), "a long, b long")


def _read_sets(scratch: Scratch, base: DataFrame, owners: DataFrame, column: str, form) -> DataFrame:
    """node and the form of its set, read from the document that owns it, as a table. owners: a small() table."""
    texts = base.join(owners, (F.col("th") == F.col("owner_th")) & F.col("id").eqNullSafe(F.col("owner_id"))).select("text", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", HASH_BYTES):
            sets = shingle_sets(raw_texts(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([form(s) for s in sets], pa.binary())], names=["node", column])

    return scratch.table(texts.mapInArrow(give_back(run), f"node long, {column} binary"), f"set-{column}")


def _candidates(scratch: Scratch, measured: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """node, fp of the sets that occur in candidates, and node, owner_th, owner_id: one document that has the set, which is known
    by id and the hash of its text, so that null and repeated ids do no harm. Both as tables."""
    ends = found.where(F.col("kind") != _GROUP).select(F.explode(F.array("a", "b")).alias("node")).distinct()
    standing = found.where(F.col("kind") == _GROUP).select(F.col("a").alias("node"), F.col("b").alias("fp"))
    nodes = scratch.small(ends.join(standing, "node", "left").select("node", F.coalesce("fp", "node").alias("fp")), "candidate-sets")
    owners = measured.where("part is null").join(nodes, "fp").groupBy("node").agg(F.min(F.struct("th", "id")).alias("o"))
    return nodes, scratch.small(owners.select("node", F.col("o.th").alias("owner_th"), F.col("o.id").alias("owner_id")), "set-owners")


def _similar_documents(documents: DataFrame, id_col: str, text_col: str, hot: int, short_list: int, block: int) -> DataFrame:
    """id, th (hash of the text), n, fp, root (null for wordless ones), smallest (the component's id)."""
    spark = documents.sparkSession
    scratch, kept = Scratch(spark), Scratch(spark)
    base = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("th"))
    schema = T.StructType([T.StructField("id", base.schema["id"].dataType), *T.StructType.fromDDL("th long, n long, fp long, part int, counts binary").fields])
    measured = kept.table(base.mapInArrow(_measure("text", ["id", "th"]), schema), "set-sizes")
    rows = measured.where("part is null").select("id", "th", "n", "fp")
    counts = _sketch(measured)
    limit = max(hot, HOT_TIMES * counts.mean()) if hot >= HOT else hot
    total = rows.agg(F.sum(F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + 1)).first()[0] or 0
    buckets = max(16, math.ceil(int(total) / BUCKET_ENTRIES))
    dealt = base.select("text").mapInArrow(_deal(spark.sparkContext.broadcast(counts), "text", buckets, limit), "bucket int, kind int, data binary")
    found = scratch.table(dealt.groupBy("bucket").applyInArrow(_meet(short_list), "kind int, a long, b long, token long, n long, rest long"), "candidates")
    nodes, owners = _candidates(scratch, measured, found)
    sets = _read_sets(scratch, base, owners, "bits", bit_set)
    # stars, and groups with their members
    first = scratch.small(found.where(F.col("kind").isin(_STAR, _MEMBER)).select("a", "b").distinct(), "pairs")
    tested, links = _links(scratch, first, sets, base, owners)
    roots = scratch.small(components(links, scratch), "roots")
    other = found.where(F.col("kind").isin(_STAR, _OTHER)).select("a", "b").distinct()
    entries = found.where(F.col("kind") == _LIST).select("token", F.col("a").alias("node"), "n", "rest")
    members = scratch.small(found.where(F.col("kind") == _MEMBER).select("a", "b", "n"), "members")
    if not members.isEmpty():  # they go where their group goes, and form a list of their own
        of = lambda c: members.select(F.col("a").alias(c), F.col("b").alias("m"))
        for c, d in (("a", "b"), ("b", "a")):
            other = other.unionByName(other.join(of(c), c).select(F.col("m").alias(c), d))
        more = entries.withColumnRenamed("node", "a").join(of("a"), "a").select("token", F.col("m").alias("node"), "n", "rest")
        own = members.select(F.col("a").alias("token"), F.explode(F.array("a", "b")).alias("node"), "n", F.col("n").alias("rest")).distinct()
        entries = entries.unionByName(more).unionByName(own)
    other = _with_root(other, roots, "a", "b").where("r_a <> r_b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    across = _across(scratch, _with_root(entries, roots, "node"), sets, block)
    second = scratch.small(other.unionByName(across).distinct().join(tested, ["a", "b"], "left_anti"), "pairs")
    _, more = _links(scratch, second, sets, base, owners)
    if not more.isEmpty():  # joins components
        joins = _with_root(more, roots, "a", "b").select(F.col("r_a").alias("a"), F.col("r_b").alias("b")).distinct()
        again = scratch.small(components(joins, scratch), "joined-roots")
        alone = joins.select(F.explode(F.array("a", "b")).alias("node")).select("node", F.col("node").alias("root"))
        roots = _with_root(roots.unionByName(alone).distinct(), again, "root").select("node", F.col("r_root").alias("root"))
    roots = kept.small(roots.join(nodes, "node").select("fp", "root"), "roots")
    # the smallest id of each component; wordless documents stand alone
    placed = rows.join(roots, "fp", "left").select("id", "th", "n", "fp", F.when(F.col("n") > 0, F.coalesce("root", "fp")).alias("root"))
    smallest = placed.where("root is not null").groupBy("root").agg(F.min("id").alias("smallest"), F.count(F.lit(1)).alias("size")).where("size > 1").drop("size")
    smallest = kept.small(smallest, "smallest-ids")
    scratch.clear()
    return placed.join(smallest, "root", "left").select("id", "th", "n", "fp", "root", F.coalesce("smallest", "id").alias("smallest"))


@contextmanager
def small_batches(spark: SparkSession):
    """Arrow batches of few rows and bytes, as rows hold whole sets; then the session's own settings hold again."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": ARROW_ROWS, "spark.sql.execution.arrow.maxBytesPerBatch": ARROW_BYTES}
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def _placed_documents(documents: DataFrame, id_col: str, text_col: str, hot: int = HOT, short_list: int = SHORT_LIST, block: int = BLOCK) -> DataFrame:
    with small_batches(documents.sparkSession):  # all steps in Python run inside this call
        return _similar_documents(documents, id_col, text_col, hot, short_list, block)


def similar_documents(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per document: id, n_shingles, component_id."""
    found = _placed_documents(documents, id_col, text_col, **options)
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("smallest").alias("component_id"))


def keep_one_of_each(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One document of each component, with all columns: that with the smallest id (null ids last), then hash of the text.

    Rows are told apart by id and text, so rows of one id with other texts are judged by themselves, and of rows that have
    both in common one stays. Wordless documents all stay."""
    found = _placed_documents(documents, id_col, text_col, **options).where("root is not null")
    order = F.struct(F.col("id").isNull().alias("last"), "id", "th")
    best = found.groupBy("root").agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("size")).where("size > 1")
    scratch = Scratch(documents.sparkSession)
    best = scratch.small(best.select("root", F.col("best.id").alias("best_id"), F.col("best.th").alias("best_th")), "kept-documents")
    in_groups = scratch.table(found.join(best, "root").withColumn("stays", (F.col("th") == F.col("best_th")) & F.col("id").eqNullSafe(F.col("best_id"))), "grouped-documents")
    a, b, th = fresh(documents.columns, "gone_id", "gone_th", "text_hash")
    pick = lambda df: df.select(F.col("id").alias(a), F.col("th").alias(b))
    keyed = documents.withColumn(th, F.xxhash64(F.col(text_col)))
    same = (F.col(th) == F.col(b)) & F.col(id_col).eqNullSafe(F.col(a))
    gone = scratch.small(pick(in_groups.where("not stays")).distinct(), "gone-documents")
    again = scratch.small(pick(in_groups.where("stays")).groupBy(a, b).count().where("count > 1").drop("count"), "repeated-documents")
    out = keyed.join(gone, same, "left_anti")
    if not again.isEmpty():
        once = out.join(again, same, "left_semi").dropDuplicates([id_col, th])
        out = out.join(again, same, "left_anti").unionByName(once)
    return out.select(*documents.columns)
