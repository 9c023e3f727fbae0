r"""Toxic passages: maximum-scoring segments over token log-odds, with extreme-value calibration.

Fitting, on labelled rows outside the held-out quarter, all of them:

1. Counts. Of each label, in how many documents a token occurs, for words and for their first 3 to 8 bytes, in 2^19 hashed
   cells a kind. Copies of a document would count its rare words many times, so for tokens that look toxic
   the distinct neighbourhoods (word before, word after) are counted instead, over all rows again, as toxic only if no
   clean row has them.
2. Log-odds. A token's share of toxic occurrences has a Dirichlet prior: the share among the other tokens of the next
   shorter prefix, weighing PRIOR occurrences; the shortest has the share of all tokens. So each occurrence counts once,
   and a word never seen has the log-odds of its longest known beginning. The score is the log-odds less those of all tokens, less DRIFT, so that ordinary text falls.
3. Calibration, on a sixth of these rows, which is not counted. Without toxic passages the best segment of n words follows
   a Gumbel distribution whose place grows with log n; place and scale come from quantiles of clean documents by size.
   Then Platt scaling of a document's evidence, from a histogram.

Scoring: segments are all maximal-scoring ones by the linear-time scan of scores (each beginning at the least running
total before it), taken over merged stretches of one sign. E is the number of segments as good that chance gives in
n words; a passage is significant at E <= max_e. The evidence of a document is that of its r best segments together, for
the r that makes it greatest: with T the sum of their -log E, chance reaches T with a probability of about
exp(-T) T^(r-1) / (r! (r-1)!), of which 2^-r is left for having tried each r. Its score is the calibrated probability.

Words are runs of ASCII letters and digits and of all other characters beyond ASCII; A-Z count as a-z. Hashed cells are
shared by chance; what reaches the driver and each task is bounded by the number of cells, whatever the corpus.

Defined results: a null, empty or wordless text has no segment and the score of no evidence; null or repeated ids are
judged row by row, and a null id is not held out; labels without id or value are skipped, of several for one id the
greatest counts; without labels of both classes among the counted rows every score is the share of toxic ones (0 if
there are none); an empty table gives an empty result. Labels are the only other column that is read, and only of rows
that are not held out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, _BYTE, _power_table, arrays, bound_batches, give_back, joined, mix, raw_texts, slices, text_of, word_spans

#: Prefix lengths in bytes; the word itself is the last kind of token.
PREFIXES = (3, 4, 5, 6, 7, 8)
KINDS = len(PREFIXES) + 1
#: Hashed cells of each kind, the weight of the prior in occurrences, and what each word's score loses.
CELL_BITS, PRIOR, DRIFT = 19, 8.0, 0.7
#: Classes of a calibrated probability, and of E.
THRESHOLD, MAX_E = 0.3, 0.05
#: The held-out quarter of the ids, and the sixteenths of them on which scores are calibrated (a sixth of the others).
PARTS, HELD_OUT, FINE_PARTS, CALIBRATION = 4, 2, 16, (3, 11)
#: Evidence is kept within these bounds, and counted in cells of a tenth.
LEAST, MOST = -3.0, 30.0

_WORD = np.ones(256, dtype=bool)
_WORD[[b for b in range(128) if not chr(b).isalnum()]] = False
_TABLE = _BYTE.copy()
_TABLE[65:91] = _BYTE[97:123]


def read_words(texts: list[bytes]):
    """Buffer, begins, starts, ends, owner, and the cells (kinds x words) of all words."""
    buffer, begin, _ = joined(texts)
    starts, ends, inside = word_spans(buffer, ~_WORD)
    owner = text_of(starts, begin)
    if not len(starts):
        return buffer, begin, starts, ends, owner, np.zeros((KINDS, 0), dtype=np.int64)
    size = ends - starts
    first = np.cumsum(size) - size
    place = np.arange(int(size.sum()), dtype=np.int64) - np.repeat(first, size)
    terms = _TABLE[buffer[inside]] * _power_table(int(size.max()))[place]
    sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(terms, dtype=np.uint64)))
    cells = np.empty((KINDS, len(starts)), dtype=np.int64)
    for k in range(KINDS):
        length = size if k == KINDS - 1 else np.minimum(size, PREFIXES[k])
        h = mix(sums[first + length] - sums[first] + length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        cells[k] = (h >> np.uint64(64 - CELL_BITS)).astype(np.int64) + (k << CELL_BITS)
    return buffer, begin, starts, ends, owner, cells


def neighbourhoods(owner: np.ndarray, words: np.ndarray) -> np.ndarray:
    """A hash of the words before and after each word, within its text."""
    w = words.astype(np.uint64) + np.uint64(1)
    before, after = np.zeros(len(w), dtype=np.uint64), np.zeros(len(w), dtype=np.uint64)
    same = owner[1:] == owner[:-1]
    before[1:][same] = w[:-1][same]
    after[:-1][same] = w[1:][same]
    return mix(before * np.uint64(0xD6E8FEB86659FD93) + after).view(np.int64)


@dataclass
class Model:
    counts: np.ndarray | None  # 2 x (kinds * cells), float32
    share: float
    rate: float  # the score without a model
    gumbel: tuple[float, float, float] = (0.0, 0.0, 1.0)  # place at log n = 0, its slope, scale
    platt: tuple[float, float] = (1.0, 0.0)

    def log_odds(self, cells: np.ndarray) -> np.ndarray:
        p = np.full(cells.shape[1], self.share)
        clean, toxic = self.counts[:, cells]
        for k in range(KINDS):  # from the shortest prefix to the word; what a longer token has counts there
            t, c = (x[k] if k == KINDS - 1 else np.maximum(x[k] - x[k + 1], 0) for x in (toxic, clean))
            p = (t + PRIOR * p) / (t + c + PRIOR)
        return np.log(p / (1 - p)) - np.log(self.share / (1 - self.share))

    def e_logs(self, scores: np.ndarray, n: np.ndarray) -> np.ndarray:
        """-log E of segments in texts of n words."""
        at, slope, scale = self.gumbel
        return (scores - at - slope * np.log(np.maximum(n, 1))) / scale

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        if self.counts is None:
            return np.full(len(evidence), self.rate)
        a, b = self.platt
        return 1 / (1 + np.exp(-np.clip(a * evidence + b, -30, 30)))


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, one past the last, score), in linear time: each new one joins those before it as
    long as the total before it and the total after it both rise above theirs."""
    total, found = 0.0, []  # first, last, total before, total after, place of the nearest one with a lesser total before
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        new = [i, i + 1, before, total, -1]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j = found[j][4]
            if j < 0 or found[j][3] >= new[3]:
                new[4] = j
                found.append(new)
                break
            new[0], new[2] = found[j][0], found[j][2]
            del found[j:]
    return [(a, b, after - before) for a, b, before, after, _ in found]


def text_segments(scores: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of n texts' words: first word, one past the last, and score of each maximal segment, by place. Stretches of one sign
    are merged first, which changes no maximal segment."""
    if not len(scores):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
    up = scores > 0
    heads = np.flatnonzero(np.concatenate(([True], (up[1:] != up[:-1]) | (owner[1:] != owner[:-1]))))
    sums = np.add.reduceat(scores, heads)
    edges = np.concatenate((heads, [len(scores)]))
    of = owner[heads]
    out = []
    for i in np.unique(of[sums > 0]):
        a, b = np.searchsorted(of, i), np.searchsorted(of, i, "right")
        out += [(edges[a + x], edges[a + y], s) for x, y, s in maximal_segments(sums[a:b].tolist())]
    if not out:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
    x, y, s = zip(*out)
    return np.array(x), np.array(y), np.array(s)


def _hash_part(id_col: str, parts: int) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % parts


def held_out(id_col: str) -> Column:
    return F.coalesce(_hash_part(id_col, PARTS) == HELD_OUT, F.lit(False))


def _labelled(documents: DataFrame, labels: DataFrame, id_col: str, text_col: str, scratch: Scratch) -> DataFrame:
    """tests (whether it is for calibration), toxic, text of each labelled document that is not held out."""
    known = labels.where(F.col("toxic").isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.max("toxic").cast("int").alias("toxic"))
    known = scratch.small(known, "toxic-labels")  # sent to all tasks up to BROADCAST_ROWS, else joined by shuffle
    texts = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    return texts.join(known, "id").select(_hash_part("id", FINE_PARTS).isin(*CALIBRATION).alias("tests"), "toxic", "text")


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    heads = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, dtype=np.int64)
    return keys[heads], np.diff(np.concatenate((heads, [len(keys)])))


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cells = KINDS << CELL_BITS
    counts = np.zeros((2, cells), dtype=np.int32)
    for batch in slices(batches, "text"):
        *_, owner, found = read_words(raw_texts(batch.column("text")))
        toxic = np.array(batch.column("toxic").to_pylist(), dtype=np.int64) > 0
        for row in found:
            keys, _ = _distinct(owner * cells + row)
            of, cell = np.divmod(keys, cells)
            for y in (0, 1):
                np.add.at(counts[y], cell[toxic[of] == bool(y)], 1)
    some = np.flatnonzero(counts.any(axis=0))
    for at in range(0, len(some), 1 << 18):
        part = some[at : at + (1 << 18)]
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(counts[0][part]), pa.array(counts[1][part])], names=["cell", "clean", "toxic"])


def _filled(table: pa.Table, counts: np.ndarray) -> None:
    at = table.column("cell").to_numpy()
    for y, name in enumerate(("clean", "toxic")):
        counts[y][at] = table.column(name).to_numpy()


def count_tokens(counted: DataFrame) -> np.ndarray:
    """Occurrences of each cell in clean and in toxic rows; at most one row a cell comes to the driver."""
    counts = np.zeros((2, KINDS << CELL_BITS), dtype=np.float32)
    rows = counted.mapInArrow(give_back(_document_counts), "cell int, clean int, toxic int")
    _filled(rows.groupBy("cell").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toArrow(), counts)
    clean, toxic = counts.sum(axis=1)
    if not clean or not toxic:
        return counts
    share = toxic / (clean + toxic)
    toxic_odds = (counts[1] + PRIOR * share) / (counts[0] + PRIOR * (1 - share))
    suspect = (counts[1] >= 2) & (toxic_odds > np.exp(DRIFT) * share / (1 - share))  # others only lower a segment
    flags = counted.sparkSession.sparkContext.broadcast(np.packbits(suspect))

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(flags.value).astype(bool)
        for batch in slices(batches, "text"):
            *_, owner, found = read_words(raw_texts(batch.column("text")))
            toxic = np.array(batch.column("toxic").to_pylist(), dtype=np.int64) > 0
            about = neighbourhoods(owner, found[-1])
            for row in found:
                pick = np.flatnonzero(wanted[row])
                if len(pick):
                    yield pa.RecordBatch.from_arrays([pa.array(row[pick].astype(np.int32)), pa.array(about[pick]), pa.array(toxic[owner[pick]])], names=["cell", "about", "toxic"])

    # a neighbourhood that clean rows have, too, is no sign of toxicity
    seen = counted.mapInArrow(give_back(contexts), "cell int, about long, toxic boolean").groupBy("cell", "about").agg(F.bool_and("toxic").alias("toxic"))
    toxic_sum = F.sum(F.col("toxic").cast("int"))
    _filled(seen.groupBy("cell").agg((F.count("*") - toxic_sum).cast("int").alias("clean"), toxic_sum.cast("int").alias("toxic")).toArrow(), counts)
    return counts


def _gumbel(cells: list) -> tuple[float, float, float]:
    """Place, slope and scale from (log n, count, median, ninth decile) of the best segments of clean rows by size."""
    if not cells:
        return 0.0, 0.5, 0.5
    x, n, half, high = (np.array([float(r[i]) for r in cells]) for i in range(4))
    w = n / n.sum()
    middle, top = -np.log(np.log(2)), -np.log(-np.log(0.9))
    scale = max(float(w @ (high - half)) / (top - middle), 0.05)
    y = half - middle * scale
    apart = float(w @ (x - w @ x) ** 2)
    slope = max(float(w @ ((x - w @ x) * y)) / apart, 0.0) if apart else 0.0
    return float(w @ (y - slope * x)), slope, scale


def _platt(value: np.ndarray, clean: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Newton steps of a logistic curve through counts at each value."""
    total, high = clean + toxic, toxic.sum()
    goal = (toxic * (high + 1) / (high + 2) + clean / (clean.sum() + 2)) / total
    a, b = 0.5, 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * value + b, -30, 30)))
        r, v = total * (p - goal), total * np.maximum(p * (1 - p), 1e-9)
        hess = np.array([[v @ value**2, v @ value], [v @ value, v.sum()]]) + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, [r @ value, r.sum()])
        a, b = max(a - np.clip(step[0], -1, 1), 0.0), b - np.clip(step[1], -5, 5)
    return float(a), float(b)


def together(e_logs: list[float]) -> float:
    """The evidence of the best segments together."""
    best, total = LEAST, 0.0
    for r, e in enumerate(sorted(e_logs, reverse=True), 1):
        total += e
        if e <= 0 and r > 1:
            break
        chance = total - (r - 1) * math.log(max(total, 1.0)) + math.lgamma(r + 1) + math.lgamma(r) - r * math.log(2)
        best = max(best, min(chance, MOST))
    return best


def evidence(e_logs: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    ends = np.searchsorted(of, np.arange(n + 1))
    return np.array([together(e_logs[a:b].tolist()) for a, b in zip(ends[:-1], ends[1:])])


def train(documents: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """The model, from all labelled rows that are not held out."""
    spark = documents.sparkSession
    scratch = Scratch(spark)
    try:
        rows = _labelled(documents, labels, id_col, text_col, scratch)
        counts = count_tokens(rows.where("not tests"))
        words = counts[:, -(1 << CELL_BITS) :].sum(axis=1)
        share = float(np.clip(words[1] / max(words.sum(), 1), 1e-6, 1 - 1e-6))
        seen = counts.any(axis=1)
        if not seen.all():
            return Model(None, share, float(seen[1]))
        model = Model(counts, share, share)
        sent = spark.sparkContext.broadcast(model)

        def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text"):
                texts = raw_texts(batch.column("text"))
                _, _, _, _, owner, cells = read_words(texts)
                first, _, score = text_segments(sent.value.log_odds(cells) - DRIFT, owner, len(texts))
                of = owner[first] if len(first) else first
                words = np.bincount(owner, minlength=len(texts))
                yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(words.astype(np.int64)), arrays(pa.float64(), np.bincount(of, minlength=len(texts)), score)], names=["toxic", "words", "scores"])

        tested = scratch.table(rows.where("tests").mapInArrow(give_back(segments), "toxic int, words long, scores array<double>"), "toxic-segments")
        best = F.coalesce(F.array_max("scores"), F.lit(0.0))
        size = F.floor(F.log2("words") * 2)
        clean = tested.where("toxic = 0 and words > 0").groupBy(size.alias("size")).agg(F.avg(F.log("words")), F.count("*"), F.percentile_approx(best, 0.5), F.percentile_approx(best, 0.9)).drop("size")
        model.gumbel = _gumbel(clean.collect())  # a row for each half power of two
        known = spark.sparkContext.broadcast(model)

        def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lists = batch.column("scores")
                of = np.repeat(np.arange(batch.num_rows), pc.list_value_length(lists).to_numpy())
                e_logs = known.value.e_logs(lists.flatten().to_numpy(), batch.column("words").to_numpy()[of])
                yield pa.RecordBatch.from_arrays([pa.array(np.round(evidence(e_logs, of, batch.num_rows), 1)), pa.array(batch.column("toxic").to_numpy() > 0)], names=["value", "toxic"])

        cells = tested.mapInArrow(give_back(weigh), "value double, toxic boolean").groupBy("value").agg(F.count_if(~F.col("toxic")), F.count_if("toxic")).collect()  # a row for each tenth between the bounds
        if cells:
            model.platt = _platt(*(np.array([float(r[i]) for r in cells]) for i in range(3)))
        return model
    finally:
        scratch.clear()


def toxic_passages(documents: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, max_e: float = MAX_E) -> DataFrame:
    """Per document: id, held_out, score, predicted, n_words, passages (start and end in code points, end exclusive; score;
    -log E), the significant ones by place."""
    spark = documents.sparkSession
    bound_batches(spark)
    model = spark.sparkContext.broadcast(train(documents, labels, id_col=id_col, text_col=text_col))
    kind = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("e_log", pa.float64())])
    schema = T.StructType([documents.schema[id_col], *T.StructType.fromDDL("held_out boolean, score double, predicted int, n_words long, passages array<struct<start:long,end:long,score:double,e_log:double>>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in slices(batches, "text"):
            texts = raw_texts(batch.column("text"))
            n = len(texts)
            buffer, begin, starts, ends, owner, cells = read_words(texts)
            words = np.bincount(owner, minlength=n)
            none = np.zeros(0, dtype=np.int64)
            first, last, score = text_segments(m.log_odds(cells) - DRIFT, owner, n) if m.counts is not None else (none, none, none.astype(float))
            of = owner[first] if len(first) else none
            e_log = m.e_logs(score, words[of])
            p = m.probability(evidence(e_log, of, n))
            found = np.flatnonzero(e_log >= -np.log(max_e))
            points = np.concatenate(([0], np.cumsum((buffer & 0xC0) != 0x80)))  # code points before each byte
            of, a, b = of[found], starts[first[found]], ends[last[found] - 1]
            offsets = np.concatenate(([0], np.cumsum(np.bincount(of, minlength=n)))).astype(np.int32)
            values = pa.StructArray.from_arrays([pa.array(points[a] - points[begin[of]]), pa.array(points[b] - points[begin[of]]), pa.array(score[found]), pa.array(e_log[found])], fields=list(kind))
            columns = [batch.column("held_out"), pa.array(p), pa.array((p >= threshold).astype(np.int32)), pa.array(words.astype(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), values)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], names=schema.names)

    return documents.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text")).mapInArrow(give_back(run), schema)
