r"""Quality rules: counted rules, and hashed n-gram logistic regression trained on labelled rows.

Counts are taken on the bytes of many texts at once. The classifier sees the hashed words, word pairs and byte
4-grams of a text, each family as shares of the text's own total. It is fitted on a bounded sample of labelled
documents (`max_train`, those with the smallest hash of their id), its scores are calibrated (Platt) on a part of the
sample that was held out of fitting, and a document passes if its calibrated probability reaches a fixed threshold.

Defined results: a null, empty or wordless text has all counts 0 and fails the base rules; repeated rows are judged one
by one; with no labelled rows of both classes the method's verdict is to keep; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACES, bound_batches, byte_table, give_back, joined, mix, raw_texts, slices, text_of, window_hashes, word_hashes, word_spans

#: Fixed values of the base rules.
SYMBOLS = b"#*$%&|<>"
REPEAT_WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT = 8, 20, 30
#: Buckets of each feature family; families are words, word pairs and byte 4-grams.
FAMILY_BITS, FAMILIES = 16, 3
#: Bound of the labelled sample, and the calibrated probability that a document must reach.
MAX_TRAIN, THRESHOLD = 4000, 0.3

_SPACE, _SYMBOL = byte_table(SPACES), byte_table(SYMBOLS)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _sum_by(values: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(of, weights=values, minlength=n).astype(np.int64)


def repeated_words(hashes: np.ndarray, owner: np.ndarray, n: int, size: int = REPEAT_WINDOW) -> np.ndarray:
    """Words of each text that lie in windows found at least twice in it."""
    windows = window_hashes(hashes, size)
    start = np.flatnonzero(owner[: len(windows)] == owner[size - 1 :]) if len(windows) else np.zeros(0, dtype=np.int64)
    if not len(start):
        return np.zeros(n, dtype=np.int64)
    keys = mix(windows[start] + (owner[start].astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(keys), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    step = np.zeros(len(hashes) + 1, dtype=np.int32)
    step[start[twice]] += 1
    step[start[twice] + size] -= 1
    return np.bincount(owner[np.cumsum(step[:-1]) > 0], minlength=n)


def base_counts(texts: list[bytes], parts) -> dict[str, np.ndarray]:
    buffer, begin, _, starts, inside, owner, hashes = parts
    n = len(texts)
    words = np.bincount(owner, minlength=n)
    counted = inside & ((buffer & 0xC0) != 0x80)
    at = np.concatenate((begin, [len(buffer)]))
    chars = np.diff(np.concatenate(([0], np.cumsum(counted)))[at])
    symbols = np.diff(np.concatenate(([0], np.cumsum(_SYMBOL[buffer])))[at])
    duplicates = np.zeros(n, dtype=np.int64)
    for i, text in enumerate(texts):
        lines = [x for x in text.split(b"\n") if x.strip(SPACES)]
        duplicates[i] = len(lines) - len(set(lines))
    repeats = repeated_words(hashes, owner, n)
    failed = (words < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * words)
    return {"n_words": words, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": duplicates, "n_repeat_words": repeats, "base_failed": failed}


def read_parts(texts: list[bytes]):
    buffer, begin, end = joined(texts)
    starts, ends, inside = word_spans(buffer, _SPACE)
    return buffer, begin, end, starts, inside, text_of(starts, begin), word_hashes(buffer, starts, ends, inside)


def features(parts) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each family: the bucket of each occurrence and the text it is in (texts ascending)."""
    buffer, begin, end, _, _, owner, hashes = parts
    shift = np.uint64(64 - FAMILY_BITS)
    out = [(hashes >> shift, owner)]
    pairs = window_hashes(hashes, 2)
    inner = owner[: len(pairs)] == owner[1:] if len(pairs) else np.zeros(0, dtype=bool)
    out.append((pairs[inner] >> shift, owner[: len(pairs)][inner]))
    b = buffer.astype(np.uint32)
    grams = b[:-3] | b[1:-2] << 8 | b[2:-1] << 16 | b[3:] << 24 if len(b) > 3 else np.zeros(0, dtype=np.uint32)
    grams = (grams * np.uint32(2654435761)) >> np.uint32(32 - FAMILY_BITS)
    sizes = np.maximum(end - begin - 3, 0)
    inner = np.repeat(begin, sizes) + np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out.append((grams[inner], np.repeat(np.arange(len(begin)), sizes)))
    return out


@dataclass
class Model:
    weights: np.ndarray  # FAMILIES rows of 2**FAMILY_BITS
    bias: float
    slope: float = 1.0
    offset: float = 0.0

    def margin(self, parts, n: int) -> np.ndarray:
        total = np.full(n, self.bias)
        for row, (bucket, owner) in zip(self.weights, features(parts)):
            count = np.bincount(owner, minlength=n)
            total += np.bincount(owner, weights=row[bucket], minlength=n) / np.maximum(count, 1)
        return total

    def probability(self, parts, n: int) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(parts, n) + self.offset, -30, 30)))


def fit(texts: list[bytes], labels: list[int], epochs: int = 6, rate: float = 0.5, l2: float = 1e-4) -> Model | None:
    """Adagrad on the sample's first four fifths, then Platt scaling on the rest. None without both classes."""
    y = np.asarray(labels, dtype=float)
    if len(set(y[: max(1, len(y) * 4 // 5)])) < 2:
        return None
    rows = []
    for text in texts:
        index, value = [], []
        for f, (bucket, _) in enumerate(features(read_parts([text]))):
            if len(bucket):
                b, c = np.unique(bucket, return_counts=True)
                index.append(b.astype(np.int64) + (f << FAMILY_BITS))
                value.append(c / c.sum())
        rows.append((np.concatenate(index), np.concatenate(value)) if index else (np.zeros(0, dtype=np.int64), np.zeros(0)))
    cut = len(rows) * 4 // 5
    w, seen = np.zeros(FAMILIES << FAMILY_BITS), np.full(FAMILIES << FAMILY_BITS, 1e-8)
    bias, seen_bias = 0.0, 1e-8
    share = np.clip(y[:cut].mean(), 0.01, 0.99)
    cost = np.where(y > 0, 0.5 / share, 0.5 / (1 - share))
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(cut):
            at, x = rows[i]
            g = cost[i] * (1 / (1 + np.exp(-np.clip(w[at] @ x + bias, -30, 30))) - y[i])
            step = g * x + l2 * w[at]
            seen[at] += step * step
            w[at] -= rate * step / np.sqrt(seen[at])
            seen_bias += g * g
            bias -= 0.1 * g / np.sqrt(seen_bias)
    model = Model(w.reshape(FAMILIES, -1), bias)
    if len(held := range(cut, len(rows))) >= 20 and len(set(y[cut:])) == 2:
        margins = np.array([w[rows[i][0]] @ rows[i][1] + bias for i in held])
        a, b = 1.0, 0.0
        target = np.where(y[cut:] > 0, 1 - 1 / (2 + y[cut:].sum()), 1 / (2 + (1 - y[cut:]).sum()))
        for _ in range(50):  # Newton steps
            p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
            r, v = p - target, np.maximum(p * (1 - p), 1e-9)
            grad = np.array([r @ margins, r.sum()])
            hess = np.array([[v @ margins**2, v @ margins], [v @ margins, v.sum()]]) + 1e-6 * np.eye(2)
            d = np.linalg.solve(hess, grad)
            a, b = a - np.clip(d[0], -5, 5), b - np.clip(d[1], -5, 5)
        model.slope, model.offset = max(a, 0.0), b
    return model


def training_sample(documents: DataFrame, labels: DataFrame, max_train: int, id_col: str, text_col: str) -> list:
    chosen = labels.select(F.col(id_col).alias("_id"), F.col("quality").alias("_quality")).where("_id is not null and _quality is not null").groupBy("_id").agg(F.max("_quality").alias("_quality"))
    # a top-k of the ids alone; texts are read for those only
    chosen = chosen.orderBy(F.xxhash64("_id"), "_id").limit(max_train)
    texts = documents.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where("_text is not null")
    rows = texts.join(F.broadcast(chosen), "_id").orderBy(F.xxhash64("_id"), "_id", "_text").limit(max_train).collect()
    return [(r["_text"].encode(), int(r["_quality"])) for r in rows]


def train(documents: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    """The sample is at most max_train documents, whatever the size of the tables."""
    sample = training_sample(documents, labels, max_train, id_col, text_col)
    return fit([t for t, _ in sample], [q for _, q in sample]) if sample else None


def _judge(model, text_col: str, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, dict[str, np.ndarray]]]:
        for batch in slices(batches, text_col):
            texts = raw_texts(batch.column(text_col))
            parts = read_parts(texts)
            out = base_counts(texts, parts)
            out["probability"] = model.value.probability(parts, len(texts)) if model.value else np.ones(len(texts))
            out["kept"] = ~out["base_failed"] & (out["probability"] >= threshold)
            yield batch, out

    return run


def quality_scores(documents: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, max_train: int = MAX_TRAIN) -> DataFrame:
    """Per document: id, the counts, base_failed, kept, probability (calibrated, of good quality)."""
    bound_batches(documents.sparkSession)
    model = documents.sparkSession.sparkContext.broadcast(train(documents, labels, max_train, id_col, text_col))
    schema = T.StructType([documents.schema[id_col], *[T.StructField(c, T.LongType()) for c in COUNTS], T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()), T.StructField("probability", T.DoubleType())])
    judge = _judge(model, text_col, threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, out in judge(batches):
            columns = [pa.array(out[f.name], pa.bool_() if f.dataType == T.BooleanType() else pa.float64() if f.dataType == T.DoubleType() else pa.int64()) for f in schema.fields[1:]]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), *columns], names=schema.names)

    return documents.select(F.col(id_col), F.col(text_col)).mapInArrow(give_back(run), schema)


def keep_good(documents: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, max_train: int = MAX_TRAIN) -> DataFrame:
    """The documents that pass, with all their columns."""
    bound_batches(documents.sparkSession)
    model = documents.sparkSession.sparkContext.broadcast(train(documents, labels, max_train, id_col, text_col))
    judge = _judge(model, text_col, threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, out in judge(batches):
            yield batch.filter(pa.array(out["kept"]))

    return documents.mapInArrow(give_back(run), documents.schema)
