"""BM25 within a task: terms counted by document, postings times weights, and the best k of each query that the task has met.

What is held is bounded: a step of documents against a block of queries and of terms, and the best k of each query.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The usual BM25 parameters.
K1, B = 1.2, 0.75
#: Documents, queries and terms that are multiplied at once, and hits that are kept before all but the best are dropped.
DOC_STEP, QUERY_BLOCK, TERM_BLOCK, PENDING = 512, 1_000, 2_000, 500_000


def count_terms(lists: pa.ListArray, known: pa.Array | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Lists of terms as places of lists, places of terms, how often each is there (by list, then term), and the terms; only `known` ones if given."""
    flat = lists.flatten()
    row = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    if known is None:
        encoded = flat.dictionary_encode()
        known, code = encoded.dictionary, encoded.indices.to_numpy(zero_copy_only=False)
    else:
        code = pc.fill_null(pc.index_in(flat, known), -1).to_numpy(zero_copy_only=False)
        row, code = row[code >= 0], code[code >= 0]
    key, n = np.unique(row * max(len(known), 1) + code, return_counts=True)
    return key // max(len(known), 1), key % max(len(known), 1), n, known


@dataclass
class Asked:
    """The terms of all queries: pairs of query and term in the order of their terms, with idf."""

    ids: pa.Array
    terms: pa.Array
    query: np.ndarray
    first: np.ndarray
    idf: np.ndarray
    avgdl: float


def asked(rows: list, id_type: pa.DataType) -> Asked:
    """rows: query_id, term, idf, avgdl."""
    queries, terms = list(dict.fromkeys(r["query_id"] for r in rows)), sorted({r["term"] for r in rows})
    q, t = {x: i for i, x in enumerate(queries)}, {x: i for i, x in enumerate(terms)}
    pairs = sorted((t[r["term"]], q[r["query_id"]], r["idf"]) for r in rows)
    term = np.array([p[0] for p in pairs], np.int64)
    return Asked(pa.array(queries, id_type), pa.array(terms, pa.string()), np.array([p[1] for p in pairs], np.int64), np.searchsorted(term, np.arange(len(terms) + 1)), np.array([p[2] for p in pairs], float), rows[0]["avgdl"] if rows else 0.0)


class Best:
    """The best k documents of each query, by score rounded to six places, then id."""

    def __init__(self, asked: Asked, k: int, id_type: pa.DataType):
        self.asked, self.k, self.id_type = asked, k, id_type
        self.floor, self.held, self.rows = np.zeros(len(asked.ids)), [], 0

    def add(self, ids: pa.Array, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, dl: np.ndarray) -> None:
        """Postings: the place of a document among ids, of a term among the asked ones, its count, and the document's length. All postings of a document come in one call."""
        impact = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / self.asked.avgdl))
        order = np.argsort(doc, kind="stable")
        doc, term, impact = doc[order], term[order], impact[order]
        for low in range(0, len(ids), DOC_STEP):
            s, e = np.searchsorted(doc, (low, low + DOC_STEP))
            if e > s:
                self._step(ids, low, doc[s:e] - low, term[s:e], impact[s:e])

    def _step(self, ids: pa.Array, low: int, doc: np.ndarray, term: np.ndarray, impact: np.ndarray) -> None:
        a, n = self.asked, min(DOC_STEP, len(ids) - low)
        used, at = np.unique(term, return_inverse=True)
        sizes = a.first[used + 1] - a.first[used]
        pair = np.repeat(a.first[used] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        column, query, idf = np.repeat(np.arange(len(used)), sizes), a.query[pair], a.idf[pair]
        for b in range(0, len(a.ids), QUERY_BLOCK):
            scores = np.zeros((min(QUERY_BLOCK, len(a.ids) - b), n))
            mine = (query >= b) & (query < b + QUERY_BLOCK)
            for t in range(0, len(used), TERM_BLOCK):
                width = min(TERM_BLOCK, len(used) - t)
                here, there = mine & (column >= t) & (column < t + width), (at >= t) & (at < t + width)
                weights, impacts = np.zeros((len(scores), width)), np.zeros((width, n))
                weights[query[here] - b, column[here] - t] = idf[here]
                impacts[at[there] - t, doc[there]] = impact[there]
                scores += weights @ impacts
            rounded = np.round(scores, 6)
            q, d = np.nonzero((scores > 0) & (rounded >= self.floor[b : b + len(scores), None]))
            self.held.append(pa.table({"q": q + b, "score": rounded[q, d], "id": ids.take(pa.array(d + low))}))
            self.rows += len(q)
            if self.rows > PENDING:
                self._prune()

    def _prune(self) -> None:
        every = pa.concat_tables(self.held)
        every = every.take(pc.sort_indices(every, sort_keys=[("q", "ascending"), ("score", "descending"), ("id", "ascending")], null_placement="at_start"))
        q = every["q"].to_numpy()
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        last = rank == self.k - 1
        self.floor[q[last]] = every["score"].to_numpy()[last]
        self.held = [every.take(pa.array(np.flatnonzero(rank < self.k)))]
        self.rows = self.held[0].num_rows

    def hits(self, names: list[str]) -> Iterator[pa.RecordBatch]:
        """query_id, id and score."""
        if self.held:
            self._prune()
            every = self.held[0].combine_chunks()
            found = pa.table([self.asked.ids.take(every["q"].combine_chunks()), every["id"].cast(self.id_type), every["score"]], names=names)
            yield from found.to_batches(max_chunksize=10_000)
