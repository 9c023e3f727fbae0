"""The pipeline as a whole: what each stage kept of its own input, against plain versions."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from archive_spark.llm import queries as q

from . import brute

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def tables(sf_dir, tmp_path_factory):
    """The smallest tables, and near copies of which no line is that of the first."""
    at = tmp_path_factory.mktemp("near")
    docs = pq.read_table(f"{sf_dir}/documents.parquet")
    rows = [r for r in docs.to_pylist() if len((r["text"] or "").split()) > 200][:12]
    near = [r | {"doc_id": 10**6 + i, "text": "\n".join(f"{x} {i}x" if x.strip() else x for x in r["text"].split("\n"))} for i, r in enumerate(rows)]
    pq.write_table(pa.concat_tables([docs, pa.Table.from_pylist(near, docs.schema)]), at / "documents.parquet")
    for name in ("labels", "benchmark"):
        pq.write_table(pq.read_table(f"{sf_dir}/{name}.parquet"), at / f"{name}.parquet")
    return str(at)


@pytest.fixture(scope="module")
def stages(spark, tables):
    """Rows before the first stage and after each one."""
    sf_dir = tables
    paths, shared = [], corpus_pipeline.shared_path
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(corpus_pipeline, "shared_path", lambda s, name: paths.append(shared(s, name)) or paths[-1])
        last = corpus_pipeline.run(spark, sf_dir)
    assert len(paths) == len(corpus_pipeline.STAGES) == 5
    found = [spark.read.parquet(p) for p in (f"{sf_dir}/documents.parquet", *paths)]
    assert all(t.columns == COLUMNS for t in found[:-1]) and last.columns == found[-1].columns
    return [[r.asDict() for r in t.collect()] for t in found]


def pairs(rows):
    return sorted((r["doc_id"], r["text"]) for r in rows)


def test_quality_rules(spark, tables, stages):
    verdict = {r["doc_id"]: r["kept"] for r in q.op10_quality(spark, tables).collect()}
    assert pairs(stages[1]) == [p for p in pairs(stages[0]) if verdict[p[0]]]
    failed = {r[0] for r in brute.quality(pairs(stages[0])) if r[-1]}
    assert failed and not failed & {r["doc_id"] for r in stages[1]}


def test_line_dedup(stages):
    left = [(d, text) for d, text, gone in brute.line_dedup(pairs(stages[1])) if not gone or brute.WORD.search(text)]
    assert pairs(stages[2]) == left and left != pairs(stages[1])


def test_ngram_jaccard_join(stages):
    root = {d: c for d, _, c in brute.jaccard(pairs(stages[2]))}
    want = [(d, t) for d, t in pairs(stages[2]) if root[d] == d]
    assert pairs(stages[3]) == want and len(want) < len(stages[2])


def test_decontamination(stages, spark, sf_dir):
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    bad = {r[0] for r in brute.contamination(pairs(stages[3]), items) if r[5]}
    assert pairs(stages[4]) == [p for p in pairs(stages[3]) if p[0] not in bad] and bad


def test_packing(stages):
    got = sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in stages[5])
    assert got == sorted(brute.pieces(pairs(stages[4])))
    for r in stages[5]:
        assert len(np.frombuffer(r["ids"], dtype="<u4")) == r["length"]
    ends = {}
    for r in sorted(stages[5], key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 1024 and len(ends) <= 1.01 * sum(ends.values()) / 1024 + 1
