"""The index on disk against the scan of all texts: with and without skipping, on awkward rows, and its blocks."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from archive_spark.functions import text as tx
from archive_spark.operators import retrieval, scoring
from archive_spark.plans import search_queries
from archive_spark.sources import search_index


@pytest.fixture(scope="module")
def tables(spark, sf_dir):
    queries, docs = search_queries._texts(spark, sf_dir)
    return queries, docs


def _rows(df):
    return sorted((r["query_id"], r["rank"], r["id"], r["score"]) for r in df.collect())


def test_skipping_loses_nothing(spark, tables, tmp_path):
    queries, docs = tables
    docs = docs.unionByName(docs.where("id < 30").withColumn("id", F.col("id") + 100_000)).cache()  # equal texts, so ties
    index = search_index.write_index(docs, f"file://{tmp_path}/index", chunk_docs=8)
    allowed = docs.where("lang = 'en'").select("id")
    for k, some in ((3, None), (20, None), (5, allowed)):
        want = _rows(retrieval.keyword_topk(queries, docs, k, some))
        assert want == _rows(search_index.keyword_topk(queries, index, k, some, prune_pairs=0)) == _rows(search_index.keyword_topk(queries, index, k, some))
    work = search_index.pairs(queries, index, 3).first()
    assert work["essential_pairs"] < work["all_pairs"] and work["looked_up"] > 0


def test_blocks_are_bounded(spark, tables, tmp_path):
    same = spark.range(500).select("id", F.lit("one two two").alias("text"))
    index = search_index.write_index(same, f"file://{tmp_path}/index", chunk_docs=50)
    sizes = [r[0] for r in index.table("blocks").select(F.size("ids")).collect()]
    assert sum(sizes) == 1000 and max(sizes) < 100
    assert {tuple(r) for r in index.table("terms").select("term", "df").collect()} == {("one", 500), ("two", 500)}


def test_awkward_documents(spark, tmp_path):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "A a b"), (4, "b ... c"), (None, "a c"), (5, "...")], "id long, text string")
    queries = spark.createDataFrame([("q", ["a", "c", "a"]), ("none", ["zz"]), ("empty", []), ("null", None)], "query_id string, terms array<string>")
    index = search_index.write_index(docs, f"file://{tmp_path}/index")
    for prune in (0, 10**9):
        got = {(r["query_id"], r["id"]): r["score"] for r in search_index.keyword_topk(queries, index, 5, prune_pairs=prune).collect()}
        want = {(r["query_id"], r["id"]): r["score"] for r in retrieval.keyword_topk(queries, docs, 5).collect()}
        assert got == want and set(got) == {("q", 3), ("q", 4), ("q", None)}
    empty = search_index.write_index(docs.where("id > 9"), f"file://{tmp_path}/empty")
    assert search_index.keyword_topk(queries, empty, 5).count() == 0


def test_matched_terms(spark, tables, tmp_path):
    queries, docs = tables
    index = search_index.write_index(docs, f"file://{tmp_path}/index", chunk_docs=16)
    hits = queries.where("query_id < 6").select("query_id").crossJoin(docs.where("id < 40").select("id"))
    want = hits.join(queries, "query_id").join(docs, "id").select("query_id", "id", F.size(F.array_intersect("terms", F.array_distinct(tx.terms(F.col("text"))))).alias("matched"))
    key = lambda df: sorted((r["query_id"], r["id"], r["matched"]) for r in df.collect())
    assert key(search_index.matched_terms(hits, queries, index)) == key(want)


def test_paths_must_be_shared(spark):
    assert search_index.new_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


def test_scores_are_made_where_the_documents_are(spark, tables, tmp_path, monkeypatch):
    """No pair of query and posting is shuffled: only blocks as they are, and the best of each task. Small steps and early dropping change nothing."""
    queries, docs = tables
    index = search_index.write_index(docs, f"file://{tmp_path}/index", chunk_docs=16)
    allowed = docs.where("lang = 'en'").select("id")
    want = [_rows(retrieval._keyword_by_joins(queries, docs, 7, some)) for some in (None, allowed)]
    for df in (search_index.keyword_topk(queries, index, 7), retrieval.keyword_topk(queries, docs, 7)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "HashAggregate" not in plan.split("MapInArrow")[0]
    monkeypatch.setattr(retrieval, "BROADCAST_ROWS", 5)
    assert _rows(retrieval.keyword_topk(queries, docs, 7)) == want[0]  # more terms than may be sent
    monkeypatch.undo()
    for some, rows in zip((None, allowed), want):
        assert _rows(search_index.keyword_topk(queries, index, 7, some)) == rows == _rows(retrieval.keyword_topk(queries, docs, 7, some))


def test_best_of_small_steps(monkeypatch):
    rng = np.random.default_rng(3)
    doc, term = np.nonzero(rng.random((90, 12)) < 0.4)
    tf, dl = rng.integers(1, 4, len(doc)), np.full(len(doc), 9)
    rows = [{"query_id": q, "term": f"t{t:02}", "idf": 0.5 + t, "avgdl": 9.0} for q in range(7) for t in range(q, 12, 3)]
    ids = pa.array([None if i == 50 else i % 45 for i in range(90)], pa.int64())

    def found():
        best = scoring.Best(scoring.asked(rows, pa.int64()), 5, pa.int64())
        best.add(ids, doc, term, tf, dl)
        return sorted((r["q"], -r["s"], r["i"] is not None, r["i"] or 0) for b in best.hits(["q", "i", "s"]) for r in b.to_pylist())

    want = found()
    assert len(want) == 35
    for name, value in (("DOC_STEP", 7), ("QUERY_BLOCK", 2), ("TERM_BLOCK", 3), ("PENDING", 11)):
        monkeypatch.setattr(scoring, name, value)
    assert found() == want
