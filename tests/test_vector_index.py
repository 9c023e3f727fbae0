"""The vector index against the scan: exact searches, recall of probes, every row in a block, awkward rows."""

import pytest
from pyspark.sql import functions as F

from archive_spark.operators import retrieval
from archive_spark.plans import search_queries
from archive_spark.sources import vector_index


def _rows(df):
    return sorted(((r["query_id"], r["rank"], r["id"], r["score"]) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def tables(spark, sf_dir):
    queries, vectors = search_queries._vectors(spark, sf_dir)
    more = vectors.unionByName(vectors.where("id < 40").withColumn("id", F.col("id") + 1_000_000)).cache()  # equal vectors, so ties
    return queries.cache(), more


@pytest.fixture(scope="module")
def index(tables, tmp_path_factory):
    return vector_index.write_vector_index(tables[1], f"file://{tmp_path_factory.mktemp('vectors')}/index")


def test_exact_search_is_the_scan(tables, index):
    queries, vectors = tables
    for k, probes in ((1, 4), (10, 1)):
        assert _rows(vector_index.vector_search(queries, index, k, probes, exact=True)) == _rows(retrieval.vector_topk(queries, vectors, k))
    assert vector_index.open_vector_index(index.spark, index.path) == index


def test_blocks_hold_every_row(tables, index, monkeypatch, tmp_path):
    monkeypatch.setattr(vector_index, "BLOCK_ROWS", 7)
    monkeypatch.setattr(vector_index, "BROADCAST_NUMBERS", 0)
    small = vector_index.write_vector_index(tables[1], f"file://{tmp_path}/small", cells=3)
    for i in (index, small):
        blocks = i.table("blocks")
        assert sorted(r[0] for r in blocks.select(F.explode("ids")).collect()) == sorted(r[0] for r in tables[1].select("id").collect())
        assert blocks.where(F.size("numbers") != F.size("ids") * i.dims).count() == 0 and blocks.where("low > high").count() == 0
    assert small.table("blocks").agg(F.max(F.size("ids"))).first()[0] == 7 and small.table("cells").count() == 3
    want = _rows(retrieval.vector_topk(*tables, 5))
    assert _rows(vector_index.vector_search(tables[0], small, 5, 1, exact=True)) == want


def test_recall(tables, index):
    queries, vectors = tables
    want = {x[::2] for x in _rows(retrieval.vector_topk(queries, vectors, 10))}
    got = {x[::2] for x in _rows(vector_index.vector_search(queries, index, 10))}
    assert len(want & got) >= 0.9 * len(want)
    w = vector_index.work(queries, index, 10).first()
    assert 0 < w["probed"] <= w["all_pairs"] and w["probed"] + w["read_besides"] <= w["all_pairs"]


def test_cells_far_away_are_skipped(spark, tmp_path):
    near = spark.range(400).select("id", F.array(F.lit(1.0), F.col("id") / 1e4, F.lit(0.0)).alias("vector"))
    far = spark.range(400).select((F.col("id") + 1000).alias("id"), F.array(F.lit(0.0), F.lit(0.1), F.lit(1.0) + F.col("id") / 1e3).alias("vector"))
    both = near.unionByName(far)
    i = vector_index.write_vector_index(both, f"file://{tmp_path}/far", cells=6)
    queries = spark.createDataFrame([(1, [1.0, 0.01, 0.0])], "query_id int, vector array<double>")
    w = vector_index.work(queries, i, 3, probes=1).first()
    assert w["probed"] + w["read_besides"] < 500
    assert _rows(vector_index.vector_search(queries, i, 3, 1, exact=True)) == _rows(retrieval.vector_topk(queries, both, 3))


def test_awkward_vectors(spark, tmp_path):
    rows = [(1, [1.0, 0.0]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [1.0, None]), (6, [float("nan"), 1.0]), (None, [1.0, 1.0]), (2**60 + 1, [0.0, 1.0]), (9, [1.0, 2.0, 3.0])]
    vectors = spark.createDataFrame([(*r, "x") for r in rows], "id long, vector array<double>, cell string")
    queries = spark.createDataFrame([("a", [1.0, 0.5]), ("null", None), ("zero", [0.0, 0.0]), ("long", [1.0, 2.0, 3.0])], "query_id string, vector array<double>")
    i = vector_index.write_vector_index(vectors, f"file://{tmp_path}/awkward")
    want = [r for r in _rows(retrieval.vector_topk(queries, vectors, 5)) if r[0] != "long"]  # the index holds the commonest size
    assert _rows(vector_index.vector_search(queries, i, 5, exact=True)) == want and len(want) == 3
    empty = vector_index.write_vector_index(vectors.where("id = 77"), f"file://{tmp_path}/empty")
    assert vector_index.vector_search(queries, empty, 5, exact=True).count() == 0


def test_batches_of_pairs_are_bounded(spark, tables, index):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.unset(key)
    try:
        got = _rows(vector_index.vector_search(tables[0], index, 3, 1))
        assert 0 < int(spark.conf.get(key)) <= 4 << 20 and got
    finally:
        spark.conf.set(key, before)
