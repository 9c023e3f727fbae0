"""Centroids, periodic runs and toxic passages against brute force, by their parts and on held-out rows."""

import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from archive_spark.llm import centroids, periodic, toxicity
from archive_spark.llm import queries as q

from . import brute
from .test_contracts import awkward, awkward_documents, empty, rows, same, table  # noqa: F401

CLUSTER = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
PERIOD = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


@pytest.fixture(scope="module")
def awkward_vectors(tmp_path_factory):
    at, rng = tmp_path_factory.mktemp("vectors"), np.random.default_rng(4)
    some = [rng.normal(size=64).tolist() for _ in range(40)]
    vectors = [*enumerate(some), (40, None), (41, []), (42, some[0][:63]), (43, [*some[0], 1.0]), (44, [None, *some[0][1:]]), (45, [float("nan"), *some[0][1:]]), (46, [float("inf"), *some[0][1:]]), (47, some[3]), (3, some[3]), (None, some[5]), (None, None), (48, [0.0] * 64), (49, [-0.0] * 64), (2**62, [1e6] * 64)]
    vectors += [(100 + i, some[7]) for i in range(60)]
    pq.write_table(pa.table({"vec_id": pa.array([i for i, _ in vectors], pa.int64()), "embedding": pa.array([v for _, v in vectors], pa.list_(pa.float32())), "id": ["x"] * len(vectors), "cluster": ["x"] * len(vectors)}), at / "embeddings.parquet")
    return str(at)


def test_clusters(spark, sf_dir, awkward_vectors):
    for sf in (sf_dir, awkward_vectors):
        same(rows(q.op11_equal_average_clusters(spark, sf), *CLUSTER), brute.clusters(table(sf, "embeddings", "vec_id", "embedding")))
        con = duckdb.connect()
        con.sql(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
        found = con.sql(q.oracle_sql()["op11_equal_average_clusters"]).select(", ".join(CLUSTER))
        key = lambda r: tuple((x is not None, x) for x in r)
        same(sorted((tuple(r) for r in found.fetchall()), key=key), brute.clusters(table(sf, "embeddings", "vec_id", "embedding")))


def test_clusters_of_few_and_no_vectors(spark, sf_dir):
    few = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id < 5")
    same(rows(centroids.cluster_vectors(few), *CLUSTER), brute.clusters([tuple(r) for r in few.select("vec_id", "embedding").collect()]))
    assert centroids.cluster_vectors(few.where("vec_id < 0")).columns == list(CLUSTER)


def test_search_is_exact_and_spares_distances():
    rng, spared = np.random.default_rng(0), 0
    for t in range(120):
        k, d = int(rng.integers(1, 40)), int(rng.integers(1, 65))
        c, v = rng.integers(-3, 4, (k, d)), rng.integers(-3, 4, (100, d))
        if t % 3 == 0:
            c, v = c * 40_000_000, v * 40_000_000
        number, distance, computed = centroids.Search.of(c).nearest(v)
        all_of_them = ((v[:, None, :] - c[None]) ** 2).sum(axis=2)
        assert (all_of_them.argmin(axis=1) == number).all() and (all_of_them.min(axis=1) == distance).all()
        spared += 100 * k - computed
    assert spared > 10_000


def test_too_large_vectors_stop(spark):
    with pytest.raises(Exception, match="64 bits"):
        centroids.cluster_vectors(spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<double>")).collect()


@pytest.mark.parametrize("where", ["tables", "awkward"])
def test_periods(spark, sf_dir, awkward, where):  # noqa: F811
    sf = sf_dir if where == "tables" else awkward
    same(rows(q.op12_periodic_runs(spark, sf), *PERIOD), brute.periods(table(sf, "documents", "doc_id", "text")))


def test_runs_of_random_words():
    rng, found = random.Random(1), 0
    for _ in range(400):
        docs = []
        for _ in range(rng.randrange(1, 5)):
            k = rng.choice((1, 2, 3, 5, 26))
            w = [rng.choice("abcdefghijklmnopqrstuvwxyz"[:k]) for _ in range(rng.randrange(rng.choice((3, 60, 120))))]
            p = [rng.choice("abc") for _ in range(rng.randrange(1, 9))]
            w = (w + p * rng.randrange(9) + w[:5]) * rng.choice((1, 1, 5))
            docs.append(w)
        hashes, owner, bounds = periodic._read([" ".join(d).encode() for d in docs])
        start, end, period = periodic.find_runs(hashes, owner, bounds[:-1], bounds[1:])
        want = [(int(bounds[i]) + s, n, q_) for i, d in enumerate(docs) for s, n, q_ in brute.word_runs(d)]
        assert list(zip(start.tolist(), (end - start).tolist(), period.tolist())) == want
        found += len(want)
    assert found > 500


def test_runs_keep_their_lists(spark):
    docs = spark.createDataFrame([(1, "x a b a b a b a b y z z z z z z"), (2, None)], "doc_id long, text string")
    first, second = periodic.periodic_runs(docs).orderBy("doc_id").collect()
    assert [tuple(r) for r in first["runs"]] == [(1, 8, 2), (10, 6, 1)] and first["collapsed"] == "x a b y z" and first["n_words"] == 16
    assert second["runs"] == [] and second["collapsed"] == "" and second["n_words"] == 0


def _segments(s, a, b):
    """The best segment (shortest of equal ones), and so on at both sides of it."""
    found = [(-sum(s[i:j]), j - i, i, j) for i in range(a, b) for j in range(i + 1, b + 1) if sum(s[i:j]) > 0]
    if not found:
        return []
    total, _, i, j = min(found)
    return [*_segments(s, a, i), (i, j, -total), *_segments(s, j, b)]


def test_maximal_segments():
    rng = random.Random(0)
    for _ in range(500):
        s = [float(rng.choice((-1, 1)) * rng.randrange(1, 1000)) for _ in range(rng.randrange(18))]
        assert toxicity.maximal_segments(s) == _segments(s, 0, len(s))
    scores, owner = np.array([1.0, 2, -1, 4, -9, 1, 3, 3, -2]), np.array([0, 0, 0, 0, 0, 0, 1, 1, 3])
    assert [x.tolist() for x in toxicity.text_segments(scores, owner, 4)] == [[0, 5, 6], [4, 6, 8], [6.0, 1.0, 6.0]]


def test_toxic_held_out(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.1")  # the smaller tables have too few labels
    label = dict(table(sf, "labels", "doc_id", "toxic"))
    found = q.op13_toxic_segments(spark, sf).select("doc_id", "held_out", "score", "predicted", "n_words", "passages").collect()
    text = dict(table(sf, "documents", "doc_id", "text"))
    assert len(found) == len(text)
    for r in found:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    held = [(r["score"], label[r["doc_id"]]) for r in found if r["held_out"] and label.get(r["doc_id"]) is not None]
    toxic, clean = (np.array([s for s, y in held if y == v]) for v in (1, 0))
    auc = np.mean((toxic[:, None] > clean) + 0.5 * (toxic[:, None] == clean))
    assert auc > 0.97 and np.mean(toxic >= 0.3) >= 0.9 and np.mean(clean < 0.3) > 0.99
    worst = {text[r["doc_id"]][p["start"] : p["end"]] for r in found for p in r["passages"] if label.get(r["doc_id"]) == 1}
    assert len(worst) > 50 and all(w == w.strip() for w in worst)


def test_held_out_labels_are_not_read(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    other = labels.withColumn("toxic", toxicity.F.when(toxicity.held_out("doc_id"), 1 - toxicity.F.col("toxic")).otherwise(toxicity.F.col("toxic")))
    key = lambda x: sorted((r["doc_id"], r["score"]) for r in x.collect())
    plain = key(toxicity.toxic_passages(docs, labels))
    assert plain == key(toxicity.toxic_passages(docs, other))
    moved = docs.selectExpr("doc_id", "text", "'zz' as lang", "'other' as source", "1 as part", "1 as toxic")
    assert plain == key(toxicity.toxic_passages(moved, labels))


def test_toxicity_of_awkward_rows(spark, awkward):  # noqa: F811
    found = rows(q.op13_toxic_segments(spark, awkward), "doc_id", "held_out", "score", "predicted")
    assert len(found) == len(awkward_documents())
    assert {r[2] for r in found} == {0.0} and not any(r[1] for r in found if r[0] is None)


def test_empty(spark, empty):  # noqa: F811
    assert q.op12_periodic_runs(spark, empty).count() == 0 and q.op13_toxic_segments(spark, empty).count() == 0
