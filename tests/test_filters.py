"""The filter of both arms: what it asks of the scan, years, and requests that can't be searched."""

import duckdb
import pytest
from pyspark.sql import functions as F

from archive_spark.operators import filters, retrieval
from archive_spark.operators.filters import ArchiveFilter


def test_both_arms_prune_and_push(spark, tmp_path):
    rows = spark.range(60).select("id", F.concat(F.lit("p"), F.col("id") % 3).alias("project_name"), (F.col("id") % 4 + 1990).cast("int").alias("form_year"), F.lit("a b c").alias("text"), F.array(F.lit(1.0), F.col("id") + 0.5).alias("vector"))
    rows.write.partitionBy("form_year").parquet(f"file://{tmp_path}/chunks")
    seen = spark.read.parquet(f"file://{tmp_path}/chunks").where(ArchiveFilter(project_name="p1", volume_name=" ", form_year=" 1992 ").predicate())
    want = {i for i in range(60) if i % 3 == 1 and i % 4 == 2}
    queries = spark.createDataFrame([(1, [1.0, 1.0], ["a"])], "query_id int, vector array<double>, terms array<string>")
    arms = retrieval.vector_topk(queries, seen, 20), retrieval.keyword_topk(queries, spark.read.parquet(f"file://{tmp_path}/chunks"), 20, seen.select("id"))
    for arm in arms:
        assert {r["id"] for r in arm.collect()} == want
        plan = arm._jdf.queryExecution().toString()
        assert "(form_year" in plan.split("PartitionFilters: [", 1)[1] and "EqualTo(project_name,p1)" in plan


@pytest.mark.parametrize("bad", ("1996年", "in 1996", "1996.5", "1e3", "--1"))
def test_years(bad):
    assert ArchiveFilter(form_year=" 1996 ").year() == 1996 and ArchiveFilter(form_year=" ").year() is None
    with pytest.raises(ValueError, match="form_year"):
        ArchiveFilter(form_year=bad).predicate()


def test_requests(spark):
    rows = [(1, "v", None, "1996", "x"), (2, None, "k", None, "x"), (3, " ", None, "1996", "x"), (4, None, None, None, "x"), (5, "v", "k", "199x", "x"), (6, "v", "k", " ", None)]
    good, bad = filters.check_requests(spark.createDataFrame(rows, "request_id int, vector_query string, keyword_query string, form_year string, other string"))
    assert {r["request_id"]: r["year"] for r in good.collect()} == {1: 1996, 2: None, 6: None}
    assert {r["request_id"]: r["reason"][:6] for r in bad.collect()} == {3: "a vect", 4: "a vect", 5: "form_y"}
    empty = good.where("false")
    assert [t.count() for t in filters.check_requests(empty.drop("year"))] == [0, 0]


def test_evidence_of_missing_values(spark):
    ranked = spark.createDataFrame([("q", 2, "keyword", 0.01875, 2), ("q", 1, "vector", 0.85, 1)], "query_id string, id long, origin string, score double, final_rank int")
    chunks = spark.createDataFrame([(1, "text %d", "3-4", "s", "p", "v", "i", 1999), (2, None, None, None, None, None, None, None)], "id long, text string, page string, section string, project_name string, volume_name string, item_name string, form_year int")
    got = {r["query_id"]: r["evidence"] for r in retrieval.evidence_blocks(ranked, chunks, spark.createDataFrame([("q",), ("none",)], "query_id string")).collect()}
    assert got["none"] == retrieval.NO_BLOCKS
    assert got["q"] == "[第1条 | 相关度 0.8500 | 来源: vector]\n块ID: 1 | 页码: 3-4 | 章节: s\n项目: p | 卷: v | 件: i | 年度: 1999\n正文: text %d\n\n[第2条 | 相关度 0.0188 | 来源: keyword]\n块ID: 2 | 页码: null | 章节: null\n项目: null | 卷: null | 件: null | 年度: -\n正文:"


def test_evidence_rounds_and_keeps_blanks_as_its_sql(spark):
    scores = [0.38985, 0.28135, 0.28125, 0.02255, 0.0000499, 1.0]
    ranked = spark.createDataFrame([("q", i, "keyword", x, i + 1) for i, x in enumerate(scores)], "query_id string, id long, origin string, score double, final_rank int")
    chunks = spark.createDataFrame([(i, f"text {i}  ", None, None, None, None, None, None) for i in range(len(scores))], "id long, text string, page string, section string, project_name string, volume_name string, item_name string, form_year int")
    got = retrieval.evidence_blocks(ranked, chunks).first()["evidence"]
    want = [duckdb.execute("select printf('%.4f', round(?::double, 4))", [x]).fetchall()[0][0] for x in scores]
    assert [x.split(" | ")[1][4:] for x in got.split("\n") if "相关度" in x] == want and want[0] == "0.3898"
    assert got.endswith("正文: text 5  ")
