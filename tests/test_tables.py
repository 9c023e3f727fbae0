"""Tables and headings on awkward rows."""

from pyspark.sql import functions as F

from archive_spark.functions import text as tx
from archive_spark.operators import archive, chunking
from archive_spark.sources import tables

CELLS = "table_id int, row_idx int, col_idx int, text string, pos int"


def test_triplets(spark):
    rows = [(1, 0, 0, "name", 0), (1, 1, 0, "a", 1), (1, 2, 0, " ", 2), (1, 3, 0, "b\n c", 3)]
    rows += [(2, 0, 0, "", 0), (2, 0, 1, "x", 1), (2, 0, 2, "y", 2), (2, 1, 0, "r", 3), (2, 1, 2, "2", 4), (2, 2, 0, "s", 5), (2, 2, 1, None, 6), (2, 2, 1, "old", 7), (2, 2, 1, "new", 8)]
    rows += [(3, 0, 0, "only", 0), (3, 0, 1, "head", 1), (4, 1, 0, "k", 0), (4, 1, 1, "v", 1)]
    got = {r["table_id"]: r["text"] for r in archive.table_triplets(spark.createDataFrame(rows, CELLS)).collect()}
    assert got == {1: "name = a. name = b  c", 2: "r, y = 2. s, x = new", 3: "only. head", 4: "k,  = v"}


def test_split_repeats_the_header(spark):
    rows = [(1, "|a|b|\n|1|2|\n \n|3|4|\r\n|5|6|"), (2, "|a|b|"), (3, ""), (4, None), (5, "|a|\n|" + "x " * 50 + "|\n|y|")]
    got = {(r["table_id"], r["part"]): r["text"] for r in chunking.split_tables(spark.createDataFrame(rows, "table_id int, text string"), 15).collect()}
    assert got == {(1, 0): "|a|b|\n|1|2|\n|3|4|\n", (1, 1): "|a|b|\n|5|6|\n", (5, 0): "|a|\n|" + "x " * 50 + "|\n", (5, 1): "|a|\n|y|\n"}


def test_pipe_table(spark):
    df = spark.createDataFrame([("\n |a|b| \nx",), ("a|b|",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(tx.is_pipe_table(F.col("t"))).collect()] == [True, False, False, False]


def test_levels_of_any_depth(spark):
    rows = [("f", 0, "a", "SECTION_HEADER", 1), ("f", 1, "b", "SECTION_HEADER", 9), ("f", 2, "c", "SECTION_HEADER", 40), ("f", 3, "t", "TEXT", 0), ("f", 4, "d", "SECTION_HEADER", 9), ("f", 5, "u", "TEXT", 0), ("f", 6, "e", "SECTION_HEADER", None), ("f", 7, "v", "TEXT", 0)]
    df = spark.createDataFrame(rows, "file_id string, pos int, text string, label string, level int").withColumns({"page_no": F.lit(1), "top": -F.col("pos").cast("double")})
    assert {r["text"]: r["headings"] for r in archive.headings(df).collect()} == {"t": ["a", "b", "c"], "u": ["a", "d"], "v": ["e"]}
    assert archive.headings(df.where("label = 'TEXT'")).select("headings").first()[0] == []


def test_tables_are_gathered_once(spark):
    cells = spark.createDataFrame([(1, 0, 0, "a", 0), (1, 1, 0, "b", 1)], CELLS)
    for made in (archive.table_markdown(cells), archive.table_triplets(cells)):
        plan = made.where("text <> ''")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange ") == 1 and "Join" not in plan and plan.count("Scan") == 1


def test_order_lines_are_dealt_by_their_number(spark, sf_dir, monkeypatch):
    want = sorted(map(tuple, archive.table_markdown(tables.load(spark, sf_dir, "table_cell")[0]).collect()))
    monkeypatch.setattr(tables, "FEW_LINES", 100)
    monkeypatch.setattr(tables, "LINES_PER_TASK", 500)
    n = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    lines, cells = tables.load(spark, sf_dir, "lineitem", "table_cell")
    sizes = [x for x in lines.groupBy(F.spark_partition_id()).count().toPandas()["count"]]
    assert lines.rdd.getNumPartitions() == n // 500 + 1 and max(sizes) < 1500
    assert sorted(map(tuple, archive.table_markdown(cells).collect())) == want
