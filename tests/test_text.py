"""Text functions on awkward values."""

from pyspark.sql import functions as F

from archive_spark.functions import text as tx
from archive_spark.operators import archive


def _one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_names_and_cuts(spark):
    name = lambda n, exists: _one(spark, tx.generated_name(F.lit(n).cast("string"), F.lit(exists)))
    assert [name(" a ", True), name("b.HtmL", False), name(" ", True), name(None, True), name(None, False)] == ["a.html", "b.HtmL", None, None, tx.DEFAULT_NAME]
    cut = lambda t, n: _one(spark, tx.abbreviate_compact(F.lit(t).cast("string"), n))
    assert [cut(" a \n\t b ", 3), cut("a  bcd", 3), cut(None, 3), cut("", 3)] == ["a b", "a b...", None, ""]


def test_review_order(spark):
    chunks = spark.createDataFrame([("f", i, "s", "1", "é  x") for i in ("f-10", "f-9", "none", "f-" + "1" * 38, "f-" + "9" * 50)] + [("f", None, None, None, None)], "file_id string, id string, section string, page string, text string")
    rows = archive.review(chunks).orderBy("place").collect()
    assert [r["id"] for r in rows][:3] == ["f-9", "f-10", "f-" + "1" * 38] and {r["id"] for r in rows[3:]} == {"none", None, "f-" + "9" * 50}
    assert (rows[0]["bytes"], rows[0]["text"]) == (5, "é x")
