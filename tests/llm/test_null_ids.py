"""Null and repeated ids in the n-gram join."""

from archive_spark.llm import ngram_join

from . import brute


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def order(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is not None, x) for x in r))


def text(first, n=60):
    return " ".join(f"w{i}" for i in range(first, first + n))


def test_null_ids_are_verified(spark):
    # each links with the next only; the null ones are bridges
    rows = [(7, text(0)), (None, text(4)), (None, text(8)), (3, text(12)), (None, text(500)), (None, text(504)), (9, text(900)), (None, text(8))]
    assert order(ngram_join.similar_documents(frame(spark, rows)).collect()) == order(brute.jaccard(rows))
    assert {c for d, _, c in brute.jaccard(rows) if d in (7, 3)} == {3}


def test_rows_are_kept_by_id_and_set(spark):
    a, b, c, d, e = (text(k) for k in (0, 1000, 2000, 3000, 4000))
    rows = [(None, a), (None, b), (1, c), (1, c), (2, d), (2, e), (4, d + " more"), (5, c + " more"), (5, text(5000)), (6, ""), (6, " "), (8, text(6000)), (8, text(6002)), (None, a)]
    # 5 has a near copy of 1 and a text of its own; 8 has two near copies; rows with a null id and one text are one document
    want = [(None, a), (None, b), (1, c), (2, d), (2, e), (5, text(5000)), (6, ""), (6, " ")]
    got = order(ngram_join.keep_one_of_each(frame(spark, rows)).collect())
    assert [r for r in got if r[0] != 8] == order(want)
    assert [r[0] for r in got].count(8) == 1


def test_internal_names_do_not_clash(spark):
    rows = [(1, text(0), 7), (2, text(1), 8), (3, text(900), 9)]
    names = ["gone_id", "gone_th", "text_hash", "fp", "th", "root", "id"]
    df = spark.createDataFrame(rows, "doc_id long, text string, x int").selectExpr("doc_id", "text", *[f"x as {c}" for c in names])
    got = ngram_join.keep_one_of_each(df)
    assert got.columns == df.columns and sorted(r["id"] for r in got.collect()) == [7, 9]


def test_text_ids(spark):
    rows = [("b", text(0)), ("a", text(1)), ("c", text(700)), (None, text(2))]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.similar_documents(df).collect()}
    assert got == {"b": "a", "a": "a", "c": "c", None: "a"}
