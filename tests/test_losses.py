"""Rows that are easily lost: null watermarks and texts, repeated writes, large ids beside nulls."""

from pyspark.sql import functions as F

from archive_spark.operators import catalog, conversation, retrieval


def test_apply_without_a_watermark(spark):
    sessions = spark.createDataFrame([(1, None, 7, 3), (2, None, 7, 3), (3, 5, 7, None), (4, None, 7, 3)], "id long, summary_upto_message_id long, last_input_tokens int, compact_count int")
    plan = spark.createDataFrame([(1, 9, "compact"), (2, 9, "compact"), (3, 9, "compact")], "session_id long, new_watermark long, action string")
    got = {r["id"]: tuple(r)[1:] for r in conversation.apply_plan(sessions, plan, F.when(F.col("id") == 2, 4).otherwise(F.col("summary_upto_message_id"))).collect()}
    assert got == {1: (9, None, 4, "applied"), 2: (None, 7, 3, "rejected"), 3: (9, None, 1, "applied"), 4: (None, 7, 3, "unchanged")}


def test_transcript_keeps_messages_without_text(spark):
    messages = spark.createDataFrame([(1, 1, 2, "hi", None), (1, 2, 3, None, None), (1, 3, 4, "out", "search"), (1, 4, 4, None, None), (1, 5, 3, "", None)], "session_id long, id long, message_type int, text string, tool_name string")
    sessions = spark.createDataFrame([(1, None)], "id long, summary_upto_message_id long")
    plan = spark.createDataFrame([(1, 5, "compact")], "session_id long, new_watermark long, action string")
    calls = spark.createDataFrame([(1, 2, [("c0", "search", '{"q":1}'), ("c1", "find", "{}")]), (1, 5, [])], "session_id long, id long, tool_calls array<struct<id:string,name:string,args:string>>")
    lines = conversation.transcript(messages, sessions, plan, calls).first()["transcript"].split("\n")
    assert lines == ["user: hi", 'assistant:  [calls: search({"q":1}), find({})]', "tool[search]: out", "tool[]: ", "assistant: "]
    assert conversation.transcript(messages.drop("tool_name"), sessions, plan).first()["transcript"].split("\n")[1:3] == ["assistant: ", "tool[]: out"]


def test_the_last_of_repeated_writes_counts(spark):
    files = spark.createDataFrame([(1, 1, "a", 2, "d", 5), (2, 1, "b", 1, None, 5)], "id long, session_id long, file_name string, kind int, description string, file_size long")
    writes = spark.createDataFrame([(1, 1, 1, "one", None, 6), (2, 1, 1, "two", "", 7), (3, None, 1, "n", None, None), (4, None, 1, "n", None, 1), (5, 9, 1, "x", None, 1)], "ord int, id long, session_id long, file_name string, description string, file_size long")
    got = sorted((tuple(r) for r in catalog.upsert_generated(files, writes).select("id", "file_name", "description", "file_size", "status").collect()), key=repr)
    assert got == sorted([(1, "two", "d", 7, "updated"), (2, "b", None, 5, "unchanged"), (None, "n", None, None, "inserted"), (None, "n", None, 1, "inserted"), (9, "x", None, 1, "inserted")], key=repr)


def test_vector_ids_are_exact(spark):
    big = 2**60
    vectors = spark.createDataFrame([(big + 1, [1.0, 0.0]), (None, [0.9, 0.1]), (big + 3, [0.8, 0.2]), (5, [0.0, 0.0]), (6, None), (7, [1.0, None]), (8, [1.0]), (9, [float("nan"), 1.0])], "id long, vector array<double>").coalesce(1)
    queries = spark.createDataFrame([("a", [2.0, 0.0]), ("b", [0.0]), ("c", None), (None, [0.0, 3.0]), ("d", [4.0])], "query_id string, vector array<double>")
    got = {(r["query_id"], r["rank"]): r["id"] for r in retrieval.vector_topk(queries, vectors, 2).collect()}
    assert got == {("a", 1): big + 1, ("a", 2): None, (None, 1): big + 3, (None, 2): None, ("d", 1): 8}


def test_blocks_of_vectors_and_queries(spark, monkeypatch):
    v = spark.range(700).select("id", F.expr("transform(sequence(1, 6), i -> cast(pmod(hash(id, i), 7) as double) - 3)").alias("vector"))
    q = v.where("id < 50").select(F.col("id").alias("query_id"), "vector")
    key = lambda df: sorted(tuple(r) for r in df.collect())
    want = key(retrieval.vector_topk(q, v, 4))
    for name, n in (("QUERY_PASS", 17), ("QUERY_BLOCK", 5), ("SCORES", 40)):
        monkeypatch.setattr(retrieval, name, n)
    assert key(retrieval.vector_topk(q, v, 4)) == want
