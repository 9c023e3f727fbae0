"""Stateful streams against their batch forms, with events out of order across micro-batches."""

import pytest
from pyspark.sql import functions as F

from archive_spark.operators import conversation
from archive_spark.sources.tables import load
from archive_spark.streaming import events, stateful

from .test_streams import _finish, _same, _stream

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture(autouse=True)
def rocks(spark):
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(PROVIDER, before)


@pytest.fixture(scope="module")
def log(spark, sf_dir):
    """A few sessions, a minute between events, and one event far later on, which moves the watermark past all others."""
    df = events.deduplicate(load(spark, sf_dir, "agent_event")[0].where("event_id < 500").withColumn("session_id", F.col("session_id") % 7))
    df = df.withColumn("ts", F.timestamp_seconds(F.col("event_id") * 60 + F.col("event_id") % 7 + 1000)).select("session_id", "ts", "event_id", "event", "call_id", "text", "input_tokens")
    end = spark.range(1).select(F.lit(99).cast(df.schema["session_id"].dataType).alias("session_id"), F.timestamp_seconds(F.lit(10_000_000)).alias("ts"), F.lit(10**6).cast("long").alias("event_id"), F.lit("STREAM_TEXT").alias("event"), F.lit("x").alias("text"))
    return df.unionByName(end, True).cache()


MIXED = ("event_id % 3 = 1 and event_id < 300", "event_id % 3 <> 1 and event_id < 400", "event_id % 3 = 1 and event_id >= 300 or event_id >= 400 and event_id < 1000", "event_id >= 1000")


def test_segments(spark, log, tmp_path):
    got = _finish(stateful.segments_stream(_stream(spark, log, f"{tmp_path}/e", *MIXED), "10 hours", 10**6), spark, "segments", "append")
    assert got.where("outcome <> 'OPEN'").count() > 100
    want = events.segments(log.where("session_id <> 99")).join(events.turn_outcome(log), ["session_id", "turn"])
    _same(got, want.select("session_id", "turn", "segment", "text", "n_calls", "outcome"))


def test_open_turns_expire(spark, tmp_path):
    rows = [(1, 0, 1, "STREAM_TEXT", "a"), (1, 5, 2, "STREAM_TEXT", "b"), (1, 900, 3, "STREAM_TEXT", "c"), (1, 910, 4, "DONE", None), (2, 0, 5, "TOOL_CALL_RESULT", None), (9, 5000, 6, "STREAM_TEXT", None)]
    df = spark.createDataFrame(rows, "session_id long, ts long, event_id long, event string, text string").withColumn("ts", F.timestamp_seconds(F.col("ts") + 1000))
    parts = ("event_id in (2, 5)", "event_id = 1", "event_id = 3", "event_id = 4", "event_id = 6")
    got = _finish(stateful.segments_stream(_stream(spark, df, f"{tmp_path}/e", *parts), "60 seconds", 300), spark, "expired", "append")
    assert sorted(tuple(r) for r in got.collect()) == [(1, 0, 0, "ab", 0, "OPEN"), (1, 1, 0, "c", 0, "DONE"), (2, 0, 0, "", 0, "OPEN")]


def test_fold_turn():
    t = lambda x: ("STREAM_TEXT", x)
    assert stateful.fold_turn([t("a"), ("TOOL_CALL_REQUEST", None), ("TOOL_CALL_RESULT", None), t(None), t("b"), ("DONE", None)]) == [(0, "a", 1), (1, "b", 0)]
    assert stateful.fold_turn([("TOOL_CALL_RESULT", None)]) == [(0, "", 0)] and stateful.fold_turn([]) == []


def test_idle_timeouts(spark, log, tmp_path):
    status = log.withColumn("status", F.expr("case when event = 'TOOL_CALL_REQUEST' then 'compacting' when event = 'DONE' then 'done' end"))
    got = _finish(stateful.idle_timeouts_stream(_stream(spark, status, f"{tmp_path}/e", *MIXED), 600, "10 hours"), spark, "idle", "append")
    want = stateful.idle_timeouts(status, 600)
    assert got.count() > 20 and status.where("status = 'compacting'").count() > 20
    _same(got, want)


def test_a_pause_over_a_batch_border(spark, tmp_path):
    rows = [(1, 0, 1, None), (1, 60, 2, "compacting"), (1, 1000, 3, "done"), (1, 1120, 4, None), (1, 1241, 5, None), (2, 0, 6, "compacting"), (9, 9000, 7, None)]
    df = spark.createDataFrame(rows, "session_id long, ts long, event_id long, status string").withColumn("ts", F.timestamp_seconds("ts"))
    stream = _stream(spark, df, f"{tmp_path}/e", "event_id in (1, 2, 6)", "event_id in (3, 5)", "event_id = 4", "event_id = 7")
    got = _finish(stateful.idle_timeouts_stream(stream, 120, "300 seconds"), spark, "paused", "append")
    assert sorted((r["session_id"], r["event_id"], r["timed_out_at"].timestamp()) for r in got.collect()) == [(1, 4, 1240.0), (1, 5, 1361.0)]
    _same(got, stateful.idle_timeouts(df, 120))


BLOCKS = 'event: STREAM_TEXT\ndata: {"text":"a",\ndata: "n":1}\n\nevent: DONE\nid: 4\ndata: {}\n\n\n\nevent: OTHER\ndata: {}\n\ndata: {}\n\nevent: ERROR\n\nevent: DONE\ndata: {oops\n\nevent:STREAM_TEXT\r\ndata:{"text":"ü"}\r\n\n'


def test_event_blocks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text(BLOCKS)
    good, bad = stateful.decode_blocks(stateful.read_blocks(spark, f"{tmp_path}/in"), "text string, n int")
    assert [(r["event"], *r["data"]) for r in good.collect()] == [("STREAM_TEXT", "a", 1), ("DONE", None, None), ("STREAM_TEXT", "ü", None)]
    assert [(r["event"], r["reason"]) for r in bad.collect()] == [("OTHER", "unknown_event"), (None, "no_event"), ("ERROR", "no_data"), ("DONE", "malformed")]
    streamed = stateful.decode_blocks(stateful.read_blocks(spark, f"{tmp_path}/in", stream=True), "text string, n int")
    _same(_finish(streamed[0], spark, "blocks", "append"), good)
    _same(_finish(streamed[1], spark, "rejects", "append"), bad)


def test_appended_once(spark, tmp_path, monkeypatch):
    rows = [(1, 1, 1, "sys"), (1, 2, 2, "hi"), (2, 3, 2, "yo"), (1, 4, 1, "sys"), (1, 5, 2, "again"), (2, 6, 1, "new"), (1, 7, 1, "other"), (2, 8, 1, "new"), (2, 9, 3, None)]
    df = spark.createDataFrame(rows, "session_id long, ord long, message_type int, text string")
    path, parts = f"file://{tmp_path}/log", ("ord <= 3", "ord > 3 and ord <= 6", "ord > 6")
    feed = _stream(spark, df, f"{tmp_path}/in", *parts)
    real, failed = conversation.append_messages, []

    def breaks(log, batch):
        out = real(log, batch)
        if not failed and batch.where("ord = 4").count():
            failed.append(1)
            out.write.parquet(f"{path}/batch=1")  # written, then the job is lost before it is committed
            raise RuntimeError("lost")
        return out

    monkeypatch.setattr(conversation, "append_messages", breaks)
    with pytest.raises(Exception, match="lost"):
        stateful.append_stream(feed, path, f"{tmp_path}/cp").awaitTermination()
    stateful.append_stream(feed, path, f"{tmp_path}/cp").awaitTermination()
    want = [(1, 0, 1, "sys"), (1, 1, 2, "hi"), (1, 2, 2, "again"), (1, 3, 1, "other"), (2, 0, 2, "yo"), (2, 1, 1, "new"), (2, 2, 3, None)]
    stored = lambda: sorted(tuple(r) for r in spark.read.parquet(path).select("session_id", "seq", "message_type", "text").collect())
    assert stored() == want and failed
    stateful.append_batch(df.where(parts[1]), 1, path)  # the same batch again
    assert stored() == want
