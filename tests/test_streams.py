"""Streams against batches, and the chunk table that a stream feeds."""

import pytest
from pyspark.sql import functions as F

from archive_spark.operators import archive
from archive_spark.sources import chunk_table
from archive_spark.sources.tables import load
from archive_spark.streaming import events


def _stream(spark, df, path, *parts):
    """One file for each condition, written one after the other."""
    for part in parts or ("event_id < 200", "event_id >= 200 and event_id < 400", "event_id >= 400"):
        df.where(part).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _finish(df, spark, name, mode):
    df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


@pytest.fixture(scope="module")
def log(spark, sf_dir):
    return load(spark, sf_dir, "agent_event")[0].where("event_id < 600")


def _same(a, b):
    assert sorted(map(repr, a.select(*sorted(a.columns)).collect())) == sorted(map(repr, b.select(*sorted(b.columns)).collect()))


def test_token_baseline(spark, log, tmp_path):
    _same(_finish(events.token_baseline(_stream(spark, log, f"{tmp_path}/e")), spark, "baseline", "complete"), events.token_baseline(log))


def test_compaction_status(spark, log, tmp_path):
    status = log.withColumn("status", F.expr("case event when 'TOOL_CALL_REQUEST' then 'compacting' when 'DONE' then 'done' end"))
    _same(_finish(events.compaction_status(_stream(spark, status, f"{tmp_path}/e")), spark, "status", "complete"), events.compaction_status(status))


def test_deduplicate(spark, log, tmp_path):
    key = ["session_id", "event", "call_id"]
    got = _finish(events.deduplicate(_stream(spark, log, f"{tmp_path}/e"), "10000 days"), spark, "deduplicated", "append").select(*key)
    _same(got, events.deduplicate(log).select(*key))


def test_closed_turns(spark, log, tmp_path):
    """Event ids follow time here, so that files hold later events one after the other."""
    timed = events.deduplicate(log).withColumn("ts", F.timestamp_seconds("event_id"))
    got = _finish(events.closed_turns(_stream(spark, timed, f"{tmp_path}/e")), spark, "closed", "append")
    assert got.count() > 10
    _same(got, events.turn_outcome(timed).where("outcome <> 'OPEN'"))


def test_chunk_table(spark, sf_dir, tmp_path):
    path = f"{tmp_path}/chunks"
    items = load(spark, sf_dir, "flow_item")[0].where("file_id < 'file-4'")
    chunks = archive.chunk_chain(archive.headings(items))
    chunk_table.write_chunks(chunks, path, 8)
    stored = lambda: chunk_table.read_chunks(spark, path)
    _same(stored(), chunks)
    files = [r[0] for r in chunks.select("file_id").distinct().orderBy("file_id").collect()]
    fresh = chunks.where(F.col("file_id") == files[0]).withColumn("text", F.lit("new")).limit(1)
    chunk_table.replace_files(fresh, path, spark.createDataFrame([(files[1],)], "file_id string"))
    want = chunks.where(~F.col("file_id").isin(files[:2])).unionByName(fresh)
    _same(stored(), want)
    feed = _stream(spark, items.where(F.col("file_id").isin(files[:2])), f"{tmp_path}/items", f"file_id = '{files[0]}'", f"file_id = '{files[1]}'")
    chunk_table.ingest(feed, path, f"{tmp_path}/cp").awaitTermination()
    _same(stored(), chunks)


def test_emptied_buckets_and_versions(spark, tmp_path):
    """Files in buckets of their own: a deleted file's rows are gone, and a reader of the version before still has them."""
    path = f"{tmp_path}/chunks"
    chunks = spark.createDataFrame([(f"f{i}", k, f"text {i} {k}") for i in range(12) for k in range(3)], "file_id string, chunk int, text string")
    chunk_table.write_chunks(chunks, path, 8)
    assert chunk_table.manifest(spark, path).buckets == 8
    new = spark.createDataFrame([("f2", 0, "new")], chunks.schema)
    chunk_table.replace_files(new, path, spark.createDataFrame([("f1",)], "file_id string"))
    want = chunks.where("file_id not in ('f1', 'f2')").unionByName(new)
    _same(chunk_table.read_chunks(spark, path), want)
    _same(chunk_table.read_chunks(spark, path, 1), chunks)
    chunk_table.delete_files(chunks.select("file_id").where("file_id <> 'f2'").distinct(), path)
    _same(chunk_table.read_chunks(spark, path), new)
    assert len(chunk_table.manifest(spark, path).held) == 1
    chunk_table.clear(spark, path)
    assert chunk_table.read_chunks(spark, path).count() == 0
    chunk_table.replace_files(new, path)
    _same(chunk_table.read_chunks(spark, path), new)
    chunk_table.vacuum(spark, path, 1)
    _same(chunk_table.read_chunks(spark, path), new)
    assert chunk_table.versions(spark, path) == [5]


def test_an_unpublished_change_is_not_read(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/chunks"
    chunks = spark.createDataFrame([("a", 1), ("b", 2)], "file_id string, chunk int")
    chunk_table.write_chunks(chunks, path, 2)
    real = chunk_table._publish

    def lost(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(chunk_table, "_publish", lost)
    with pytest.raises(RuntimeError, match="lost"):
        chunk_table.delete_files(chunks.select("file_id"), path)
    _same(chunk_table.read_chunks(spark, path), chunks)
    monkeypatch.setattr(chunk_table, "_publish", real)
    chunk_table.delete_files(chunks.where("chunk = 1").select("file_id"), path)
    _same(chunk_table.read_chunks(spark, path), chunks.where("chunk = 2"))
    with pytest.raises(RuntimeError, match="another writer"):
        chunk_table._publish(spark, path, chunk_table.manifest(spark, path))
