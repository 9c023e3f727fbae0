"""Event operators whose stream form keeps state and timers: segments of turns, and idle timeouts; event blocks; appended messages.

The processors buffer a session's events until the watermark has passed them, so events may come out of order within the delay
and across micro-batches, and the result is that of the batch form. They need the RocksDB state store
(`spark.sql.streaming.stateStore.providerClass`)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators import conversation
from .events import ENDS

PAUSE = "compacting"
#: The event names that a client handles.
KNOWN = ("STREAM_TEXT", "TOOL_CALL_REQUEST", "TOOL_CALL_RESULT", "DONE", "ERROR")


def _ms(ts) -> int:
    return int(pd.Timestamp(ts).value // 1_000_000)


def fold_turn(rows: list[tuple]) -> list[tuple[int, str, int]]:
    """(segment, text, calls) of one turn's events (event, text) in order; a tool result is the last of its segment."""
    out, texts, calls, n, some = [], [], 0, 0, False
    for event, text in rows:
        some = True
        if event == "STREAM_TEXT":
            texts.append(text or "")
        elif event == "TOOL_CALL_REQUEST":
            calls += 1
        elif event == "TOOL_CALL_RESULT":
            out.append((n, "".join(texts), calls))
            texts, calls, n, some = [], 0, n + 1, False
    return [*out, (n, "".join(texts), calls)] if some else out


class _Segments(StatefulProcessor):
    """State of a session: its buffered events, and the number of its turn. Each event has a timer after the time to live, and
    one that ends a turn has one right after it; at a timer all events before it have come."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "ts timestamp, event_id long, event string, text string")
        self.turn = handle.getValueState("turn", "turn long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            for r in part.itertuples():
                self.rows.appendValue((r.ts.to_pydatetime(), int(r.event_id), r.event, r.text))
                self.handle.registerTimer(_ms(r.ts) + 1 + (0 if r.event in ENDS else self.ttl_ms))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        turn = self.turn.get()[0] if self.turn.exists() else 0
        rows = sorted(self.rows.get(), key=lambda r: (r[0], r[1]))
        out, current, kept = [], [], 0
        for i, (ts, _, event, text) in enumerate(rows):
            if _ms(ts) >= now:
                break
            current.append((event, text))
            after = _ms(rows[i + 1][0]) if i + 1 < len(rows) else None
            open_too_long = _ms(ts) + self.ttl_ms < now and (after is None or after > _ms(ts) + self.ttl_ms)
            if event in ENDS or open_too_long:
                out += [(key[0], turn, *s, event if event in ENDS else "OPEN") for s in fold_turn(current)]
                turn, current, kept = turn + 1, [], i + 1
        if kept:
            self.rows.put(rows[kept:]) if rows[kept:] else self.rows.clear()
            self.turn.update((turn,))
        if out:
            yield pd.DataFrame(out, columns=["session_id", "turn", "segment", "text", "n_calls", "outcome"])

    def close(self) -> None:
        pass


def segments_stream(events: DataFrame, delay: str = "1 hour", ttl: int = 86_400) -> DataFrame:
    """The stream form of `segments`: a turn's segments, with how it ended, once the watermark has passed its end; an open turn
    to which nothing came for `ttl` seconds goes as OPEN. Events should be deduplicated before."""
    kind = events.schema["session_id"].dataType.simpleString()
    timed = events.select("session_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", "event", "text").withWatermark("ts", delay)
    schema = f"session_id {kind}, turn long, segment long, text string, n_calls long, outcome string"
    return timed.groupBy("session_id").transformWithStateInPandas(_Segments(ttl * 1000), schema, "append", "eventTime")


def idle_timeouts(events: DataFrame, limit: int = 120) -> DataFrame:
    """events: session_id, ts, event_id, status. A row for each event after which nothing came for `limit` seconds, unless its
    status is `compacting`, which pauses the clock until the next event. The clock stands at the last event of all."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    now = timed.agg(F.max("ts").alias("now"))
    after = F.lead("ts").over(Window.partitionBy("session_id").orderBy("ts", "event_id"))
    out = F.col("ts") + F.make_interval(secs=F.lit(limit))
    gaps = timed.withColumns({"after": after, "timed_out_at": out}).join(F.broadcast(now))
    late = (F.coalesce("after", "now") > F.col("timed_out_at")) & ~F.col("status").eqNullSafe(PAUSE)
    return gaps.where(late).select("session_id", "event_id", "timed_out_at")


class _Idle(StatefulProcessor):
    """State of a session: its events of the last `limit` seconds. Each has a timer; another event before that is a sign of life."""

    def __init__(self, limit_ms: int):
        self.limit_ms = limit_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "ts timestamp, event_id long, status string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            for r in part.itertuples():
                self.rows.appendValue((r.ts.to_pydatetime(), int(r.event_id), r.status))
                self.handle.registerTimer(_ms(r.ts) + self.limit_ms + 1)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = expiredTimerInfo.getExpiryTimeInMs() - self.limit_ms - 1
        rows = sorted(self.rows.get(), key=lambda r: (r[0], r[1]))
        limit = pd.Timedelta(milliseconds=self.limit_ms)
        out = []
        for (ts, event_id, status), after in zip(rows, [*rows[1:], None]):
            if _ms(ts) == due and status != PAUSE and (after is None or after[0] > ts + limit):
                out.append((key[0], event_id, ts + limit))
        left = [r for r in rows if _ms(r[0]) > due]
        self.rows.put(left) if left else self.rows.clear()
        if out:
            yield pd.DataFrame(out, columns=["session_id", "event_id", "timed_out_at"])

    def close(self) -> None:
        pass


def idle_timeouts_stream(events: DataFrame, limit: int = 120, delay: str = "1 hour") -> DataFrame:
    """The stream form: a row once the watermark has passed the timeout."""
    kind = events.schema["session_id"].dataType.simpleString()
    timed = events.select("session_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", "status").withWatermark("ts", delay)
    return timed.groupBy("session_id").transformWithStateInPandas(_Idle(limit * 1000), f"session_id {kind}, event_id long, timed_out_at timestamp", "append", "eventTime")


def read_blocks(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Text files of event blocks with a blank line between them: value, a row for each block."""
    return (spark.readStream if stream else spark.read).option("lineSep", "\n\n").text(path)


def decode_blocks(blocks: DataFrame, schema: str, known: tuple[str, ...] = KNOWN) -> tuple[DataFrame, DataFrame]:
    """blocks: value, and any other columns. Events (event, data by `schema`) and rejects (event, value, reason).

    `event:` names an event; the `data:` lines, joined by line ends, are its JSON. Blank blocks are neither. Of a line other
    than these two kinds nothing is read. Reasons: no_event, unknown_event, no_data, malformed. Both take a stream."""
    others = [c for c in blocks.columns if c != "value"]
    line = lambda name: F.regexp_extract_all("value", F.lit(rf"(?m)^{name}: ?([^\r\n]*)"), F.lit(1))
    df = blocks.where(F.col("value").rlike(r"\S")).select(*others, "value", F.get(line("event"), F.lit(0)).alias("event"), line("data").alias("lines"))
    df = df.withColumn("parsed", F.from_json(F.array_join("lines", "\n"), f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}))
    reason = (
        F.when(F.col("event").isNull() | (F.trim("event") == ""), "no_event").when(~F.col("event").isin(*known), "unknown_event").when(F.size("lines") == 0, "no_data")
        .when(F.col("parsed").isNull() | F.col("parsed._bad").isNotNull(), "malformed")
    )
    df = df.withColumn("reason", reason)
    return df.where("reason is null").select(*others, "event", F.col("parsed").dropFields("_bad").alias("data")), df.where("reason is not null").select(*others, "event", "value", "reason")


def append_batch(batch: DataFrame, batch_id: int, path: str) -> None:
    """batch: session_id, ord, message_type, text. Its rows become the partition `batch=<id>` of the message table at path.

    Numbers and the last system message go on from earlier partitions alone, and a repeated batch writes its own partition
    anew, so a batch that failed after writing, or ran twice, leaves no row behind."""
    spark = batch.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    exists = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at)
    kind = batch.schema["session_id"].dataType.simpleString()
    schema = f"session_id {kind}, seq int, message_type int, text string, batch long"
    log = spark.read.schema(schema).parquet(path).where(F.col("batch") < batch_id) if exists else spark.createDataFrame([], schema)
    log = log.join(batch.select("session_id").distinct(), "session_id", "left_semi").withColumn("id", F.col("seq"))
    conversation.append_messages(log, batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def append_stream(batches: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends a stream of messages to the message table at path, each micro-batch once."""
    return batches.writeStream.foreachBatch(lambda batch, batch_id: append_batch(batch, batch_id, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
