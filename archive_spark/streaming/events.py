"""Agent event streams: dedupe of tool frames, text segments, turn outcomes, token baselines.

Each operator takes a batch; `deduplicate`, `token_baseline` and `compaction_status` take a stream as well, `closed_turns` takes streams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TOOL_FRAMES, ENDS = ("TOOL_CALL_REQUEST", "TOOL_CALL_RESULT"), ("DONE", "ERROR")


def deduplicate(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """The first of the frames with equal session, event and call id stays; frames without a call id, and those without an event, always do."""
    keyed = F.coalesce(F.col("event").isin(*TOOL_FRAMES), F.lit(False)) & (F.coalesce("call_id", F.lit("")) != "")
    if events.isStreaming:
        frames = events.where(keyed).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["session_id", "event", "call_id"])
        return frames.unionByName(events.where(~keyed).withColumn("ts", F.col("ts").cast("timestamp")))
    nth = F.row_number().over(Window.partitionBy("session_id", "event", "call_id").orderBy("ts", "event_id"))
    return events.where(keyed).withColumn("nth", nth).where("nth = 1").drop("nth").unionByName(events.where(~keyed))


def _turns(events: DataFrame) -> DataFrame:
    w = Window.partitionBy("session_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    return deduplicate(events).withColumn("turn", F.coalesce(F.sum(F.col("event").isin(*ENDS).cast("int")).over(w), F.lit(0)))


def segments(events: DataFrame) -> DataFrame:
    """Text of each segment of a turn; a tool result closes a segment."""
    w = Window.partitionBy("session_id", "turn").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    df = _turns(events).withColumn("segment", F.coalesce(F.sum((F.col("event") == "TOOL_CALL_RESULT").cast("int")).over(w), F.lit(0)))
    parts = F.array_sort(F.collect_list(F.when(F.col("event") == "STREAM_TEXT", F.struct("ts", "event_id", "text"))))
    calls = F.count_if(F.col("event") == "TOOL_CALL_REQUEST").alias("n_calls")
    return df.groupBy("session_id", "turn", "segment").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "").alias("text"), calls)


def turn_outcome(events: DataFrame) -> DataFrame:
    """How each turn ended; open if it did not."""
    end = F.max_by(F.when(F.col("event").isin(*ENDS), F.col("event")), F.when(F.col("event").isin(*ENDS), F.struct("ts", "event_id")))
    return _turns(events).groupBy("session_id", "turn").agg(F.coalesce(end, F.lit("OPEN")).alias("outcome"), F.count(F.lit(1)).alias("n_events"))


def closed_turns(events: DataFrame) -> DataFrame:
    """The stream form of `turn_outcome`: a row when a turn ends. Events should be deduplicated before.

    A session's state is two numbers: its turn, and the events in it. Within a micro-batch events count by time, across them as they arrive."""
    kind = events.schema["session_id"].dataType.simpleString()

    def close(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        turn, n = state.get if state.exists else (0, 0)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        at = np.flatnonzero(rows["event"].isin(ENDS).to_numpy())
        counts = np.diff(at, prepend=-1)
        if len(at):
            counts[0] += n
        state.update((turn + len(at), int(len(rows) - 1 - at[-1]) if len(at) else n + len(rows)))
        yield pd.DataFrame({"session_id": [key[0]] * len(at), "turn": turn + np.arange(len(at)), "outcome": rows["event"].to_numpy()[at], "n_events": counts})

    keyed = events.select("session_id", "ts", "event_id", "event").groupBy("session_id")
    return keyed.applyInPandasWithState(close, f"session_id {kind}, turn long, outcome string, n_events long", "turn long, n long", "append", "NoTimeout")


def token_baseline(events: DataFrame) -> DataFrame:
    """The input tokens last reported by a finished turn; none after an error."""
    ends = events.where(F.col("event").isin(*ENDS))
    value = F.when(F.col("event") == "DONE", F.col("input_tokens"))
    return ends.groupBy("session_id").agg(F.max_by(value, F.struct("ts", "event_id")).alias("baseline"))


def touched_files(events: DataFrame, file: str = "call_id") -> DataFrame:
    """The distinct files of the tool results of each turn, sorted; a turn without any has no row."""
    results = _turns(events).where(f"event = 'TOOL_CALL_RESULT' and {file} <> ''")
    return results.groupBy("session_id", "turn").agg(F.array_sort(F.collect_set(file)).alias("files"))


def compaction_status(events: DataFrame) -> DataFrame:
    """The last status of each session (events: session_id, ts, event_id, status); null ones say nothing."""
    return events.where("status is not null").groupBy("session_id").agg(F.max_by("status", F.struct("ts", "event_id")).alias("status"))


def decode(lines: DataFrame, schema: str) -> DataFrame:
    """Raw JSON lines (`value`) to events; malformed and unknown ones go."""
    return lines.select(F.from_json("value", schema).alias("e")).select("e.*").where("event is not null")
