"""Conversation views, tool-call repair, token budgets and compaction plans over a message log."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

#: Message type codes.
SYSTEM, USER, AI, TOOL = 1, 2, 3, 4
MISSING, STALE, SUMMARY = "[tool result missing]", "[old tool output removed]", "Summary so far: "


@dataclass(frozen=True)
class Options:
    window: int = 1_000_000
    trigger: float = 0.90
    keep: float = 0.15
    tool_tokens: int = 8000
    message_chars: int = 2000
    summary_tokens: int = 16_000
    soft_ratio: float = 0.75


#: The fields of a stored message.
STORED = "type string, text string, id string, toolName string, contents array<struct<type: string, text: string>>, toolExecutionRequests array<struct<id: string, name: string, arguments: string>>"


def decode_messages(stored: DataFrame) -> DataFrame:
    """stored: session_id, id, content (JSON). User, assistant and tool messages; others, and what is no JSON, go.

    Arguments of a tool call that are no JSON are kept under `_raw`; missing ones are an empty object."""
    m = F.from_json("content", STORED)
    df = stored.select("session_id", "id", m.alias("m"))
    role = F.when(F.col("m.type") == "USER", "human").when(F.col("m.type") == "AI", "ai").when(F.col("m.type") == "TOOL_EXECUTION_RESULT", "tool")
    said = F.array_join(F.transform(F.filter("m.contents", lambda c: c["type"] == "TEXT"), lambda c: F.coalesce(c["text"], F.lit(""))), "")
    none = lambda c: F.coalesce(c, F.lit(""))
    raw = lambda a: F.when(none(a) == "", "{}").when(F.try_parse_json(a).isNull(), F.to_json(F.struct(a.alias("_raw")))).otherwise(a)
    calls = F.transform("m.toolExecutionRequests", lambda r: F.struct(none(r["id"]).alias("id"), none(r["name"]).alias("name"), raw(r["arguments"]).alias("args")))
    content = F.when(F.col("role") == "human", none(said)).otherwise(none(F.col("m.text")))
    tool = lambda c: F.when(F.col("role") == "tool", none(F.col(c)))
    return df.withColumn("role", role).where("role is not null").select("session_id", "id", "role", content.alias("content"), F.when(F.col("role") == "ai", calls).alias("tool_calls"), tool("m.id").alias("tool_call_id"), tool("m.toolName").alias("tool_name"))


def edit_and_resend(messages: DataFrame, edits: DataFrame) -> DataFrame:
    """edits: session_id, message_id, text; one for each session. The message and all after it go, the new text follows without an id.

    An unknown message drops nothing."""
    known = edits.join(messages.select("session_id", F.col("id").alias("message_id")), ["session_id", "message_id"], "left_semi").select("session_id", F.col("message_id").alias("from_id"))
    kept = messages.join(known, "session_id", "left").where("from_id is null or id < from_id").select("session_id", "id", "message_type", "text")
    return kept.unionByName(edits.select("session_id", F.lit(None).cast("long").alias("id"), F.lit(USER).alias("message_type"), "text"))


def requests(messages: DataFrame) -> DataFrame:
    """A row for each tool request of an assistant message, from its array `request_ids`."""
    return messages.select("session_id", F.col("id").alias("request_id"), F.posexplode("request_ids").alias("i", "call_id"))


def repair_tool_calls(messages: DataFrame) -> DataFrame:
    """Every request gets exactly one result: the first one stays, missing ones are filled, orphans go."""
    w = Window.partitionBy("session_id").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    seg = messages.withColumn("segment", F.max(F.when(F.col("message_type") != TOOL, F.col("id"))).over(w))
    asked = requests(messages).withColumnRenamed("request_id", "segment")
    first = F.row_number().over(Window.partitionBy("session_id", "segment", "call_id").orderBy("id"))
    results = seg.where(F.col("message_type") == TOOL).withColumn("nth", first).where("nth = 1").join(asked.select("session_id", "segment", "call_id", "i"), ["session_id", "segment", "call_id"])
    base = seg.where(F.col("message_type") != TOOL).select("session_id", "segment", F.lit(0).alias("kind"), F.col("id").alias("ordinal"), "message_type", "text", F.lit(None).cast("string").alias("call_id"))
    kept = results.select("session_id", "segment", F.lit(1).alias("kind"), F.col("id").alias("ordinal"), "message_type", "text", "call_id")
    filled = asked.join(results.select("session_id", "segment", "call_id"), ["session_id", "segment", "call_id"], "left_anti").select("session_id", "segment", F.lit(2).alias("kind"), F.col("i").cast("long").alias("ordinal"), F.lit(TOOL).alias("message_type"), F.lit(MISSING).alias("text"), "call_id")
    return base.unionByName(kept).unionByName(filled)


def budget_tool_output(view: DataFrame, budget: int) -> DataFrame:
    """The newest tool outputs up to `budget` tokens stay; older ones become a placeholder."""
    order = Window.partitionBy("session_id", "is_tool").orderBy(F.desc("segment"), F.desc("kind"), F.desc("ordinal")).rowsBetween(Window.unboundedPreceding, 0)
    df = view.withColumns({"is_tool": F.col("message_type") == TOOL, "tokens": tx.token_count(F.col("text"))})
    used = F.sum("tokens").over(order)
    return df.withColumn("stale", F.col("is_tool") & (used > budget)).withColumn("text", F.when(F.col("stale"), STALE).otherwise(F.col("text"))).drop("is_tool", "tokens")


def conversation_view(messages: DataFrame, sessions: DataFrame, options: Options = Options()) -> DataFrame:
    """The latest system message, the summary, then repaired and shortened messages after the watermark."""
    s = sessions.select(F.col("id").alias("session_id"), "summary", F.coalesce("summary_upto_message_id", F.lit(0)).alias("mark"))
    system = messages.where(F.col("message_type") == SYSTEM).groupBy("session_id").agg(F.max_by("text", "id").alias("text"))
    after = messages.join(s.select("session_id", "mark"), "session_id").where(f"id > mark and message_type <> {SYSTEM}").drop("mark")
    body = budget_tool_output(repair_tool_calls(after), options.tool_tokens)
    body = body.withColumn("text", tx.abbreviate_middle(F.col("text"), options.message_chars)).select("session_id", F.lit(2).alias("part"), "segment", "kind", "ordinal", "message_type", "text")
    zero = lambda c: F.lit(0).cast("long").alias(c)
    head = system.select("session_id", F.lit(0).alias("part"), zero("segment"), F.lit(0).alias("kind"), zero("ordinal"), F.lit(SYSTEM).alias("message_type"), "text")
    summary = s.where("trim(summary) <> ''").select("session_id", F.lit(1).alias("part"), zero("segment"), F.lit(0).alias("kind"), zero("ordinal"), F.lit(USER).alias("message_type"), F.concat(F.lit(SUMMARY), "summary").alias("text"))
    every = head.unionByName(summary).unionByName(body)
    position = F.row_number().over(Window.partitionBy("session_id").orderBy("part", "segment", "kind", "ordinal"))
    return every.select("session_id", position.alias("position"), "message_type", "text")


def _live(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    s = sessions.select(F.col("id").alias("session_id"), F.coalesce("summary_upto_message_id", F.lit(0)).alias("mark"))
    return messages.where(F.col("message_type") != SYSTEM).join(s, "session_id").where("id > mark").withColumn("tokens", tx.token_count(F.col("text")))


def compaction_plan(messages: DataFrame, sessions: DataFrame, options: Options = Options()) -> DataFrame:
    """For each session: whether to compact, how many messages, and the new watermark."""
    live = _live(messages, sessions)
    w = Window.partitionBy("session_id").orderBy("id")
    back = Window.partitionBy("session_id").orderBy(F.desc("id")).rowsBetween(Window.unboundedPreceding, 0)
    rows = live.withColumns({"idx": F.row_number().over(w) - 1, "from_end": F.sum("tokens").over(back)})
    keep = int(options.window * options.keep)
    starts = rows.groupBy("session_id").agg((F.coalesce(F.max(F.when(F.col("from_end") > keep, F.col("idx"))), F.lit(-1)) + 1).alias("start"), F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("total_tokens"))
    # never begin with a tool result: go back to the message that asked for it
    aligned = rows.join(starts, "session_id").groupBy("session_id", "n", "total_tokens", "start").agg(F.max(F.when((F.col("idx") <= F.col("start")) & (F.col("message_type") != TOOL), F.col("idx"))).alias("a"))
    keep_start = F.when(F.col("start") >= F.col("n"), F.col("n")).otherwise(F.coalesce("a", F.lit(0)))
    plans = aligned.withColumn("keep_start", keep_start.cast("int"))
    last = rows.join(plans.select("session_id", "keep_start"), "session_id").where("idx < keep_start").groupBy("session_id").agg(F.max("id").alias("last_id"))
    s = sessions.select(F.col("id").alias("session_id"), "last_input_tokens", "summary")
    estimate = F.coalesce("last_input_tokens", F.col("total_tokens") + tx.token_count(F.col("summary")))
    line = int(options.window * options.trigger)
    df = plans.join(s, "session_id").join(last, "session_id", "left").withColumn("estimate", estimate)
    action = F.when(F.col("estimate") <= line, "none").when(F.col("keep_start") <= 0, "skip").otherwise("compact")
    df = df.withColumn("action", action)
    done = F.col("action") == "compact"
    return df.select("session_id", "estimate", F.lit(line).cast("long").alias("trigger_line"), "keep_start", "action", F.when(done, F.col("keep_start")).otherwise(0).alias("n_compacted"), F.when(done, F.col("last_id")).alias("new_watermark"))


def transcript(messages: DataFrame, sessions: DataFrame, plan: DataFrame, calls: DataFrame | None = None) -> DataFrame:
    """One text of all messages to be compacted, a labelled line each; a message without text has an empty line.

    A tool's line names the tool (`tool_name`). calls: session_id, id, tool_calls (as decode_messages gives them); an
    assistant's line then ends with the names and arguments of its calls."""
    name = F.coalesce("tool_name", F.lit("")) if "tool_name" in messages.columns else F.lit("")
    label = F.when(F.col("message_type") == TOOL, F.concat(F.lit("tool["), name, F.lit("]"))).otherwise(F.when(F.col("message_type") == USER, "user").otherwise("assistant"))
    rows = _live(messages, sessions).join(plan.where("action = 'compact'").select("session_id", "new_watermark"), "session_id").where("id <= new_watermark")
    asked = F.lit("")
    if calls is not None:
        rows = rows.join(calls.where("size(tool_calls) > 0").select("session_id", "id", "tool_calls"), ["session_id", "id"], "left")
        shown = F.array_join(F.transform("tool_calls", lambda c: F.concat(c["name"], F.lit("("), c["args"], F.lit(")"))), ", ")
        asked = F.when(F.col("tool_calls").isNotNull(), F.concat(F.lit(" [calls: "), shown, F.lit("]"))).otherwise("")
    line = F.concat(label, F.lit(": "), F.coalesce("text", F.lit("")), asked)
    parts = F.array_sort(F.collect_list(F.struct("id", line.alias("line"))))
    return rows.groupBy("session_id").agg(F.array_join(F.transform(parts, lambda x: x["line"]), "\n").alias("transcript"))


def summary_requests(messages: DataFrame, sessions: DataFrame, plan: DataFrame, options: Options = Options(), calls: DataFrame | None = None) -> DataFrame:
    """What a summary model is asked for each session to be compacted: soft limit (a share of the hard one, so that summaries
    rarely run into it), hard limit, the summary so far (`none` where blank) and the transcript."""
    soft = int(options.summary_tokens * options.soft_ratio)
    old = sessions.select(F.col("id").alias("session_id"), F.when(F.trim("summary") != "", F.col("summary")).otherwise("none").alias("old_summary"))
    return transcript(messages, sessions, plan, calls).join(old, "session_id").select("session_id", F.lit(soft).alias("soft_limit"), F.lit(options.summary_tokens).alias("max_tokens"), "old_summary", "transcript")


def apply_plan(sessions: DataFrame, plan: DataFrame, expected: Column) -> DataFrame:
    """Compare-and-set: a plan applies only where the watermark is still the expected one; none counts as 0."""
    p = plan.where("action = 'compact'").select(F.col("session_id").alias("p_id"), "new_watermark")
    both = sessions.join(p, sessions.id == F.col("p_id"), "left")
    hit = F.col("p_id").isNotNull() & (F.coalesce("summary_upto_message_id", F.lit(0)) == F.coalesce(expected, F.lit(0)))
    status = F.when(hit, "applied").when(F.col("p_id").isNotNull(), "rejected").otherwise("unchanged")
    return both.select("id", F.when(hit, F.col("new_watermark")).otherwise(F.col("summary_upto_message_id")).alias("summary_upto_message_id"), F.when(hit, F.lit(None)).otherwise(F.col("last_input_tokens")).alias("last_input_tokens"), (F.coalesce("compact_count", F.lit(0)) + hit.cast("int")).alias("compact_count"), status.alias("status"))


def append_messages(log: DataFrame, batch: DataFrame) -> DataFrame:
    """batch: session_id, ord, message_type, text. Numbers go on after the log; a system message equal to the last is skipped."""
    latest = log.where(F.col("message_type") == SYSTEM).groupBy("session_id").agg(F.max_by("text", "id").alias("last_system"))
    w = Window.partitionBy("session_id", "message_type").orderBy("ord")
    rows = batch.join(latest, "session_id", "left").withColumn("before", F.coalesce(F.lag("text").over(w), "last_system"))
    rows = rows.where(~((F.col("message_type") == SYSTEM) & F.col("text").eqNullSafe(F.col("before"))))
    top = log.groupBy("session_id").agg(F.max("seq").alias("top"))
    seq = F.coalesce("top", F.lit(-1)) + F.row_number().over(Window.partitionBy("session_id").orderBy("ord"))
    return rows.join(top, "session_id", "left").select("session_id", seq.cast("int").alias("seq"), "message_type", "text")
