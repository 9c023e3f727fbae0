"""Conversation, catalog, event and governed-SQL queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import catalog, conversation as c, governed
from ..sources.tables import load, with_tables
from ..streaming import events as ev
from ..streaming import stateful as st

OPTIONS = c.Options(window=1000, trigger=0.5, keep=0.15, tool_tokens=200, message_chars=300)


def _plan(s, d):
    m, sessions = load(s, d, "chat_message", "chat_session")
    return c.compaction_plan(m, sessions, OPTIONS), m, sessions


def _summary_requests(s, d):
    plan, m, sessions = _plan(s, d)
    return c.summary_requests(m, sessions, plan, OPTIONS, c.decode_messages(load(s, d, "stored_message")[0]))


def _transcript(s, d):
    plan, m, sessions = _plan(s, d)
    return c.transcript(m, sessions, plan, c.decode_messages(load(s, d, "stored_message")[0]))


def _apply(s, d):
    plan, _, sessions = _plan(s, d)
    # every fifth session was changed meanwhile
    return c.apply_plan(sessions, plan, F.when(F.col("id") % 5 == 0, -1).otherwise(F.col("summary_upto_message_id")))


def _append(s, d):
    m = load(s, d, "chat_message")[0]
    return c.append_messages(m, m.where("message_type <= 2").select("session_id", F.col("id").alias("ord"), "message_type", "text"))


def _delete(s, d):
    sessions, files = load(s, d, "chat_session", "chat_file")
    keys = sessions.where("id % 3 = 0").select(F.when(F.col("id") % 2 == 0, F.col("user_id")).otherwise("nobody").alias("user_id"), F.col("id").alias("session_id"))
    a, b = catalog.delete_sessions(sessions, files, keys)
    return a.select(F.lit("session").alias("what"), "id", "del_flag").unionByName(b.select(F.lit("file").alias("what"), "id", "del_flag"))


def _upsert(s, d):
    files = load(s, d, "chat_file")[0]
    name = F.when(F.col("id") % 3 == 0, " ").otherwise(F.concat(F.lit("new-"), "file_name"))
    writes = files.where("id % 5 < 2").select(F.lit(1).alias("ord"), "id", "session_id", name.alias("file_name"), F.lit(None).cast("string").alias("description"), (F.col("file_size") + 1).alias("file_size"))
    again = writes.where("id % 5 = 1").withColumns({"ord": F.lit(0), "file_name": F.lit("older")})
    new = files.where("id % 7 = 0").select(F.lit(2).alias("ord"), F.lit(None).cast("long").alias("id"), "session_id", F.concat(F.lit("more-"), "file_name").alias("file_name"), F.lit("new").alias("description"), "file_size")
    return catalog.upsert_generated(files, writes.unionByName(again).unionByName(new))


def _uploads(s, d):
    files = load(s, d, "ar_file")[0].withColumn("batch", F.when(F.col("file_size") % 3 == 0, F.concat(F.lit("one-"), "id")).otherwise(F.col("archive_id")))
    return catalog.validate_uploads(files, "batch")


def _page_status(s, d):
    files = load(s, d, "chat_file")[0]
    asked = files.select(F.col("id").alias("request_id"), "session_id", F.get(F.array(F.lit(None), F.lit("report"), F.lit("no such file")), (F.col("id") % 3).cast("int")).alias("keyword"), (F.col("id") % 5).cast("int").alias("page"))
    return catalog.page_status(files, asked, 3)


def _rename(s, d):
    sessions = load(s, d, "chat_session")[0]
    mine = sessions.select(F.col("id").alias("ord"), F.when(F.col("id") % 3 == 0, "nobody").otherwise(F.col("user_id")).alias("user_id"), F.col("id").alias("session_id"), F.when(F.col("id") % 4 == 0, " ").otherwise(F.concat(F.lit("New "), "title")).alias("title"))
    return catalog.rename_sessions(sessions, mine.unionByName(mine.where("session_id % 5 = 0").select((F.col("ord") - 1).alias("ord"), "user_id", "session_id", F.lit("older").alias("title"))))


def _content(s, d):
    sessions, stored = load(s, d, "chat_session", "stored_message")
    asked = sessions.select(F.when(F.col("id") % 3 == 0, "nobody").otherwise(F.col("user_id")).alias("user_id"), F.col("id").alias("session_id"))
    got = c.decode_messages(stored.join(catalog.owned(sessions, asked).select("session_id"), "session_id", "left_semi"))
    first = F.get("tool_calls", F.lit(1))
    return got.select("session_id", "id", "role", "content", F.coalesce(F.size("tool_calls"), F.lit(0)).alias("n_calls"), first["id"].alias("second_call"), first["args"].alias("second_args"), "tool_call_id", "tool_name")


def _resend(s, d):
    m = load(s, d, "chat_message")[0]
    edits = m.groupBy("session_id").agg(F.max(F.when(F.col("message_type") == 2, F.col("id"))).alias("last_user")).where("last_user is not null")
    return c.edit_and_resend(m, edits.select("session_id", F.when(F.col("session_id") % 4 == 0, -5).otherwise(F.col("last_user")).alias("message_id"), F.lit("edited").alias("text")))


def _edits(s, d):
    docs = load(s, d, "documents")[0].select(F.col("doc_id").alias("id"), "text")
    words = F.split("text", r"[ \n]+")
    return catalog.unique_edits(docs, docs.select("id", F.element_at(words, F.greatest(F.size(words), F.lit(1))).alias("old"), F.lit("<edited>").alias("new")))


def _names(s, d):
    """Names, paths and times of the files that sessions generate."""
    files, sessions, e = load(s, d, "chat_file", "chat_session", "agent_event")
    asked = F.when(F.col("id") % 5 == 0, F.concat(F.lit(" "), "file_name", F.lit(" "))).when(F.col("id") % 5 == 1, " ").when(F.col("id") % 5 == 2, "Report.HTML").otherwise(F.concat(F.lit("r"), F.col("id").cast("string")))
    rows = files.join(sessions.select(F.col("id").alias("session_id"), "user_id"), "session_id").join(e.groupBy(F.col("event_id").alias("id")).agg(F.max("ts").alias("ts")), "id")
    path = tx.session_path(F.col("user_id"), F.col("session_id"), F.col("id"), tx.extension(F.col("file_name")))
    return rows.select("id", tx.generated_name(asked, F.col("id") % 2 == 0).alias("name"), path.alias("path"), tx.minute(F.col("ts")).alias("minute"))


ALLOWED = ["ek_ar_main", "ek_ar_side", "ek_ar_project", "ek_user"]
RUN = """with live as (select status, form_year from ek_ar_main where del_flag = '0' /* ; */)
 select status, form_year, count(*) as volumes, nullif(status, '3') as open from live group by status, form_year order by form_year, status"""


def _run(s, d):
    return governed.run(s, RUN, {"ek_ar_main": load(s, d, "ar_main")[0]})


def _describe(s, d):
    docs, dictionary = load(s, d, "documents", "dictionary")
    names = F.array(*[F.lit(n) for n in (" EK_AR_Main.md", "ek_ar_side", "../ek_ar_side", " ", "ek_user", "ek_other", "ek_ar_project.MD")])
    asked = docs.select(F.col("doc_id").alias("request_id"), F.get(names, (F.col("doc_id") % 8).cast("int")).alias("name"))
    return governed.describe(asked, dictionary, ALLOWED)


def _stale(s, d):
    return c.budget_tool_output(c.repair_tool_calls(load(s, d, "chat_message")[0]), OPTIONS.tool_tokens)


def _status(s, d):
    return load(s, d, "agent_event")[0].withColumn("status", F.expr("case event when 'TOOL_CALL_REQUEST' then 'compacting' when 'DONE' then 'done' when 'ERROR' then 'error' end"))


def _blocks(s, d):
    """Each event as the text that a server sends; some with an unknown name, without data, or with data that is cut."""
    e = load(s, d, "agent_event")[0]
    name = F.when(F.col("event_id") % 17 == 0, "PING").otherwise(F.col("event"))
    data = F.to_json(F.struct("session_id", "call_id", "text"))
    value = F.when(F.col("event_id") % 19 == 0, F.concat(F.lit("event: "), name)).when(F.col("event_id") % 23 == 0, F.concat(F.lit("event: "), name, F.lit("\ndata: "), F.left(data, F.lit(9)))).otherwise(F.concat(F.lit("id: 1\nevent:"), name, F.lit("\ndata: "), data))
    return st.decode_blocks(e.select("event_id", F.when(F.col("event_id") % 29 == 0, F.lit(" \n")).otherwise(value).alias("value")), "session_id long, call_id string, text string")


QUERIES = {
    "tool_call_repair": lambda s, d: c.repair_tool_calls(load(s, d, "chat_message")[0]),
    "stale_output_budget": _stale,
    "conversation_view": lambda s, d: c.conversation_view(*load(s, d, "chat_message", "chat_session"), OPTIONS),
    "compaction_plan": lambda s, d: _plan(s, d)[0],
    "compaction_transcript": _transcript,
    "summary_requests": _summary_requests,
    "compaction_apply": _apply,
    "append_messages": _append,
    "session_page": lambda s, d: catalog.session_page(load(s, d, "chat_session")[0], 1, 5),
    "session_search": lambda s, d: catalog.session_page(load(s, d, "chat_session")[0], 1, 5, "tion 1"),
    "session_delete_cascade": _delete,
    "file_list_page": lambda s, d: catalog.file_page(load(s, d, "chat_file")[0], "report", 1, 3),
    "file_anchor": lambda s, d: catalog.anchor_files(*load(s, d, "chat_file", "file_turn", "chat_message")),
    "upsert_generated_files": _upsert,
    "upload_validation": _uploads,
    "generated_file_names": _names,
    "file_page_status": _page_status,
    "session_rename": _rename,
    "session_content": _content,
    "edit_and_resend": _resend,
    "unique_edits": _edits,
    "sql_audit": lambda s, d: governed.audit(load(s, d, "sql_log")[0], ALLOWED, "ek"),
    "governed_run": _run,
    "dictionary_lookup": _describe,
    "markdown_result": lambda s, d: governed.markdown(load(s, d, "orders")[0].select("o_orderkey", "o_orderpriority", "o_orderstatus"), ["o_orderkey"], 100),
    "tool_error_triage": lambda s, d: governed.triage(load(s, d, "tool_cause")[0]),
    "event_dedupe": lambda s, d: ev.deduplicate(load(s, d, "agent_event")[0]),
    "event_segments": lambda s, d: ev.segments(load(s, d, "agent_event")[0]),
    "turn_outcome": lambda s, d: ev.turn_outcome(load(s, d, "agent_event")[0]),
    "touched_files": lambda s, d: ev.touched_files(load(s, d, "agent_event")[0]).withColumn("files", F.array_join("files", ",")),
    "compaction_status": lambda s, d: ev.compaction_status(_status(s, d)),
    "idle_timeouts": lambda s, d: st.idle_timeouts(_status(s, d), 21_600),
    "event_blocks": lambda s, d: _blocks(s, d)[0].select("event_id", "event", "data.*"),
    "event_rejects": lambda s, d: _blocks(s, d)[1].select("event_id", "event", "reason"),
    "token_baseline": lambda s, d: ev.token_baseline(load(s, d, "agent_event")[0]),
}

_REPAIR = """, sg as (select *, max(case when message_type <> 4 then id end) over (partition by session_id order by id rows unbounded preceding) segment from chat_message),
 rq as (select session_id, id segment, request_ids, unnest(range(len(request_ids))) i from chat_message where request_ids is not null), rc as (select session_id, segment, i, request_ids[i + 1] call_id from rq),
 rs as (select s.*, i from sg s join rc using (session_id, segment, call_id) where s.message_type = 4 qualify row_number() over (partition by s.session_id, s.segment, s.call_id order by s.id) = 1),
 rp as (select session_id, segment, 0 kind, id ordinal, message_type, text, null call_id from sg where message_type <> 4
  union all select session_id, segment, 1, id, message_type, text, call_id from rs
  union all select session_id, segment, 2, i, 4, '[tool result missing]', call_id from rc where not exists (select 1 from rs where rs.session_id = rc.session_id and rs.segment = rc.segment and rs.call_id = rc.call_id))"""
_DEDUPE = ", dd as (select * from agent_event qualify event not in ('TOOL_CALL_REQUEST', 'TOOL_CALL_RESULT') or call_id = '' or row_number() over (partition by session_id, event, call_id order by ts, event_id) = 1)"
_TURNS = _DEDUPE + ", tn as (select *, coalesce(sum(case when event in ('DONE', 'ERROR') then 1 else 0 end) over (partition by session_id order by ts, event_id rows between unbounded preceding and 1 preceding), 0) turn from dd)"
_HAN = r"len(regexp_extract_all(regexp_replace(coalesce({}, ''), '(\p{{Han}})', ' \1 ', 'g'), '\p{{Han}}|[\p{{L}}\p{{N}}]+|[^\s\p{{L}}\p{{N}}]'))"

# The audit from its rules: a table is what follows FROM or JOIN, or a comma if the last such word before it is FROM or JOIN.
_HIDE = r"""(?s)--[^\n]*|#[^\n]*|/\*.*?(?:\*/|\z)|''(?:[^''\\]|\\.|\\\z|'''')*(?:''|\z)|"(?:[^"\\]|\\.|\\\z)*(?:"|\z)|"""
_AUDIT = r""", c as (select stmt_id, sql, regexp_replace(coalesce(sql, ''), 'HIDE`(?:[^`\\]|\\.|\\\z)*(?:`|\z)', ' ', 'g') s, regexp_replace(coalesce(sql, ''), 'HIDE(`(?:[^`\\]|\\.|\\\z)*(?:`|\z))', ' \1 ', 'g') kept from sql_log),
 q as (select *, regexp_matches(s, '(?i)^[\s(]*(select|with)') query, case when regexp_matches(s, '(?i)^[\s(]*with') then list_transform(regexp_extract_all(s, '(?i)([a-z0-9_]+)\s+as\s*\(', 1), lambda x: lower(x)) else [] end ctes from c),
 w as (select stmt_id, unnest(regexp_extract_all(lower(kept), '`[^`]*`?|[\w$]+|[().,]')) x, generate_subscripts(regexp_extract_all(lower(kept), '`[^`]*`?|[\w$]+|[().,]'), 1) i from q where query),
 k as (select *, x in ('from', 'join', 'select', 'where', 'group', 'order', 'having', 'limit', 'union', 'except', 'intersect', 'window', 'values', 'with') word, lag(x) over (partition by stmt_id order by i) before, lead(x) over (partition by stmt_id order by i) dot, lead(x, 2) over (partition by stmt_id order by i) two, lead(x, 3) over (partition by stmt_id order by i) dots, lead(x, 4) over (partition by stmt_id order by i) three from w),
 d as (select *, sum(case x when '(' then 1 else 0 end) over (partition by stmt_id order by i) - sum(case x when ')' then 1 else 0 end) over (partition by stmt_id order by i rows between unbounded preceding and current row) depth from k),
 h as (select *, last_value(case when word then x end ignore nulls) over (partition by stmt_id, depth order by i rows unbounded preceding) clause from d),
 r as (select stmt_id, i, regexp_replace(x, '^`(\w+)`$', '\1') || case when dot = '.' and regexp_matches(two, '[\w$`]') then '.' || two || case when dots = '.' and regexp_matches(three, '[\w$`]') then '.' || three else '' end else '' end t from h where not word and x not in ('(', ')', '.', ',') and (before in ('from', 'join') or before = ',' and clause in ('from', 'join'))),
 v as (select r.*, case when contains(t, '.') and t not like 'ek.%' then 'cross_database' when list_contains(ctes, t) then null when replace(t, 'ek.', '') not in ('ek_ar_main', 'ek_ar_side', 'ek_ar_project', 'ek_user') then 'unknown_table' end bad from r join q using (stmt_id)),
 b as (select stmt_id, arg_min(bad, i) filter (where bad is not null) bad, string_agg(t, ',' order by i) refs from v group by 1)
 select stmt_id, coalesce(refs, '') refs, case when trim(coalesce(sql, '')) = '' then 'empty' when not query then 'not_select'
  when regexp_matches(s, '(?i)\b(insert|update|delete|drop|create|alter|truncate|replace|grant|revoke|call|set|handler|lock|unlock|load|outfile|dumpfile|load_file|into)\b') then 'write_keyword'
  when contains(regexp_replace(s, ';\s*$', ''), ';') then 'stacked' when bad is not null then bad when refs is null then 'no_table' else 'ok' end verdict from q left join b using (stmt_id)""".replace("HIDE", _HIDE)
_TRIAGE = r""", c as (select *, lower(coalesce(message, '')) m from tool_cause), k as (select call_id, attempt,
 count(*) filter (where error_type in ('FileNotFoundException') or regexp_matches(m, 'connection refused|http 40[01345]|http 422|invalid.api.key|unauthorized|authentication|sql syntax|unknown (column|table)|doesn''t exist|does not exist')) fatal,
 count(*) filter (where error_type in ('SocketTimeoutException', 'EOFException') or sql_state like '08%' or regexp_matches(m, 'connection reset|broken pipe|timed out|timeout|http 50[0234]|http 429|deadlock found|lock wait timeout')) passing,
 count(*) filter (where regexp_matches(message, 'timeout|Timeout|超时')) slow, count(*) filter (where regexp_matches(message, 'Connection re(set|fused)|SocketException|Broken pipe|connect timed out')) net, count(*) filter (where regexp_matches(message, 'NoClassDefFoundError|ClassNotFoundException')) inner_,
 max(depth) dm from c group by 1, 2)
 select k.call_id, k.attempt, case when fatal > 0 then 'fatal' when passing > 0 then 'transient' else 'unknown' end kind, c.message root_cause,
 case when slow > 0 then '当前服务响应较慢，请稍后重试' when net > 0 then '网络出现波动，请稍后重试' when inner_ > 0 then '服务内部出现异常，请稍后重试' else '服务暂时开小差，请稍后重试' end told,
 [200, 400, 800, 1000][k.attempt] backoff_ms, [100, 200, 400, 500][k.attempt] backoff_min, [300, 600, 1200, 1500][k.attempt] backoff_max
 from k join c on c.call_id = k.call_id and c.depth = dm"""


def _paged(rows: str, key: str, order: str, number: int, size: int, select: str) -> str:
    return f"select {select} from (select *, row_number() over (partition by {key} order by {order}) rn, count(*) over (partition by {key}) total, cast(ceil(count(*) over (partition by {key}) / {size}) as bigint) pages from ({rows}) x) y where rn between {(number - 1) * size + 1} and {number * size}"


_SESSIONS = "user_id, id, title, rn, total, pages, total > 5 as has_more"

ORACLE = {
    "generated_file_names": with_tables("""select f.id, case f.id % 5 when 0 then file_name || case when file_name like '%.html' then '' else '.html' end when 1 then case when f.id % 2 = 1 then '未命名文件.html' end when 2 then 'Report.HTML' else 'r' || f.id || '.html' end as name,
 user_id || '/' || session_id || '/' || f.id || '.' || case when f.id % 2 = 0 then 'html' else 'pdf' end as path, strftime(ts, '%Y-%m-%d %H:%M') as minute
 from chat_file f join chat_session s on s.id = session_id join (select event_id, max(ts) ts from agent_event group by 1) e on event_id = f.id""", "chat_file", "chat_session", "agent_event"),
    "tool_call_repair": with_tables(_REPAIR + " select * from rp", "chat_message"),
    "stale_output_budget": with_tables(_REPAIR + f", us as (select *, message_type = 4 and sum({_HAN.format('text')}) over (partition by session_id, message_type = 4 order by segment desc, kind desc, ordinal desc rows unbounded preceding) > 200 stale from rp) select session_id, segment, kind, ordinal, message_type, case when stale then '[old tool output removed]' else text end as text, call_id, stale from us", "chat_message"),
    "append_messages": with_tables(""", b as (select session_id, id ord, message_type, text from chat_message where message_type <= 2), ls as (select session_id, arg_max(text, id) t from chat_message where message_type = 1 group by 1),
 k as (select b.*, coalesce(lag(text) over (partition by session_id, message_type order by ord), ls.t) pv from b left join ls using (session_id)), tp as (select session_id, max(seq) mx from chat_message group by 1)
 select session_id, cast(mx + row_number() over (partition by session_id order by ord) as int) seq, message_type, text from (select * from k where not (message_type = 1 and text is not distinct from pv)) z join tp using (session_id)""", "chat_message"),
    "session_page": with_tables(_paged("select * from chat_session where del_flag = 0", "user_id", "updated_ord desc, id", 1, 5, _SESSIONS), "chat_session"),
    "session_search": with_tables(_paged("select * from chat_session where del_flag = 0 and title like '%tion 1%'", "user_id", "updated_ord desc, id", 1, 5, _SESSIONS), "chat_session"),
    "session_delete_cascade": with_tables("""select 'session' what, id, case when id % 6 = 0 then 1 else del_flag end del_flag from chat_session
 union all select 'file', f.id, case when s.id is not null then 1 else f.del_flag end from chat_file f left join (select id from chat_session where id % 6 = 0) s on s.id = f.session_id""", "chat_session", "chat_file"),
    "file_list_page": with_tables(_paged("select * from chat_file where del_flag = 0 and (file_name like '%report%' or description like '%report%')", "session_id", "id desc", 1, 3,
 "session_id, id, case when kind = 2 then regexp_replace(file_name, '\\.html?$', '') || '.pdf' else file_name end display_name, case when file_size < 1024 then file_size || ' B' when file_size < 1048576 then round(file_size / 1024, 1) || ' KB' else round(file_size / 1048576, 1) || ' MB' end size, rn, total, pages"), "chat_file"),
    "file_anchor": with_tables(""", u as (select f.session_id, f.id, kind, completed, (select min(m.id) from chat_message m where m.session_id = f.session_id and message_type = 2 and m.id > before_id) un from chat_file f join file_turn t on t.file_id = f.id where del_flag = 0),
 n as (select u.*, (select min(m.id) from chat_message m where m.session_id = u.session_id and message_type = 2 and m.id > un) nx from u where un is not null),
 a as (select *, case when kind <> 2 then un when completed then (select max(m.id) from chat_message m where m.session_id = n.session_id and (nx is null or m.id < nx)) end anchor from n)
 select session_id, anchor anchor_message_id, count(*) n_files, string_agg(cast(id as varchar), ',' order by id) file_ids from a where anchor is not null group by 1, 2""", "chat_file", "file_turn", "chat_message"),
    "file_page_status": with_tables("""select request_id, total, cast(ceil(total / 3) as bigint) pages, case when total = 0 and k = '' then 'no_files' when total = 0 then 'no_match' when greatest(page, 1) > ceil(total / 3) then 'past_end' else 'ok' end status
 from (select a.id request_id, a.id % 5 page, ['', 'report', 'no such file'][a.id % 3 + 1] k, (select count(*) from chat_file f where f.session_id = a.session_id and del_flag = 0 and (file_name || ' ' || coalesce(description, '')) like '%' || ['', 'report', 'no such file'][a.id % 3 + 1] || '%') total from chat_file a) x""", "chat_file"),
    "session_rename": with_tables("select id, case when r and id % 4 = 0 then 'older' when r then 'New ' || title else title end title, r renamed from (select *, id % 3 <> 0 and del_flag = 0 and (id % 4 <> 0 or id % 5 = 0) r from chat_session) x", "chat_session"),
    "session_content": with_tables("""select m.session_id, m.id, case message_type when 2 then 'human' when 3 then 'ai' else 'tool' end as role, text as content, cast(case when message_type = 3 then coalesce(len(request_ids), 0) else 0 end as int) n_calls,
 request_ids[2] second_call, '{"_raw":"q ' || request_ids[2] || '"}' second_args, case when message_type = 4 then call_id end tool_call_id, case when message_type = 4 then tool_name end tool_name
 from chat_message m join chat_session s on s.id = m.session_id where s.del_flag = 0 and s.id % 3 <> 0 and message_type <> 1 and m.id % 170 <> 0""", "chat_message", "chat_session"),
    "edit_and_resend": with_tables(""", lu as (select session_id, max(id) l from chat_message where message_type = 2 group by 1)
 select m.session_id, id, message_type, text from chat_message m left join lu using (session_id) where l is null or session_id % 4 = 0 or id < l union all select session_id, null, 2, 'edited' from lu""", "chat_message"),
    "upsert_generated_files": with_tables("""select id, session_id, case when w and kind = 2 and id % 3 <> 0 then 'new-' || file_name else file_name end file_name, description, case when w and kind = 2 then file_size + 1 else file_size end file_size,
 case when not w then 'unchanged' when kind = 2 then 'updated' else 'rejected' end status from (select *, id % 5 < 2 w from chat_file) x
 union all select null, session_id, 'more-' || file_name, 'new', file_size, 'inserted' from chat_file where id % 7 = 0""", "chat_file"),
    "upload_validation": with_tables("""select batch, id, ext, case when n > 5 then 'too_many' when ext in ('docx', 'xlsx', 'pdf') then 'ok' else 'bad_extension' end verdict from (
 select *, count(*) over (partition by batch) n from (select id, case when file_size % 3 = 0 then 'one-' || id else archive_id end batch, lower(list_last(string_split(file_name, '.'))) ext from ar_file) x) y""", "ar_file"),
    "unique_edits": r"""select id, cast(h as int) hits, case when h = 0 then 'not_found' when h > 1 then 'ambiguous' else 'ok' end status, case when h = 1 then replace(text, o, '<edited>') else text end as text
 from (select *, case when o = '' then 0 else (length(text) - length(replace(text, o, ''))) // length(o) end h from (select doc_id id, text, list_last(regexp_split_to_array(text, '[ \n]+')) o from documents) x) y""",
    "sql_audit": with_tables(_AUDIT, "sql_log"),
    "governed_run": with_tables(""", t as (select status, form_year, count(*) n from ar_main where del_flag = '0' group by all), k as (select *, row_number() over (order by form_year, status) i from t)
 select '| status | form_year | volumes | open |' || chr(10) || '| --- | --- | --- | --- |' || chr(10) || string_agg('| ' || status || ' | ' || form_year || ' | ' || n || ' | ' || case when status = '3' then 'NULL' else status end || ' |' || chr(10), '' order by i)
  || chr(10) || '共 ' || count(*) || ' 行' markdown, cast(count(*) as int) n_rows, false truncated from k""", "ar_main"),
    "dictionary_lookup": with_tables("""select request_id, n as name, st status, case when st = 'ok' then t.text end as text from (select request_id, n, case when n = '' then 'no_name' when n like '../%' then 'illegal_name' when n = 'ek_other' then 'unknown_table' when n = 'ek_user' then 'no_text' else 'ok' end st
 from (select doc_id request_id, ['ek_ar_main', 'ek_ar_side', '../ek_ar_side', '', 'ek_user', 'ek_other', 'ek_ar_project', ''][doc_id % 8 + 1] n from documents) x) y left join dictionary t on t.name = n""", "dictionary"),
    "markdown_result": """select '| o_orderkey | o_orderpriority | o_orderstatus |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg('| ' || o_orderkey || ' | ' || o_orderpriority || ' | ' || o_orderstatus || ' |' || chr(10), '' order by o_orderkey)
 || chr(10) || '共 ' || count(*) || ' 行' || case when (select count(*) from orders) > 100 then '（已截断，最多返回 100 行，请加 WHERE/LIMIT 缩小范围）' else '' end markdown,
 cast(count(*) as int) n_rows, (select count(*) from orders) > 100 truncated from (select * from orders order by o_orderkey limit 100) x""",
    "tool_error_triage": with_tables(_TRIAGE, "tool_cause"),
    "event_dedupe": with_tables(_DEDUPE + " select * from dd", "agent_event"),
    "event_segments": with_tables(_TURNS + """, sm as (select *, coalesce(sum(case when event = 'TOOL_CALL_RESULT' then 1 else 0 end) over (partition by session_id, turn order by ts, event_id rows between unbounded preceding and 1 preceding), 0) segment from tn)
 select session_id, cast(turn as bigint) turn, cast(segment as bigint) segment, coalesce(string_agg(case when event = 'STREAM_TEXT' then text end, '' order by ts, event_id), '') as text, count(*) filter (where event = 'TOOL_CALL_REQUEST') n_calls from sm group by 1, 2, 3""", "agent_event"),
    "turn_outcome": with_tables(_TURNS + " select session_id, cast(turn as bigint) turn, coalesce(max(case when event in ('DONE', 'ERROR') then event end), 'OPEN') outcome, count(*) n_events from tn group by 1, 2", "agent_event"),
    "touched_files": with_tables(_TURNS + " select session_id, cast(turn as bigint) turn, string_agg(distinct call_id, ',' order by call_id) files from tn where event = 'TOOL_CALL_RESULT' and call_id <> '' group by 1, 2", "agent_event"),
    "compaction_status": with_tables("select session_id, arg_max(case event when 'TOOL_CALL_REQUEST' then 'compacting' when 'DONE' then 'done' else 'error' end, (ts, event_id)) status from agent_event where event in ('TOOL_CALL_REQUEST', 'DONE', 'ERROR') group by 1", "agent_event"),
    "idle_timeouts": with_tables("""select session_id, event_id, timed_out_at from (select *, ts + interval 6 hours timed_out_at, coalesce(lead(ts) over (partition by session_id order by ts, event_id), (select max(ts) from agent_event)) later from agent_event) x
 where later > timed_out_at and event <> 'TOOL_CALL_REQUEST'""", "agent_event"),
    "event_blocks": with_tables("select event_id, event, session_id, call_id, text from agent_event where event_id % 17 <> 0 and event_id % 19 <> 0 and event_id % 23 <> 0 and event_id % 29 <> 0", "agent_event"),
    "event_rejects": with_tables("""select event_id, case when event_id % 17 = 0 then 'PING' else event end event, case when event_id % 17 = 0 then 'unknown_event' when event_id % 19 = 0 then 'no_data' else 'malformed' end reason
 from agent_event where event_id % 29 <> 0 and (event_id % 17 = 0 or event_id % 19 = 0 or event_id % 23 = 0)""", "agent_event"),
    "token_baseline": with_tables("select session_id, case when arg_max(event, (ts, event_id)) = 'DONE' then arg_max(input_tokens, (ts, event_id)) end baseline from agent_event where event in ('DONE', 'ERROR') group by 1", "agent_event"),
}
_LIVE = f""", lv as (select m.session_id, m.id, m.message_type, m.text, m.tool_name, m.request_ids, {_HAN.format('m.text')} tok from chat_message m join chat_session s on s.id = m.session_id where m.message_type <> 1 and m.id > coalesce(s.summary_upto_message_id, 0)),
 ix as (select *, row_number() over (partition by session_id order by id) - 1 idx, sum(tok) over (partition by session_id order by id desc rows unbounded preceding) fe from lv),
 st as (select session_id, coalesce(max(case when fe > 150 then idx end), -1) + 1 start, count(*) n, sum(tok) tk from ix group by 1),
 al as (select st.*, case when start >= n then n else coalesce((select max(idx) from ix where ix.session_id = st.session_id and idx <= start and message_type <> 4), 0) end ks from st),
 pl as (select al.session_id, cast(coalesce(s.last_input_tokens, tk + {_HAN.format('s.summary')}) as bigint) estimate, 500 trigger_line, cast(ks as int) keep_start, (select max(id) from ix where ix.session_id = al.session_id and idx < ks) lid from al join chat_session s on s.id = al.session_id),
 pa as (select *, case when estimate <= 500 then 'none' when keep_start <= 0 then 'skip' else 'compact' end action from pl),
 pn as (select session_id, estimate, trigger_line, keep_start, action, case when action = 'compact' then keep_start else 0 end n_compacted, case when action = 'compact' then lid end new_watermark from pa)"""
_LINE = """case message_type when 2 then 'user' when 3 then 'assistant' else 'tool[' || tool_name || ']' end || ': ' || text || case when id % 170 <> 0 and len(request_ids) > 0 then
 ' [calls: ' || array_to_string(list_transform(request_ids, lambda x: 'search(' || case when x like '%0' then '{"q":1}' else '{"_raw":"q ' || x || '"}' end || ')'), ', ') || ']' else '' end"""
ORACLE |= {
    "compaction_plan": with_tables(_LIVE + " select * from pn", "chat_message", "chat_session"),
    "conversation_view": with_tables(
        ", am as (select m.* from chat_message m join chat_session s on s.id = m.session_id where m.id > coalesce(s.summary_upto_message_id, 0) and m.message_type <> 1)" + _REPAIR.replace("chat_message", "am")
        + f", us as (select *, message_type = 4 and sum({_HAN.format('text')}) over (partition by session_id, message_type = 4 order by segment desc, kind desc, ordinal desc rows unbounded preceding) > 200 stale from rp)"
        + """, vw as (select session_id, 0 part, 0 segment, 0 kind, 0 ordinal, 1 message_type, arg_max(text, id) as text from chat_message where message_type = 1 group by 1
 union all select id, 1, 0, 0, 0, 2, 'Summary so far: ' || summary from chat_session where trim(summary) <> ''
 union all select session_id, 2, segment, kind, ordinal, message_type, case when stale then '[old tool output removed]' when length(text) > 300 then left(text, 150) || chr(10) || '[...]' || chr(10) || right(text, 150) else text end from us)
 select session_id, cast(row_number() over (partition by session_id order by part, segment, kind, ordinal) as int) as position, message_type, text from vw""", "chat_message", "chat_session"),
    "summary_requests": with_tables(_LIVE + f""", tr as (select lv.session_id, string_agg({_LINE}, chr(10) order by id) transcript from lv join pn using (session_id) where action = 'compact' and id <= new_watermark group by 1)
 select session_id, 12000 soft_limit, 16000 max_tokens, case when trim(summary) <> '' then summary else 'none' end old_summary, transcript from tr join chat_session s on s.id = session_id""", "chat_message", "chat_session"),
    "compaction_transcript": with_tables(_LIVE + f" select lv.session_id, string_agg({_LINE}, chr(10) order by id) transcript from lv join pn using (session_id) where action = 'compact' and id <= new_watermark group by 1", "chat_message", "chat_session"),
    "compaction_apply": with_tables(_LIVE + """ select id, case when st2 = 'applied' then new_watermark else summary_upto_message_id end summary_upto_message_id, case when st2 = 'applied' then null else last_input_tokens end last_input_tokens, compact_count + case when st2 = 'applied' then 1 else 0 end compact_count, st2 status
 from (select s.*, new_watermark, case when action = 'compact' and id % 5 <> 0 then 'applied' when action = 'compact' then 'rejected' else 'unchanged' end st2 from chat_session s left join pn on pn.session_id = s.id) x""", "chat_message", "chat_session"),
}
