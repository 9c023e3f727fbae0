"""Table readers, and the archive tables derived from the given ones.

Derivations are SQL that Spark and DuckDB both run; only `flow_item` differs in how it explodes lines.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: Derivations of the archive, chat and event tables.
DERIVED = {
    "ar_project": "select concat('prj-', cast(n_nationkey as string)) id, concat('cat-', cast(n_regionkey as string)) category_id, n_name project_name, '0' del_flag from nation where n_nationkey <> 24",
    "ar_main": """select concat('main-', cast(o.o_orderkey as string)) id, concat('cat-', cast(n.n_regionkey as string)) category_id,
 concat('prj-', cast(c.c_nationkey as string)) project_id, concat('Volume ', cast(o.o_orderkey as string)) title,
 case o.o_orderstatus when 'O' then '1' when 'P' then '2' else '3' end status, o.o_orderpriority retention_period,
 cast(o.o_orderkey % 5 as string) security_level, cast(year(o.o_orderdate) as int) form_year,
 case when o.o_orderkey % 50 = 0 then '1' else '0' end del_flag
 from orders o join customer c on o.o_custkey = c.c_custkey join nation n on c.c_nationkey = n.n_nationkey""",
    "ar_side": """select concat('side-', cast(l_orderkey as string), '-', cast(l_linenumber as string)) id,
 case when l_orderkey % 89 = 0 then 'main-missing' else concat('main-', cast(l_orderkey as string)) end main_id,
 concat('Item ', cast(l_orderkey as string), '-', cast(l_linenumber as string)) title, l_linenumber sequence_no, '0' del_flag
 from (select distinct l_orderkey, l_linenumber from lineitem) x""",
    "ar_file": """select concat('file-', cast(d.doc_id as string)) id,
 case when d.doc_id % 10 < 6 then s.id when d.doc_id % 10 < 9 then m.id else 'none' end archive_id,
 concat('doc-', cast(d.doc_id as string), case d.doc_id % 4 when 0 then '.pdf' when 1 then '.docx' when 2 then '.xlsx' else '.html' end) file_name,
 concat('p/', cast(d.doc_id as string)) file_path, cast(d.doc_id % 3 as string) file_type, d.n_chars file_size, md5(d.text) md5, '0' del_flag
 from documents d
 left join ar_side s on s.id = concat('side-', cast(d.doc_id + 1 as string), '-', cast(d.doc_id % 3 + 1 as string))
 left join ar_main m on m.id = concat('main-', cast(d.doc_id + 1 as string))""",
    "chat_message": """with b as (select conv_id session_id, role, text,
   conv_id * 1000000 + row_number() over (partition by conv_id order by turn, role, text) rn from conversations),
 base as (select rn*10 id, session_id, case role when 'system' then 1 when 'user' then 2 else 3 end message_type, text,
   case when role='assistant' and rn % 3 = 0 then split(concat('call-', cast(rn as string), '-0,call-', cast(rn as string), '-1'), ',') end request_ids,
   cast(null as string) call_id, cast(null as string) tool_name from b),
 res as (select rn*10+1 id, session_id, 4 message_type, text, split(cast(null as string), ',') request_ids, concat('call-', cast(rn as string), '-0') call_id, 'search' tool_name
   from b where role='assistant' and rn % 3 = 0
  union all select rn*10+2, session_id, 4, text, split(cast(null as string), ','), concat('call-', cast(rn as string), '-1'), 'sqlexecute'
   from b where role='assistant' and rn % 3 = 0 and rn % 2 = 0
  union all select rn*10+3, session_id, 4, text, split(cast(null as string), ','), concat('orphan-', cast(rn as string)), 'search' from b where role='user' and rn % 11 = 0)
 select id, session_id, cast(row_number() over (partition by session_id order by id) - 1 as int) seq, message_type, text, request_ids, call_id, tool_name, 0 del_flag
 from (select * from base union all select * from res) u""",
    "chat_session": """select session_id id, concat('u-', cast(session_id % 5 as string)) user_id,
 concat('Conversation ', cast(session_id as string)) title, case when session_id % 13 = 0 then 1 else 0 end del_flag,
 case when session_id % 4 = 0 then 900 + session_id else null end last_input_tokens,
 case when session_id % 3 = 0 then concat('Summary of conversation ', cast(session_id as string)) else null end summary,
 case when session_id % 3 = 0 then min(id) + 10 else 0 end summary_upto_message_id, 0 compact_count, max(id) updated_ord
 from chat_message group by session_id""",
    "chat_file": """select doc_id id, doc_id % 100 session_id, concat('doc-', cast(doc_id as string), case when doc_id % 2 = 0 then '.html' else '.pdf' end) file_name,
 case when doc_id % 2 = 0 then 2 else 1 end kind, case when doc_id % 2 = 0 then 4 else 3 end format,
 case when doc_id % 2 = 0 then concat('report from ', source) else null end description, n_chars file_size,
 case when doc_id % 17 = 0 then 1 else 0 end del_flag from documents""",
    "file_turn": """select f.id file_id, lo - 1 + (f.id * 13) % (hi - lo + 12) before_id, f.id % 7 <> 3 completed
 from chat_file f join (select session_id, min(id) lo, max(id) hi from chat_message group by session_id) m on m.session_id = f.session_id""",
    "table_cell": """with l as (select l_orderkey, l_linenumber, min(cast(l_quantity as int)) q, min(l_returnflag) f from lineitem group by l_orderkey, l_linenumber),
 r as (select l_orderkey, l_linenumber, q, f, row_number() over (partition by l_orderkey order by l_linenumber) rn from l)
 select l_orderkey table_id, 0 row_idx, 0 col_idx, 'line' text from (select distinct l_orderkey from l) x
 union all select l_orderkey, 0, 1, 'quantity' from (select distinct l_orderkey from l) x
 union all select l_orderkey, 0, 2, 'flag' from (select distinct l_orderkey from l) x
 union all select l_orderkey, cast(rn as int), 0, concat('L', cast(l_linenumber as string)) from r
 union all select l_orderkey, cast(rn as int), 1, cast(q as string) from r
 union all select l_orderkey, cast(rn as int), 2, f from r where l_linenumber <> 3""",
    "flow_table": """select concat('file-', cast(d.doc_id as string)) file_id, t.table_id, cast(t.table_id % 2 as int) + 1 page_no, cast(800 - (t.table_id % 20) * 30 as double) top
 from (select distinct l_orderkey table_id from lineitem) t join documents d on d.doc_id = cast(floor(t.table_id / 2) as bigint)""",
    "sql_log": """select doc_id stmt_id, case doc_id % 23
 when 0 then 'select count(*) n from ek_ar_main where title = ' || q when 1 then '/* ' || text || ' */ select id from ek_ar_side' when 2 then 'select id from ek_ar_main -- ' || replace(text, chr(10), ' ')
 when 3 then text when 4 then 'update ek_ar_main set title = ' || q
 when 5 then 'select ' || chr(39) || '/*' || chr(39) || ' from ek_ar_main; delete from ek_ar_main; select ' || chr(39) || '*/' || chr(39) || ' from ek_ar_main'
 when 6 then 'select ' || chr(39) || '--' || chr(39) || ' as x from ek_ar_main' when 7 then '(select id from ek_ar_main)'
 when 8 then 'with recursive t as (select id from ek_ar_main), u as (select 1 from t) select * from t join ek_ar_side on 1 = 1 join u on 1 = 1' when 9 then 'select * from ' || source || '.ek_ar_main'
 when 10 then 'select 1' when 11 then ' ' when 12 then 'select * from ek_not_exist where x = ' || q when 13 then 'select m.id from EK . ek_ar_main m join EK_AR_SIDE s on true'
 when 14 then 'select "delete" from ek_ar_main' when 15 then 'select id from ek_ar_main ; ' when 16 then 'select id from ek_ar_main into outfile ' || q
 when 17 then 'select id from ek_ar_main where title = ' || chr(39) || text when 18 then 'select id from ek_ar_main where x in (select y from ' || source || '_t) # ' || replace(text, chr(10), ' ')
 when 19 then 'select count(*) n from ek_ar_main m, ek_ar_side as s where m.id = s.main_id and m.title in (' || q || ', ' || q || ')' when 20 then 'select 1 from ek_ar_main, ' || source || ' where x = ' || q
 when 21 then 'select 1 from (select id from ek_ar_side, ' || source || '.t) x, ek_user order by a, b' else 'select x from `ek_ar_main` m join `' || source || '/f` on true' end sql
 from (select *, chr(39) || replace(text, chr(39), chr(39) || chr(39)) || chr(39) q from documents) d""",
    "dictionary": """select 'ek_ar_main' name, concat('volumes of ', cast(min(form_year) as string), ' to ', cast(max(form_year) as string), ', ', cast(count(*) as string), ' rows') text from ar_main
 union all select 'ek_ar_side', concat('items of volumes, ', cast(count(*) as string), ' rows') from ar_side union all select 'ek_ar_project', concat('projects from ', min(project_name), ' to ', max(project_name)) from ar_project""",
    "tool_cause": """select event_id call_id, cast(event_id % 4 + 1 as int) attempt, 0 depth, 'RuntimeException' error_type, cast(null as string) sql_state, 'tool ' || event_type || ' failed' message from events
 union all select event_id, cast(event_id % 4 + 1 as int), 1, case event_id % 11 when 0 then 'SocketTimeoutException' when 1 then 'FileNotFoundException' when 2 then 'EOFException' else 'Exception' end,
 case when event_id % 7 = 0 then '08S01' else '42000' end,
 case user_id % 12 when 0 then 'Read timed out after ' || props when 1 then 'Connection refused' when 2 then 'Unknown column x' when 3 then 'HTTP 503' when 4 then 'Deadlock found when trying to get lock' when 5 then 'HTTP 404 ' || props
  when 6 then 'Table t doesn' || chr(39) || 't exist' when 7 then 'Connection reset' when 8 then props when 9 then 'Invalid API key' when 10 then 'ClassNotFoundException: x' end from events where event_id % 13 <> 0""",
    "agent_event": r"""select event_id, ts, user_id session_id, case event_type when 'view' then 'STREAM_TEXT' when 'click' then 'TOOL_CALL_REQUEST'
 when 'purchase' then 'TOOL_CALL_RESULT' when 'signup' then 'DONE' else 'ERROR' end event,
 concat('c', regexp_extract(props, '([0-9]+)', 1)) call_id, concat('t', cast(event_id as string), ' ') text, cast(floor(value * 10) as int) input_tokens from events""",
    "flow_item": r"""select concat('file-', cast(doc_id as string)) file_id, cast(pos as int) pos, line text,
 case when pos % 11 = 10 then 'PAGE_FOOTER' when pos % 7 = 0 then 'SECTION_HEADER' else 'TEXT' end label,
 case when pos % 11 <> 10 and pos % 7 = 0 then cast(floor(pos / 7) % 3 as int) else 0 end level,
 cast(floor(pos / 20) as int) + 1 page_no, cast(800 - (pos % 20) * 30 as double) top from (select doc_id, pos, line from documents lateral view posexplode(split(text, '\n')) t as pos, line) x""",
}
#: Messages as they are stored; only Spark reads these.
DERIVED["stored_message"] = """select session_id, id, case when id % 170 = 0 then text || '{' when message_type = 1 then to_json(named_struct('type', 'SYSTEM', 'text', text))
 when message_type = 2 then to_json(named_struct('type', 'USER', 'contents', array(named_struct('type', 'TEXT', 'text', left(text, 10)), named_struct('type', 'IMAGE', 'text', 'x'), named_struct('type', 'TEXT', 'text', substring(text, 11)))))
 when message_type = 3 then to_json(named_struct('type', 'AI', 'text', text, 'toolExecutionRequests', transform(request_ids, x -> named_struct('id', x, 'name', 'search', 'arguments', case when x like '%0' then '{"q":1}' else 'q ' || x end))))
 else to_json(named_struct('type', 'TOOL_EXECUTION_RESULT', 'id', call_id, 'toolName', tool_name, 'text', text)) end content from chat_message"""
DUCKDB = DERIVED | {
    "flow_item": DERIVED["flow_item"].replace(r"documents lateral view posexplode(split(text, '\n')) t as pos, line", "(select doc_id, unnest(range(len(string_split(text, chr(10))))) pos, unnest(string_split(text, chr(10))) line from documents) y")
}


def needed(name: str) -> list[str]:
    """The tables that a derived table is built from, and itself, in order."""
    if name in BASE:
        return [name]
    words = set(re.findall(r"\w+", DERIVED[name])) - {name}
    out: list[str] = []
    for other in [*BASE, *DERIVED]:
        if other in words:
            out += [x for x in needed(other) if x not in out]
    return [*out, name]


#: Rows of `lineitem` that a task derives tables from, and up to how many rows partitions are left to Spark.
LINES_PER_TASK, FEW_LINES = 75_000, 1_000_000


def _given(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A given table. Order lines compress so well that partitions joined by their bytes would grow with the table: beyond a few
    rows, counted from the files' footers, they are dealt by order to tasks of about equally many, and grouped there."""
    df = spark.read.parquet(path)
    if name == "lineitem" and (rows := df.count()) > FEW_LINES:
        return df.repartition(rows // LINES_PER_TASK + 1, "l_orderkey")
    return df


def load(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    """The named tables, given or derived."""
    made: dict[str, DataFrame] = {}
    for name in [x for n in names for x in needed(n)]:
        if name not in made:
            made[name] = _given(spark, f"{sf_dir}/{name}.parquet", name) if name in BASE else spark.sql(DERIVED[name])
            made[name].createOrReplaceTempView(name)
    return [made[n] for n in names]


def with_tables(sql: str, *names: str) -> str:
    """DuckDB SQL with the derived tables put before it."""
    parts: dict[str, str] = {}
    for name in [x for n in names for x in needed(n)]:
        if name in DERIVED:
            parts[name] = f"{name} as ({DUCKDB[name]})"
    return f"with recursive {', '.join(parts.values())} {sql}" if parts else sql
