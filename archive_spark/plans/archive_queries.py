"""Archive, chunk, table and report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import archive, chunking, flow
from ..sources.tables import load, with_tables

AR = ("ar_file", "ar_side", "ar_main", "ar_project")


def _chunks(spark, sf):
    return archive.chunk_chain(archive.headings(load(spark, sf, "flow_item")[0]))


def _join_headings(df):
    return df.withColumn("headings", F.array_join("headings", " > "))


def _flow(spark, sf):
    """Items, and tables as text with their places: Markdown, or triplets for every third."""
    items, cells, places = load(spark, sf, "flow_item", "table_cell", "flow_table")
    placed = cells.join(places.select("table_id"), "table_id", "left_semi")
    texts = archive.table_markdown(placed.where("table_id % 3 <> 0")).unionByName(archive.table_triplets(placed.where("table_id % 3 = 0")))
    return items, places.join(texts, "table_id")


def document_chunks(spark, sf):
    rows = flow.chunk_rows(flow.document_chunks(*_flow(spark, sf), 128), archive.identity(*load(spark, sf, *AR)), "table:embeddings")
    return rows.withColumn("refs", F.array_join("refs", ","))


def replaced(spark, sf):
    chunks = _chunks(spark, sf).select("id", "file_id", "text")
    fresh = chunks.where("file_id like '%7' and id like '%-1'").withColumn("text", F.concat(F.lit("new "), "text"))
    return archive.replace_by_file(chunks, fresh)


QUERIES = {
    "archive_identity": lambda s, d: archive.identity(*load(s, d, *AR)),
    "ingest_summary": lambda s, d: archive.ingest_summary(archive.identity(*load(s, d, *AR))),
    "heading_stack": lambda s, d: _join_headings(archive.headings(load(s, d, "flow_item")[0])),
    "chunk_metadata_chain": _chunks,
    "chunk_review": lambda s, d: archive.review(_chunks(s, d), 20),
    "corpus_overview": lambda s, d: archive.overview(_chunks(s, d)),
    "neighbour_expansion": lambda s, d: archive.neighbours(_chunks(s, d)),
    "replace_by_file": replaced,
    "semantic_chunks": lambda s, d: _join_headings(chunking.semantic_chunks(archive.headings(load(s, d, "flow_item")[0]), 128)),
    "semantic_parts": lambda s, d: _join_headings(chunking.split_items(archive.headings(load(s, d, "flow_item")[0]), 128)),
    "reading_flow": lambda s, d: flow.reading_flow(*_flow(s, d)).select("file_id", "ord", "ref", "label", "page_no", "top", F.length("text").alias("n_chars")),
    "document_chunks": document_chunks,
    "table_markdown": lambda s, d: archive.table_markdown(load(s, d, "table_cell")[0]),
    "table_triplets": lambda s, d: archive.table_triplets(load(s, d, "table_cell")[0]),
    "table_split": lambda s, d: chunking.split_tables(archive.table_markdown(load(s, d, "table_cell")[0]).where(tx.is_pipe_table(F.col("text"))), 24),
    "chunk_context": lambda s, d: archive.headings(load(s, d, "flow_item")[0]).select("file_id", "ord", tx.contextual(F.col("headings"), F.col("text")).alias("context")),
    "token_counts": lambda s, d: load(s, d, "documents")[0].select("doc_id", tx.token_count(F.col("text")).alias("n_tokens")),
    "text_pages": lambda s, d: load(s, d, "documents")[0].select("doc_id", F.posexplode(tx.text_pages(F.col("text"))).alias("page", "text")),
    "archive_by_status": lambda s, d: archive.by_status(load(s, d, "ar_main")[0]),
    "archive_by_year_category": lambda s, d: archive.by_year_category(load(s, d, "ar_main")[0]),
    "archive_year_status_cube": lambda s, d: archive.year_status_cube(load(s, d, "ar_main")[0]),
    "archive_year_status_pivot": lambda s, d: archive.year_status_pivot(load(s, d, "ar_main")[0]),
    "project_items": lambda s, d: archive.project_items(*load(s, d, "ar_project", "ar_main", "ar_side")),
    "project_report": lambda s, d: archive.project_report(*load(s, d, "ar_project", "ar_main", "ar_side")),
    "volume_items": lambda s, d: archive.volume_items(*load(s, d, "ar_main", "ar_side")),
}

IDENTITY = """
 select f.id file_id, case when m.id is not null then coalesce(p.project_name, '') end project_name,
  case when m.id is null then null when s.id is not null then m.title else '' end volume_name,
  case when m.id is null then null when s.id is not null then s.title else m.title end item_name, m.form_year,
  case when m.id is not null then null when s.id is not null then 'volume not found' else 'archive not found' end error
 from ar_file f left join ar_side s on f.archive_id = s.id left join ar_main m on m.id = coalesce(s.main_id, f.archive_id) left join ar_project p on p.id = m.project_id"""

# Headings by a search backwards for each item and level, unlike the windows on the Spark side.
HEADINGS = r"""
 , o as (select file_id, page_no, label, greatest(level, 1) lv, trim(regexp_replace(text, '[\s\x{00A0}\x{3000}]+', ' ', 'g')) text,
   row_number() over (partition by file_id order by page_no, top desc, pos) ord
   from (select * from flow_item where label not in ('PAGE_HEADER', 'PAGE_FOOTER') and trim(regexp_replace(text, '[\s\x{00A0}\x{3000}]+', ' ', 'g')) <> '') z),
 hd as (select file_id, ord, lv, text, (select min(h2.ord) from o h2 where h2.file_id = o.file_id and h2.label = 'SECTION_HEADER' and h2.ord > o.ord and h2.lv <= o.lv) ends from o where label = 'SECTION_HEADER'),
 it as (select i.file_id, i.ord, i.page_no, i.text, coalesce(string_agg(h.text, ' > ' order by h.lv), '') headings
   from o i left join hd h on h.file_id = i.file_id and h.ord < i.ord and (h.ends is null or h.ends > i.ord) where i.label <> 'SECTION_HEADER' group by all),
 ch as (select file_id || '-' || row_number() over w id, file_id, row_number() over w seq, text, case when headings = '' then '未知章节' else headings end section, cast(page_no as varchar) page
   from it window w as (partition by file_id order by ord))
"""


def _headed(select: str) -> str:
    return with_tables(HEADINGS + select, "flow_item").replace(") \n ,", ")\n ,", 1)


_GRID = """, w as (select table_id, max(col_idx) mc from table_cell group by 1),
 g as (select r.table_id, r.row_idx, c.i col_idx, coalesce(t.text, '') text from (select distinct table_id, row_idx from table_cell) r join w on w.table_id = r.table_id, range(0, 3) c(i)
  left join table_cell t on t.table_id = r.table_id and t.row_idx = r.row_idx and t.col_idx = c.i where c.i <= w.mc)"""
_HAN = r"regexp_extract_all(regexp_replace(coalesce(text, ''), '(\p{Han})', ' \1 ', 'g'), '\p{Han}|[\p{L}\p{N}]+|[^\s\p{L}\p{N}]')"

ORACLE = {
    "archive_identity": with_tables(IDENTITY, *AR),
    "ingest_summary": with_tables(f"select count(*) filter (where error is null) success, count(*) filter (where error is not null) failed from ({IDENTITY}) x", *AR),
    "heading_stack": _headed("select * from it"),
    "chunk_metadata_chain": _headed("select *, coalesce(lag(id) over w2, '') prev_id, coalesce(lead(id) over w2, '') next_id from ch window w2 as (partition by file_id order by seq)"),
    "chunk_review": _headed("select file_id, seq place, id, section, page, octet_length(encode(text)) bytes, case when length(text) > 20 then left(text, 20) || '...' else text end text from ch"),
    "corpus_overview": _headed("select file_id, count(*) n_chunks, arg_min(section, seq) first_section from ch group by 1"),
    "neighbour_expansion": _headed("select a.id, cast(b.seq - a.seq as int) step, b.id neighbour_id from ch a join ch b on a.file_id = b.file_id and abs(a.seq - b.seq) = 1"),
    "replace_by_file": _headed("select id, file_id, case when file_id like '%7' then 'new ' || text else text end text from ch where file_id not like '%7' or id like '%-1'"),
    # a place is counted: items and tables that are on an earlier page, higher up, or at the same height and earlier
    "reading_flow": with_tables(_GRID + r""", tx as (select table_id, sum(length(text)) + sum(1) + count(distinct row_idx) + count(distinct row_idx) - 1 md from g group by 1),
 tr as (select v.table_id, string_agg(f.text || ', ' || h.text || ' = ' || v.text, '. ') tt from g v join g f on f.table_id = v.table_id and f.row_idx = v.row_idx and f.col_idx = 0
  join g h on h.table_id = v.table_id and h.row_idx = 0 and h.col_idx = v.col_idx where v.row_idx > 0 and v.col_idx > 0 and v.text <> '' group by 1),
 e as (select file_id, '#/texts/' || pos ref, label, page_no, top, length(trim(regexp_replace(text, '[\s\x{00A0}\x{3000}]+', ' ', 'g'))) n_chars, 0 t, pos src from flow_item
   where label not in ('PAGE_HEADER', 'PAGE_FOOTER') and trim(regexp_replace(text, '[\s\x{00A0}\x{3000}]+', ' ', 'g')) <> ''
  union all select file_id, '#/tables/' || p.table_id, 'TABLE', page_no, top, case when p.table_id % 3 <> 0 then md else length(tt) end, 1, p.table_id from flow_table p join tx using (table_id) left join tr using (table_id))
 select a.file_id, a.ref, a.label, a.page_no, a.top, a.n_chars, (select count(*) from e b where b.file_id = a.file_id and (b.page_no, -b.top, b.t, b.src) <= (a.page_no, -a.top, a.t, a.src)) ord from e a""", "flow_item", "table_cell", "flow_table"),
    "table_markdown": with_tables(_GRID + " select table_id, string_agg(line, chr(10) order by row_idx) as text from (select table_id, row_idx, '|' || string_agg(text, '|' order by col_idx) || '|' line from g group by 1, 2) x group by 1", "table_cell"),
    "table_triplets": with_tables(_GRID + """ select v.table_id, string_agg(f.text || ', ' || h.text || ' = ' || v.text, '. ' order by v.row_idx, v.col_idx) as text from g v join g f on f.table_id = v.table_id and f.row_idx = v.row_idx and f.col_idx = 0
  join g h on h.table_id = v.table_id and h.row_idx = 0 and h.col_idx = v.col_idx where v.row_idx > 0 and v.col_idx > 0 and v.text <> '' group by 1""", "table_cell"),
    "chunk_context": _headed("select file_id, ord, case when headings = '' then '' else replace(headings, ' > ', chr(10)) || chr(10) end || text context from it"),
    "table_split": with_tables(_GRID + """, ln as (select table_id, row_idx, '|' || string_agg(text, '|' order by col_idx) || '|' line, len(regexp_extract_all('|' || string_agg(text, '|' order by col_idx) || '|', '[a-zA-Z0-9]+|[^ ]')) n from g group by 1, 2),
 h as (select * from ln where row_idx = 0), fold as (select l.table_id, l.row_idx, l.line, h.line head, h.n hn, 0 part, h.n + l.n used from ln l join h using (table_id) where l.row_idx = 1
  union all select l.table_id, l.row_idx, l.line, f.head, f.hn, f.part + case when f.used + l.n > 24 then 1 else 0 end, case when f.used + l.n > 24 then f.hn + l.n else f.used + l.n end from fold f join ln l on l.table_id = f.table_id and l.row_idx = f.row_idx + 1)
 select table_id, part, head || chr(10) || string_agg(line || chr(10), '' order by row_idx) as text from fold group by table_id, part, head""", "table_cell"),
    "token_counts": f"select doc_id, len({_HAN}) n_tokens from documents",
    "text_pages": "select doc_id, cast(i as int) page, substring(coalesce(text, ''), i * 4000 + 1, 4000) as text from (select doc_id, text, unnest(range(greatest(cast(ceil(length(coalesce(text, '')) / 4000) as bigint), 1))) i from documents) x",
    "archive_by_status": with_tables("select case status when '1' then 'registered' when '2' then 'processing' else 'archived' end status, count(*) volumes from ar_main where del_flag = '0' group by 1", "ar_main"),
    "archive_by_year_category": with_tables("select form_year, category_id, count(*) volumes from ar_main where del_flag = '0' group by rollup(form_year, category_id)", "ar_main"),
    "archive_year_status_cube": with_tables("select form_year, status, cast(grouping(form_year, status) as int) as level, count(*) volumes from (select form_year, case status when '1' then 'registered' when '2' then 'processing' else 'archived' end status from ar_main where del_flag = '0') x group by cube(form_year, status)", "ar_main"),
    "archive_year_status_pivot": with_tables("select form_year, count(*) filter (where status = '1') registered, count(*) filter (where status = '2') processing, count(*) filter (where status = '3') archived from ar_main where del_flag = '0' group by 1", "ar_main"),
    "project_items": with_tables("select p.id project_id, m.id main_id, s.id item_id, s.title, s.sequence_no, m.title volume_name, p.project_name from ar_project p join ar_main m on m.project_id = p.id and m.del_flag = '0' join ar_side s on s.main_id = m.id and s.del_flag = '0' where p.del_flag = '0'", "ar_project", "ar_main", "ar_side"),
    "project_report": with_tables("select p.id project_id, p.project_name, count(distinct m.id) volumes, count(s.id) items from ar_project p left join ar_main m on m.project_id = p.id and m.del_flag = '0' left join ar_side s on s.main_id = m.id and s.del_flag = '0' where p.del_flag = '0' group by 1, 2", "ar_project", "ar_main", "ar_side"),
    "volume_items": with_tables("select m.id main_id, m.title, count(s.id) n_items, max(s.sequence_no) last_no from (select * from ar_main where del_flag = '0') m left join (select * from ar_side where del_flag = '0') s on s.main_id = m.id group by 1, 2", "ar_main", "ar_side"),
}
