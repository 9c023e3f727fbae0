"""Chunks of documents with tables against a plain version, with budgets that cut tables and merge over them."""

import pytest
from pyspark.sql import functions as F

from archive_spark.functions import text as tx
from archive_spark.operators import archive, flow
from archive_spark.plans import archive_queries
from archive_spark.sources.tables import load

from .test_chunking import count, parts_of


def plain_order(items, tables):
    """Tables go one by one before the first item that is after them, then pages are sorted by height."""
    out = [(r["page_no"], r["top"], r["label"], r["level"], " ".join((r["text"] or "").split()), f"#/texts/{r['pos']}", False) for r in sorted(items, key=lambda r: r["pos"]) if r["label"] not in ("PAGE_HEADER", "PAGE_FOOTER")]
    out.sort(key=lambda x: (x[0], -x[1]))
    for t in sorted(tables, key=lambda t: t["table_id"]):
        at = next((i for i, x in enumerate(out) if (x[0], -x[1]) > (t["page_no"], -t["top"])), len(out))
        out.insert(at, (t["page_no"], t["top"], "TABLE", 0, t["text"], f"#/tables/{t['table_id']}", True))
    return [x for x in out if x[4].strip()]


def table_parts(text, budget):
    head, *body = text.split("\n")
    out, buf, n = [], "", count(head)
    for line in body:
        if n + count(line) > budget and buf:
            out.append(head + "\n" + buf)
            buf, n = "", count(head)
        buf, n = buf + line + "\n", n + count(line)
    return out + ([head + "\n" + buf] if buf else [])


def plain_chunks(items, tables, limit):
    stack, parts = {}, []
    for page, top, label, level, text, ref, is_table in plain_order(items, tables):
        if label in ("SECTION_HEADER", "TITLE"):
            stack = {k: v for k, v in stack.items() if k < max(level, 1)} | {max(level, 1): text}
            continue
        heads = [stack[k] for k in sorted(stack)]
        if count("\n".join(heads)) + count(text) > limit and count("\n".join(heads)) >= limit:
            heads = []
        h = count("\n".join(heads))
        found = [text] if h + count(text) <= limit else table_parts(text, limit - h) if is_table and text.startswith("|") else parts_of(text, limit - h)
        parts += [(heads, x, ref, page, is_table) for x in found]
    out = []
    for heads, text, ref, page, is_table in parts:
        if out and out[-1][0] == heads and count("\n".join(heads)) + count(out[-1][1]) + count(text) <= limit:
            last = out[-1]
            out[-1] = (heads, last[1] + "\n" + text, last[2] + [ref] * (ref not in last[2]), last[3] + [page] * (page not in last[3]), last[4] or is_table)
        else:
            out.append((heads, text, [ref], [page], is_table))
    return [(*c[:4], "table" if c[4] else "text") for c in out]


@pytest.fixture(scope="module")
def tables(spark, sf_dir):
    items, placed = archive_queries._flow(spark, sf_dir)
    some = F.col("file_id").endswith("4")
    extra = spark.createDataFrame([("x", 0, " a  heading ", "TITLE", 0, 1, 700.0), ("x", 1, "one. two", None, 0, 1, 500.0), ("x", 2, "foot", "PAGE_FOOTER", 0, 1, 10.0), ("x", 3, None, "TEXT", 0, 1, 400.0), ("x", 4, "last", "TEXT", 0, 2, 700.0), ("x", 5, "no place", "TEXT", 0, None, None)], "file_id string, pos int, text string, label string, level int, page_no int, top double")
    more = spark.createDataFrame([("x", 9, "|a|b|\n|1|2|\n|3|4|\n|5|6|", 1, 500.0), ("x", 8, "|h|", 1, 500.0), ("x", 7, "a, b = 2. c, b = 4", 2, 900.0), ("x", 6, "", 1, 600.0), ("y", 1, "|only|\n|a table|", 0, 0.0)], "file_id string, table_id long, text string, page_no int, top double")
    items = items.where(some).unionByName(extra, allowMissingColumns=True).withColumn("h", F.lit("clash")).cache()
    return items, placed.where(some).select(*more.columns).unionByName(more).cache()


def by_file(df, **kw):
    out = {}
    for r in df.collect():
        d = {k: kw[k] if k in kw and v is None else v for k, v in r.asDict().items()}
        out.setdefault(d["file_id"], []).append(d)
    return out


@pytest.mark.parametrize("limit", (8, 30, 200))
def test_chunks_with_tables(tables, limit):
    items, placed = (by_file(t, page_no=0, top=0.0, label="TEXT") for t in tables)
    got = {}
    for r in flow.document_chunks(*tables, limit).orderBy("file_id", "ord", "part").collect():
        got.setdefault(r["file_id"], []).append((r["headings"], r["text"], r["refs"], r["pages"], r["block_type"]))
        assert r["n_tokens"] == count("\n".join(r["headings"])) + count(r["text"])
    want = {f: plain_chunks(items.get(f, []), placed.get(f, []), limit) for f in items | placed}
    assert got == {f: c for f, c in want.items() if c}
    kinds = [c[4] for rows in got.values() for c in rows]
    assert {"table", "text"} == set(kinds)


def test_order_of_equal_heights(tables):
    got = [r["ref"] for r in flow.reading_flow(*tables).where("file_id = 'x'").orderBy("ord").collect()]
    assert got == ["#/texts/5", "#/texts/0", "#/texts/1", "#/tables/8", "#/tables/9", "#/tables/7", "#/texts/4"]


def test_unmerged_parts_and_rows(spark, sf_dir, tables):
    parts = flow.document_chunks(*tables, 30, merge=False)
    assert parts.where("size(refs) <> 1").count() == 0 and parts.count() > flow.document_chunks(*tables, 30).count()
    known = spark.createDataFrame([("x", "p", "v", "i", 1999, None), ("file-4", None, None, None, None, "archive not found")], "file_id string, project_name string, volume_name string, item_name string, form_year int, error string")
    rows = flow.chunk_rows(flow.document_chunks(*tables, 8), known, "m:1").orderBy("seq").collect()
    assert {r["file_id"] for r in rows} == {"x"} and [r["id"] for r in rows] == [f"x-{i + 1}" for i in range(len(rows))]
    assert [r["next_id"] for r in rows] == [r["id"] for r in rows[1:]] + [""] and rows[0]["prev_id"] == "" and rows[0]["page"] == "0"
    assert flow.document_chunks(tables[0].where("false"), tables[1].where("false")).count() == 0
