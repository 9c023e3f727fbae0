"""Semantic chunks against a plain version, with budgets that force cuts, dropped headings and merges."""

import pytest
import regex

from archive_spark.operators import archive, chunking
from archive_spark.sources.tables import load

TOKEN = r"(?:\p{Han}|[[\p{L}\p{N}]--\p{Han}]+|[^ \t\n\x0b\f\r\p{L}\p{N}])"
tokens = regex.compile(TOKEN, regex.V1)
pieces = regex.compile(r"[ \t\n\x0b\f\r]*" + TOKEN, regex.V1)


def count(text):
    return len(tokens.findall(text))


def parts_of(text, budget):
    out, held = [], []
    for s in regex.split(r"(?<=[。！？；!?;\n])", text, flags=regex.V1):
        if not s.strip(" "):
            continue
        if count(s) > budget or sum(map(count, held)) + count(s) > budget:
            if held:
                out.append("\n".join(held))
            held = []
        if count(s) > budget:
            found = pieces.findall(s)
            out += ["".join(found[i : i + budget]) for i in range(0, len(found), budget)]
        else:
            held.append(s)
    return out + (["\n".join(held)] if held else [])


def split(items, limit):
    out = []
    for r in items:
        heads, h, t = r["headings"], count("\n".join(r["headings"])), count(r["text"])
        if h + t > limit and h >= limit:
            heads, h = [], 0
        found = [r["text"]] if h + t <= limit else parts_of(r["text"], limit - h)
        out += [(r["file_id"], r["ord"], r["page_no"], tuple(heads), h, i, x) for i, x in enumerate(found)]
    return sorted(out)


def merge(parts, limit):
    out, before = [], None
    for f, ord_, page, heads, h, _, text in sorted(parts, key=lambda p: (p[0], p[1], p[5])):
        n = count(text)
        if before == (f, heads) and h + out[-1][7] + n <= limit:
            c = out[-1]
            out[-1] = (*c[:3], page, *c[4:6], c[6] + "\n" + text, c[7] + n)
        else:
            out.append((f, ord_, page, page, heads, h, text, n))
        before = (f, heads)
    return sorted(out)


def rows(df):
    return sorted(tuple(tuple(x) if isinstance(x, list) else x for x in r) for r in df.collect())


@pytest.mark.parametrize("limit", (6, 24, 128))
def test_chunks(spark, sf_dir, limit):
    items = archive.headings(load(spark, sf_dir, "flow_item")[0]).where("file_id like '%1'").cache()
    extra = spark.createDataFrame([("x", 1, 1, "第一句。第二句！ third one; 4?\n", ["标题"]), ("x", 2, 1, "一二三四五六七八九十" * 3, ["标题"]), ("x", 3, 2, "short", ["a b c d e f g h"]), ("x", 4, 2, "end", ["a b c d e f g h"])], "file_id string, ord int, page_no int, text string, headings array<string>")
    items = items.unionByName(extra)
    want = split([r.asDict() for r in items.collect()], limit)
    assert rows(chunking.split_items(items, limit)) == want
    merged = merge(want, limit)
    assert rows(chunking.semantic_chunks(items, limit)) == merged and len(merged) <= len(want)


def test_a_long_sentence_is_searched_once(spark):
    text = " ".join(f"w{i % 97} ," if i % 5 else "é一" for i in range(20_000))
    items = spark.createDataFrame([("x", 1, 1, text, ["h"]), ("x", 2, 2, "end", ["h"])], "file_id string, ord int, page_no int, text string, headings array<string>")
    want = split([r.asDict() for r in items.collect()], 6)
    chunks = chunking.semantic_chunks(items, 6)
    assert rows(chunks) == merge(want, 6) and len(want) > 5000
    # headings, whole texts, sentences and the pieces of a long one; nothing is counted again for each cut or merge
    assert chunks._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 4


def test_levels_of_blank_headings(spark):
    rows_ = [("x", 0, "TITLE", 3, "\u3000", 1, 9.0), ("x", 1, "SECTION_HEADER", 1, "A", 1, 8.0), ("x", 2, "TEXT", 0, " \u00a0", 1, 7.0), ("x", 3, "TEXT", 0, " a\tb ", 1, 6.0), ("x", 4, "TEXT", 0, None, 1, 5.0)]
    items = spark.createDataFrame(rows_, "file_id string, pos int, label string, level int, text string, page_no int, top double")
    assert [tuple(r) for r in archive.headings(items).collect()] == [("x", 2, 1, "a b", ["A"])]
