"""Text functions as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A Han character, a run of other letters and digits, or any other visible character is one token. ASCII comes
#: first, as scripts are slow to look up: no two branches begin with the same character but the two of runs.
TOKEN = r"(?!\s)(?:\p{Alnum}+[\p{L}\p{N}&&[^\p{IsHan}]]*|\p{Punct}|\p{IsHan}|[\p{L}\p{N}&&[^\p{IsHan}]]+|[^\s\p{L}\p{N}])"
TERM = r"\p{IsHan}|[\p{L}\p{N}&&[^\p{IsHan}]]+"
#: Characters after which a sentence ends.
SENTENCE_END = "。！？；!?;\\n"

#: The name of a generated file without one.
DEFAULT_NAME = "未命名文件.html"


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is made once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def in_runs(array: Column, key: Callable[[Column], Column]) -> Column:
    """An array cut where the key of its elements changes, in time linear in its size."""

    def cut(a: Column) -> Column:
        at = F.when(F.size(a) > 0, F.sequence(F.lit(0), F.size(a) - 1)).otherwise(F.array().cast("array<int>"))
        begins = F.filter(at, lambda i: (i == 0) | ~key(F.get(a, i)).eqNullSafe(key(F.get(a, i - 1))))
        return let(begins, lambda b: F.transform(b, lambda s, j: F.slice(a, s + 1, F.coalesce(F.get(b, j + 1), F.size(a)) - s)))

    return let(array, cut)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), 0)


def token_count(text: Column) -> Column:
    """Null counts 0."""
    return F.size(tokens(text))


def terms(text: Column) -> Column:
    """Lower-cased tokens without punctuation."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TERM), 0)


def squeeze(text: Column, mode: str = "collapse") -> Column:
    """White space, no-break and ideographic blanks included, becomes one blank (collapse) or nothing (remove)."""
    return F.regexp_replace(text, r"[\s\x{00A0}\x{3000}]+", " " if mode == "collapse" else "")


def is_blank(text: Column) -> Column:
    """Whether nothing but white space is left of a text, as squeeze knows it; found without squeezing it."""
    return ~text.rlike(r"[^\s\x{00A0}\x{3000}]")


def sentences(text: Column, extra: str = "") -> Column:
    parts = F.split(text, f"(?<=[{SENTENCE_END}{extra}])")
    return F.filter(parts, lambda x: F.trim(x) != "")


def page_range(first: Column, last: Column) -> Column:
    one = F.coalesce(first.cast("string"), F.lit("0"))
    return F.when((first == last) | last.isNull(), one).otherwise(F.concat_ws("-", one, last.cast("string")))


def section_path(headings: Column, placeholder: str = "未知章节") -> Column:
    return F.when(F.size(headings) > 0, F.array_join(headings, " > ")).otherwise(F.lit(placeholder))


def contextual(headings: Column, text: Column) -> Column:
    """A chunk as it is embedded: its headings, a line each, before its text."""
    return F.concat_ws("\n", headings, text)


def is_pipe_table(text: Column) -> Column:
    """Whether the first line of the text is a row of pipes."""
    return F.regexp_extract(F.coalesce(text, F.lit("")), r"\A\s*(.*)", 1).rlike(r"\A\|.*\|\s*\z")


def abbreviate(text: Column, limit: int) -> Column:
    """Longer texts are cut and say how long they were."""
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit("... ("), F.length(text).cast("string"), F.lit(" chars)"))).otherwise(text)


def abbreviate_middle(text: Column, limit: int, mark: str = "\n[...]\n") -> Column:
    """Longer texts keep half of `limit` from each end."""
    half = limit // 2
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(half)), F.lit(mark), F.right(text, F.lit(half)))).otherwise(text)


def text_pages(text: Column, size: int = 4000) -> Column:
    """Fixed-size pages; an empty text has one empty page."""
    text = F.coalesce(text, F.lit(""))
    pages = F.greatest(F.ceil(F.length(text) / size), F.lit(1)).cast("int")
    return F.transform(F.sequence(F.lit(0), pages - 1), lambda i: F.substring(text, i * size + 1, F.lit(size)))


def extension(name: Column) -> Column:
    """Lower-cased, after the last dot; empty without one."""
    return F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))


def display_name(name: Column, generated: Column) -> Column:
    """Generated HTML files are shown as PDF."""
    return F.when(generated, F.concat(F.regexp_replace(name, r"(?i)\.html?$", ""), F.lit(".pdf"))).otherwise(name)


def readable_size(size: Column) -> Column:
    kb, mb = F.round(size / 1024, 1), F.round(size / 1048576, 1)
    return F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B"))).when(size < 1048576, F.concat(kb.cast("string"), F.lit(" KB"))).otherwise(F.concat(mb.cast("string"), F.lit(" MB")))


def markdown_cell(value: Column) -> Column:
    text = F.regexp_replace(value.cast("string"), r"[\r\n]+", " ")
    return F.coalesce(F.replace(text, F.lit("|"), F.lit("\\|")), F.lit("NULL"))


def abbreviate_compact(text: Column, limit: int) -> Column:
    """White space becomes one blank before the cut; null stays null."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) > limit, F.concat(F.left(flat, F.lit(limit)), F.lit("..."))).otherwise(flat)


def generated_name(name: Column, exists: Column, default: str = DEFAULT_NAME) -> Column:
    """The name of a generated file, ending in .html; a blank one is null for an existing file (its name stays), else the default."""
    flat = F.trim(name)
    named = F.when(F.lower(flat).endswith(".html"), flat).otherwise(F.concat(flat, F.lit(".html")))
    return F.when(F.coalesce(flat, F.lit("")) != "", named).when(~exists, F.lit(default))


def minute(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm")


def session_path(user: Column, session: Column, file: Column, extension: Column) -> Column:
    """The relative path of a session's file."""
    return F.concat(F.concat_ws("/", user.cast("string"), session.cast("string"), file.cast("string")), F.lit("."), extension)


def digits(value: Column) -> Column:
    """The number that all digits of an id make, up to 38 of them; null without a digit, so that it can be sorted last."""
    return F.regexp_replace(value, r"[^0-9]", "").try_cast("decimal(38,0)")
