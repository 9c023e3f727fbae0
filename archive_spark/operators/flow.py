"""Documents whose tables stand among their items: reading order, token-bounded parts, merged neighbours and full chunk rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from . import archive, chunking

#: Labels of items that are not content.
CHROME = ("PAGE_HEADER", "PAGE_FOOTER")


def reading_flow(items: DataFrame, tables: DataFrame) -> DataFrame:
    """items: file_id, pos, text, label, level, page_no, top. tables: file_id, table_id, text, page_no, top.

    Order by page, then from the top down; a table comes after the items of the same height, items keep their source order and
    tables the order of their ids. A missing page or height counts as 0. Items are squeezed to one line; page headers, page
    footers and blank texts go; a table keeps its lines."""
    text = F.trim(tx.squeeze(F.col("text")))
    place = [F.coalesce("page_no", F.lit(0)).alias("page_no"), F.coalesce("top", F.lit(0.0)).alias("top")]
    ref = F.concat(F.lit("#/texts/"), F.col("pos").cast("string"))
    a = items.where(~F.coalesce("label", F.lit("TEXT")).isin(*CHROME)).select("file_id", F.col("pos").cast("long").alias("src"), ref.alias("ref"), F.coalesce("label", F.lit("TEXT")).alias("label"), "level", *place, F.lit(False).alias("is_table"), text.alias("text"))
    ref = F.concat(F.lit("#/tables/"), F.col("table_id").cast("string"))
    b = tables.select("file_id", F.col("table_id").cast("long").alias("src"), ref.alias("ref"), F.lit("TABLE").alias("label"), F.lit(0).alias("level"), *place, F.lit(True).alias("is_table"), F.col("text"))
    both = a.unionByName(b).where(F.trim(tx.squeeze(F.col("text"))) != "")
    order = Window.partitionBy("file_id").orderBy("page_no", F.desc("top"), "is_table", "src")
    return both.withColumn("ord", F.row_number().over(order)).drop("src")


def pack_rows(text: Column, budget: Column) -> Column:
    """Parts of a pipe table: whole rows within the budget, each part with the first row before them.

    Blank rows go, a row over the budget by itself is a part, and a table without other rows has none. Tokens of a row are
    counted once, before the fold."""
    rows = F.split(text, r"\r?\n")
    head = F.get(rows, F.lit(0))
    first = tx.token_count(head)
    body = F.filter(F.slice(rows, 2, F.greatest(F.size(rows), F.lit(1))), lambda x: F.trim(tx.squeeze(x)) != "")
    counted = F.transform(body, lambda x: F.struct(x.alias("x"), tx.token_count(x).alias("n")))
    kind = "struct<out:array<string>,buf:string,n:int>"
    begin = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("buf"), first.alias("n")).cast(kind)

    def step(a: Column, r: Column) -> Column:
        line = F.concat(r["x"], F.lit("\n"))
        full = (a["n"] + r["n"] > budget) & (a["buf"] != "")
        closed = F.struct(F.concat(a["out"], F.array(a["buf"])).alias("out"), line.alias("buf"), (first + r["n"]).alias("n"))
        more = F.struct(a["out"].alias("out"), F.concat(a["buf"], line).alias("buf"), (a["n"] + r["n"]).alias("n"))
        return F.when(full, closed).otherwise(more).cast(kind)

    parts = F.aggregate(counted, begin, step, lambda a: F.when(a["buf"] != "", F.concat(a["out"], F.array(a["buf"]))).otherwise(a["out"]))
    return F.transform(parts, lambda x: F.concat(head, F.lit("\n"), x))


def split_flow(flow: DataFrame, max_tokens: int) -> DataFrame:
    """Items and tables over the budget become parts: pipe tables by rows, all else by sentences.

    Headings count, and are dropped where they leave no room."""
    df = flow.withColumns({"h": tx.token_count(F.array_join("headings", "\n")), "t": tx.token_count(F.col("text"))})
    drop = (F.col("h") + F.col("t") > max_tokens) & (F.col("h") >= max_tokens)
    df = df.withColumns({"headings": F.when(drop, F.array().cast("array<string>")).otherwise(F.col("headings")), "h": F.when(drop, 0).otherwise(F.col("h"))})
    room = F.lit(max_tokens) - F.col("h")
    by_rows = F.col("is_table") & tx.is_pipe_table(F.col("text"))
    parts = F.when(F.col("h") + F.col("t") <= max_tokens, F.array("text")).when(by_rows, pack_rows(F.col("text"), room)).otherwise(chunking.pack_sentences(tx.sentences(F.col("text")), room))
    return df.select("file_id", "ord", "ref", "page_no", "top", "is_table", "headings", "h", F.posexplode(parts).alias("part", "text"))


def merge_flow(parts: DataFrame, max_tokens: int) -> DataFrame:
    """Neighbours with equal headings merge while they fit.

    A chunk has the references and pages of its parts, each once, in order; it is a table if any part is, and stands where its first part stands. Only token counts go to Python."""
    w = Window.partitionBy("file_id").orderBy("ord", "part")
    before = F.lag("headings").over(w)
    runs = parts.withColumn("new", (before.isNull() | (before != F.col("headings"))).cast("int")).withColumn("run", F.sum("new").over(w))
    row = F.struct("ord", "part", "page_no", "top", "ref", "is_table", "text", tx.token_count(F.col("text")).alias("n"))
    rows = runs.groupBy("file_id", "run").agg(F.first("headings").alias("headings"), F.first("h").alias("h"), F.array_sort(F.collect_list(row)).alias("rows"))
    chunk = chunking._greedy(F.col("rows.n"), F.col("h"), F.lit(max_tokens))
    cut = rows.withColumn("chunk", chunk).select("file_id", "headings", "h", F.explode(F.sequence(F.lit(0), F.array_max("chunk"))).alias("c"), "rows", "chunk")
    own = F.filter("rows", lambda r, i: F.get("chunk", i) == F.col("c"))
    df = cut.select("file_id", "headings", "h", own.alias("own"))
    first = F.get("own", F.lit(0))
    return df.select("file_id", first["ord"].alias("ord"), first["part"].alias("part"), first["page_no"].alias("page_no"), first["top"].alias("top"), "headings", F.array_join("own.text", "\n").alias("text"),
                     F.array_distinct("own.ref").alias("refs"), F.array_distinct("own.page_no").alias("pages"), F.when(F.exists("own.is_table", lambda x: x), "table").otherwise("text").alias("block_type"),
                     (F.col("h") + F.aggregate("own.n", F.lit(0), lambda a, n: a + n)).alias("n_tokens"))


def document_chunks(items: DataFrame, tables: DataFrame, max_tokens: int = 512, merge: bool = True) -> DataFrame:
    """The chunks of each file, tables in their places: file_id, ord, part, page_no, top, headings, text, refs, pages, block_type, n_tokens."""
    parts = split_flow(archive.with_headings(reading_flow(items, tables)), max_tokens)
    if merge:
        return merge_flow(parts, max_tokens)
    kind = F.when(F.col("is_table"), "table").otherwise("text")
    return parts.select("file_id", "ord", "part", "page_no", "top", "headings", "text", F.array("ref").alias("refs"), F.array("page_no").alias("pages"), kind.alias("block_type"), (F.col("h") + tx.token_count(F.col("text"))).alias("n_tokens"))


def chunk_rows(chunks: DataFrame, identities: DataFrame, model: str) -> DataFrame:
    """Chunks as they are stored: id (`file-n`, from 1), neighbours' ids ('' at the ends), section, page range, block type, the file's identity and the model's tag.

    Files without an identity have no rows; archive.identity says why."""
    w = Window.partitionBy("file_id").orderBy("ord", "part")
    known = identities.where("error is null").select("file_id", "project_name", "volume_name", "item_name", "form_year")
    df = chunks.join(known, "file_id").withColumn("seq", F.row_number().over(w))
    df = df.withColumn("id", F.concat_ws("-", "file_id", F.col("seq").cast("string")))
    beside = {"prev_id": F.coalesce(F.lag("id").over(w), F.lit("")), "next_id": F.coalesce(F.lead("id").over(w), F.lit(""))}
    page = tx.page_range(F.get("pages", F.lit(0)), F.element_at("pages", -1))
    return df.withColumns(beside).select("id", "file_id", "seq", "text", tx.section_path(F.col("headings")).alias("section"), page.alias("page"), "refs", "block_type", "n_tokens", "prev_id", "next_id",
                                         "project_name", "volume_name", "item_name", "form_year", F.lit(model).alias("embedding_model"))
