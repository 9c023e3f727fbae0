"""Token-bounded chunks: folds over one item's sentences and one run of equal headings."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from ..functions import text as tx

#: A token with the blanks before it, to cut a long sentence without losing text.
_PIECE = rf"\s*+(?:{tx.TOKEN})"


#: A part of an item with its tokens.
_PART = "struct<text:string,n:int>"


def _part(text: Column, n: Column) -> Column:
    return F.struct(text.alias("text"), n.alias("n")).cast(_PART)


def _hard_cuts(sentence: Column, budget: Column) -> Column:
    """The pieces are found once, however many cuts there are, in time linear in the sentence."""

    def cuts(pieces: Column) -> Column:
        size = F.size(pieces)

        def cut(i: Column) -> Column:
            end = F.least((i + 1) * budget, size)
            own = F.transform(F.sequence(i * budget, end - 1), lambda k: F.get(pieces, k))
            return _part(F.array_join(own, ""), end - i * budget)

        return F.transform(F.sequence(F.lit(0), F.ceil(size / budget).cast("int") - 1), cut)

    return tx.let(F.regexp_extract_all(sentence, F.lit(_PIECE), 0), cuts)


def pack_counted(sentences: Column, budget: Column) -> Column:
    """Greedy packing joined by newlines, with tokens; a sentence over the budget is cut by tokens. Each sentence is counted once, before the fold."""
    kind = f"struct<out:array<{_PART}>,buf:string,n:int>"
    begin = F.struct(F.array().cast(f"array<{_PART}>").alias("out"), F.lit("").alias("buf"), F.lit(0).alias("n")).cast(kind)
    counted = F.transform(sentences, lambda x: F.struct(x.alias("x"), tx.token_count(x).alias("n")))

    def flush(a: Column) -> Column:
        return F.when(a["n"] > 0, F.concat(a["out"], F.array(_part(a["buf"], a["n"])))).otherwise(a["out"])

    def step(a: Column, s: Column) -> Column:
        x, c = s["x"], s["n"]
        cut = F.struct(F.concat(flush(a), _hard_cuts(x, budget)).alias("out"), F.lit("").alias("buf"), F.lit(0).alias("n"))
        more = F.struct(a["out"].alias("out"), F.when(a["n"] > 0, F.concat_ws("\n", a["buf"], x)).otherwise(x).alias("buf"), (a["n"] + c).alias("n"))
        fresh = F.struct(flush(a).alias("out"), x.alias("buf"), c.alias("n"))
        return F.when(c > budget, cut).when(a["n"] + c <= budget, more).otherwise(fresh).cast(kind)

    return F.aggregate(counted, begin, step, flush)


def pack_sentences(sentences: Column, budget: Column) -> Column:
    return F.transform(pack_counted(sentences, budget), lambda p: p["text"])


def _counted_parts(items: DataFrame, max_tokens: int, extra_terminators: str = "") -> DataFrame:
    """The parts of split_items with their tokens."""
    df = items.withColumns({"h": tx.token_count(F.array_join("headings", "\n")), "t": tx.token_count(F.col("text"))})
    drop = (F.col("h") + F.col("t") > max_tokens) & (F.col("h") >= max_tokens)
    df = df.withColumns({"headings": F.when(drop, F.array().cast("array<string>")).otherwise(F.col("headings")), "h": F.when(drop, 0).otherwise(F.col("h"))})
    packed = pack_counted(tx.sentences(F.col("text"), extra_terminators), F.lit(max_tokens) - F.col("h"))
    parts = F.when(F.col("h") + F.col("t") <= max_tokens, F.array(_part(F.col("text"), F.col("t")))).otherwise(packed)
    return df.select("file_id", "ord", "page_no", "headings", "h", F.posexplode(parts).alias("part", "p")).select("file_id", "ord", "page_no", "headings", "h", "part", F.col("p.text").alias("text"), F.col("p.n").alias("n"))


def split_items(items: DataFrame, max_tokens: int, extra_terminators: str = "") -> DataFrame:
    """Items over the budget become parts; headings count, and are dropped where they leave no room."""
    return _counted_parts(items, max_tokens, extra_terminators).drop("n")


def merge_peers(parts: DataFrame, max_tokens: int) -> DataFrame:
    """Neighbours with equal headings merge while they fit; one fold for each run of equal headings. parts: with their tokens n, or these are counted."""
    if "n" not in parts.columns:
        parts = parts.withColumn("n", tx.token_count(F.col("text")))
    w = Window.partitionBy("file_id").orderBy("ord", "part")
    before = F.lag("headings").over(w)
    runs = parts.withColumn("new", (before.isNull() | (before != F.col("headings"))).cast("int")).withColumn("run", F.sum("new").over(w))
    rows = runs.groupBy("file_id", "run").agg(F.first("headings").alias("headings"), F.first("h").alias("h"), F.array_sort(F.collect_list(F.struct("ord", "part", "page_no", "text", "n"))).alias("rows"))
    chunk = "struct<ord:int,page_no:int,last_page:int,text:string,n:int>"
    kind = f"struct<out:array<{chunk}>,cur:{chunk}>"
    begin = F.struct(F.array().cast(f"array<{chunk}>").alias("out"), F.lit(None).cast(chunk).alias("cur")).cast(kind)

    def step(a: Column, x: Column) -> Column:
        c = x["n"]
        one = F.struct(x["ord"].alias("ord"), x["page_no"].alias("page_no"), x["page_no"].alias("last_page"), x["text"].alias("text"), c.alias("n")).cast(chunk)
        cur = a["cur"]
        both = F.struct(cur["ord"].alias("ord"), cur["page_no"].alias("page_no"), x["page_no"].alias("last_page"), F.concat_ws("\n", cur["text"], x["text"]).alias("text"), (cur["n"] + c).alias("n")).cast(chunk)
        first = F.struct(a["out"].alias("out"), one.alias("cur"))
        merged = F.struct(a["out"].alias("out"), both.alias("cur"))
        after = F.struct(F.concat(a["out"], F.array(cur)).alias("out"), one.alias("cur"))
        return F.when(cur.isNull(), first).when(F.col("h") + cur["n"] + c <= max_tokens, merged).otherwise(after).cast(kind)

    done = F.aggregate("rows", begin, step, lambda a: F.concat(a["out"], F.array(a["cur"])))
    return rows.select("file_id", "headings", "h", F.explode(done).alias("c")).select("file_id", F.col("c.ord").alias("ord"), F.col("c.page_no").alias("page_no"), F.col("c.last_page").alias("last_page"), "headings", "h", F.col("c.text").alias("text"), F.col("c.n").alias("n_tokens"))


def semantic_chunks(items: DataFrame, max_tokens: int = 512, merge: bool = True) -> DataFrame:
    parts = _counted_parts(items, max_tokens)
    if merge:
        return merge_peers(parts, max_tokens)
    return parts.withColumnRenamed("n", "n_tokens").withColumn("last_page", F.col("page_no"))


@F.pandas_udf(ArrayType(IntegerType()))
def _greedy(counts: pd.Series, start: pd.Series, budget: pd.Series) -> pd.Series:
    """The part that each line falls into: a part begins with `start` tokens and takes lines while they fit, one at least."""
    out = []
    for lines, first, limit in zip(counts, start, budget):
        part, used, parts = 0, first, []
        for n in [] if lines is None else lines:
            if used + n > limit and used > first:
                part, used = part + 1, first
            used += n
            parts.append(part)
        out.append(parts)
    return pd.Series(out)


def split_tables(tables: DataFrame, max_tokens: int) -> DataFrame:
    """tables: table_id, text (pipe rows). Parts of whole rows within the budget, each with the first row before it.

    Blank rows go; a row that is over the budget by itself is a part; a table of one row has none. Only token counts go to Python."""
    rows = F.split("text", r"\r?\n")
    body = F.filter(F.slice(rows, 2, F.greatest(F.size(rows), F.lit(1))), lambda x: F.trim(tx.squeeze(x)) != "")
    df = tables.select("table_id", F.get(rows, F.lit(0)).alias("head"), body.alias("body"))
    part = _greedy(F.transform("body", lambda x: tx.token_count(x)), tx.token_count(F.col("head")), F.lit(max_tokens))
    parts = tx.in_runs(F.arrays_zip(part.alias("part"), "body"), lambda x: x["part"])
    cut = df.select("table_id", "head", F.explode_outer(parts).alias("p")).where("p is not null")  # outer, else parts are made twice
    text = F.array_join(F.transform("p.body", lambda x: F.concat(x, F.lit("\n"))), "")
    return cut.select("table_id", F.get("p.part", F.lit(0)).alias("part"), F.concat("head", F.lit("\n"), text).alias("text"))
