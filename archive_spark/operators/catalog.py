"""Session and file catalogs: paging, filters, soft delete, upsert, anchoring, edits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

#: File kinds, and what may be uploaded.
SOURCE, GENERATED = 1, 2
UPLOADS, MAX_UPLOADS = ("docx", "xlsx", "pdf"), 5


def page(rows: DataFrame, key: str, order: list, number: int, size: int) -> DataFrame:
    """One page of each key's rows, with total, pages and has_more. Numbers below 1 count as 1."""
    w = Window.partitionBy(key)
    number = max(1, number)
    df = rows.withColumns({"rn": F.row_number().over(w.orderBy(*order)), "total": F.count(F.lit(1)).over(w)})
    df = df.withColumns({"pages": F.ceil(F.col("total") / size), "has_more": F.col("total") > number * size})
    return df.where(F.col("rn").between((number - 1) * size + 1, number * size))


def session_page(sessions: DataFrame, number: int = 1, size: int = 20, title: str = "") -> DataFrame:
    live = sessions.where("del_flag = 0")
    live = live.where(F.contains("title", F.lit(title.strip()))) if title.strip() else live
    return page(live, "user_id", [F.desc("updated_ord"), "id"], number, size).select("user_id", "id", "title", "rn", "total", "pages", "has_more")


def file_page(files: DataFrame, keyword: str = "", number: int = 1, size: int = 20) -> DataFrame:
    live = files.where("del_flag = 0")
    if keyword.strip():
        live = live.where(F.contains("file_name", F.lit(keyword)) | F.coalesce(F.contains("description", F.lit(keyword)), F.lit(False)))
    shown = tx.display_name(F.col("file_name"), F.col("kind") == GENERATED).alias("display_name")
    return page(live, "session_id", [F.desc("id")], number, size).select("session_id", "id", shown, tx.readable_size(F.col("file_size")).alias("size"), "rn", "total", "pages")


def delete_sessions(sessions: DataFrame, files: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """keys: user_id, session_id. Only a user's own sessions go, with their files."""
    hit = sessions.join(keys.select("user_id", F.col("session_id").alias("id")).distinct(), ["user_id", "id"], "left_semi").select(F.col("id").alias("hit_id"))
    s = sessions.join(hit, sessions.id == hit.hit_id, "left").withColumn("del_flag", F.when(F.col("hit_id").isNotNull(), 1).otherwise(F.col("del_flag"))).drop("hit_id")
    f = files.join(hit, files.session_id == hit.hit_id, "left").withColumn("del_flag", F.when(F.col("hit_id").isNotNull(), 1).otherwise(F.col("del_flag"))).drop("hit_id")
    return s, f


def upsert_generated(files: DataFrame, writes: DataFrame) -> DataFrame:
    """writes: ord, id (null: new), session_id, file_name, description, file_size. Blank names and descriptions keep the old
    ones. Of several writes of one id the last by ord is the one that counts; each write without an id is a new file.

    Rows: id, status (inserted, updated, rejected, unchanged), and the values that hold afterwards."""
    fields = F.struct("session_id", "file_name", "description", "file_size")
    last = writes.where("id is not null").groupBy("id").agg(F.max_by(fields, "ord").alias("w")).select("id", "w.*")
    once = last.unionByName(writes.where("id is null").select(*last.columns))
    w = once.select(F.col("id").alias("w_id"), F.col("session_id").alias("w_session"), F.col("file_name").alias("w_name"), F.col("description").alias("w_description"), F.col("file_size").alias("w_size"), F.lit(True).alias("written"))
    both = files.join(w, files.id == F.col("w_id"), "full_outer")
    ok = F.col("kind") == GENERATED
    status = F.when(F.col("written").isNull(), "unchanged").when(F.col("id").isNull(), "inserted").when(F.coalesce(ok, F.lit(False)), "updated").otherwise("rejected")
    filled = lambda new, old: F.when(F.trim(new) != "", F.trim(new)).otherwise(old)
    change = F.col("status").isin("updated", "inserted")
    df = both.withColumn("status", status)
    return df.select(F.coalesce("id", "w_id").alias("id"), F.coalesce("session_id", "w_session").alias("session_id"), F.when(change, filled(F.col("w_name"), F.col("file_name"))).otherwise(F.col("file_name")).alias("file_name"), F.when(change, filled(F.col("w_description"), F.col("description"))).otherwise(F.col("description")).alias("description"), F.when(change, F.col("w_size")).otherwise(F.col("file_size")).alias("file_size"), "status")


def anchor_files(files: DataFrame, turns: DataFrame, messages: DataFrame) -> DataFrame:
    """turns: file_id, before_id (the session's last message when the file's turn began), completed.

    Uploaded files hang on the first user message of their turn; generated ones on its last message, if the turn was completed.
    Files and messages are ranked together from the newest on, so that no file meets every message of its session."""
    user = F.when(F.col("message_type") == 2, F.col("id"))
    latest = Window.partitionBy("session_id").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    ends = messages.withColumn("user_id", F.last(user, True).over(latest)).groupBy("session_id", "user_id").agg(F.max("id").alias("last_id")).where("user_id is not null")
    live = files.where("del_flag = 0").join(turns, files.id == turns.file_id).select("session_id", files.id.alias("file_id"), "kind", "completed", F.col("before_id").alias("at"))
    both = live.unionByName(messages.where("message_type = 2").select("session_id", F.col("id").alias("at"), F.col("id").alias("user_id")), True)
    newer = Window.partitionBy("session_id").orderBy(F.desc("at"), F.col("user_id").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    placed = both.withColumn("user_id", F.last("user_id", True).over(newer)).where("file_id is not null and user_id is not null").join(ends, ["session_id", "user_id"])
    anchor = F.when(F.col("kind") != GENERATED, F.col("user_id")).when(F.col("completed"), F.col("last_id"))
    anchored = placed.withColumn("anchor_message_id", anchor).where("anchor_message_id is not null")
    return anchored.groupBy("session_id", "anchor_message_id").agg(F.count(F.lit(1)).alias("n_files"), F.array_join(F.transform(F.array_sort(F.collect_list("file_id")), lambda x: x.cast("string")), ",").alias("file_ids"))


def page_status(files: DataFrame, asked: DataFrame, size: int = 20) -> DataFrame:
    """asked: request_id, session_id, keyword, page. Whether the page has files, is past the end, or why there are none."""
    live = files.where("del_flag = 0").select("session_id", "file_name", "description")
    word = F.trim(F.coalesce("keyword", F.lit("")))
    hit = (word == "") | F.contains("file_name", word) | F.coalesce(F.contains("description", word), F.lit(False))
    n = asked.join(live, "session_id", "left").groupBy("request_id", "session_id", "keyword", "page").agg(F.count_if(F.col("file_name").isNotNull() & hit).alias("total"))
    pages, number = F.ceil(F.col("total") / size), F.greatest(F.coalesce("page", F.lit(1)), F.lit(1))
    status = F.when((F.col("total") == 0) & (word == ""), "no_files").when(F.col("total") == 0, "no_match").when(number > pages, "past_end").otherwise("ok")
    return n.select("request_id", "total", pages.alias("pages"), status.alias("status"))


def owned(sessions: DataFrame, asked: DataFrame) -> DataFrame:
    """asked: user_id, session_id. Those of live sessions that are the user's own."""
    live = sessions.where("del_flag = 0").select("user_id", F.col("id").alias("session_id"))
    return asked.select("user_id", "session_id").distinct().join(live, ["user_id", "session_id"], "left_semi")


def rename_sessions(sessions: DataFrame, asked: DataFrame) -> DataFrame:
    """asked: ord, user_id, session_id, title. A live session of the user's own takes the last title asked for; blank ones are ignored."""
    last = asked.where("trim(title) <> ''").groupBy("user_id", F.col("session_id").alias("id")).agg(F.max_by("title", "ord").alias("new_title"))
    hit = F.col("new_title").isNotNull() & (F.col("del_flag") == 0)
    return sessions.join(last, ["user_id", "id"], "left").select("id", F.when(hit, F.col("new_title")).otherwise(F.col("title")).alias("title"), F.coalesce(hit, F.lit(False)).alias("renamed"))


def validate_uploads(files: DataFrame, batch_col: str) -> DataFrame:
    n = F.count(F.lit(1)).over(Window.partitionBy(batch_col))
    ext = tx.extension(F.col("file_name"))
    return files.withColumns({"n": n, "ext": ext}).select(batch_col, "id", "ext", F.when(F.col("n") > MAX_UPLOADS, "too_many").when(~F.col("ext").isin(*UPLOADS), "bad_extension").otherwise("ok").alias("verdict"))


def unique_edits(texts: DataFrame, edits: DataFrame) -> DataFrame:
    """texts: id, text. edits: id, old, new. An edit applies only if its old text occurs exactly once."""
    hits = F.when(F.col("old") == "", 0).otherwise(((F.length("text") - F.length(F.replace("text", "old", F.lit("")))) / F.length("old")).cast("int"))
    df = texts.join(edits, "id").withColumn("hits", hits)
    status = F.when(F.col("hits") == 0, "not_found").when(F.col("hits") > 1, "ambiguous").otherwise("ok")
    return df.select("id", "hits", status.alias("status"), F.when(F.col("hits") == 1, F.replace("text", "old", "new")).otherwise(F.col("text")).alias("text"))
