"""Archive identity, chunk tables and reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

#: Status codes of a volume.
STATUS = {"1": "registered", "2": "processing", "3": "archived"}


def identity(files: DataFrame, sides: DataFrame, mains: DataFrame, projects: DataFrame) -> DataFrame:
    """Each file's project, volume, item and year: the archive id is looked up among items first, then among volumes.

    A dangling id or a missing volume gives a row with an error; a missing project gives an empty name."""
    s = sides.select(F.col("id").alias("side_id"), "main_id", F.col("title").alias("side_title"))
    m = mains.select(F.col("id").alias("m_id"), "project_id", F.col("title").alias("main_title"), "form_year")
    p = projects.select(F.col("id").alias("p_id"), "project_name")
    wanted = F.coalesce("main_id", "archive_id")
    found = files.join(s, F.col("archive_id") == F.col("side_id"), "left").withColumn("wanted", wanted).join(m, F.col("wanted") == F.col("m_id"), "left").join(p, F.col("project_id") == F.col("p_id"), "left")
    error = F.when(F.col("m_id").isNull() & F.col("side_id").isNotNull(), "volume not found").when(F.col("m_id").isNull(), "archive not found")
    item = F.when(F.col("side_id").isNotNull(), F.col("side_title")).otherwise(F.col("main_title"))
    volume = F.when(F.col("side_id").isNotNull(), F.col("main_title")).otherwise("")
    ok = F.col("m_id").isNotNull()
    return found.select(F.col("id").alias("file_id"), F.when(ok, F.coalesce("project_name", F.lit(""))).alias("project_name"), F.when(ok, volume).alias("volume_name"), F.when(ok, item).alias("item_name"), F.when(ok, F.col("form_year")).alias("form_year"), error.alias("error"))


def ingest_summary(identities: DataFrame) -> DataFrame:
    return identities.agg(F.count_if(F.col("error").isNull()).alias("success"), F.count_if(F.col("error").isNotNull()).alias("failed"))


def reading_order(items: DataFrame, drop_chrome: bool = True) -> DataFrame:
    """Page ascending, top descending, then source position; page headers and footers and blank items go."""
    kept = items.where(~F.col("label").isin("PAGE_HEADER", "PAGE_FOOTER")) if drop_chrome else items
    kept = kept.where(~tx.is_blank(F.col("text"))).withColumn("text", F.trim(tx.squeeze(F.col("text"))))
    return kept.withColumn("ord", F.row_number().over(Window.partitionBy("file_id").orderBy("page_no", F.desc("top"), "pos")))


def headings(items: DataFrame, levels: list[int] | None = None) -> DataFrame:
    """The active headings of each item, ascending by level: a heading of level k ends those of level k and more.

    Any level counts (null and less than 1 as 1). The levels that occur are read from the items, unless given."""
    if levels is None:  # those of blank headings too, which give nothing
        levels = heading_levels(items)
    return with_headings(reading_order(items), levels).select("file_id", "ord", "page_no", "text", "headings")


def _heading_level() -> Column:
    return F.when(F.col("label").isin("SECTION_HEADER", "TITLE"), F.greatest("level", F.lit(1)))


def heading_levels(items: DataFrame) -> list[int]:
    """The levels that occur, ascending."""
    return sorted(r["lv"] for r in items.select(_heading_level().alias("lv")).where("lv is not null").distinct().collect())


def with_headings(ordered: DataFrame, levels: list[int] | None = None) -> DataFrame:
    """Ordered items (file_id, ord, label, level, text and others) other than headings and titles, with their headings."""
    if levels is None:
        levels = heading_levels(ordered)
    w = Window.partitionBy("file_id").orderBy("ord")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    df = ordered.withColumn("lv", _heading_level())
    columns = {}
    for k in levels:
        columns[f"h{k}"] = F.last(F.when(F.col("lv") == k, F.struct("ord", "text")), True).over(before)
        columns[f"c{k}"] = F.max(F.when(F.col("lv") < k, F.col("ord"))).over(before)
    df = df.withColumns(columns)
    active = [F.when(F.col(f"h{k}.ord") > F.coalesce(f"c{k}", F.lit(0)), F.col(f"h{k}.text")) for k in levels]
    df = df.where("lv is null").withColumn("headings", F.filter(F.array(*active).cast("array<string>"), lambda x: x.isNotNull()))
    return df.drop("lv", *columns)


def chunk_chain(chunks: DataFrame) -> DataFrame:
    """Adds id (`file-n`, from 1), prev_id and next_id ('' at the ends), section and page."""
    w = Window.partitionBy("file_id").orderBy("ord")
    n = F.row_number().over(w)
    df = chunks.withColumn("n", n).withColumn("id", F.concat_ws("-", "file_id", F.col("n").cast("string")))
    df = df.withColumns({"prev_id": F.coalesce(F.lag("id").over(w), F.lit("")), "next_id": F.coalesce(F.lead("id").over(w), F.lit(""))})
    return df.select("id", "file_id", F.col("n").alias("seq"), "text", tx.section_path(F.col("headings")).alias("section"), F.col("page_no").cast("string").alias("page"), "prev_id", "next_id")


def review(chunks: DataFrame, limit: int = 200) -> DataFrame:
    """Every chunk for a reader: its place in its file by the digits of its id (ids without any come last), its size in bytes, and the beginning of its text on one line."""
    place = F.row_number().over(Window.partitionBy("file_id").orderBy(F.asc_nulls_last(tx.digits(F.col("id"))), "id"))
    return chunks.select("file_id", place.alias("place"), "id", "section", "page", F.octet_length("text").alias("bytes"), tx.abbreviate_compact(F.col("text"), limit).alias("text"))


def overview(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("file_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.min_by("section", "seq").alias("first_section"))


def neighbours(chunks: DataFrame, distance: int = 1) -> DataFrame:
    """Each chunk with the texts before and after it."""
    other = chunks.select("file_id", F.col("seq").alias("o_seq"), F.col("id").alias("neighbour_id"))
    steps = F.explode(F.array(*[F.lit(d) for d in range(-distance, distance + 1) if d]))
    return chunks.select("id", "file_id", "seq", steps.alias("step")).withColumn("o_seq", F.col("seq") + F.col("step")).join(other, ["file_id", "o_seq"]).select("id", "step", "neighbour_id")


def replace_by_file(old: DataFrame, new: DataFrame) -> DataFrame:
    """All rows of the files in `new` are replaced."""
    return old.join(new.select("file_id").distinct(), "file_id", "left_anti").unionByName(new)


def table_grids(cells: DataFrame, text: Callable[[Column], Column]) -> DataFrame:
    """table_id and text(rows) of each table, gathered once: its rows in order, each with its cells in column order; absent cells of the grid are empty.

    Of several texts in one cell the last by `pos` stays, or the greatest where cells have no such column. The text is made in
    the aggregate itself, so that no filter on it makes it again."""
    named = ("pos", F.when(F.col("pos").isNotNull(), F.col("text")).alias("text")) if "pos" in cells.columns else ("text",)
    flat = lambda x: F.when(F.contains(x, F.lit("\n")) | F.contains(x, F.lit("\r")), F.regexp_replace(x, r"[\r\n]+", " ")).otherwise(F.coalesce(x, F.lit("")))

    def grid(row: Column, width: Column) -> Column:
        last = F.filter(row, lambda x, i: ~x["col_idx"].eqNullSafe(F.get(row, i + 1)["col_idx"]))
        known = F.map_from_entries(F.transform(last, lambda x: F.struct(x["col_idx"], x["text"])))
        placed = tx.let(known, lambda m: F.transform(F.sequence(F.lit(0), width - 1), lambda c: F.element_at(m, c)))
        return F.struct(F.get(row, F.lit(0))["row_idx"].alias("row_idx"), F.transform(placed, flat).alias("cells"))

    every = F.struct(F.array_sort(F.collect_list(F.struct("row_idx", "col_idx", *named))).alias("c"), (F.max("col_idx") + 1).alias("width"))
    rows = lambda t: F.transform(tx.in_runs(t["c"], lambda x: x["row_idx"]), lambda row: grid(row, t["width"]))
    return cells.groupBy("table_id").agg(tx.let(every, lambda t: tx.let(rows(t), text)).alias("text"))


def table_markdown(cells: DataFrame) -> DataFrame:
    line = lambda r: F.concat(F.lit("|"), F.array_join(r["cells"], "|"), F.lit("|"))
    return table_grids(cells, lambda rows: F.array_join(F.transform(rows, line), "\n"))


def table_triplets(cells: DataFrame) -> DataFrame:
    """`row, column = value` for each filled value cell, joined by `. `; `column = value` in tables of one column.

    A table without any such triplet lists its filled cells. Row 0 has the column names, column 0 the row names."""

    def triplets(head: Column, row: Column) -> Column:
        def triplet(value: Column, i: Column) -> Column:
            own = F.concat(F.coalesce(F.get(head, F.lit(0)), F.lit("")), F.lit(" = "), value)
            many = F.concat(F.get(row["cells"], F.lit(0)), F.lit(", "), F.coalesce(F.get(head, i), F.lit("")), F.lit(" = "), value)
            return F.when(value == "", None).when(F.size(row["cells"]) == 1, own).when(i > 0, many)

        return F.filter(F.transform(row["cells"], triplet), lambda x: x.isNotNull())

    def text(rows: Column) -> Column:
        head = F.get(F.filter(rows, lambda r: r["row_idx"] == 0), F.lit(0))["cells"]
        found = tx.let(head, lambda h: F.flatten(F.transform(F.filter(rows, lambda r: r["row_idx"] > 0), lambda r: triplets(h, r))))
        filled = F.flatten(F.transform(rows, lambda r: F.filter(r["cells"], lambda x: x != "")))
        return F.array_join(tx.let(found, lambda t: F.when(F.size(t) > 0, t).otherwise(filled)), ". ")

    trimmed = lambda r: F.struct(r["row_idx"].alias("row_idx"), F.transform(r["cells"], lambda x: F.trim(x)).alias("cells"))
    return table_grids(cells, lambda rows: tx.let(F.transform(rows, trimmed), text))


def by_status(mains: DataFrame) -> DataFrame:
    labels = F.create_map(*[F.lit(x) for pair in STATUS.items() for x in pair])
    return mains.where("del_flag = '0'").groupBy(labels[F.col("status")].alias("status")).agg(F.count(F.lit(1)).alias("volumes"))


def by_year_category(mains: DataFrame) -> DataFrame:
    return mains.where("del_flag = '0'").rollup("form_year", "category_id").agg(F.count(F.lit(1)).alias("volumes"))


def year_status_cube(mains: DataFrame) -> DataFrame:
    """Live volumes by year and status, by each alone, and all; `level` is 0, 1 (year), 2 (status) or 3."""
    labels = F.create_map(*[F.lit(x) for pair in STATUS.items() for x in pair])
    rows = mains.where("del_flag = '0'").select("form_year", labels[F.col("status")].alias("status"))
    return rows.cube("form_year", "status").agg(F.grouping_id().cast("int").alias("level"), F.count(F.lit(1)).alias("volumes"))


def year_status_pivot(mains: DataFrame) -> DataFrame:
    """A row for each year, a column for each status."""
    rows = mains.where("del_flag = '0'").groupBy("form_year").pivot("status", list(STATUS)).count()
    return rows.select("form_year", *[F.coalesce(code, F.lit(0)).alias(label) for code, label in STATUS.items()])


def project_items(projects: DataFrame, mains: DataFrame, sides: DataFrame) -> DataFrame:
    """The live items of each live project, by way of its volumes."""
    live = [t.where("del_flag = '0'") for t in (projects, mains, sides)]
    p = live[0].select(F.col("id").alias("project_id"), "project_name")
    m = live[1].select(F.col("id").alias("main_id"), "project_id", F.col("title").alias("volume_name"))
    return live[2].select(F.col("id").alias("item_id"), "main_id", "title", "sequence_no").join(m, "main_id").join(p, "project_id")


def project_report(projects: DataFrame, mains: DataFrame, sides: DataFrame) -> DataFrame:
    """Live volumes and items of each live project, 0 included; items are counted by volume before they are joined."""
    items = sides.where("del_flag = '0'").groupBy("main_id").agg(F.count(F.lit(1)).alias("n"))
    volumes = mains.where("del_flag = '0'").select(F.col("id").alias("main_id"), "project_id").join(items, "main_id", "left")
    counts = volumes.groupBy("project_id").agg(F.count(F.lit(1)).alias("volumes"), F.sum("n").alias("items"))
    named = projects.where("del_flag = '0'").select(F.col("id").alias("project_id"), "project_name").join(counts, "project_id", "left")
    return named.select("project_id", "project_name", F.coalesce("volumes", F.lit(0)).alias("volumes"), F.coalesce("items", F.lit(0)).alias("items"))


def volume_items(mains: DataFrame, sides: DataFrame) -> DataFrame:
    live = sides.where("del_flag = '0'").groupBy("main_id").agg(F.count(F.lit(1)).alias("n_items"), F.max("sequence_no").alias("last_no"))
    return mains.where("del_flag = '0'").join(live, mains.id == live.main_id, "left").select(mains.id.alias("main_id"), "title", F.coalesce("n_items", F.lit(0)).alias("n_items"), "last_no")
