"""Governed SQL: audit of a statement log, guarded runs, rendered results, the data dictionary, tool-error triage."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx

#: Words that write.
WRITE = "insert|update|delete|drop|create|alter|truncate|replace|grant|revoke|call|set|handler|lock|unlock|load|outfile|dumpfile|load_file|into"
#: Exception types and parts of lower-cased messages that no retry mends, and those that one may.
FATAL_TYPES = ("IllegalArgumentException", "NoSuchFileException", "FileNotFoundException", "AccessDeniedException", "ConnectException")
FATAL = ("connection refused", "http 400", "http 401", "http 403", "http 404", "http 405", "http 422", "invalid api key", "invalid_api_key", "unauthorized", "authentication", "sqlsyntaxerrorexception", "you have an error in your sql syntax", "unknown column", "unknown table", "doesn't exist", "does not exist")
TRANSIENT_TYPES = ("SocketTimeoutException", "HttpTimeoutException", "TimeoutException", "SQLTimeoutException", "SQLTransientException", "EOFException")
TRANSIENT = ("connection reset", "broken pipe", "unexpected end of stream", "premature end", "connection abort", "connect timed out", "timed out", "timeout", "http 500", "http 502", "http 503", "http 504", "http 429", "unavailable_shards_exception", "cluster_block_exception", "nonodeavailable", "node not connected", "connect_exception", "deadlock found", "lock wait timeout", "communications link failure", "could not get jdbc connection", "connection is not available")
#: What users are told, by parts of the messages.
SLOW, NETWORK, INTERNAL = ("timeout", "Timeout", "超时"), ("Connection reset", "SocketException", "Broken pipe", "connect timed out", "Connection refused"), ("NoClassDefFoundError", "ClassNotFoundException")
TOLD = {"slow": "当前服务响应较慢，请稍后重试", "network": "网络出现波动，请稍后重试", "internal": "服务内部出现异常，请稍后重试", "other": "服务暂时开小差，请稍后重试"}

#: Words after which a table stands, and words that end a list of tables.
BEFORE_TABLE, AFTER_TABLES = ("from", "join"), ("select", "where", "group", "order", "having", "limit", "union", "except", "intersect", "window", "values", "with")

#: Comments and quoted parts in the order in which they begin; an open one reaches to the end.
_COMMENTS = [r"(?s)--[^\n]*", r"#[^\n]*", r"/\*.*?(?:\*/|\z)"]
_QUOTED = [r"'[^'\\]*+(?:(?:\\(?:.|\z)|'')[^'\\]*+)*+(?:'|\z)", r'"[^"\\]*+(?:\\(?:.|\z)[^"\\]*+)*+(?:"|\z)']
_NAMED = r"`[^`\\]*+(?:\\(?:.|\z)[^`\\]*+)*+(?:`|\z)"
_HIDDEN = "|".join([*_COMMENTS, *_QUOTED, _NAMED])
#: The same, with names in backticks as a group of their own, to be kept.
_SHOWN = "|".join([*_COMMENTS, *_QUOTED, f"({_NAMED})"])


def stripped(sql: Column) -> Column:
    """Comments, literals and quoted names become blanks, in one pass from left to right."""
    return F.regexp_replace(F.coalesce(sql, F.lit("")), _HIDDEN, " ")


def referenced(sql: Column) -> Column:
    """The tables of a statement in the order in which they are named, as `name` or `database.name`: what follows FROM or JOIN,
    and what follows a comma in the same list, at any depth of parentheses. Plain names may stand in backticks; others keep
    theirs, so that no list of tables has them.

    One fold over the words: a letter for each open parenthesis says whether a table is due there (t), was named (l), or
    neither (n)."""
    kept = F.regexp_replace(F.coalesce(sql, F.lit("")), _SHOWN, " $1 ")
    words = F.transform(F.regexp_extract_all(F.lower(kept), F.lit(r"`[^`]*`?|[\w$]+|[().,]"), F.lit(0)), lambda w: F.regexp_replace(w, r"\A`(\w+)`\z", "$1"))
    start = F.struct(F.lit("n").alias("open"), F.lit(0).alias("near"), F.lit("").alias("refs"))

    def step(s: Column, x: Column) -> Column:
        top, below = F.right(s["open"], F.lit(1)), F.substring(s["open"], F.lit(1), F.length(s["open"]) - 1)
        word = x.rlike(r"[\w$`]")
        name = word & (top == "t") & ~x.isin(*BEFORE_TABLE, *AFTER_TABLES, "lateral")
        more = word & s["near"].isin(2, 4)  # the second and third part of a name
        closed = F.when(F.length(below) == 0, "n").when(F.right(below, F.lit(1)) == "t", F.concat(F.substring(below, F.lit(1), F.length(below) - 1), F.lit("l"))).otherwise(below)
        opened = (
            F.when(more, s["open"]).when(x == "(", F.concat(s["open"], F.when(top == "t", "t").otherwise("n"))).when(x == ")", closed).when((x == ",") & (top == "l"), F.concat(below, F.lit("t")))
            .when(x.isin(*BEFORE_TABLE), F.concat(below, F.lit("t"))).when(x.isin(*AFTER_TABLES), F.concat(below, F.lit("n"))).when(name, F.concat(below, F.lit("l"))).otherwise(s["open"])
        )
        near = F.when(name & ~more, 1).when(more | (x == ".") & s["near"].isin(1, 3), s["near"] + 1).otherwise(0)
        refs = F.when(more, F.concat(s["refs"], F.lit("."), x)).when(name, F.concat(s["refs"], F.lit("\n"), x)).otherwise(s["refs"])
        return F.struct(opened.alias("open"), near.alias("near"), refs.alias("refs"))

    return F.filter(F.split(F.aggregate(words, start, step)["refs"], "\n"), lambda r: r != "")


def _lower(found: Column) -> Column:
    return F.transform(found, lambda x: F.lower(x))


def audit(log: DataFrame, allowed: list[str], database: str = "") -> DataFrame:
    """log: stmt_id, sql. The first rule that a statement breaks is its verdict; of its tables, the first bad one decides.

    Tables of `database` may be named with it. Null and blank statements are empty, those of comments alone no query; the
    tables (refs) of statements that are no query are not read."""
    query = F.col("s").rlike(r"(?i)^[\s(]*(?:select|with)")
    named = F.regexp_extract_all("s", F.lit(r"(?i)(\w+)\s*(?:\([^()]*\)\s*)?as\s*\("), F.lit(1))
    df = log.select("stmt_id", "sql", stripped(F.col("sql")).alias("s"))
    df = df.withColumns({"refs": F.when(query, referenced(F.col("sql"))).otherwise(F.array().cast("array<string>")), "ctes": F.when(F.col("s").rlike(r"(?i)^[\s(]*with"), _lower(named)).otherwise(F.array().cast("array<string>"))})
    known = F.array(*[F.lit(a.lower()) for a in allowed]).cast("array<string>")

    def judge(ref: Column) -> Column:
        parts = F.split(ref, r"\.(?![^`]*`\z)")
        alone, table = F.size(parts) == 1, F.element_at(parts, -1)
        home = alone | ((F.size(parts) == 2) & (F.get(parts, F.lit(0)) == database.lower()))
        return F.when(~home, "cross_database").when(~(alone & F.array_contains("ctes", table)) & ~F.array_contains(known, table), "unknown_table")

    bad = F.get(F.filter(F.transform("refs", judge), lambda x: x.isNotNull()), F.lit(0))
    verdict = (
        F.when(F.coalesce("sql", F.lit("")).rlike(r"\A\s*\z"), "empty").when(~query, "not_select").when(F.col("s").rlike(rf"(?i)\b(?:{WRITE})\b"), "write_keyword")
        .when(F.regexp_replace("s", r";\s*\z", "").contains(";"), "stacked").when(bad.isNotNull(), bad).when(F.size("refs") == 0, "no_table").otherwise("ok")
    )
    return df.select("stmt_id", verdict.alias("verdict"), F.array_join("refs", ",").alias("refs"))


def _render(rows: DataFrame, key: list[Column], cap: int) -> DataFrame:
    names = rows.columns
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[tx.markdown_cell(rows[c]) for c in names]), F.lit(" |\n"))
    parts = F.array_sort(F.collect_list(F.struct("k", "line")))
    head = "| " + " | ".join(names) + " |\n|" + " --- |" * len(names) + "\n"
    n, cut = F.least(F.size("parts"), F.lit(cap)), F.size("parts") > cap
    body = F.array_join(F.transform(F.slice("parts", 1, cap), lambda x: x["line"]), "")
    note = F.when(cut, f"（已截断，最多返回 {cap} 行，请加 WHERE/LIMIT 缩小范围）").otherwise("")
    text = F.concat(F.lit(head), body, F.lit("\n共 "), n.cast("string"), F.lit(" 行"), note)
    return rows.select(F.struct(*key).alias("k"), line.alias("line")).agg(parts.alias("parts")).select(text.alias("markdown"), n.alias("n_rows"), cut.alias("truncated"))


def markdown(rows: DataFrame, order: list[str], cap: int = 100) -> DataFrame:
    """The first `cap` rows as one Markdown text that says how many there are; one row more is read to know whether it was cut."""
    cut = rows.orderBy(*order).limit(cap + 1)
    return _render(cut, [cut[c] for c in order], cap)


def run(spark: SparkSession, sql: str, views: dict[str, DataFrame], database: str = "", cap: int = 100) -> DataFrame:
    """Runs one statement over the named views alone and renders its rows in their order; a statement that breaks a rule raises.

    What Spark's parser reads is held against the views as well, so nothing else can be read however it is written. The views
    are the session's only until the statement is analysed."""
    verdict = audit(spark.createDataFrame([(0, sql)], "stmt_id int, sql string"), list(views), database).first()
    tables_of_it = f"tables: {', '.join(sorted(views))}"
    if verdict["verdict"] != "ok":
        raise ValueError(f"{verdict['verdict']}: {verdict['refs'] or sql}; {tables_of_it}")
    known = {v.lower() for v in views}
    if other := [r for r in _relations(spark, sql) if r.lower() not in known]:
        raise ValueError(f"unknown_table: {', '.join(other)}; {tables_of_it}")
    before = {name: spark.table(name) for name in views if spark.catalog.tableExists(name)}
    try:
        for name, df in views.items():
            df.createOrReplaceTempView(name)
        rows = spark.sql(sql)
    finally:
        for name in views:
            before[name].createOrReplaceTempView(name) if name in before else spark.catalog.dropTempView(name)
    return _render(rows.limit(cap + 1), [F.monotonically_increasing_id().alias("n")], cap)


def _relations(spark: SparkSession, sql: str) -> list[str]:
    """What a statement reads by name or function, without its own common table expressions."""
    text = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql.strip().rstrip(";")).treeString()
    own = {n.lower() for names in re.findall(r"(?m)CTE \[([^\]]*)\]", text) for n in names.split(", ")}
    found = re.findall(r"Unresolved(?:Relation|TableValuedFunction|InlineTable|TVFAliases) \[([^\]]*)\]", text)
    return [".".join(f.split(", ")) for f in found if f.lower() not in own]


def tables(spark: SparkSession, prefix: str = "ek_") -> list[str]:
    """The allow-list: views and tables whose name starts with the prefix, as they are now."""
    return sorted(t.name.lower() for t in spark.catalog.listTables() if t.name.lower().startswith(prefix))


def describe(asked: DataFrame, dictionary: DataFrame, known: list[str]) -> DataFrame:
    """asked: request_id, name. dictionary: name, text, a row for each table. The text of each asked table, or why there is none."""
    name = F.regexp_replace(F.lower(F.trim("name")), r"\.md\z", "")
    df = asked.select("request_id", F.coalesce(name, F.lit("")).alias("name"))
    df = df.join(dictionary.select("name", "text"), "name", "left")
    status = (
        F.when(F.col("name") == "", "no_name").when(F.col("name").rlike(r"\.\.|[/\\]"), "illegal_name").when(~F.col("name").isin(*[k.lower() for k in known]), "unknown_table")
        .when(F.col("text").isNull(), "no_text").otherwise("ok")
    )
    return df.select("request_id", "name", status.alias("status"), F.when(status == "ok", F.col("text")).alias("text"))


def _any(text: Column, parts: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for p in parts:
        found = found | F.contains(text, F.lit(p))
    return F.bool_or(found)


def triage(causes: DataFrame) -> DataFrame:
    """causes: call_id, attempt, depth (0 outermost), error_type (class name), sql_state, message; a row for each link of a chain.

    One fatal cause makes a call fatal; else one transient cause makes it transient. Nulls say nothing."""
    message, kind = F.coalesce("message", F.lit("")), F.coalesce("error_type", F.lit(""))
    low = F.lower(message)
    fatal = F.bool_or(kind.isin(*FATAL_TYPES)) | _any(low, FATAL)
    transient = F.bool_or(kind.isin(*TRANSIENT_TYPES)) | F.bool_or(F.coalesce(F.col("sql_state").startswith("08"), F.lit(False))) | _any(low, TRANSIENT)
    told = F.when(_any(message, SLOW), TOLD["slow"]).when(_any(message, NETWORK), TOLD["network"]).when(_any(message, INTERNAL), TOLD["internal"]).otherwise(TOLD["other"])
    calls = causes.groupBy("call_id", "attempt").agg(F.when(fatal, "fatal").when(transient, "transient").otherwise("unknown").alias("kind"), F.max_by("message", "depth").alias("root_cause"), told.alias("told"))
    base = F.least(200 * F.pow(F.lit(2), F.col("attempt") - 1), F.lit(1000)).cast("int")
    return calls.select("call_id", "attempt", "kind", "root_cause", "told", base.alias("backoff_ms"), (base / 2).cast("int").alias("backoff_min"), (base * 1.5).cast("int").alias("backoff_max"))
