"""Governed SQL on statements and errors written by hand."""

import pytest

from archive_spark.operators import governed

STATEMENTS = [
    (None, "empty"), (" \n", "empty"), ("-- only", "not_select"), ("SHOW TABLES", "not_select"), ("UPDATE ek_a SET x = 1", "not_select"),
    ("SELECT id, title FROM ek_a ORDER BY id LIMIT 3", "ok"), ("select id from EK_A;", "ok"), ("(SELECT id FROM ek_a)", "ok"), ("select 1", "no_table"),
    ("SELECT '--' AS x FROM ek_a", "ok"), ("SELECT '/*' FROM ek_a; DELETE FROM ek_a; SELECT '*/' FROM ek_a", "write_keyword"),
    ("SELECT 'it''s; delete' FROM ek_a", "ok"), (r"SELECT 'a\'; delete' FROM ek_a", "ok"), ('SELECT "delete" FROM ek_a', "ok"), ("SELECT `drop` FROM ek_a", "ok"),
    ("SELECT id FROM ek_a # delete", "ok"), ("SELECT id FROM ek_a /* delete", "ok"), ("SELECT id FROM ek_a WHERE x = 'open; delete", "ok"), ("SELECT 'x\\", "no_table"),
    ("SELECT id FROM ek_a; SELECT id FROM ek_a", "stacked"), ("SELECT * FROM ek_a INTO OUTFILE 'x'", "write_keyword"), ("SELECT load_file('x') FROM ek_a", "write_keyword"), ("SELECT created, reset FROM ek_a", "ok"),
    ("SELECT * FROM information_schema.tables LIMIT 1", "cross_database"), ("SELECT * FROM ek.ek_a", "ok"), ("SELECT * FROM ek . nothing", "unknown_table"), ("SELECT * FROM ek_no LIMIT 1", "unknown_table"),
    ("SELECT * FROM ek_no JOIN mysql.user", "unknown_table"), ("SELECT * FROM mysql.user JOIN ek_no", "cross_database"), ("SELECT t.x FROM ek_a m JOIN ek_b t ON 1 = 1", "ok"), ("SELECT x FROM (SELECT x FROM ek_no) y", "unknown_table"),
    ("WITH m AS (SELECT id FROM ek_a), n AS (SELECT id FROM m) SELECT * FROM n JOIN m ON 1 = 1", "ok"), ("WITH RECURSIVE t AS (SELECT id FROM ek_a) SELECT * FROM t", "ok"), ("SELECT cast(x AS (y)) FROM x", "unknown_table"),
    ("SELECT valid_from FROM ek_a", "ok"),
    ("select 1 from ek_a, ek_b", "ok"), ("select 1 from ek_a, secret", "unknown_table"), ("select 1 from ek_a a, mysql.user u", "cross_database"), ("select 1 from ek_a as a , (select 1 from ek_b, secret) b", "unknown_table"),
    ("select 1 from ek_a, parquet.`/root/a,b.parquet`", "cross_database"), ("select 1 from `ek_a` x, `EK`.`ek_b`", "ok"), ("select 1 from `secret`", "unknown_table"), ("select 1 from ek_a a join ek_b b on a.x = b.x, secret", "unknown_table"),
    ("select a, b from ek_a group by a, secret order by b, secret", "ok"), ("select f(a, b), c from (ek_a, secret)", "unknown_table"), ("select 1 from ek_a where x in (1, 2) and y in (select z from ek_b), secret", "ok"), ("select 1 from (select 1 from ek_a) t, secret", "unknown_table"),
    ("select 1 from ek.ek_a.secret", "cross_database"), ("select 1 from ek_a -- `\n, secret", "unknown_table"), ("select 1 from ek_a union select 1 from ek_b, ek_no", "unknown_table"), ("with t (a, b) as (select 1, 2 from ek_a) select * from t, ek_b", "ok"),
]
CHAINS = [
    ([("RuntimeException", None, "wrapper"), ("ConnectException", None, "Connection refused")], "fatal"), ([("X", None, "Table 't' doesn't exist")], "fatal"), ([("X", None, "Unknown column 'a'")], "fatal"), ([("X", None, "HTTP 404 Not Found")], "fatal"),
    ([("X", None, "HTTP 503")], "transient"), ([("X", None, "Deadlock found when trying to get lock")], "transient"), ([("SQLException", "08S01", "gone")], "transient"), ([("SocketTimeoutException", None, None)], "transient"),
    ([("SocketTimeoutException", None, "timeout"), ("IllegalArgumentException", None, "bad")], "fatal"), ([("X", None, "odd")], "unknown"), ([(None, None, None)], "unknown"),
]


def test_audit(spark):
    log = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(STATEMENTS)], "stmt_id int, sql string")
    got = {r["stmt_id"]: r["verdict"] for r in governed.audit(log, ["ek_a", "EK_b"], "EK").collect()}
    assert [(s, got[i]) for i, (s, _) in enumerate(STATEMENTS)] == STATEMENTS


def test_long_statements(spark):
    log = spark.createDataFrame([(1, "select '" + "a\\'''" * 300_000 + "' from ek_a"), (2, "select '" + "x" * 3_000_000), (3, "/*" + "*" * 3_000_000 + "*/ select 1 from ek_a")], "stmt_id int, sql string")
    assert {r["stmt_id"]: r["verdict"] for r in governed.audit(log, ["ek_a"]).collect()} == {1: "ok", 2: "no_table", 3: "ok"}


def test_run(spark):
    views = {"ek_a": spark.range(5).selectExpr("id", "case when id = 1 then null else 'a|b' || char(10) || 'c' end t")}
    got = governed.run(spark, "select id, t from ek_a order by id desc", views, cap=4).first()
    assert (got["n_rows"], got["truncated"]) == (4, True)
    assert got["markdown"].startswith("| id | t |\n| --- | --- |\n| 4 | a\\|b c |\n") and "| 1 | NULL |\n\n共 4 行（" in got["markdown"]
    assert governed.run(spark, "select id from ek_a where id > 9", views).first()["markdown"] == "| id |\n| --- |\n\n共 0 行"
    assert "ek_a" not in governed.tables(spark)
    views["ek_a"].createOrReplaceTempView("ek_a")
    assert "ek_a" in governed.tables(spark)
    joined = "with t as (select id from ek_a where id > 2) select t.id, a.id b from t, ek_a a where a.id = t.id order by 1"
    assert governed.run(spark, joined, views).first()["n_rows"] == 2
    file = "parquet.`/root/testdata/sf0.001/labels.parquet` "
    for bad in (f"select count(*) n from ek_a, {file}", f"select (select count(*) from {file}) from ek_a ek_a", "select id from ek_a where exists (from secret_ek_a select *)", "select 1 from ek_a, ek_a join range(3)", "delete from ek_a", "select 1 from mysql.user", "select 1 from ek_a; select 1 from ek_a"):
        with pytest.raises(ValueError, match="ek_a"):
            governed.run(spark, bad, views)


def test_triage(spark):
    rows = [(i, 1, d, *link) for i, (chain, _) in enumerate(CHAINS) for d, link in enumerate(chain)]
    df = spark.createDataFrame(rows, "call_id int, attempt int, depth int, error_type string, sql_state string, message string")
    got = {r["call_id"]: r["kind"] for r in governed.triage(df).collect()}
    assert [(c, got[i]) for i, (c, _) in enumerate(CHAINS)] == CHAINS
