"""Each registered query of the library against its SQL in DuckDB."""

import datetime
import decimal
import math

import duckdb
import pytest

from archive_spark import plans
from archive_spark.sources.tables import BASE


def plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value) if value % 1 else int(value)
    if isinstance(value, float) and not math.isnan(value):
        return round(value, 5)
    return value.replace(tzinfo=None) if isinstance(value, datetime.datetime) else value


def rows(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in records), key=lambda r: tuple((x is not None, str(type(x)), x) for x in r))


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for name in BASE:
        con.sql(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, sf_dir, duck, name):
    df = plans.queries()[name](spark, sf_dir)
    got = rows(df.columns, df.collect())
    assert got
    if name in plans.oracle_sql():
        found = duck.sql(plans.oracle_sql()[name])
        assert sorted(df.columns) == sorted(found.columns)
        want = rows(found.columns, found.fetchall())
        assert got == want
