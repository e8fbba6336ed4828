"""Every query of the catalogue against its SQL, on the smallest data directory."""

import glob
import os

import pytest

import __spark_entry__ as entry
from colligo.plans import catalogue

duckdb = pytest.importorskip("duckdb")


def canon(value):
    if isinstance(value, float):
        return repr(round(value, 6))
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(canon, value)) + "]"
    return str(value)


@pytest.fixture(scope="module")
def sql(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_query_equals_its_sql(spark, sf, sql, name):
    df = catalogue.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted(tuple(canon(r[c]) for c in columns) for r in df.collect())
    result = sql.execute(catalogue.ORACLE[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    want = sorted(tuple(canon(r[names.index(c)]) for c in columns) for r in result.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE)))
def test_query_without_sql_runs(spark, sf, name):
    df = catalogue.QUERIES[name](spark, sf)
    assert df.columns and df.count() >= 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["Severity", "Message", "Source"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
