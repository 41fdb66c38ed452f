import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_names_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def plain(value):
    """A value as both engines give it: numbers rounded, arrays as tuples."""
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if isinstance(value, bool):
        return str(value)
    if hasattr(value, "item") and not hasattr(value, "__len__"):
        value = value.item()
    if isinstance(value, (int, float)):
        return f"{float(value):.6g}"
    if hasattr(value, "isoformat"):
        return value.isoformat()[:19].replace("T", " ")
    if isinstance(value, str):
        return value
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    return tuple(plain(v) for v in value) if hasattr(value, "__iter__") else str(value)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_rows_as_sql(spark, sf_dir, name):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    got = entry.queries()[name](spark, sf_dir)
    want = con.sql(entry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    rows = sorted(tuple(map(plain, r)) for r in got.select(*columns).collect())
    at = [want.columns.index(c) for c in columns]
    assert rows == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())
