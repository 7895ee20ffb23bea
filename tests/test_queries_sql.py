"""Every registered query against its SQL in DuckDB, on the whole smallest tables."""

import datetime as dt
from pathlib import Path

import duckdb
import pytest

from txnwatch.plans.oracle import all_oracles
from txnwatch.plans.queries import all_queries

QUERIES, SQL = all_queries(), all_oracles()
TYPES = {
    "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string",
    "BOOLEAN": "boolean", "TIMESTAMP": "timestamp_ntz", "DATE": "date",
}


@pytest.fixture(scope="module")
def con(small):
    connection = duckdb.connect()
    for path in Path(small).glob("*.parquet"):
        connection.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    yield connection
    connection.close()


def plain(value):
    if isinstance(value, float):
        return repr(round(value, 9))
    if isinstance(value, dt.datetime):
        return value.isoformat()
    return str(value)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, small, con, name):
    df = QUERIES[name](spark, small)
    columns = sorted(df.columns)
    expected = con.sql(SQL[name])
    assert sorted(expected.columns) == columns
    types = {c: TYPES[str(t)] for c, t in zip(expected.columns, expected.types)}
    assert {c: df.schema[c].dataType.simpleString() for c in columns} == types
    got = sorted(tuple(plain(v) for v in r) for r in df.select(columns).collect())
    order = [expected.columns.index(c) for c in columns]
    want = sorted(tuple(plain(r[i]) for i in order) for r in expected.fetchall())
    assert len(got) > 0
    assert got == want
