"""Every registered query against its SQL, on the driver's tables."""

import os
import re
import time

import duckdb
import pytest

import __spark_entry__ as registered

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(
            f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF_DIR}/{table}.parquet')"
        )
    return connection


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(row[i] for i in order) for row in rows), key=repr)


TYPES = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}


@pytest.mark.parametrize("name", sorted(registered.library_queries()))
def test_query_matches_sql(spark, duck, name):
    begin = time.time()
    frame = registered.library_queries()[name](spark, SF_DIR)
    found = [tuple(row) for row in frame.collect()]
    print(f"{name}: {len(found)} rows, {time.time() - begin:.1f} s")
    sql = registered.library_sql().get(name)
    assert sql is not None
    result = duck.execute(sql)
    columns = [d[0] for d in result.description]
    assert sorted(frame.columns) == sorted(columns)
    types = dict(zip(columns, (TYPES[str(d[1])] for d in result.description)))
    assert dict(frame.dtypes) == types
    assert found
    assert _rows(frame.columns, found) == _rows(columns, result.fetchall())


def test_every_sql_has_a_query():
    assert set(registered.oracle_sql()) <= set(registered.queries())


def test_entry(spark):
    frame = registered.entry(spark)
    assert frame.columns == ["id", "component"]
    assert frame.count() > 0


def test_no_cross_joins_in_sql():
    for sql in registered.oracle_sql().values():
        assert not re.search(r"cross\s+join", sql, re.IGNORECASE)
