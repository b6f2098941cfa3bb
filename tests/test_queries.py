"""Every registered query against its SQL on the smallest dataset."""

import os
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry_points
from millrace.plans.registry import ORACLES, QUERIES

FOLDER = os.environ.get("MILLRACE_TEST_DATA", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, (int, Decimal)):
        return str(Decimal(value).normalize())
    return repr(value) if isinstance(value, float) else str(value)


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES)
    assert set(QUERIES) <= set(entry_points.queries())


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sql, name):
    frame = QUERIES[name](spark, FOLDER)
    columns = sorted(frame.columns)
    got = sorted(tuple(plain(row[c]) for c in columns) for row in frame.collect())
    cursor = sql.execute(ORACLES[name])
    names = [item[0] for item in cursor.description]
    expected = sorted(tuple(plain(row[names.index(c)]) for c in columns) for row in cursor.fetchall())
    assert sorted(names) == columns
    assert got == expected
