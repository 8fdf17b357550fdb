"""Every registered query against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from tests.conftest import SF
from workload.oracle import SQL
from workload.queries import QUERIES

TABLES = ("events", "lineitem", "orders", "part", "documents")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


def plain(rows, columns):
    def cell(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return ""
        return repr(float(v)) if isinstance(v, float) else str(v)
    return sorted(tuple(cell(r[c]) for c in columns) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    cursor = duck.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    expected = [dict(zip(names, r)) for r in cursor.fetchall()]
    assert sorted(got.columns) == sorted(names)
    columns = sorted(names)
    assert plain([r.asDict() for r in got.collect()], columns) == plain(expected, columns)
