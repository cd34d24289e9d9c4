"""Every sample query against its SQL, row for row."""

from __future__ import annotations

import math
import os
from collections import Counter

import duckdb
import pytest

from pulltally.samples.oracle import ORACLE
from pulltally.samples.queries import QUERIES

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "orders lineitem documents".split()


def normal(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value
    return value


SAME_TYPE = {"BIGINT": "bigint", "VARCHAR": "string", "INTEGER": "int", "DOUBLE": "double",
             "TIMESTAMP": "timestamp_ntz", "BOOLEAN": "boolean"}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, duck, name):
    result = QUERIES[name](spark, FOLDER)
    columns = sorted(result.columns)
    found = Counter(tuple(normal(v) for v in row) for row in result.select(*columns).collect())
    cursor = duck.execute(ORACLE[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    types = dict(result.dtypes)
    assert {d[0]: SAME_TYPE[str(d[1])] for d in cursor.description} == types
    order = [names.index(c) for c in columns]
    expected = Counter(tuple(normal(row[i]) for i in order) for row in cursor.fetchall())
    assert sum(expected.values()) > 0
    missing, extra = expected - found, found - expected
    assert not missing and not extra, (len(missing), len(extra), list(missing)[:2], list(extra)[:2])
