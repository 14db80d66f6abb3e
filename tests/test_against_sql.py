"""Every registered query against its SQL equivalent on the same tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from plantfuse.plans.star_queries import star_queries
from star_sql import ORACLE_SQL

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return connection


def normal(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value
    return value


def sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(normal(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(star_queries()))
def test_matches_sql(spark, duck, name):
    result = duck.execute(ORACLE_SQL[name])
    columns = [d[0] for d in result.description]
    expected = sorted_rows(columns, result.fetchall())
    frame = entry.queries()[name](spark, SF_DIR)
    assert sorted(frame.columns) == sorted(columns)
    actual = sorted_rows(frame.columns, [tuple(r) for r in frame.collect()])
    assert len(actual) == len(expected)
    assert actual == expected
    kinds = [{type(v) for r in rows for v in r} for rows in (actual, expected)]
    assert kinds[0] == kinds[1]


def test_every_query_has_sql():
    assert set(star_queries()) == set(ORACLE_SQL)
    assert set(star_queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
