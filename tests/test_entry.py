"""Every registered query against its SQL, on the smallest tables."""

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql
from workloads.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.sql(f"create view {table} as select * from '{SF_DIR}/{table}.parquet'")
    return connection


def rows(columns, records):
    order = sorted(range(len(columns)), key=lambda n: columns[n])
    return sorted(([record[n] for n in order] for record in records), key=repr)


def queries():
    return QUERIES


def test_every_query_has_an_oracle():
    assert set(queries()) <= set(oracle_sql())


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, duck, name):
    found = queries()[name](spark, SF_DIR)
    expected = duck.sql(oracle_sql()[name])
    assert sorted(found.columns) == sorted(expected.columns)
    assert rows(found.columns, found.collect()) == rows(expected.columns, expected.fetchall())


def test_entry(spark):
    assert entry(spark).count() > 0


def test_known_results(spark):
    """Counts agreed on beforehand for the tables of scale 0.01."""
    at = "/root/testdata/sf0.01"
    summary = {(row.action, row.reason): (row["items"], row.bytes) for row in queries()["sync_plan_summary"](spark, at).collect()}
    assert summary == {
        ("convert", "new"): (110, 267325),
        ("convert", "stale"): (90, 222798),
        ("copy", "new"): (76, 195445),
        ("copy", "stale"): (41, 105114),
        ("skip", "fresh"): (683, 1619188),
    }
    assert sorted(row.path for row in queries()["removable_dirs"](spark, at).collect()) == ["orphans/1", "orphans/3"]
    conflicts = queries()["target_conflicts"](spark, at).groupBy().agg({"n_sources": "sum", "*": "count"}).first()
    assert sorted(conflicts) == [2663, 5411]
