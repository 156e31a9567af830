"""Every query with SQL against DuckDB on the smallest tables."""

import os
from collections import Counter

import duckdb
import pytest

from quern.plans import catalogue


def plain(value):
    if isinstance(value, float):
        return round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for file in os.listdir(sf_dir):
        connection.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf_dir}/{file}')")
    return connection


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, sf_dir, name):
    frame = catalogue.QUERIES[name](spark, sf_dir)
    columns = sorted(frame.columns)
    rows = Counter(tuple(plain(r[c]) for c in columns) for r in frame.collect())
    if name not in catalogue.ORACLES:
        assert sum(rows.values()) > 0
        return
    result = duck.execute(catalogue.ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert rows == Counter(tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
