"""Queries of the subpackage that have SQL, against DuckDB on the smallest tables."""

import os
from collections import Counter

import duckdb
import pytest
from quern.llm import registry


@pytest.mark.parametrize("name", sorted(registry.oracles()))
def test_query(spark, sf_dir, name):
    duck = duckdb.connect()
    for file in os.listdir(sf_dir):
        duck.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf_dir}/{file}')")
    frame = registry.queries()[name](spark, sf_dir)
    columns = sorted(frame.columns)
    result = duck.execute(registry.oracles()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    rows = Counter(tuple(str(r[c]) for c in columns) for r in frame.collect())
    assert rows == Counter(tuple(str(r[names.index(c)]) for c in columns) for r in result.fetchall())
