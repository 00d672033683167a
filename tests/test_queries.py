"""Every query against its SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import SMALL
from tetraspark.queries import ORACLE_SQL, QUERIES


def rows(values, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(v[i] for i in order) for v in values), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in Path(SMALL).glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    found, wanted = QUERIES[name](spark, SMALL), con.sql(ORACLE_SQL[name])
    assert sorted(found.columns) == sorted(wanted.columns)
    assert rows([tuple(r) for r in found.collect()], found.columns) == rows(wanted.fetchall(), wanted.columns)


def test_entry_and_registry(spark):
    assert entry.entry(spark).collect()[0].asDict() == {"cell_count": 1200, "vertex_count": 462, "min_insphere": pytest.approx(1 / (2 + 2 * 2**0.5)), "degenerate_cells": 0}
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) == set(ORACLE_SQL)
