"""Every registered query against its SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from shopfront.queries.registry import QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for file in Path(sf_dir).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


def canonical(rows):
    def value(v):
        return round(v, 9) if isinstance(v, float) and not math.isnan(v) else v

    return sorted(repr(tuple(value(v) for v in row)) for row in rows)


def test_every_query_has_sql():
    assert set(QUERIES) <= set(oracle_sql()) and set(QUERIES) <= set(queries())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_agrees_with_sql(spark, sf_dir, duck, name):
    table = queries()[name](spark, sf_dir)
    columns = sorted(table.columns)
    answer = duck.sql(oracle_sql()[name])
    assert sorted(answer.columns) == columns
    expected = answer.select(", ".join(f'"{c}"' for c in columns)).fetchall()
    got = table.select(*(f"`{c}`" for c in columns)).collect()
    assert canonical(got) == canonical(expected) and got


def test_entry(spark):
    assert entry(spark).columns[0] == "url"
