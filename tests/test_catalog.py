"""Every registered query with SQL gives the same rows in DuckDB (at sf0.001)."""

from __future__ import annotations

import math

import duckdb
import pytest

import __spark_entry__ as contract
from limner.catalog.bindings import TABLES
from tests.conftest import TESTDATA

SF = f"{TESTDATA}/sf0.001"
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _plain(v):
    return None if isinstance(v, float) and math.isnan(v) else v


def _sorted(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    df = contract.queries()[name](spark, SF)
    expected = duck.sql(contract.oracle_sql()[name])
    kinds = {f.name: TYPES.get(f.dataType.simpleString()) for f in df.schema.fields}
    assert kinds == dict(zip(expected.columns, map(str, expected.types)))
    assert _sorted(df.columns, df.collect()) == _sorted(expected.columns, expected.fetchall())


@pytest.mark.parametrize("name", sorted(set(contract.queries()) - set(contract.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    df = contract.queries()[name](spark, SF)
    assert df.columns
    df.count()


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["class_id", "name", "n", "top1_acc", "top1_acc_4"]
    assert df.count() > 0
