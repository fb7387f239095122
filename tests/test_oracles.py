"""Every query of the engine's own operators against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from leafspark import queries as core

SF = "/root/testdata/sf0.001"


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([float(f"{r[i]:.9g}") if isinstance(r[i], float) else r[i] for i in order]) for r in rows)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(core.ORACLES))
def test_query_equals_sql(spark, duck, name):
    found = entry.queries()[name](spark, SF)
    wanted = duck.sql(core.ORACLES[name])
    assert sorted(found.columns) == sorted(wanted.columns)
    assert _rows(found.columns, [tuple(r) for r in found.collect()]) == _rows(wanted.columns, wanted.fetchall())


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - set(core.ORACLES)))
def test_query_without_sql_has_rows(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
