"""Registered queries against their SQL, and the contract of the entry module."""

from __future__ import annotations

from pathlib import Path

import pytest
from compare import connect, differences

import __spark_entry__ as contract
from aisle.catalog import ENTRIES

FOLDER = Path(contract.SMOKE_FOLDER)
needs_data = pytest.mark.skipif(not FOLDER.is_dir(), reason="the warehouse files are not here")


@pytest.fixture(scope="module")
def db():
    return connect(str(FOLDER))


def test_every_query_has_its_sql():
    assert set(ENTRIES) <= set(contract.queries()) and set(ENTRIES) <= set(contract.oracle_sql())
    assert all("SELECT" in sql for sql in contract.oracle_sql().values())


@needs_data
def test_entry_gives_the_top_products(spark):
    df = contract.entry(spark)
    assert df.columns[0] == "product_id" and df.count() == 10


@needs_data
@pytest.mark.parametrize("name", sorted(ENTRIES))
def test_query_agrees_with_sql_and_joins_no_pairs(spark, db, name):
    df = contract.queries()[name](spark, str(FOLDER))
    text = df._jdf.queryExecution().toString()
    for operator in ("BroadcastNestedLoopJoin", "CartesianProduct", "PythonUDF", "MapInPandas"):
        assert operator not in text
    assert differences(name, df, db) == []
