"""Rows at a place of an order, found by counting, against a plain sort."""

from __future__ import annotations

import datetime as dt
import random

import pytest

import __spark_entry__ as contract
from aisle.operators import paging
from aisle.plans import positions, selection
from aisle.sources.warehouse import Warehouse

TABLE = "d timestamp_ntz, t timestamp, n double, k bigint, note string"


def made(seed: int, count: int) -> list[tuple]:
    """Rows of which a third share one instant and some have NULLs."""
    pick, start = random.Random(seed), dt.datetime(2024, 1, 1)
    hot = start + dt.timedelta(days=3)
    rows = []
    for key in range(count):
        at = hot if key % 3 == 0 else start + dt.timedelta(seconds=pick.randrange(600_000), microseconds=pick.choice([0, 1, 999_999]))
        number = pick.choice([None, float("nan"), -0.5, 0.25, pick.random()])
        rows.append((None if key % 50 == 1 else at, at if key % 40 else None, number, key, f"n{key}"))
    pick.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(made(7, 4000), TABLE).repartition(5).cache()


@pytest.mark.parametrize("order, offset, rows", [
    ([("d", False), ("k", True)], 1333, 40),
    ([("d", True), ("k", False)], 2700, 1),
    ([("n", False), ("t", True), ("k", True)], 3990, 50),
    ([("note", False)], 2000, 7),
])
def test_the_rows_of_a_plain_sort(table, monkeypatch, order, offset, rows):
    monkeypatch.setattr(selection, "SAMPLE_ROWS", 64)
    expected = [r["k"] for r in table.orderBy(*selection.sort_columns(order)).collect()][offset : offset + rows]
    found = selection.rows_at(table, order, offset, rows, enough=20)
    assert [r["k"] for r in found.collect()] == expected
    assert found.columns == table.columns


def test_what_is_left_to_sort_is_small(table):
    order = [("d", False), ("k", True)]
    found = selection.find_range(table, order, 2000, 10, enough=100)
    assert found.skip <= 100
    assert selection.rows_between(table, order, found).count() <= 400


def test_beyond_the_end_and_empty(table, spark):
    order = [("d", False), ("k", True)]
    assert selection.rows_at(table, order, 4000, 5, 10).count() == 0
    assert selection.rows_at(table.limit(0), order, 0, 5, 10).count() == 0


def test_rows_that_the_order_cannot_tell_apart(spark):
    same = spark.range(500).selectExpr("CAST(id % 2 AS BIGINT) AS v", "id")
    found = selection.rows_at(same, [("v", True)], 240, 20, enough=10).collect()
    assert [r["v"] for r in found] == [0] * 10 + [1] * 10
    assert len({r["id"] for r in found}) == 20


def test_a_deep_page_checkpoints_nothing(table, monkeypatch):
    monkeypatch.setattr(positions, "materialise", lambda df: pytest.fail("rows were stored"))
    page = paging.page_rows(table, [("d", False)], [("k", True)], 40, 50, shallow=100)
    assert "TakeOrderedAndProject" in page._jdf.queryExecution().executedPlan().toString()


def test_the_deep_page_of_a_join_joins_once(spark, tmp_path):
    orders = spark.range(1, 9001).selectExpr("id AS o_orderkey", "id AS o_custkey", "'F' AS o_orderstatus", "1D AS o_totalprice", "TIMESTAMP_NTZ '2000-01-01' + make_dt_interval(id % 700) AS o_orderdate", "'1-URGENT' AS o_orderpriority")
    lines = spark.range(45_000).selectExpr("id % 9000 + 1 AS l_orderkey", "id AS l_partkey", "id % 3 AS l_suppkey", "CAST(id AS INT) AS l_linenumber", "1D AS l_quantity", "id + 0.5D AS l_extendedprice")
    orders.write.parquet(str(tmp_path / "orders.parquet"))
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    found = contract.queries()["paginate_deep"](spark, str(tmp_path))
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    every = Warehouse(spark, str(tmp_path)).transactions().select("transaction_id", "transaction_date").collect()
    ids = sorted(every, key=lambda r: (-r["transaction_date"].toordinal(), r["transaction_id"]))[40_000:40_100]
    assert [r["transaction_id"] for r in found.collect()] == [r["transaction_id"] for r in ids]
