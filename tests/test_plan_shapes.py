"""What the planner makes of the operators: pushed filters, narrow scans, joins after aggregation."""

from __future__ import annotations

from pathlib import Path

import pytest

import __spark_entry__ as contract
from aisle.operators import filters, sales
from aisle.sources.warehouse import Warehouse

FOLDER = Path(contract.SMOKE_FOLDER)
pytestmark = pytest.mark.skipif(not FOLDER.is_dir(), reason="the warehouse files are not here")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def w(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    return Warehouse(spark, str(FOLDER))


def test_status_and_dates_reach_the_scan(w):
    text = plan(filters.between_dates(w.completed(), "2000-01-01", "2000-12-31"))
    assert "EqualTo(o_orderstatus,F)" in text
    assert "GreaterThanOrEqual(o_orderdate,2000-01-01" in text and "LessThan(o_orderdate,2001-01-01" in text


def test_only_needed_columns_are_read(w):
    text = plan(sales.dashboard_kpis(w.completed()))
    assert "l_discount" not in text and "o_orderpriority" not in text


def test_top_products_aggregate_before_the_join(w):
    text = plan(sales.top_products(w.completed(), w.products()))
    assert "TakeOrderedAndProject" in text and "partial_sum" in text
    assert text.count("hashpartitioning") == 1


def test_newest_rows_are_cut_before_the_names_are_joined(w):
    text = plan(sales.sales_detail(w.completed(), w.customers(), w.products(), w.stores()))
    below_joins = text.rindex("TakeOrderedAndProject")
    assert text.count("TakeOrderedAndProject") == 2 and text.index("Join") < below_joins


def test_single_row_rules_share_a_scan(w):
    from aisle.operators.fraud import row_rule_flags

    assert plan(row_rule_flags(w.events())).count("FileScan") == 1
