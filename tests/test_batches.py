"""Batches stored by one commit: broken, repeated and refused ones."""

from __future__ import annotations

import pytest
from conftest import rows_of

import __spark_entry__ as contract
from aisle.sources import batches
from aisle.sources.warehouse import Warehouse
from aisle.streaming import arrivals

SCHEMA = "id bigint, note string"


def test_a_broken_batch_shows_nothing_and_counts_once_repeated(spark, shop, tmp_path, monkeypatch):
    folder = str(tmp_path / "stream")
    write = arrivals.arrival_writer(folder, rapid=False)
    write(shop["transactions"].filter("transaction_id <= 7"), 0)
    flags, sold = rows_of(arrivals.arrival_flags(spark, folder)), rows_of(batches.read_batches(spark, folder, "sold", "product_id bigint, sold bigint"))
    rest = shop["transactions"].filter("transaction_id > 7")

    with monkeypatch.context() as patch:
        patch.setattr(arrivals, "sold_units", lambda df: df.select(arrivals.F.raise_error(arrivals.F.lit("lost")).alias("sold")))
        with pytest.raises(Exception, match="lost"):
            write(rest, 1)
    assert rows_of(arrivals.arrival_flags(spark, folder)) == flags
    assert rows_of(batches.read_batches(spark, folder, "sold", "product_id bigint, sold bigint")) == sold
    for _ in range(2):
        write(rest, 1)
        assert arrivals.arrival_flags(spark, folder).count() == arrivals.stream_row_rules(shop["transactions"]).count()
        assert arrivals.arrival_sale_log(spark, folder).count() == arrivals.sale_log(shop["transactions"]).count()


def test_append_refuses_known_and_repeated_keys(spark, tmp_path):
    folder = str(tmp_path / "tables")
    append = lambda rows, batch: batches.append_batch(spark.createDataFrame(rows, SCHEMA), folder, "notes", batch, "id", SCHEMA)
    stored = lambda: sorted(rows_of(batches.read_batches(spark, folder, "notes", SCHEMA)))
    assert stored() == []
    assert append([(1, "a"), (2, "b")], "first").count() == 0
    second = [(2, "again"), (3, "c"), (4, "x"), (4, "y"), (None, "z")]
    for _ in range(2):
        refused = append(second, "second")
        assert sorted(rows_of(refused, "note", "problem")) == [
            ("again", "id already stored"), ("x", "id repeated in batch"), ("y", "id repeated in batch"), ("z", "missing id"),
        ]
        assert stored() == [(1, "a"), (2, "b"), (3, "c")]
    assert append([], "empty").count() == 0 and len(stored()) == 3


def test_tries_without_a_commit_are_not_read(spark, tmp_path):
    folder = str(tmp_path / "tables")
    spark.createDataFrame([(9, "lost")], SCHEMA).write.parquet(f"{folder}/notes/write=broken")
    assert batches.read_batches(spark, folder, "notes", SCHEMA).count() == 0
    assert batches.write_batch(spark, folder, "one", {"notes": spark.createDataFrame([(1, "a")], SCHEMA)})
    assert not batches.write_batch(spark, folder, "one", {"notes": spark.createDataFrame([(2, "b")], SCHEMA)})
    assert rows_of(batches.read_batches(spark, folder, "notes", SCHEMA)) == [(1, "a")]


def test_batches_of_a_join_read_it_once(spark, tmp_path):
    """What is refused and what is stored come from keys and sales that were stored, not from the join again."""
    orders = spark.range(1, 200).selectExpr("id AS o_orderkey", "id % 9 AS o_custkey", "array('F', 'O', 'P')[id % 3] AS o_orderstatus", "1D AS o_totalprice", "TIMESTAMP_NTZ '2000-01-01' AS o_orderdate", "'1-URGENT' AS o_orderpriority")
    lines = spark.range(800).selectExpr("id % 199 + 1 AS l_orderkey", "id % 5 AS l_partkey", "id % 3 AS l_suppkey", "CAST(id AS INT) AS l_linenumber", "CAST(id % 50 + 1 AS DOUBLE) AS l_quantity", "id + 0.5D AS l_extendedprice")
    orders.write.parquet(str(tmp_path / "orders.parquet"))
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    found = contract.queries()["append_batches"](spark, str(tmp_path))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan and "Aggregate" not in plan
    sales = Warehouse(spark, str(tmp_path)).transactions()
    assert found.filter("problem = 'stored'").count() == sales.filter("status IN ('completed', 'refunded')").count()
    again = sales.filter("status = 'completed' AND quantity > 40").count()
    assert found.filter("problem = 'transaction_id already stored'").count() == again > 0
