from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest
from conftest import ROWS, rows_of, when
from pyspark.sql import functions as F

from aisle.operators import changes, quality
from aisle.schemas import TABLES
from aisle.sources import tables



def at():
    return F.lit("2024-08-01 12:00:00").cast("timestamp_ntz")


SALE = "customer_id bigint, product_id bigint, store_id bigint, employee_id bigint, quantity int, unit_price double, payment_method string"


def test_append_transactions_checks_and_totals(spark, shop):
    batch = spark.createDataFrame(
        [
            (1, 1, 1, 1, 3, 0.1, "cash"),
            (1, 1, 1, None, 3, 1.0, "cash"),
            (2, 1, 1, 1, 0, 1.0, "cash"),
            (3, 1, 1, 1, 1, 0.0, "cash"),
            (4, 1, 1, 1, 1, 1.0, "barter"),
        ],
        SALE,
    )
    found = changes.append_transactions(batch, at())
    row = found.accepted.first()
    assert found.accepted.count() == 1
    assert (row["total_amount"], row["status"], row["transaction_date"]) == (Decimal("0.30"), "completed", when("2024-08-01 12:00:00"))
    assert sorted(rows_of(found.rejected, "problem")) == [
        "missing employee_id", "price not above 0", "quantity below 1", "unknown payment_method",
    ]
    numbered = changes.with_next_ids(found.accepted, shop["transactions"], "transaction_id", ["customer_id"])
    assert rows_of(numbered, "transaction_id") == [15]
    assert numbered.columns == TABLES["transactions"].names


def test_append_without_a_required_column(spark):
    batch = spark.createDataFrame([("Kite", 1)], "product_name string, category_id int")
    found = changes.append_products(batch, at())
    assert found.accepted.count() == 0 and rows_of(found.rejected, "problem") == ["missing price"]  # the first of three


def test_append_products_defaults(spark):
    batch = spark.createDataFrame(
        [("Kite", 1, 2.345, 7, 4), ("Drum", 1, 2.0, None, 4), ("Ball", 9, 2.0, 1, 1), ("Gold", 1, 1e12, 1, 1)],
        "product_name string, category_id int, price double, stock_quantity int, reorder_level int",
    )
    categories = spark.createDataFrame([(1,), (1,)], "category_id int")
    found = changes.append_products(batch, at(), categories)
    row = found.accepted.first()
    assert found.accepted.count() == 1
    assert (row["price"], row["stock_quantity"], row["reorder_level"]) == (Decimal("2.35"), 7, 4)
    assert dict(rows_of(found.rejected, "product_name", "problem")) == {
        "Drum": "missing stock_quantity", "Ball": "unknown category_id", "Gold": "price out of range",
    }
    assert found.rejected.columns == [*found.rejected.columns[:-1], "problem"] and "has_category_id" not in found.rejected.columns


def test_sales_out_of_range_or_without_parents_are_refused_one_by_one(spark, shop):
    batch = spark.createDataFrame(
        [(1, 1, 1, 1, 2, 3.0, "cash"), (1, 1, 1, 1, 2_000_000_000, 99_999_999.0, "cash"), (1, 1, 1, 1, 1, 1e12, "cash"), (999, 1, 1, 1, 1, 1.0, "cash")],
        SALE,
    )
    found = changes.append_transactions(batch, at(), shop)
    assert found.accepted.count() == 1
    assert sorted(rows_of(found.rejected, "problem")) == ["price out of range", "total out of range", "unknown customer_id"]


def test_append_customers_unique_email(spark, shop):
    batch = spark.createDataFrame(
        [("Ada", "ada@shop.test", None), ("New", "new@shop.test", "Nice"), ("Other", "new@shop.test", None), ("Gus", None, None)],
        "name string, email string, city string",
    )
    found = changes.append_customers(batch, shop["customers"], at())
    assert rows_of(found.accepted, "name", "email", "phone", "city", "country") == [("New", "new@shop.test", "", "Nice", "USA")]
    assert sorted(rows_of(found.rejected, "problem")) == ["email already stored", "email repeated in batch", "missing email"]


def test_every_refused_customer_is_told_with_all_fields(spark, shop):
    batch = spark.createDataFrame([("B", "x@y.z"), ("A", "x@y.z"), ("B", "x@y.z"), ("A", "x@y.z")], "name string, email string")
    found = changes.append_customers(batch, shop["customers"], at())
    assert rows_of(found.accepted, "name") == ["A"]
    assert sorted(rows_of(found.rejected, "name")) == ["A", "B", "B"]


def test_update_products_keeps_what_is_not_given(spark, shop):
    new = spark.createDataFrame([(1, None, 55.5), (2, "Bricks", None)], "product_id bigint, product_name string, price double")
    updated = changes.update_products(new, shop["products"])
    rows = {r["product_id"]: r for r in updated.collect()}
    assert (rows[1]["product_name"], rows[1]["price"]) == ("Kite", Decimal("55.50"))
    assert (rows[2]["product_name"], rows[2]["price"], rows[2]["stock_quantity"]) == ("Bricks", Decimal("25.00"), 10)
    assert [f.dataType for f in updated.schema] == [f.dataType for f in shop["products"].schema]


def test_repeated_changes_do_not_multiply_rows(spark, shop):
    new = spark.createDataFrame([(1, 5.0, 1), (1, 4.0, 2), (1, 3.0, 0)], "product_id bigint, price double, seq int")
    for order, price in ((None, "50.00"), ("seq", "4.00")):
        updated = changes.update_products(new.drop("seq") if order is None else new, shop["products"], order)
        assert updated.count() == 6
        assert rows_of(updated.filter("product_id = 1"), "price") == [Decimal(price)]
    assert changes.repeated_changes(new.drop("seq"), "product_id").count() == 3
    parts = spark.createDataFrame([(1, "new", None, 1), (1, None, 7, 2)], "product_id bigint, product_name string, stock_quantity int, seq int")
    row = changes.update_products(parts, shop["products"], "seq").filter("product_id = 1").first()
    assert (row["product_name"], row["stock_quantity"], row["price"]) == ("new", 7, Decimal("50.00"))
    moves = spark.createDataFrame([(1, "refunded", 1), (1, "cancelled", 2)], "transaction_id bigint, status string, seq int")
    updated = changes.update_status(moves, shop["transactions"], "seq")
    assert updated.count() == 14 and rows_of(updated.filter("transaction_id = 1"), "status") == ["cancelled"]


def test_resolve_and_status(spark, shop):
    ids = spark.createDataFrame([(2,), (2,), (99,)], "flag_id bigint")
    assert dict(rows_of(changes.resolve_flags(shop["fraud_flags"], ids), "flag_id", "resolved")) == {1: 1, 2: 1, 3: 0}
    new = spark.createDataFrame([(1, "refunded"), (2, "lost")], "transaction_id bigint, status string")
    status = dict(rows_of(changes.update_status(new, shop["transactions"]), "transaction_id", "status"))
    assert status[1] == "refunded" and status[2] == "completed" and len(status) == 14
    more = new.unionByName(spark.createDataFrame([(99, "refunded"), (3, None)], new.schema))
    assert dict(rows_of(changes.rejected_status(more, shop["transactions"]), "transaction_id", "problem")) == {
        2: "unknown status", 3: "missing status", 99: "unknown transaction_id",
    }
    assert rows_of(changes.unknown_flags(ids, shop["fraud_flags"]), "flag_id") == [99]


def test_cascades(spark, shop):
    gone = spark.createDataFrame([(3,)], "transaction_id bigint")
    assert rows_of(changes.cascade_delete(shop["fraud_flags"], gone, "transaction_id"), "flag_id") == [1]
    held = changes.restrict_delete(shop["stores"], shop["transactions"], "store_id")
    assert sorted(rows_of(held, "store_id")) == [1, 2]
    mapping = spark.createDataFrame([(2, 20)], "store_id bigint, new_key bigint")
    moved = changes.cascade_key_update(shop["employees"], mapping, "store_id")
    assert dict(rows_of(moved, "employee_id", "store_id")) == {1: 1, 2: 20, 3: 1}


def test_clean_tables_pass_every_check(shop):
    assert quality.check_unique_keys(shop).count() == 0
    assert quality.check_foreign_keys(shop).count() == 0
    for name, df in shop.items():
        assert quality.check_table(name, df).count() == 0


def test_broken_rows_are_reported(spark, shop):
    doubled = dict(shop)
    doubled["customers"] = shop["customers"].unionByName(shop["customers"].filter("customer_id = 1"))
    assert sorted(rows_of(quality.check_unique_keys(doubled))) == [
        ("customers", "customer_id", 1, 1), ("customers", "email", 1, 1),
    ]
    bad = shop["transactions"].withColumn("product_id", F.when(F.col("product_id") == 4, 44).otherwise(F.col("product_id")))
    assert rows_of(quality.check_foreign_keys({**shop, "transactions": bad})) == [("transactions", "product_id", "44", 3)]
    odd = shop["transactions"].limit(1).selectExpr(
        "* EXCEPT (status, customer_id, payment_method)", "'lost' AS status", "CAST(NULL AS BIGINT) AS customer_id", "'cash' AS payment_method"
    )
    assert sorted(rows_of(quality.check_table("transactions", odd), "column", "problem")) == [
        ("customer_id", "null"), ("status", "not allowed"),
    ]
    long = shop["stores"].withColumn("store_name", F.repeat(F.lit("x"), 151))
    assert set(rows_of(quality.check_table("stores", long), "problem")) == {"too long"}


def test_seed_load_from_csv_and_json(spark, shop, tmp_path):
    for name, df in shop.items():
        df.write.option("header", True).csv(str(tmp_path / "csv" / name))
        df.write.json(str(tmp_path / "json" / name))
    for kind in ("csv", "json"):
        loaded = tables.load_seed(spark, str(tmp_path / kind), str(tmp_path / f"from_{kind}"), format=kind)
        counts = dict(rows_of(tables.table_counts(loaded)))
        assert counts == {name: len(rows) for name, rows in ROWS.items()}
        again = tables.scan_all(spark, str(tmp_path / f"from_{kind}"))
        assert sorted(map(repr, again["transactions"].collect())) == sorted(map(repr, shop["transactions"].collect()))
    assert rows_of(tables.listing(again["categories"], "categories"), "category_name") == ["Garden", "Pantry", "Toys"]


def test_malformed_seed_row_stops_the_load(spark, tmp_path):
    (tmp_path / "stores").mkdir()
    (tmp_path / "stores" / "a.csv").write_text("store_id,store_name,city,region,manager_name\nx,North,Oslo,N,Max\n")
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        tables.load_seed(spark, str(tmp_path), str(tmp_path / "out"), schemas={"stores": TABLES["stores"]})


def test_json_export(spark, shop, tmp_path):
    tables.export_json(shop["transactions"].filter("transaction_id = 3"), str(tmp_path / "out"))
    row = spark.read.text(str(tmp_path / "out")).first()[0]
    assert '"total_amount":1500.0' in row and '"transaction_date":"2024-03-01T04:59:59"' in row
    tables.export_json(shop["demand_forecast"].filter("forecast_id = 1"), str(tmp_path / "f"))
    row = spark.read.text(str(tmp_path / "f")).first()[0]
    assert '"forecast_date":"2024-06-01"' in row and '"actual_demand":null' in row


def test_transactions_stored_by_month(spark, shop, tmp_path):
    tables.write_transactions(shop["transactions"], str(tmp_path / "tx"))
    months = sorted(p.name for p in (tmp_path / "tx").iterdir() if p.is_dir())
    assert months[0] == "month=2024-01" and len(months) == 5
    stored = spark.read.parquet(str(tmp_path / "tx"))
    assert stored.count() == 14 and stored.schema["transaction_date"].dataType.typeName() == "timestamp_ntz"
    assert dt.datetime(2024, 5, 31, 23, 59, 59) in rows_of(stored, "transaction_date")
