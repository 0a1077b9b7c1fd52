from __future__ import annotations

import datetime as dt
from decimal import Decimal

from conftest import rows_of, when
from pyspark.sql import functions as F

from aisle.operators import demand, inventory


def stock_of(df) -> dict:
    return dict(rows_of(df, "product_id", "stock_quantity"))


def test_sales_reduce_stock_below_zero(shop):
    after = inventory.apply_sales_to_stock(shop["products"], shop["transactions"])
    assert stock_of(after) == {1: 339, 2: 7, 3: -4, 4: -5, 5: 12, 6: -17}
    assert after.columns == shop["products"].columns
    position = inventory.stock_position(shop["products"], shop["transactions"])
    for row in position.collect():
        assert row["stock_quantity"] == row["opening_stock"] - row["units_sold"]


def test_stock_labels(shop):
    flags = dict(rows_of(inventory.low_stock_flag(shop["products"]), "product_id", "low_stock"))
    assert flags == {1: 0, 2: 1, 3: 1, 4: 1, 5: 0, 6: 0}  # stock equal to the level counts as low
    status = dict(rows_of(inventory.stock_status(shop["products"]), "product_id", "stock_status"))
    assert status[2] == "REORDER NEEDED" and status[5] == "OK"
    label = dict(rows_of(inventory.stock_label(shop["products"]), "product_id", "stock_label"))
    assert (label[1], label[2], label[3]) == ("In Stock", "Low Stock", "Out of Stock")
    fill = dict(rows_of(inventory.stock_fill_pct(shop["products"]), "product_id", "stock_fill_pct"))
    assert fill == {1: 100, 2: 33, 3: 0, 4: 17, 5: 40, 6: 100}
    assert rows_of(inventory.out_of_stock(shop["products"]), "product_id") == [3]


def test_low_stock_report_order(shop):
    found = rows_of(inventory.low_stock(shop["products"], shop["categories"]), "product_id", "units_needed")
    assert found == [(3, 5), (4, 5), (2, 0)]


def test_alert_lists_empty_products_before_low_ones(shop):
    assert rows_of(inventory.stock_alert_list(shop["products"]), "level", "part", "alerts", "names") == [
        ("out_of_stock", 0, 1, "Honey")
    ]
    stocked = shop["products"].filter("stock_quantity > 0")
    for spread in (False, True):
        found = inventory.stock_alert_list(stocked, spread=spread)
        assert rows_of(found, "level", "names") == [("low_stock", "Blocks, Rice")]
    parts = rows_of(inventory.stock_alert_list(stocked, names_per_row=1).orderBy("part"), "part", "names")
    assert parts == [(0, "Blocks"), (1, "Rice")]
    assert inventory.stock_alert_list(shop["products"].filter("product_id = 1")).count() == 0


def test_sale_log_and_history(shop):
    log = inventory.sale_log(shop["transactions"])
    assert log.count() == 11
    row = log.filter("notes = 'Auto-logged from transaction #6'").first()
    assert (row["change_type"], row["quantity_change"], row["log_date"]) == ("sale", -8, when("2024-04-10 12:00:00"))
    for enforced in (True, False):
        history = inventory.inventory_history(
            shop["inventory_log"], shop["products"], shop["stores"], limit=1, enforced_keys=enforced
        )
        assert rows_of(history, "log_id", "product_name", "store_name") == [(2, "Rice", "Shop South")]


def test_restock_adds_up_deliveries(spark, shop):
    deliveries = spark.createDataFrame([(3, 2, 4), (3, 1, 6), (1, 1, 0)], "product_id bigint, store_id bigint, quantity int")
    assert stock_of(inventory.restock(shop["products"], deliveries))[3] == 10
    assert stock_of(inventory.restock(shop["products"], deliveries))[1] == 400
    log = inventory.restock_log(deliveries, F.lit("2024-07-01").cast("timestamp_ntz"))
    assert sorted(rows_of(log, "product_id", "quantity_change")) == [(3, 4), (3, 6)]


def test_forecast_divides_by_months_with_sales(shop):
    found = dict(rows_of(demand.forecast_demand(shop["transactions"], shop["products"], "2024-05-31"), "product_id", "predicted_demand"))
    # from 29 February: product 1 sold 31 in February only, product 4 ten units in April only
    assert found == {1: 31, 2: 3, 3: 4, 4: 10, 5: 0, 6: 20}
    dates = set(rows_of(demand.forecast_demand(shop["transactions"], shop["products"], "2024-01-31"), "forecast_date"))
    assert dates == {dt.date(2024, 2, 1)}


def test_forecast_of_complete_months_and_chosen_products(spark, shop):
    whole = demand.forecast_demand(shop["transactions"], shop["products"], "2024-05-31", complete_months=True)
    found = dict(rows_of(whole, "product_id", "predicted_demand"))
    assert found[1] == 31 and found[6] == 0  # May itself is left out
    ids = spark.createDataFrame([(4,), (77,)], "product_id bigint")
    chosen = demand.forecast_demand(shop["transactions"], shop["products"], "2024-05-31", ids)
    assert rows_of(chosen, "product_id") == [4]
    assert rows_of(demand.unknown_products(ids, shop["products"]), "product_id") == [77]


def test_forecast_rounds_half_up(spark, shop):
    rows = [(1, 1, "2024-03-05"), (1, 0, "2024-04-05"), (1, 0, "2024-05-05")]
    tx = spark.createDataFrame(rows, "product_id bigint, quantity int, d string").selectExpr(
        "*", "CAST(d AS timestamp_ntz) AS transaction_date", "'completed' AS status"
    )
    found = demand.forecast_demand(tx, shop["products"].filter("product_id = 1"), "2024-05-31")
    assert rows_of(found, "predicted_demand") == [Decimal("0.33")]


def test_upsert_updates_inserts_and_repeats(spark, shop):
    new = demand.forecast_demand(shop["transactions"], shop["products"], "2024-05-31")
    once = demand.upsert_forecast(new, shop["demand_forecast"])
    rows = {(r["product_id"], r["forecast_date"]): r for r in once.collect()}
    june = dt.date(2024, 6, 1)
    assert rows[1, june]["predicted_demand"] == 31 and rows[1, june]["forecast_id"] == 1
    assert rows[4, june]["forecast_id"] is None and rows[4, june]["actual_demand"] is None
    assert rows[1, dt.date(2024, 5, 1)]["accuracy_pct"] == Decimal("80.00")
    assert once.count() == 8
    twice = demand.upsert_forecast(new, once)
    assert sorted(map(repr, twice.collect())) == sorted(map(repr, once.collect()))


def test_accuracy_and_bands(spark):
    df = spark.createDataFrame(
        [(1, Decimal(9), Decimal(10)), (2, Decimal(4), Decimal(3)), (3, Decimal(3), Decimal(2)), (4, Decimal(3), None), (5, Decimal(0), Decimal(0)), (6, Decimal(0), Decimal(4))],
        "id int, predicted_demand decimal(10,2), actual_demand decimal(10,2)",
    )
    found = {r["id"]: (r["accuracy_pct"], r["accuracy_band"]) for r in demand.accuracy_band(demand.forecast_accuracy(df)).collect()}
    assert found == {
        1: (Decimal("90.00"), "good"),
        2: (Decimal("75.00"), "fair"),
        3: (Decimal("66.67"), "poor"),
        4: (None, None),
        5: (None, None),
        6: (Decimal("0.00"), "poor"),
    }


def test_actuals_fill_only_sold_months(shop):
    filled = demand.record_actuals(shop["demand_forecast"], shop["transactions"])
    found = {(r["product_id"], str(r["forecast_date"])): r["actual_demand"] for r in filled.collect()}
    assert found == {(1, "2024-06-01"): None, (1, "2024-05-01"): 10, (2, "2024-05-01"): 3}


def test_history_keeps_newest_rows_per_product(spark, shop):
    months = spark.sql(
        "SELECT CAST(p AS BIGINT) AS product_id, add_months(DATE'2022-01-01', m) AS forecast_date, "
        "CAST(m AS DECIMAL(10,2)) AS predicted_demand FROM (SELECT explode(sequence(1, 2)) AS p), "
        "LATERAL (SELECT explode(sequence(1, 14)) AS m)"
    )
    found = demand.forecast_history(months, shop["products"])
    assert found.count() == 24
    assert min(rows_of(found, "predicted_demand")) == 3
    one = demand.forecast_history(months, shop["products"], product_id=2, rows=1)
    assert rows_of(one, "product_name", "stock_status", "predicted_demand") == [("Blocks", "REORDER NEEDED", 14)]
    listed = rows_of(demand.forecast_history_all(shop["demand_forecast"], shop["products"]), "forecast_date", "product_name")
    assert [name for _, name in listed] == ["Kite", "Blocks", "Kite"]


def test_rolling_forecast_uses_earlier_months_only(spark):
    tx = spark.createDataFrame(
        [(1, 4, "2024-01-05"), (1, 8, "2024-03-05"), (1, 3, "2024-04-05")], "product_id bigint, quantity int, d string"
    ).selectExpr("*", "CAST(d AS timestamp_ntz) AS transaction_date", "'completed' AS status")
    found = rows_of(demand.rolling_forecast(tx).orderBy("forecast_date"), "predicted_demand", "actual_demand", "accuracy_pct")
    assert found == [(4, 8, Decimal("50.00")), (6, 3, Decimal("50.00"))]
