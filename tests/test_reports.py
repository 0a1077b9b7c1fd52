from __future__ import annotations

import pytest
from conftest import rows_of

from aisle import reports


def test_every_report_runs_on_stored_and_empty_tables(spark, shop, empty):
    ids = spark.createDataFrame([(1,), (77,)], "product_id bigint")
    for tables in (shop, empty):
        found = [
            reports.dashboard(tables, "2024-06-01"),
            reports.sales_page(tables, "2024-01-01", "2024-12-31"),
            reports.sales_summary(tables, "2024-01-01", "2024-12-31"),
            reports.demand_page(tables),
            reports.demand_page(tables, product_id=1),
            reports.run_forecast(tables, "2024-05-31", ids),
            reports.fraud_page(tables, severity="high"),
            reports.run_fraud_detection(tables),
            reports.transactions_page(tables),
        ]
        for report in found:
            for name, df in report.items():
                assert df.columns and df.collect() is not None, name


def test_report_contents(spark, shop):
    page = reports.sales_page(shop, "2024-03-01", "2024-05-31", category_id=2)
    assert rows_of(page["by_category"], "category_name") == ["Pantry"]
    assert rows_of(page["summary"], "sales") == [5]
    assert rows_of(page["top_products"], "product_name") == ["Honey", "Rice"]
    run = reports.run_forecast(shop, "2024-05-31", spark.createDataFrame([(1,), (77,)], "product_id bigint"))
    assert rows_of(run["unknown_products"]) == [(77,)]
    assert rows_of(run["predictions"], "product_id") == [1]
    june = run["demand_forecast"].filter("forecast_date = '2024-06-01'")
    assert rows_of(june, "forecast_id", "predicted_demand") == [(1, 31)]
    everything = reports.run_forecast(shop, "2024-05-31")["demand_forecast"]
    assert sorted(rows_of(everything, "forecast_id")) == list(range(1, 9))
    assert dict(rows_of(reports.run_fraud_detection(shop)["counts"]))["total"] == 5
    assert rows_of(reports.demand_page(shop, product_id=1)["forecast"], "accuracy_band") == [None, "fair"]


@pytest.mark.parametrize(
    ("view", "rows"),
    [("vw_sales_ranking", 5), ("vw_running_total", 8), ("vw_customer_spending", 5), ("vw_fraud_analysis", 15)],
)
def test_views_answer_sql(spark, shop, view, rows):
    assert view in reports.create_views(shop)
    assert spark.sql(f"SELECT * FROM {view}").count() == rows
