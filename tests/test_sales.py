from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest
from conftest import rows_of, when

from aisle.functions.labels import short_label, without_prefix
from aisle.operators import filters, paging, ranking, sales
from pyspark.sql import functions as F


def one(df) -> dict:
    rows = df.collect()
    assert len(rows) == 1
    return rows[0].asDict()


def test_dashboard_counts_completed_only(shop):
    found = one(sales.dashboard_kpis(shop["transactions"]))
    assert found == {
        "total_revenue": Decimal("14085.01"),
        "total_transactions": 11,
        "total_units_sold": 98,
        "unique_customers": 5,
    }


def test_empty_tables_give_zero_or_null(empty):
    assert one(sales.dashboard_kpis(empty["transactions"]))["total_revenue"] == 0
    summary = one(sales.summary_kpis(empty["transactions"], "2024-01-01", "2024-12-31"))
    assert summary["total_transactions"] == 0 and summary["unique_customers"] == 0
    assert summary["total_revenue"] is None and summary["avg_transaction_value"] is None
    assert one(sales.sales_page_summary(empty["transactions"]))["average"] == 0
    assert sales.revenue_by_category(empty["transactions"], empty["products"], empty["categories"]).count() == 0


def test_date_range_includes_both_days(shop):
    picked = filters.between_dates(shop["transactions"], "2024-01-31", "2024-02-29")
    assert sorted(rows_of(picked, "transaction_id")) == [1, 2]
    assert sorted(rows_of(filters.between_dates(shop["transactions"], None, "2024-02-29"), "transaction_id")) == [1, 2]
    assert filters.between_dates(shop["transactions"], "2024-05-31", None).count() == 1
    assert filters.between_dates(shop["transactions"], None, None).count() == 14


def test_trailing_months_clamps_to_short_months(shop):
    recent = filters.trailing_months(shop["transactions"], "2024-05-31", 3)  # from 29 February
    assert 2 in rows_of(recent, "transaction_id") and 1 not in rows_of(recent, "transaction_id")


def test_monthly_trend_is_ordered(shop):
    found = rows_of(sales.monthly_trend(shop["transactions"], "2024-06-30"))
    assert [m for m, _, _ in found] == ["2024-01", "2024-02", "2024-03", "2024-04", "2024-05"]
    assert found[2] == ("2024-03", Decimal("4000.00"), 3)


def test_top_products_breaks_ties_by_id_and_checks_limit(shop):
    found = rows_of(sales.top_products(shop["transactions"], shop["products"], 3, shop["categories"]), "product_id", "revenue")
    assert found == [(1, Decimal("10000.01")), (2, Decimal("4000.00")), (3, Decimal("40.00"))]
    assert sales.top_products(shop["transactions"], shop["products"], None, shop["categories"]).count() == 5
    with pytest.raises(ValueError):
        sales.top_products(shop["transactions"], shop["products"], 50, shop["categories"], most=sales.TOP_PRODUCTS_MAX)
    with pytest.raises(ValueError):
        sales.top_products(shop["transactions"], shop["products"], 0, shop["categories"])


def test_period_summary_has_three_results(shop):
    found = sales.sales_summary(
        shop["transactions"], shop["products"], shop["stores"], "2024-03-01", "2024-04-30", shop["categories"]
    )
    assert one(found["kpis"])["total_revenue"] == Decimal("4025.00")
    assert rows_of(found["top_products"], "product_id", "units_sold") == [(2, 3), (4, 10)]
    assert rows_of(found["top_stores"], "store_id", "transaction_count") == [(1, 2), (2, 4)]


def test_category_revenue_and_share(shop):
    found = rows_of(sales.category_revenue_share(shop["transactions"], shop["products"], shop["categories"]))
    assert [(c, str(r)) for c, r, _, _ in found] == [("Toys", "14000.01"), ("Pantry", "65.00"), ("Garden", "20.00")]
    assert sum(share for *_, share in found) == pytest.approx(100)
    filtered = sales.revenue_by_category(
        shop["transactions"], shop["products"], shop["categories"], start="2024-03-01", end="2024-05-31", store_id=2, category_id=2
    )
    assert rows_of(filtered) == [("Pantry", Decimal("65.00"), 14)]


def test_store_performance_keeps_stores_without_sales(shop):
    found = {r["store_id"]: r for r in sales.store_performance(shop["stores"], shop["transactions"]).collect()}
    assert found[3]["total_transactions"] == 0 and found[3]["total_revenue"] == 0
    assert found[3]["avg_transaction"] == 0 and found[3]["unique_customers"] == 0
    assert found[1]["unique_customers"] == 3 and found[1]["manager_name"] == "Max"


def test_customer_spend_keeps_customers_without_sales(shop):
    found = rows_of(sales.customer_spend(shop["customers"], shop["transactions"]), "customer_id", "total_transactions", "total_spent")
    assert found[0] == (1, 2, Decimal("10000.01")) and found[-1] == (6, 0, Decimal("0.00"))


@pytest.mark.parametrize("enforced", [True, False])
def test_sales_detail_newest_first(shop, enforced):
    found = sales.sales_detail(
        shop["transactions"], shop["customers"], shop["products"], shop["stores"], shop["categories"],
        limit=3, enforced_keys=enforced,
    )
    assert rows_of(found, "transaction_id", "customer_name", "category_name", "status") == [
        (12, "Eve", "Garden", "completed"),
        (11, "Di", "Pantry", "completed"),
        (9, "Di", "Pantry", "completed"),
    ]
    pantry = sales.sales_detail(
        shop["transactions"], shop["customers"], shop["products"], shop["stores"], shop["categories"],
        category_id=2, store_id=2, end="2024-04-30", limit=2, enforced_keys=enforced,
    )
    assert rows_of(pantry, "transaction_id") == [8, 7]


def test_listing_summary_and_names(shop):
    rows = sales.sales_rows(shop["transactions"], shop["customers"], shop["products"], shop["stores"], shop["categories"])
    assert one(sales.sales_page_summary(rows))["sales"] == 11
    assert rows_of(sales.top_products_by_name(rows, 2), "product_name") == ["Kite", "Blocks"]


def test_catalog_employees_categories(shop):
    catalog = rows_of(sales.product_catalog(shop["products"], shop["categories"]), "product_name", "low_stock")
    assert catalog == [("Blocks", 1), ("Honey", 1), ("Kite", 0), ("Rice", 1), ("Seeds", 0), ("Spade", 0)]
    directory = sales.employee_directory(shop["employees"], shop["stores"])
    assert rows_of(directory, "name", "store_name") == [("Amy", "Shop South"), ("Kim", "Shop North"), ("Zed", "Shop North")]
    assert sorted(rows_of(filters.employees_of_store(directory, 1), "name")) == ["Kim", "Zed"]
    named = sales.with_category(shop["products"], shop["categories"])
    assert rows_of(sales.distinct_categories(named)) == [("Garden",), ("Pantry",), ("Toys",)]


def test_search_ignores_case_over_all_rows(shop):
    assert rows_of(filters.search_rows(shop["products"], "RICE", ["product_name"]), "product_id") == [4]
    assert filters.search_rows(shop["products"], "RICE", ["product_name"], case_insensitive=False).count() == 0
    assert filters.search_rows(shop["products"], "", ["product_name"]).count() == 6
    assert rows_of(filters.with_prefix(shop["products"], "product_name", "S"), "product_id") == [5, 6]


def test_existing_ids_split(spark, shop):
    wanted = spark.createDataFrame([(1,), (99,)], "product_id bigint")
    known, unknown = filters.existing(shop["products"], wanted, "product_id")
    assert rows_of(known) == [(1,)] and rows_of(unknown) == [(99,)]


def test_ranking_by_revenue_category_and_units(shop):
    found = {
        r["product_id"]: (r["revenue_rank"], r["category_rank"], r["units_rank"])
        for r in ranking.sales_ranking(shop["transactions"], shop["products"], shop["categories"]).collect()
    }
    assert found == {1: (1, 1, 1), 2: (2, 2, 5), 3: (3, 1, 4), 4: (4, 2, 3), 6: (5, 1, 2)}


def test_running_total_selling_days_and_calendar(spark, shop):
    selling = ranking.running_total(shop["transactions"], shop["stores"], rolling=2)
    north = sorted(rows_of(selling.filter("store_id = 1"), "sale_date", "running_total", "rolling_7day_avg"))
    assert north[1] == (dt.date(2024, 2, 29), Decimal("10000.01"), pytest.approx(5000.005))
    calendar = ranking.running_total(shop["transactions"], shop["stores"], rolling=2, calendar=True)
    north = sorted(rows_of(calendar.filter("store_id = 1"), "sale_date", "rolling_7day_avg"))
    assert north[1][1] == pytest.approx(5000.01) and north[2][1] == pytest.approx((5000.01 + 1500) / 2)


def test_customer_spending_tiers_uneven(shop):
    found = ranking.customer_spending(shop["transactions"], shop["customers"]).collect()
    tiers = {r["customer_id"]: (r["spending_quartile"], r["customer_tier"]) for r in found}
    assert tiers == {1: (1, "Platinum"), 2: (1, "Platinum"), 4: (2, "Gold"), 3: (3, "Silver"), 5: (4, "Bronze")}
    percentiles = {r["customer_id"]: r["spending_percentile"] for r in found}
    assert percentiles[1] == 1.0 and percentiles[5] == 0.0 and percentiles[4] == 0.5
    assert 6 not in tiers


def test_flag_mark_does_not_multiply_rows(shop):
    found = paging.transactions_flagged(shop["transactions"], shop["customers"], shop["products"], shop["stores"], shop["fraud_flags"])
    marks = dict(rows_of(found, "transaction_id", "is_flagged"))
    assert len(marks) == found.count() == 14
    assert [i for i, m in marks.items() if m] in ([2, 3], [3, 2])


def test_pages_cover_everything_once(shop):
    seen = []
    for number in range(1, 5):
        page = paging.transactions_page(
            shop["transactions"], shop["customers"], shop["products"], shop["stores"], shop["fraud_flags"], number, 4
        )
        seen += rows_of(page.rows, "transaction_id")
    assert sorted(seen) == list(range(1, 15))
    assert rows_of(page.totals) == [(4, 4, 14, 4, 13, 14)]
    with pytest.raises(ValueError):
        paging.page_bounds(1, 0)
    assert paging.page_bounds(0, 500) == (0, 500)
    with pytest.raises(ValueError):
        paging.page_bounds(1, 500, paging.MAX_PER_PAGE)


def test_deep_page_and_key_page_agree_with_offset(shop):
    tx = shop["transactions"]
    near = rows_of(paging.page_rows(tx, paging.NEWEST, paging.BY_ID, 2, 5), "transaction_id")
    deep = rows_of(paging.page_rows(tx, paging.NEWEST, paging.BY_ID, 2, 5, shallow=0), "transaction_id")
    first = paging.page_rows(tx, paging.NEWEST, paging.BY_ID, 1, 5).collect()[-1]
    after = rows_of(paging.page_after(tx, first["transaction_date"], first["transaction_id"], 5), "transaction_id")
    assert near == deep == after


def test_resort_is_numeric(shop):
    assert rows_of(paging.resorted(shop["products"], "stock_quantity"), "stock_quantity") == [0, 3, 5, 10, 12, 400]


def test_chart_labels(spark):
    df = spark.createDataFrame([("A very long product name",), ("Shop A",)], "t string")
    assert rows_of(df.select(short_label(F.col("t")))) == [("A very long produc…",), ("Shop A",)]
    assert rows_of(df.select(without_prefix(F.col("t"), "Shop ").alias("t")), "t")[1] == "A"


def test_month_of_last_second(shop):
    may = filters.between_dates(shop["transactions"], "2024-05-31", "2024-05-31")
    assert rows_of(may, "transaction_date") == [when("2024-05-31 23:59:59")]
