"""The application's pages as sets of DataFrames, and its views for SQL users.

``tables`` maps table names to DataFrames, for example from :func:`aisle.sources.tables.scan_all`.
Apart from size checks and the forecast run, nothing runs until a result is used.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from aisle.functions.dates import Day
from aisle.operators import changes, demand, fraud, inventory, paging, ranking, sales
from aisle.operators.fraud import DEFAULT, Thresholds
from aisle.session import materialise

Tables = Mapping[str, DataFrame]
Report = dict[str, DataFrame]


def dashboard(tables: Tables, as_of: Day | None = None) -> Report:
    """Headline figures and the twelve-month trend."""
    return {
        "summary": sales.dashboard_kpis(tables["transactions"]),
        "fraud_alerts": sales.open_fraud_count(tables["fraud_flags"]),
        "low_stock_items": sales.low_stock_count(tables["products"]),
        "monthly_trend": sales.monthly_trend(tables["transactions"], as_of),
    }


def sales_page(
    tables: Tables, start: Day, end: Day, store_id=None, category_id=None, limit: int | None = sales.LISTING_LIMIT
) -> Report:
    """The sales of a period: the newest ``limit`` as a listing (all for None), figures over all of them."""
    options = {"start": start, "end": end, "store_id": store_id, "category_id": category_id}
    parts = [tables[name] for name in ("transactions", "customers", "products", "stores", "categories")]
    every = sales.sales_rows(*parts, **options)
    return {
        "transactions": sales.sales_detail(*parts, **options, limit=limit),
        "by_category": sales.revenue_by_category(
            tables["transactions"], tables["products"], tables["categories"], **options
        ),
        "summary": sales.sales_page_summary(every),
        "top_products": sales.top_products_by_name(every),
    }


def sales_summary(tables: Tables, start: Day, end: Day) -> Report:
    """Figures, best products and best stores of a period."""
    return sales.sales_summary(
        tables["transactions"], tables["products"], tables["stores"], start, end, tables["categories"]
    )


def demand_page(tables: Tables, product_id=None) -> Report:
    """Stored forecasts, of one product or all, and the products to reorder."""
    forecast, products = tables["demand_forecast"], tables["products"]
    if product_id is None:
        rows = demand.forecast_history_all(forecast, products)
    else:
        rows = demand.forecast_history(forecast, products, product_id)
    return {
        "forecast": demand.accuracy_band(rows),
        "low_stock_alerts": inventory.low_stock(products, tables["categories"]),
    }


def run_forecast(tables: Tables, as_of: Day | None = None, product_ids: DataFrame | None = None) -> Report:
    """New predictions, the forecast table with them, and requested products that do not exist.

    The predictions are stored once, as the numbering of added rows reads them several times.
    """
    new = materialise(demand.forecast_demand(tables["transactions"], tables["products"], as_of, product_ids))
    table = demand.upsert_forecast(new, tables["demand_forecast"])
    numbered = changes.with_missing_ids(table, "forecast_id", ["product_id", "forecast_date"])
    report = {"predictions": new, "demand_forecast": numbered}
    if product_ids is not None:
        report["unknown_products"] = demand.unknown_products(product_ids, tables["products"])
    return report


def fraud_page(tables: Tables, severity: str | None = None, resolved: int | None = None) -> Report:
    """Flags with their sale, the counts over all flags, and the alert level."""
    flags = tables["fraud_flags"]
    return {
        "flags": fraud.fraud_flag_detail(
            flags,
            tables["transactions"],
            tables["customers"],
            tables["products"],
            tables["stores"],
            severity=severity,
            resolved=resolved,
        ),
        "stats": fraud.fraud_stats(flags),
        "alert": fraud.fraud_alert_level(flags),
        "by_severity": fraud.flags_by_severity(flags),
    }


def run_fraud_detection(tables: Tables, limits: Thresholds = DEFAULT) -> Report:
    """Flags to append and how many there are per rule."""
    new = fraud.detect_fraud(tables["transactions"], tables["products"], tables["fraud_flags"], limits)
    return {"new_flags": new, "counts": fraud.new_flag_count(new)}


def transactions_page(tables: Tables, page: int = 1, per_page: int = 20) -> Report:
    """One page of all transactions with their flag mark, and the totals."""
    found = paging.transactions_page(
        tables["transactions"],
        tables["customers"],
        tables["products"],
        tables["stores"],
        tables["fraud_flags"],
        page,
        per_page,
    )
    return {"transactions": found.rows, "pagination": found.totals}


def create_views(tables: Tables) -> list[str]:
    """Temporary views with the published names, for use from SQL; returns the names.

    The rankings choose their plan when the view is created, from the size of the tables then.
    """
    transactions, products = tables["transactions"], tables["products"]
    views = {
        "vw_sales_ranking": ranking.sales_ranking(transactions, products, tables["categories"]),
        "vw_running_total": ranking.running_total(transactions, tables["stores"]),
        "vw_customer_spending": ranking.customer_spending(transactions, tables["customers"]),
        "vw_fraud_analysis": fraud.fraud_analysis(
            transactions, tables["fraud_flags"], tables["customers"], products, tables["stores"]
        ),
    }
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return list(views)
