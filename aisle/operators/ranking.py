"""Ranked and running reports: product ranking, store running totals, customer spending tiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aisle.functions.labels import spending_tier
from aisle.functions.money import average
from aisle.operators.filters import completed_sales
from aisle.operators.sales import product_sales, with_category
from aisle.plans.positions import ntile, percent_rank_reversed, positions

ROLLING_DAYS = 7


def sales_ranking(
    transactions: DataFrame,
    products: DataFrame,
    categories: DataFrame | None = None,
    *,
    spread: bool | None = None,
) -> DataFrame:
    """Products with their revenue rank, rank within category and dense rank by units.

    The ranks cover all products, so they are windowed in one task while the product table is small
    and spread over range partitions beyond that.
    """
    named = with_category(products, categories)
    rows = product_sales(transactions).join(
        named.select("product_id", "product_name", "category_id", "category_name"), "product_id"
    )
    by_revenue, by_units, by_id = [("revenue", False)], [("units_sold", False)], [("product_id", True)]
    size = products.count()
    kept = rows.columns

    def ranked(df: DataFrame, order, source: str, name: str, keys: tuple[str, ...] = ()) -> DataFrame:
        numbered = positions(df, order, by_id, keys, rows=size, spread=spread)
        return numbered.select(*df.columns, F.col(source).alias(name))

    rows = ranked(rows, by_revenue, "rank_no", "revenue_rank")
    rows = ranked(rows, by_revenue, "rank_no", "category_rank", ("category_id",))
    rows = ranked(rows, by_units, "dense_no", "units_rank")
    return rows.select(
        "product_id",
        "product_name",
        "category_name",
        F.col("units_sold").alias("total_units_sold"),
        F.col("revenue").alias("total_revenue"),
        *[c for c in rows.columns if c not in kept],
    )


def running_total(
    transactions: DataFrame, stores: DataFrame, *, rolling: int = ROLLING_DAYS, calendar: bool = False
) -> DataFrame:
    """Daily revenue per store with its running total and rolling average.

    Sales are reduced to one row per store and day first, so a window holds at most the days of one
    store. The average covers the last ``rolling`` days with sales, or calendar days if asked.
    """
    daily = (
        completed_sales(transactions)
        .groupBy("store_id", F.to_date("transaction_date").alias("sale_date"))
        .agg(F.sum("total_amount").alias("daily_revenue"))
    )
    by_day = Window.partitionBy("store_id").orderBy("sale_date")
    if calendar:
        recent = Window.partitionBy("store_id").orderBy(F.unix_date("sale_date")).rangeBetween(1 - rolling, 0)
    else:
        recent = by_day.rowsBetween(1 - rolling, 0)
    to_here = by_day.rowsBetween(Window.unboundedPreceding, 0)
    windowed = daily.select(
        "*",
        F.sum("daily_revenue").over(to_here).alias("running_total"),
        average(F.sum("daily_revenue").over(recent), F.count("*").over(recent)).alias("rolling_7day_avg"),
    )
    return windowed.join(stores.select("store_id", "store_name", "city"), "store_id").select(
        "store_id", "store_name", "city", "sale_date", "daily_revenue", "running_total", "rolling_7day_avg"
    )


def customer_spending(
    transactions: DataFrame, customers: DataFrame, *, spread: bool | None = None
) -> DataFrame:
    """Buyers with their totals, spending quartile, decile, percentile and tier."""
    spend = (
        completed_sales(transactions)
        .groupBy("customer_id")
        .agg(
            F.count("*").alias("total_transactions"),
            F.sum("total_amount").alias("total_spent"),
            F.max("total_amount").alias("max_transaction"),
        )
    )
    rows = spend.join(
        customers.select("customer_id", F.col("name").alias("customer_name"), "city"), "customer_id"
    )
    numbered = positions(
        rows, [("total_spent", False)], [("customer_id", True)], rows=customers.count(), spread=spread
    )
    return numbered.select(
        "customer_id",
        "customer_name",
        "city",
        "total_transactions",
        "total_spent",
        average(F.col("total_spent"), F.col("total_transactions")).alias("avg_transaction"),
        "max_transaction",
        ntile(4).alias("spending_quartile"),
        ntile(10).alias("spending_decile"),
        percent_rank_reversed().alias("spending_percentile"),
        spending_tier(ntile(4)).alias("customer_tier"),
    )

