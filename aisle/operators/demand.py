"""Demand: monthly units, next-month forecasts, forecast history and accuracy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aisle.functions import labels
from aisle.functions.dates import Day, day, month_start, next_month_start
from aisle.operators.filters import completed_sales, existing, trailing_months
from aisle.schemas import PERCENT, PRICE

WINDOW_MONTHS = 3
HISTORY_ROWS = 12


def monthly_demand(
    transactions: DataFrame,
    as_of: Day | None = None,
    months: int | None = WINDOW_MONTHS,
    *,
    complete_months: bool = False,
) -> DataFrame:
    """Units per product and calendar month.

    By default the window starts ``months`` before ``as_of`` to the day and has no end, so its first
    month may be partial. ``complete_months`` takes the ``months`` whole calendar months before the
    month of ``as_of``. ``months=None`` covers all history.
    """
    sales = completed_sales(transactions)
    if months is not None and complete_months:
        this_month = F.trunc(day(as_of), "MM")
        ts = F.col("transaction_date")
        sales = sales.filter((ts >= F.add_months(this_month, -months)) & (ts < this_month))
    elif months is not None:
        sales = trailing_months(sales, as_of, months)
    return sales.groupBy("product_id", month_start(F.col("transaction_date")).alias("month_start")).agg(
        F.sum("quantity").alias("monthly_qty")
    )


def forecast_demand(
    transactions: DataFrame,
    products: DataFrame,
    as_of: Day | None = None,
    product_ids: DataFrame | None = None,
    *,
    complete_months: bool = False,
) -> DataFrame:
    """Next month's demand for every product: the mean of its months with sales, zero without any.

    The mean is taken over the months that have sales only. ``product_ids`` restricts the products;
    see :func:`unknown_products` for ids that do not exist.
    """
    if product_ids is not None:
        wanted = product_ids.select("product_id").distinct()
        products = products.join(wanted, "product_id", "left_semi")
        transactions = transactions.join(wanted, "product_id", "left_semi")
    mean = (
        monthly_demand(transactions, as_of, complete_months=complete_months)
        .groupBy("product_id")
        .agg(F.sum("monthly_qty").alias("units"), F.count("*").alias("months"))
        .select("product_id", F.round(F.col("units").cast("decimal(20,0)") / F.col("months"), 2).cast(PRICE).alias("mean"))
    )
    return products.select("product_id").join(mean, "product_id", "left").select(
        "product_id",
        next_month_start(as_of).alias("forecast_date"),
        F.coalesce("mean", F.lit(0).cast(PRICE)).alias("predicted_demand"),
    )


def unknown_products(product_ids: DataFrame, products: DataFrame) -> DataFrame:
    """Requested ids without a product; the forecast leaves these out."""
    return existing(products, product_ids.select("product_id"), "product_id")[1]


def upsert_forecast(new: DataFrame, forecast: DataFrame) -> DataFrame:
    """The forecast table after setting predictions by (product, month).

    Existing rows keep actual demand and accuracy; missing ones are added without either. Columns
    other than these are not touched for existing rows and NULL for new ones.
    """
    key = ["product_id", "forecast_date"]
    incoming = new.select(*key, F.col("predicted_demand").alias("new_demand"))
    joined = forecast.join(incoming, key, "full")
    return joined.select(
        *[
            F.coalesce("new_demand", "predicted_demand").alias("predicted_demand")
            if c == "predicted_demand"
            else F.col(c)
            for c in forecast.columns
        ]
    )


def record_actuals(forecast: DataFrame, transactions: DataFrame) -> DataFrame:
    """Fill actual demand of each forecast month from completed sales, then the accuracy."""
    actual = monthly_demand(transactions, months=None).select(
        "product_id",
        F.col("month_start").alias("forecast_date"),
        F.col("monthly_qty").cast(PRICE).alias("sold"),
    )
    kept = [c for c in forecast.columns if c not in ("actual_demand", "accuracy_pct")]
    joined = forecast.join(actual, ["product_id", "forecast_date"], "left")
    value = F.coalesce("sold", "actual_demand") if "actual_demand" in forecast.columns else F.col("sold")
    return forecast_accuracy(joined.select(*kept, value.cast(PRICE).alias("actual_demand")))


def forecast_accuracy(forecast: DataFrame) -> DataFrame:
    """accuracy_pct from predicted and actual demand."""
    pct = labels.accuracy_pct(F.col("predicted_demand"), F.col("actual_demand"))
    return forecast.withColumn("accuracy_pct", pct.cast(PERCENT))


def accuracy_band(forecast: DataFrame) -> DataFrame:
    return forecast.withColumn("accuracy_band", labels.accuracy_band(F.col("accuracy_pct")))


def rolling_forecast(transactions: DataFrame, months: int = WINDOW_MONTHS) -> DataFrame:
    """Forecast rows a monthly run over all history would have stored.

    One row per product and month with sales after its first; the prediction averages the up to
    ``months`` selling months before it. A product contributes one window row per month.
    """
    before = Window.partitionBy("product_id").orderBy("month_start").rowsBetween(-months, -1)
    units, count = F.sum("monthly_qty").over(before), F.count("*").over(before)
    rows = monthly_demand(transactions, months=None).select(
        "product_id",
        F.col("month_start").alias("forecast_date"),
        F.round(units.cast("decimal(20,0)") / count, 2).cast(PRICE).alias("predicted_demand"),
        F.col("monthly_qty").cast(PRICE).alias("actual_demand"),
    )
    return forecast_accuracy(rows.filter(F.col("predicted_demand").isNotNull()))


def _status() -> Column:
    return labels.stock_status(F.col("stock_quantity"), F.col("reorder_level")).alias("stock_status")


def _with_product(forecast: DataFrame, products: DataFrame) -> DataFrame:
    shown = products.select("product_id", "product_name", "stock_quantity", "reorder_level")
    return forecast.join(shown, "product_id").select("*", _status())


def forecast_history(
    forecast: DataFrame, products: DataFrame, product_id=None, rows: int | None = HISTORY_ROWS
) -> DataFrame:
    """The newest ``rows`` forecasts per product, or of one product, with stock status; all for None."""
    if product_id is not None:
        forecast = forecast.filter(F.col("product_id") == product_id)
    if rows is None:
        return _with_product(forecast, products).orderBy("product_id", F.desc("forecast_date"))
    newest = Window.partitionBy("product_id").orderBy(F.desc("forecast_date"))
    recent = forecast.withColumn("nth", F.row_number().over(newest)).filter(F.col("nth") <= rows).drop("nth")
    return _with_product(recent, products).orderBy("product_id", F.desc("forecast_date"))


def forecast_history_all(forecast: DataFrame, products: DataFrame) -> DataFrame:
    """Every forecast with its product and stock status, newest month first, then by name."""
    return _with_product(forecast, products).orderBy(F.desc("forecast_date"), "product_name", "product_id")
