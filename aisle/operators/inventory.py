"""Stock: positions after sales, low-stock reports, the movement log and restocking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aisle.functions import labels
from aisle.operators.filters import completed_sales
from aisle.operators.sales import limited, with_category
from aisle.plans.positions import positions

LOG_LIMIT = 200
NAMES_PER_ROW = 1_000


def _stock() -> tuple[Column, Column]:
    return F.col("stock_quantity"), F.col("reorder_level")


def sold_units(transactions: DataFrame) -> DataFrame:
    """Units sold per product; only completed sales move stock."""
    return completed_sales(transactions).groupBy("product_id").agg(F.sum("quantity").alias("sold"))


def subtract_sold(products: DataFrame, sold: DataFrame) -> DataFrame:
    """Products with ``sold`` units taken off their stock; there is no floor at zero."""
    left = F.col("stock_quantity") - F.coalesce("sold", F.lit(0))
    return products.join(sold, "product_id", "left").select(
        *[left.alias(c) if c == "stock_quantity" else F.col(c) for c in products.columns]
    )


def apply_sales_to_stock(products: DataFrame, transactions: DataFrame) -> DataFrame:
    """Products after a batch of transactions, or after the whole history from opening stock."""
    return subtract_sold(products, sold_units(transactions))


def stock_position(products: DataFrame, transactions: DataFrame) -> DataFrame:
    """Opening stock, units sold and stock now, per product, with its status."""
    sold = sold_units(transactions)
    opening, reorder = _stock()
    now = opening - F.coalesce("sold", F.lit(0))
    return products.join(sold, "product_id", "left").select(
        "product_id",
        "product_name",
        opening.alias("opening_stock"),
        F.coalesce("sold", F.lit(0)).alias("units_sold"),
        now.alias("stock_quantity"),
        "reorder_level",
        labels.stock_status(now, reorder).alias("stock_status"),
    )


def sale_log(transactions: DataFrame) -> DataFrame:
    """Log rows of completed sales, without ids."""
    return completed_sales(transactions).select(
        "product_id",
        "store_id",
        F.lit("sale").alias("change_type"),
        (-F.col("quantity")).alias("quantity_change"),
        F.col("transaction_date").alias("log_date"),
        F.concat(
            F.lit("Auto-logged from transaction #"), F.col("transaction_id").cast("string")
        ).alias("notes"),
    )


def low_stock(products: DataFrame, categories: DataFrame | None = None) -> DataFrame:
    """Products at or below their reorder level, most units needed first."""
    stock, reorder = _stock()
    low = products.filter(labels.is_low(stock, reorder))
    return (
        with_category(low, categories)
        .select(
            "product_id",
            "product_name",
            "category_name",
            "stock_quantity",
            "reorder_level",
            (reorder - stock).alias("units_needed"),
        )
        .orderBy(F.desc("units_needed"), "product_id")
    )


def low_stock_flag(products: DataFrame) -> DataFrame:
    return products.withColumn("low_stock", labels.low_stock_flag(*_stock()))


def stock_status(products: DataFrame) -> DataFrame:
    return products.withColumn("stock_status", labels.stock_status(*_stock()))


def out_of_stock(products: DataFrame) -> DataFrame:
    return products.filter(F.col("stock_quantity") == 0)


def stock_label(products: DataFrame) -> DataFrame:
    return products.withColumn("stock_label", labels.stock_label(*_stock()))


def stock_fill_pct(products: DataFrame) -> DataFrame:
    return products.withColumn("stock_fill_pct", labels.stock_fill_pct(*_stock()))


def stock_alert_list(
    products: DataFrame, names_per_row: int = NAMES_PER_ROW, *, spread: bool | None = None
) -> DataFrame:
    """The alert shown above the products: its level and the names, joined by ', '.

    Out-of-stock products if there are any, else low ones. The names come in rows of at most
    ``names_per_row``, numbered by ``part``, so no value grows with the table; joined in order of
    ``part`` they are the full list. ``alerts`` is the number of products in the whole list.
    """
    stock, reorder = _stock()
    level = F.when(stock == 0, "out_of_stock").otherwise("low_stock")
    low = products.filter((stock == 0) | labels.is_low(stock, reorder)).select(
        "product_id", "product_name", level.alias("level")
    )
    # 'out_of_stock' sorts last, so it is the largest level present; one row
    strongest = low.agg(F.max("level").alias("level"))
    listed = low.join(F.broadcast(strongest), "level")
    by_name = [("product_name", True), ("product_id", True)]
    numbered = positions(listed, by_name, [], rows=products.count(), spread=spread)
    name = F.struct("row_no", "product_name")
    return numbered.groupBy(
        "level", F.floor((F.col("row_no") - 1) / names_per_row).alias("part"), F.col("group_rows").alias("alerts")
    ).agg(F.array_join(F.sort_array(F.collect_list(name)).getField("product_name"), ", ").alias("names"))


def inventory_history(
    log: DataFrame, products: DataFrame, stores: DataFrame, limit: int | None = LOG_LIMIT, *, enforced_keys: bool = True
) -> DataFrame:
    """The newest log entries with names. The log's foreign keys are mandatory, so it is cut first."""
    newest = [F.desc("log_date"), F.asc("log_id")]
    if enforced_keys and limit is not None:
        log = limited(log.orderBy(*newest), limit)
    named = (
        log.join(products.select("product_id", "product_name"), "product_id")
        .join(stores.select("store_id", "store_name"), "store_id")
        .select("log_id", "product_name", "store_name", "change_type", "quantity_change", "log_date", "notes")
        .orderBy(*newest)
    )
    return limited(named, limit)


def restock(products: DataFrame, deliveries: DataFrame) -> DataFrame:
    """Products after adding delivered units; several deliveries of one product add up.

    ``deliveries`` has product_id and quantity; :func:`rejected_deliveries` has those that do not count.
    """
    arrived = (
        deliveries.filter(F.col("quantity") >= 1).groupBy("product_id").agg(F.sum("quantity").alias("arrived"))
    )
    stock = F.col("stock_quantity") + F.coalesce("arrived", F.lit(0))
    return products.join(arrived, "product_id", "left").select(
        *[stock.alias(c) if c == "stock_quantity" else F.col(c) for c in products.columns]
    )


def rejected_deliveries(products: DataFrame, deliveries: DataFrame) -> DataFrame:
    """Deliveries that change no stock, whole, with the ``problem``."""
    known = products.select("product_id").distinct().withColumn("known", F.lit(True))
    problem = (
        F.when(F.col("quantity").isNull(), "missing quantity")
        .when(F.col("quantity") < 1, "quantity below 1")
        .when(F.col("known").isNull(), "unknown product_id")
    )
    found = deliveries.join(known, "product_id", "left").withColumn("problem", problem)
    return found.filter(F.col("problem").isNotNull()).select(*deliveries.columns, "problem")


def restock_log(deliveries: DataFrame, log_date: Column, notes: str = "Restock") -> DataFrame:
    """Log rows for deliveries that carry a store, without ids."""
    return deliveries.filter(F.col("quantity") >= 1).select(
        "product_id",
        "store_id",
        F.lit("restock").alias("change_type"),
        F.col("quantity").alias("quantity_change"),
        log_date.alias("log_date"),
        F.lit(notes).alias("notes"),
    )
