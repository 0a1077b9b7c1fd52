"""Business labels: stock state, forecast accuracy, spending tiers, fraud indicators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from aisle.functions.dates import hour_between
from aisle.schemas import PERCENT

# Labels and cut-offs that results must carry.
REORDER_NEEDED, STOCK_OK = "REORDER NEEDED", "OK"
OUT_OF_STOCK, LOW_STOCK, IN_STOCK = "Out of Stock", "Low Stock", "In Stock"
GOOD_ACCURACY, FAIR_ACCURACY = 90, 75
TIERS = ("Platinum", "Gold", "Silver", "Bronze")
LABEL_LENGTH = 18


def is_low(stock: Column, reorder: Column) -> Column:
    return stock <= reorder


def low_stock_flag(stock: Column, reorder: Column) -> Column:
    """1 when stock is at or below the reorder level, else 0."""
    return F.when(is_low(stock, reorder), 1).otherwise(0)


def stock_status(stock: Column, reorder: Column) -> Column:
    return F.when(is_low(stock, reorder), REORDER_NEEDED).otherwise(STOCK_OK)


def stock_label(stock: Column, reorder: Column) -> Column:
    return (
        F.when(stock == 0, OUT_OF_STOCK).when(is_low(stock, reorder), LOW_STOCK).otherwise(IN_STOCK)
    )


def stock_fill_pct(stock: Column, reorder: Column) -> Column:
    """Stock as a whole percent of three reorder levels, at most 100; 100 without a level."""
    filled = F.floor(stock / (reorder * F.lit(3.0)) * 100 + 0.5)
    return F.when(reorder > 0, F.least(F.lit(100).cast("bigint"), filled)).otherwise(F.lit(100))


def accuracy_pct(predicted: Column, actual: Column) -> Column:
    """100 · smaller / larger, two decimals. NULL without an actual or when both are zero."""
    larger = F.greatest(predicted, actual)
    smaller = F.least(predicted, actual)
    return F.when(actual.isNotNull() & (larger > 0), F.round(smaller * 100 / larger, 2).cast(PERCENT))


def accuracy_band(pct: Column) -> Column:
    return (
        F.when(pct.isNull(), F.lit(None).cast("string"))
        .when(pct >= GOOD_ACCURACY, "good")
        .when(pct >= FAIR_ACCURACY, "fair")
        .otherwise("poor")
    )


def spending_tier(quartile: Column) -> Column:
    platinum, gold, silver, bronze = TIERS
    return (
        F.when(quartile == 1, platinum)
        .when(quartile == 2, gold)
        .when(quartile == 3, silver)
        .otherwise(bronze)
    )


def fraud_indicator(
    amount: Column,
    seconds_since_last: Column,
    quantity: Column,
    ts: Column,
    *,
    high_amount: float,
    rapid_seconds: int,
    high_quantity: int,
    night_amount: float,
    night_hours: tuple[int, int],
) -> Column:
    """First matching rule, strongest first."""
    return (
        F.when(amount > high_amount, "HIGH_AMOUNT")
        .when(seconds_since_last <= rapid_seconds, "RAPID_SUCCESSION")
        .when(quantity > high_quantity, "UNUSUAL_QUANTITY")
        .when(hour_between(ts, *night_hours) & (amount > night_amount), "LATE_NIGHT_HIGH_VALUE")
        .otherwise("NORMAL")
    )


def short_label(text: Column, length: int = LABEL_LENGTH) -> Column:
    """Chart label: cut to ``length`` characters with an ellipsis."""
    return F.when(
        F.length(text) > length, F.concat(F.substring(text, 1, length), F.lit("…"))
    ).otherwise(text)


def without_prefix(text: Column, prefix: str) -> Column:
    """Chart label: the first occurrence of ``prefix`` removed."""
    at = F.locate(prefix, text)
    return F.when(
        at > 0, F.concat(F.substring(text, F.lit(1), at - 1), F.substring(text, at + len(prefix), F.length(text)))
    ).otherwise(text)
