"""Money: exact decimals in, formatted text out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from aisle.schemas import AMOUNT, PRICE


def amount(value: Column) -> Column:
    """Cast to the line-total type, decimal(12,2), rounding half up."""
    return value.cast(AMOUNT)


def price(value: Column) -> Column:
    """Cast to the unit-price type, decimal(10,2), rounding half up."""
    return value.cast(PRICE)


def money_text(value: Column) -> Column:
    """``1234.5`` → ``1,234.50``; rounds half up before formatting (the formatter rounds to even)."""
    return F.format_number(F.round(value, 2), 2)


def average(total: Column, rows: Column) -> Column:
    """Total over row count as a double; NULL when there are no rows."""
    return F.when(rows > 0, total.cast("double") / rows)
