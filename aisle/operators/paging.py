"""Pages of an ordered listing."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aisle.operators.sales import newest_first, with_dimensions
from aisle.plans.positions import Order, sort_columns
from aisle.plans.selection import rows_at

MAX_PER_PAGE = 100
SALES_PAGE = 25
SHALLOW_ROWS = 10_000  # rows a top-k may keep in one task; deeper pages look for their range first

NEWEST: Order = [("transaction_date", False)]
BY_ID: Order = [("transaction_id", True)]


class Page(NamedTuple):
    rows: DataFrame
    totals: DataFrame


def page_bounds(page: int, per_page: int, most: int | None = None) -> tuple[int, int]:
    """(offset, rows) of a page; pages count from 1. More than a stated ``most`` is an error."""
    if per_page < 1:
        raise ValueError("per_page must be at least 1")
    if most is not None and per_page > most:
        raise ValueError(f"per_page must be at most {most}")
    return (max(1, page) - 1) * per_page, per_page


def page_totals(df: DataFrame, page: int, per_page: int, most: int | None = None) -> DataFrame:
    """page, per_page, total rows, pages, and the first and last row number shown."""
    offset, rows = page_bounds(page, per_page, most)
    total = F.col("total")
    return df.agg(F.count("*").alias("total")).select(
        F.lit(max(1, page)).alias("page"),
        F.lit(rows).alias("per_page"),
        "total",
        F.ceil(total / rows).alias("pages"),
        F.least(F.lit(offset + 1), total).alias("first_row"),
        F.least(F.lit(offset + rows), total).alias("last_row"),
    )


def page_rows(
    df: DataFrame,
    order: Order,
    tie_break: Order,
    page: int,
    per_page: int,
    most: int | None = None,
    shallow: int = SHALLOW_ROWS,
) -> DataFrame:
    """Rows of one page.

    Near the start a bounded top-k with an offset suffices. A deep page would make that top-k hold
    everything before it, so there counts between split points of the order lead to the range the page
    lies in, and the top-k runs inside that range. That reads ``df`` several times: if it is a join, it
    should be stored before. ``order`` and ``tie_break`` together should tell rows
    apart; which of several equal rows a page has is otherwise undefined.
    """
    offset, rows = page_bounds(page, per_page, most)
    by = order + tie_break
    if offset + rows <= shallow:
        return df.orderBy(*sort_columns(by)).offset(offset).limit(rows)
    return rows_at(df, by, offset, rows, shallow)


def page_after(df: DataFrame, last_date, last_id, per_page: int, most: int | None = None) -> DataFrame:
    """The page following a known last row: a filter and a small top-k at any depth."""
    _, rows = page_bounds(1, per_page, most)
    date, key = F.col("transaction_date"), F.col("transaction_id")
    beyond = (date < F.lit(last_date)) | ((date == F.lit(last_date)) & (key > F.lit(last_id)))
    return df.filter(beyond).orderBy(*newest_first()).limit(rows)


def flagged_mark(transactions: DataFrame, flags: DataFrame) -> DataFrame:
    """Transactions with is_flagged 1/0, one row each however many flags there are."""
    flagged = flags.select("transaction_id").distinct().withColumn("flagged", F.lit(True))
    return transactions.join(flagged, "transaction_id", "left").select(
        *transactions.columns, F.col("flagged").isNotNull().cast("int").alias("is_flagged")
    )


def _named(transactions: DataFrame, customers: DataFrame, products: DataFrame, stores: DataFrame) -> DataFrame:
    return with_dimensions(
        transactions, customers, products.select("product_id", "product_name"), stores
    ).select(
        "transaction_id",
        "transaction_date",
        "customer_name",
        "product_name",
        "store_name",
        "quantity",
        "unit_price",
        "total_amount",
        "payment_method",
        "status",
        "is_flagged",
    )


def transactions_flagged(
    transactions: DataFrame, customers: DataFrame, products: DataFrame, stores: DataFrame, flags: DataFrame
) -> DataFrame:
    """Every transaction with its names and whether it carries any flag."""
    return _named(flagged_mark(transactions, flags), customers, products, stores)


def transactions_page(
    transactions: DataFrame,
    customers: DataFrame,
    products: DataFrame,
    stores: DataFrame,
    flags: DataFrame,
    page: int = 1,
    per_page: int = 20,
    most: int | None = None,
) -> Page:
    """One page of :func:`transactions_flagged`, newest first, with its totals.

    The page is cut before anything is joined (foreign keys are mandatory), so flags and dimensions
    meet one page of rows and the transactions are scanned once for the page.
    """
    chosen = page_rows(transactions, NEWEST, BY_ID, page, per_page, most)
    rows = _named(flagged_mark(chosen, flags), customers, products, stores)
    return Page(rows.orderBy(*newest_first()), page_totals(transactions, page, per_page, most))


def resorted(df: DataFrame, column: str, ascending: bool = True) -> DataFrame:
    """Sort a listing on any typed column."""
    return df.orderBy(F.col(column).asc() if ascending else F.col(column).desc())
