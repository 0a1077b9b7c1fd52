"""Row filters shared by the reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aisle.functions.dates import Day, between_days, day
from aisle.functions.dates import trailing_months as in_trailing_months

COMPLETED = "completed"


def completed_sales(transactions: DataFrame) -> DataFrame:
    return transactions.filter(F.col("status") == COMPLETED)


def between_dates(
    df: DataFrame, start: Day | None, end: Day | None, column: str = "transaction_date"
) -> DataFrame:
    """Inclusive calendar days; a missing bound leaves that side open."""
    if start is not None and end is not None:
        return df.filter(between_days(F.col(column), start, end))
    if start is not None:
        return df.filter(F.to_date(column) >= day(start))
    if end is not None:
        return df.filter(F.to_date(column) <= day(end))
    return df


def trailing_months(
    df: DataFrame, as_of: Day | None, months: int, column: str = "transaction_date"
) -> DataFrame:
    """Rows on or after the day ``months`` before ``as_of``; no upper bound."""
    return df.filter(in_trailing_months(F.col(column), as_of, months))


def matching(df: DataFrame, **wanted) -> DataFrame:
    """Equality filters for the options that are given; None means any value."""
    for column, value in wanted.items():
        if value is not None:
            df = df.filter(F.col(column) == value)
    return df


def search_rows(
    df: DataFrame, text: str, columns: Sequence[str] | None = None, *, case_insensitive: bool = True
) -> DataFrame:
    """Rows whose displayed text (columns joined by a space) contains ``text``."""
    shown = F.concat_ws(" ", *[F.col(c).cast("string") for c in (columns or df.columns)])
    if not text:
        return df
    if case_insensitive:
        return df.filter(F.lower(shown).contains(text.lower()))
    return df.filter(shown.contains(text))


def with_prefix(df: DataFrame, column: str, prefix: str) -> DataFrame:
    return df.filter(F.col(column).startswith(prefix))


def employees_of_store(employees: DataFrame, store_id: int) -> DataFrame:
    return employees.filter(F.col("store_id") == store_id)


def existing(df: DataFrame, wanted: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Split ``wanted`` ids into those present in ``df`` and the rejected rest.

    The table is first reduced to the wanted ids, the side expected to be small.
    """
    ids = df.select(key).join(wanted.select(key), key, "left_semi").distinct()
    return wanted.join(ids, key, "left_semi"), wanted.join(ids, key, "left_anti")
