"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aisle.session import stored  # noqa: F401  the operators take it from here

WHITE_SPACE = r"[ \t-\r]+"
NOT_WHITE_SPACE = r"[^ \t-\r]+"
HOT_SHARE = 1000  # a group above 1/HOT_SHARE of all rows is hot, so there are at most HOT_SHARE hot groups


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def text_of(column: str | Column = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def remainder(divisor: int, column: str = "doc_id") -> Column:
    """crc32 of the id written as text, modulo ``divisor``; a null id counts as the text ''."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % divisor


def attach_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Inner join of rows with the one row of their group, safe when a group holds a third of the rows.

    Groups above total/HOT_SHARE rows, at most HOT_SHARE of them as sizes add up to ``total``, are
    broadcast; the join on the key moves only rows of the other groups.
    """
    limit = max(HOT_SHARE, total // HOT_SHARE)
    hot = F.broadcast(groups.filter(F.col(size) > limit))
    rest = groups.filter(F.col(size) <= limit)
    return rows.join(hot, key).unionByName(rows.join(hot, key, "left_anti").join(rest, key))
