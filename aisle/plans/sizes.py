"""Size checks that decide between a simple plan and its balanced counterpart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aisle.session import materialise

SINGLE_TASK_ROWS = 1_000_000  # rows one task may sort or rank on its own
BROADCAST_ROWS = 1_000_000  # narrow key rows that may be copied to every executor
KEY_ROWS = 100_000  # rows of one key that one task may window over


def hot_keys(df: DataFrame, key: str, limit: int = KEY_ROWS) -> DataFrame:
    """Keys holding more than ``limit`` rows. Counts are combined before the shuffle."""
    return df.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") > limit).select(key)


def split_hot(
    df: DataFrame, key: str, limit: int | None = KEY_ROWS, count_in: DataFrame | None = None
) -> tuple[DataFrame, DataFrame | None]:
    """Rows of ordinary keys, and rows of keys too large for one task or None if there are none.

    Keys are counted by reading the key column of ``count_in``, a table as cheap to read as possible
    (``df`` by default). ``limit=None`` skips that for data known to have no such key. The list of
    hot keys is copied to the executors only while its measured size allows.
    """
    if limit is None:
        return df, None
    hot = hot_keys(df if count_in is None else count_in, key, limit)
    count = hot.count()
    if count == 0:
        return df, None
    hot = materialise(hot)
    if count <= BROADCAST_ROWS:
        hot = F.broadcast(hot)
    return df.join(hot, key, "left_anti"), df.join(hot, key, "left_semi")


def most_rows_per_key(df: DataFrame, key: str) -> int:
    """The largest number of rows of one key; 0 for an empty table."""
    return df.groupBy(key).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
