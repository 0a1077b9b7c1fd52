"""Exact row numbers and ranks over an order that one task could not sort.

A window without PARTITION BY, or with one huge partition, runs in a single task. Here the rows are
range-partitioned by the whole order into segments, ranked inside each segment, and shifted by what
earlier segments hold. Ties may span segments: the shift also carries where a tie run began and
where it ends, so a value shared by a third of all rows is still spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aisle.plans.sizes import SINGLE_TASK_ROWS
from aisle.session import materialise

Order = list[tuple[str, bool]]  # (column, ascending)


def sort_columns(order: Order) -> list[Column]:
    return [F.col(c).asc_nulls_first() if up else F.col(c).desc_nulls_last() for c, up in order]


def segment_count(df: DataFrame) -> int:
    """One segment per configured shuffle partition."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def plain_positions(df: DataFrame, order: Order, tie_break: Order, keys: tuple[str, ...] = ()) -> DataFrame:
    """The same columns as :func:`spread_positions` from ordinary windows."""
    by_value = Window.partitionBy(*keys).orderBy(*sort_columns(order))
    by_row = Window.partitionBy(*keys).orderBy(*sort_columns(order + tie_break))
    return df.select(
        "*",
        F.row_number().over(by_row).cast("bigint").alias("row_no"),
        F.rank().over(by_value).cast("bigint").alias("rank_no"),
        F.dense_rank().over(by_value).cast("bigint").alias("dense_no"),
        F.count("*").over(by_value).alias("last_peer"),
        F.count("*").over(Window.partitionBy(*keys)).alias("group_rows"),
    )


def spread_positions(
    df: DataFrame,
    order: Order,
    tie_break: Order,
    keys: tuple[str, ...] = (),
    segments: int | None = None,
) -> DataFrame:
    """Add row_no, rank_no, dense_no, last_peer (position of the last tie) and group_rows.

    ``order`` decides ranks, ``tie_break`` makes row numbers total; both restart per ``keys``.
    """
    by_segment = ("segment", *keys)
    total_order = sort_columns([(k, True) for k in keys] + order + tie_break)
    by_value = Window.partitionBy(*by_segment).orderBy(*sort_columns(order))
    by_row = Window.partitionBy(*by_segment).orderBy(*sort_columns(order + tie_break))
    value = F.struct(*[c for c, _ in order])
    ranked = materialise(
        df.repartitionByRange(segments or segment_count(df), *total_order)
        .withColumn("segment", F.spark_partition_id())
        .select(
            "*",
            F.row_number().over(by_row).cast("bigint").alias("local_row"),
            F.rank().over(by_value).cast("bigint").alias("local_rank"),
            F.dense_rank().over(by_value).cast("bigint").alias("local_dense"),
            F.count("*").over(by_value).alias("local_last"),
        )
    )
    summary = ranked.groupBy(*by_segment).agg(
        F.count("*").alias("rows"),
        F.max("local_dense").alias("values"),
        F.min_by(value, "local_row").alias("first_value"),
        F.max_by(value, "local_row").alias("last_value"),
        F.min("local_last").alias("first_run"),
        F.max("local_rank").alias("last_start"),
    )
    shifts = _shifts(summary, keys)
    if not keys:
        shifts = F.broadcast(shifts)  # one row per segment
    joined = ranked.join(shifts, list(by_segment))
    continued = F.col("continues") & (F.col("local_rank") == 1)
    running_on = F.col("runs_on") & (F.col("local_last") == F.col("rows"))
    return joined.select(
        *df.columns,
        (F.col("before") + F.col("local_row")).alias("row_no"),
        F.when(continued, F.col("run_start")).otherwise(F.col("before") + F.col("local_rank")).alias("rank_no"),
        (F.col("values_before") + F.col("local_dense")).alias("dense_no"),
        F.when(running_on, F.col("run_end")).otherwise(F.col("before") + F.col("local_last")).alias("last_peer"),
        "group_rows",
    )


def _shifts(summary: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """What each segment must add to its local numbers; one row per (segment, key)."""
    ahead = Window.partitionBy(*keys).orderBy("segment")
    earlier = ahead.rowsBetween(Window.unboundedPreceding, -1)
    up_to_here = ahead.rowsBetween(Window.unboundedPreceding, 0)
    later = Window.partitionBy(*keys).orderBy(F.desc("segment")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(*keys)
    one_run = F.col("values") == 1
    linked = summary.select(
        "*",
        F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("before"),
        F.coalesce(F.sum("values").over(earlier), F.lit(0)).alias("raw_values_before"),
        F.sum("rows").over(everything).alias("group_rows"),
        (F.lag("segment").over(ahead).isNotNull() & F.lag("last_value").over(ahead).eqNullSafe(F.col("first_value"))).alias("continues"),
        (F.lead("segment").over(ahead).isNotNull() & F.lead("first_value").over(ahead).eqNullSafe(F.col("last_value"))).alias("runs_on"),
    )
    starts_here = ~(F.col("continues") & one_run)
    ends_here = ~(F.col("runs_on") & one_run)
    marked = linked.select(
        "*",
        F.when(starts_here, F.col("before") + F.col("last_start")).alias("start_mark"),
        F.when(ends_here, F.col("before") + F.col("first_run")).alias("end_mark"),
    )
    return marked.select(
        "segment",
        *keys,
        "rows",
        "before",
        "group_rows",
        "continues",
        "runs_on",
        F.last("start_mark", ignorenulls=True).over(earlier).alias("run_start"),
        F.last("end_mark", ignorenulls=True).over(later).alias("run_end"),
        (F.col("raw_values_before") - F.sum(F.col("continues").cast("int")).over(up_to_here)).alias("values_before"),
    )


def positions(
    df: DataFrame,
    order: Order,
    tie_break: Order,
    keys: tuple[str, ...] = (),
    *,
    rows: int | None = None,
    spread: bool | None = None,
) -> DataFrame:
    """Ordinary windows while the rows fit one task, else spread over segments that do.

    ``rows`` is a known upper bound, such as the size of the dimension the rows were grouped by;
    without it ``df`` is counted. ``spread`` forces one form.
    """
    if rows is None and spread is None:
        rows = df.count()
    if spread is None:
        spread = rows > SINGLE_TASK_ROWS
    if not spread:
        return plain_positions(df, order, tie_break, keys)
    segments = max(segment_count(df), (rows or 0) // SINGLE_TASK_ROWS + 1)
    return spread_positions(df, order, tie_break, keys, segments)


def ntile(buckets: int) -> Column:
    """NTILE(``buckets``) from row_no and group_rows: larger buckets come first."""
    size = F.floor(F.col("group_rows") / buckets)
    extra = F.col("group_rows") % buckets
    in_larger = extra * (size + 1)
    row = F.col("row_no")
    return F.when(
        row <= in_larger, F.floor((row - 1) / (size + 1)) + 1
    ).otherwise(extra + F.floor((row - in_larger - 1) / F.greatest(size, F.lit(1))) + 1)


def percent_rank_reversed() -> Column:
    """PERCENT_RANK of the opposite direction, from last_peer and group_rows."""
    rows = F.col("group_rows")
    return F.when(rows <= 1, F.lit(0.0)).otherwise((rows - F.col("last_peer")) / (rows - 1))
