"""Per-key sequence windows that also work for a key too large for one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aisle.plans.positions import segment_count
from aisle.plans.sizes import KEY_ROWS
from aisle.session import materialise

ADDED = ["previous_ts", "previous_value", "rolling_value", "recent_rows"]


def _window_columns(key: tuple[str, ...], ts: str, tie_break: list[str], value: str, rows: int) -> list:
    in_order = Window.partitionBy(*key).orderBy(ts, *tie_break)
    return [
        F.lag(ts).over(in_order).alias("previous_ts"),
        F.lag(value).over(in_order).alias("previous_value"),
        F.sum(value).over(in_order.rowsBetween(1 - rows, 0)).alias("rolling_value"),
    ]


def plain_sequence(
    df: DataFrame, key: str, ts: str, tie_break: list[str], value: str, rows: int, seconds: int
) -> DataFrame:
    """One window per key: previous row, sum over ``rows`` rows, rows in the last ``seconds``."""
    recent = F.expr(
        f"count(1) OVER (PARTITION BY `{key}` ORDER BY `{ts}` "
        f"RANGE BETWEEN INTERVAL '{seconds}' SECOND PRECEDING AND CURRENT ROW)"
    )
    return df.select("*", *_window_columns((key,), ts, tie_break, value, rows), recent.alias("recent_rows"))


def spread_sequence(
    df: DataFrame,
    key: str,
    ts: str,
    tie_break: list[str],
    value: str,
    rows: int,
    seconds: int,
    segments: int | None = None,
) -> DataFrame:
    """The same columns with every key cut into range segments.

    There are as many segments as the counted rows need at KEY_ROWS each, and at least one per shuffle
    partition. Each is windowed on its own after receiving the last ``rows - 1`` rows before it; a
    segment hands on at most that many. The time-ranged count is found once per instant
    (:func:`recent_counts`) and comes to the rows by key, segment and instant, so an instant that
    holds a third of all rows stays spread over its segments.
    """
    carried_rows = rows - 1
    segments = segments or max(segment_count(df), df.count() // KEY_ROWS + 1)
    cut = materialise(
        df.repartitionByRange(segments, key, ts, *tie_break).withColumn("segment", F.spark_partition_id())
    )
    part = (key, "segment")
    from_end = Window.partitionBy(*part).orderBy(*[F.desc(c) for c in (ts, *tie_break)])
    tails = (
        cut.withColumn("from_end", F.row_number().over(from_end))
        .filter(F.col("from_end") <= carried_rows)
        .groupBy(*part)
        .agg(F.sort_array(F.collect_list(F.struct(ts, *tie_break, value))).alias("tail"))
    )
    before = Window.partitionBy(key).orderBy("segment").rowsBetween(-carried_rows, -1)
    earlier = F.flatten(F.collect_list("tail").over(before))
    start = F.greatest(F.size("earlier") - carried_rows + 1, F.lit(1))
    carried = (
        tails.select(*part, earlier.alias("earlier"))
        .select(*part, F.explode(F.slice("earlier", start, F.lit(carried_rows))).alias("row"))
        .select(*part, "row.*", F.lit(False).alias("home"))
    )
    windowed = (
        cut.withColumn("home", F.lit(True))
        .unionByName(carried, allowMissingColumns=True)
        .select("*", *_window_columns(part, ts, tie_break, value, rows))
        .filter("home")
    )
    held = materialise(cut.groupBy(key, "segment", ts).agg(F.count("*").alias("n")))
    instants = held.groupBy(key, ts).agg(F.sum("n").alias("n"))
    recent = held.select(key, "segment", ts).join(recent_counts(instants, key, ts, seconds, segments), [key, ts])
    return windowed.join(recent, [key, "segment", ts]).select(*df.columns, *ADDED)


def recent_counts(instants: DataFrame, key: str, ts: str, seconds: int, segments: int) -> DataFrame:
    """(key, ts, recent_rows) from (key, ts, n): the rows from ``seconds`` before each instant up to it.

    That is the difference of two prefix sums: the rows up to the instant, and those before its start.
    Every instant sends a probe to the place where its start lies in the order of all instants. Instants
    and probes are cut into range segments, summed up inside each, and shifted by what earlier segments of
    the key hold, so no task needs all instants of a key, however many fall within the reach.
    """
    probes = instants.select(
        key, F.col(ts).alias("of"), (F.col(ts) - F.make_dt_interval(secs=F.lit(seconds))).alias("at"), F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("n")
    )
    both = instants.select(key, F.col(ts).alias("of"), F.col(ts).alias("at"), F.lit(1).alias("kind"), "n").unionByName(probes)
    # a probe comes before the instant it names, which counts
    cut = materialise(both.repartitionByRange(segments, key, "at", "kind", "of").withColumn("part", F.spark_partition_id()))
    inside = Window.partitionBy(key, "part").orderBy("at", "kind", "of").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = cut.groupBy(key, "part").agg(F.sum("n").alias("held"))
    shifts = shifts.select(key, "part", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("before"))
    summed = cut.withColumn("inside", F.sum("n").over(inside)).join(shifts, [key, "part"])
    up_to = F.col("before") + F.col("inside")
    signed = F.sum(F.when(F.col("kind") == 1, up_to).otherwise(-up_to)).alias("recent_rows")
    return summed.groupBy(key, F.col("of").alias(ts)).agg(signed)
