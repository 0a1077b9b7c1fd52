"""Order-statistic selection: the few rows at a given place of an order over everything.

Neither a sort of all rows nor a number for each is needed to find rows 1,000,001 to 1,000,100. A hash sample
of the order's columns gives split points on both sides of the place, one pass counts the rows between them, and the
range that holds the place, usually a fortieth, is searched again in the same way until what precedes the place
inside it fits a top-k. An unlucky sample costs another round, never a wrong row. Each range is a
filter on the order's columns, so later passes skip the files and row groups outside of it.
"""

from __future__ import annotations

from functools import reduce
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, TimestampNTZType, TimestampType

from aisle.plans.positions import Order, segment_count, sort_columns, spread_positions
from aisle.plans.sizes import SINGLE_TASK_ROWS

SAMPLE_ROWS = 4_096  # sampled rows brought to the driver in one round, on average
NEAR, FAR = 1.5, 3.0  # standard deviations of the place in the sample that the split points keep from it


class Range(NamedTuple):
    """Rows from ``low`` on and before ``high`` (values of the order's columns; None is open), ``skip`` before the place."""

    low: tuple | None
    high: tuple | None
    skip: int


def _carried(column: str, kind: DataType) -> Column:
    """The value in a form that survives the way to the driver and back whatever its time zone."""
    if isinstance(kind, TimestampType):
        return F.unix_micros(column).alias(column)
    if isinstance(kind, TimestampNTZType):
        return F.col(column).cast("string").alias(column)
    return F.col(column)


def _literal(value: Any, kind: DataType) -> Column:
    if isinstance(kind, TimestampType) and value is not None:
        return F.timestamp_micros(F.lit(value))
    return F.lit(value).cast(kind)


def precedes(df: DataFrame, order: Order, point: tuple) -> Column:
    """Whether a row comes before ``point``; NULL is the smallest value, as in :func:`sort_columns`."""
    result = F.lit(False)
    for (name, up), value in reversed(list(zip(order, point, strict=True))):
        column, kind = F.col(name), df.schema[name].dataType
        bound = _literal(value, kind)
        if value is None:
            before, same = (F.lit(False) if up else column.isNotNull()), column.isNull()
        elif up:
            before, same = column.isNull() | (column < bound), column.isNotNull() & (column == bound)
        else:
            before, same = column.isNotNull() & (column > bound), column.isNotNull() & (column == bound)
        result = before | (same & result)
    return result


def _leading(df: DataFrame, order: Order, found: Range) -> list[Column]:
    """What the range says of the first column alone, in a form that a file scan can use."""
    name, up = order[0]
    column, kind = F.col(name), df.schema[name].dataType
    tests = []
    for point, start in ((found.low, True), (found.high, False)):
        if point is not None and point[0] is not None:
            bound = _literal(point[0], kind)
            rising = start == up  # the bound is the smallest value of the range
            tests.append(column >= bound if rising else (column <= bound) | column.isNull())
    return tests


def rows_between(df: DataFrame, order: Order, found: Range) -> DataFrame:
    tests = _leading(df, order, found)
    if found.low is not None:
        tests.append(~precedes(df, order, found.low))
    if found.high is not None:
        tests.append(precedes(df, order, found.high))
    return df.filter(reduce(Column.__and__, tests)) if tests else df


def _split_points(rows: DataFrame, order: Order, total: int, skip: int, wanted: int) -> list[tuple]:
    """At most four different points in order, around the place; a sample that lost tasks choose again alike."""
    names, schema, every = [name for name, _ in order], rows.schema, max(1, total // SAMPLE_ROWS)
    # the limit is far above the sample's size: it lets a top-k sort it, without a range partitioning that scans twice
    sample = (
        rows.filter(F.pmod(F.xxhash64(*names), F.lit(every)) == 0)
        .distinct()
        .orderBy(*sort_columns(order))
        .limit(8 * SAMPLE_ROWS)
    )
    points = [tuple(r) for r in sample.select(*[_carried(n, schema[n].dataType) for n in names]).collect()]
    first, last = skip * len(points) / total, (skip + wanted) * len(points) / total
    chosen = []
    for at, widths in ((first, (-FAR, -NEAR)), (last, (NEAR, FAR))):
        deviation = 0 if every == 1 else max(1.0, at * (1 - at / max(1, len(points)))) ** 0.5
        chosen += [int(at + width * deviation) for width in widths]
    return [points[i] for i in sorted(set(chosen)) if 0 <= i < len(points)]


def _counts(rows: DataFrame, order: Order, points: list[tuple]) -> dict[int, int]:
    """Rows by how many of the points they do not precede; at most five rows come to the driver."""
    place = reduce(Column.__add__, [(~precedes(rows, order, point)).cast("int") for point in points], F.lit(0))
    return dict(rows.groupBy(place.alias("place")).count().collect())


def find_range(df: DataFrame, order: Order, offset: int, rows: int, enough: int) -> Range | None:
    """A range holding rows ``offset`` + 1 to ``offset`` + ``rows``, at most ``enough`` rows before them.

    None if there are no such rows. Rows of equal order columns can't be told apart: if more than ``enough``
    of them precede the place, the range stays that large.
    """
    narrow = df.select(*[name for name, _ in order])
    total, found = narrow.count(), Range(None, None, offset)
    if offset >= total:
        return None
    while found.skip > enough:
        inside = rows_between(narrow, order, found)
        points = _split_points(inside, order, total, found.skip, rows)
        counts = _counts(inside, order, points)
        before, places = 0, sorted(counts)
        for first in places:
            if before + counts[first] > found.skip:
                break
            before += counts[first]
        end, held = before, 0
        for last in places[places.index(first) :]:
            end, held = end + counts[last], held + counts[last]
            if end >= found.skip + rows:
                break
        low = points[first - 1] if first > 0 else found.low
        high = points[last] if last < len(points) else found.high
        if (low, high) == (found.low, found.high):
            break
        total, found = held, Range(low, high, found.skip - before)
    return found


def rows_at(df: DataFrame, order: Order, offset: int, rows: int, enough: int) -> DataFrame:
    """Rows ``offset`` + 1 to ``offset`` + ``rows`` of ``df`` in ``order``, sorted."""
    found = find_range(df, order, offset, rows, enough)
    if found is None:
        return df.limit(0)
    inside = rows_between(df, order, found)
    if found.skip <= enough:
        return inside.orderBy(*sort_columns(order)).offset(found.skip).limit(rows)
    # many rows of equal order columns: their numbers decide
    segments = max(segment_count(df), found.skip // SINGLE_TASK_ROWS + 1)
    spread = [(name, up) for name, up in order] + [("spread_id", True)]
    numbered = spread_positions(inside.withColumn("spread_id", F.xxhash64(*df.columns)), spread, [], segments=segments)
    wanted = numbered.filter(F.col("row_no").between(found.skip + 1, found.skip + rows))
    return wanted.select(*df.columns).orderBy(*sort_columns(order))
