"""Nearby-in-time tests per key, linear in the rows of a key.

Comparing all pairs of one key is quadratic. Keys of ordinary size are windowed in order of time. A
key too large for one task is first reduced to distinct seconds or instants (combined before the
shuffle) and then windowed over short stretches of time, so neither a busy key nor a busy instant
can fill a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aisle.functions.dates import seconds
from aisle.plans.sizes import KEY_ROWS, split_hot

STRETCH_SECONDS = 3600


def _tumbling(ts: Column, width: int) -> Column:
    return F.window(ts, f"{width} seconds").getField("start")


def _reach(within_seconds: int) -> Column:
    """The truncated difference is <= n exactly when the true one is < n + 1."""
    return seconds(within_seconds + 1)


def rows_with_close_neighbour(
    df: DataFrame, key: str, ts: str, within_seconds: int, key_limit: int | None = KEY_ROWS
) -> DataFrame:
    """Rows of ``df`` having another row of the same key at most ``within_seconds`` whole seconds away.

    In order of time only the row before and the row after can be closest.
    """
    df = df.filter(F.col(key).isNotNull() & F.col(ts).isNotNull())
    ordinary, hot = split_hot(df, key, key_limit)
    in_order = Window.partitionBy(key).orderBy(ts)
    gap = _reach(within_seconds)
    close = (
        ordinary.select("*", F.lag(ts).over(in_order).alias("previous"), F.lead(ts).over(in_order).alias("following"))
        .filter((F.col(ts) < F.col("previous") + gap) | (F.col("following") < F.col(ts) + gap))
        .select(*df.columns)
    )
    return close if hot is None else close.unionByName(crowded_close_neighbours(hot, key, ts, within_seconds))


def crowded_close_neighbours(
    df: DataFrame, key: str, ts: str, within_seconds: int, stretch: int = STRETCH_SECONDS
) -> DataFrame:
    """:func:`rows_with_close_neighbour` for keys of any size.

    Rows sharing a second are close by definition, so the answer is the same for every row of a
    (key, second) group: alone in it, only the nearest earlier and later groups matter. Stretches
    overlap by the reach so that each group sees both in its own stretch.
    """
    reach = within_seconds + 1
    per_second = df.groupBy(key, _tumbling(F.col(ts), 1).alias("second")).agg(
        F.count("*").alias("n"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts")
    )
    overlapping = F.window(
        "second", f"{stretch + 2 * reach} seconds", f"{stretch} seconds", f"{-reach % stretch} seconds"
    )
    in_order = Window.partitionBy(key, "stretch").orderBy("second")
    gap = seconds(reach)
    close = (
        per_second.select("*", overlapping.getField("start").alias("stretch"))
        .select(
            "*",
            F.lag("last_ts").over(in_order).alias("previous"),
            F.lead("first_ts").over(in_order).alias("following"),
        )
        .filter(
            (F.col("second") >= F.col("stretch") + gap)
            & (F.col("second") < F.col("stretch") + seconds(stretch + reach))
        )
        .filter(
            (F.col("n") > 1)
            | (F.col("first_ts") < F.col("previous") + gap)
            | (F.col("following") < F.col("last_ts") + gap)
        )
        .select(key, "second")
    )
    return (
        df.withColumn("second", _tumbling(F.col(ts), 1))
        .join(close, [key, "second"], "left_semi")
        .select(*df.columns)
    )


def rows_after_close_arrival(
    df: DataFrame,
    key: str,
    ts: str,
    arrival: str,
    within_seconds: int,
    candidate: Column,
    wanted: Column,
    key_limit: int | None = KEY_ROWS,
) -> DataFrame:
    """``wanted`` rows with a ``candidate`` of the same key that arrived earlier and lies close in time.

    ``arrival`` orders arrivals: any orderable column, structs included.
    """
    df = df.filter(F.col(key).isNotNull() & F.col(ts).isNotNull())
    ordinary, hot = split_hot(df, key, key_limit)
    # the widest closed range inside the open one: time has microseconds
    near = f"INTERVAL '{within_seconds}.999999' SECOND"
    earliest = F.expr(
        f"min(candidate_arrival) OVER (PARTITION BY `{key}` ORDER BY `{ts}` "
        f"RANGE BETWEEN {near} PRECEDING AND {near} FOLLOWING)"
    )
    close = (
        ordinary.select("*", wanted.alias("wanted"), F.when(candidate, F.col(arrival)).alias("candidate_arrival"))
        .withColumn("earliest", earliest)
        .filter(F.col("wanted") & (F.col("earliest") < F.col(arrival)))
        .select(*df.columns)
    )
    if hot is None:
        return close
    crowded = crowded_after_close_arrival(hot.filter(wanted), hot.filter(candidate), key, ts, arrival, within_seconds)
    return close.unionByName(crowded)


def crowded_after_close_arrival(
    rows: DataFrame, candidates: DataFrame, key: str, ts: str, arrival: str, within_seconds: int
) -> DataFrame:
    """:func:`rows_after_close_arrival` for keys of any size.

    Time is cut into blocks as wide as the reach. The row's own block qualifies whole; of the two
    next to it, the part within reach is a suffix or a prefix, so a running minimum of ``arrival``
    answers it. Each distinct instant of ``rows`` is placed as a probe into the three blocks.
    """
    width = within_seconds + 1
    reach = seconds(width)

    def probe(side: str, shift: Column | None) -> Column:
        block, at = F.col("block"), F.col(ts)
        if shift is not None:
            block, at = block + shift, at + shift
        return F.struct(F.lit(side).alias("side"), block.alias("block"), at.alias("pos"))

    instants = rows.groupBy(key, ts).agg(F.max(arrival).alias("latest")).withColumn("block", _tumbling(F.col(ts), width))
    placed = F.explode(F.array(probe("before", -reach), probe("own", None), probe("after", reach)))
    probes = instants.select(key, F.col(ts).alias("at"), placed.alias("probe"), "latest").select(
        key, "probe.*", "at", "latest", F.lit(0).alias("kind")
    )
    found = (
        candidates.groupBy(key, ts)
        .agg(F.min(arrival).alias("arrived"))
        .withColumn("block", _tumbling(F.col(ts), width))
        .select(key, "block", F.col(ts).alias("pos"), F.lit(1).alias("kind"), "arrived")
    )
    block = Window.partitionBy(key, "block")
    rising = block.orderBy("pos", "kind").rowsBetween(Window.unboundedPreceding, 0)
    falling = block.orderBy(F.desc("pos"), "kind").rowsBetween(Window.unboundedPreceding, 0)
    earliest = (
        F.when(F.col("side") == "own", F.min("arrived").over(block))
        .when(F.col("side") == "before", F.min("arrived").over(falling))
        .otherwise(F.min("arrived").over(rising))
    )
    hits = (
        probes.unionByName(found, allowMissingColumns=True)
        .select(key, "kind", "at", "latest", earliest.alias("earliest"))
        .filter((F.col("kind") == 0) & (F.col("earliest") < F.col("latest")))
        .groupBy(key, F.col("at").alias(ts))
        .agg(F.min("earliest").alias("earliest"))
    )
    return rows.join(hits, [key, ts]).filter(F.col("earliest") < F.col(arrival)).select(*rows.columns)


def trailing_counts(df: DataFrame, key: str, ts: str, width: int) -> DataFrame:
    """(key, ts, n): rows of the key from ``width`` seconds before each instant up to it, both included.

    The same blocks as above: a running sum from the start of the instant's own block plus one from
    the end of the block before.
    """
    reach = seconds(width)
    instants = (
        df.groupBy(key, ts)
        .agg(F.count("*").alias("n"))
        .withColumn("block", _tumbling(F.col(ts), width))
    )
    own = instants.select(key, "block", F.col(ts).alias("pos"), F.lit(0).alias("kind"), "n", F.col(ts).alias("at"))
    probes = instants.select(
        key,
        (F.col("block") - reach).alias("block"),
        (F.col(ts) - reach).alias("pos"),
        F.lit(1).alias("kind"),
        F.lit(0).cast("bigint").alias("n"),
        F.col(ts).alias("at"),
    )
    block = Window.partitionBy(key, "block")
    rising = block.orderBy("pos", "kind").rowsBetween(Window.unboundedPreceding, 0)
    falling = block.orderBy(F.desc("pos"), "kind").rowsBetween(Window.unboundedPreceding, 0)
    return (
        own.unionByName(probes)
        .select(
            key,
            "at",
            F.when(F.col("kind") == 0, F.sum("n").over(rising)).otherwise(F.sum("n").over(falling)).alias("part"),
        )
        .groupBy(key, F.col("at").alias(ts))
        .agg(F.sum("part").alias("n"))
    )
