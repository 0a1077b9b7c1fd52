"""Balanced plans against the obvious ones, on data with heavy keys and ties."""

from __future__ import annotations

import random

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from aisle.plans.neighbours import (
    crowded_close_neighbours,
    rows_after_close_arrival,
    rows_with_close_neighbour,
    trailing_counts,
)
from aisle.plans.positions import ntile, percent_rank_reversed, plain_positions, spread_positions
from aisle.plans.sequences import plain_sequence, spread_sequence
from aisle.plans.sizes import hot_keys, most_rows_per_key, split_hot


def sorted_text(df) -> list[str]:
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("segments", [1, 7])
@pytest.mark.parametrize("keys", [(), ("k",)])
@pytest.mark.parametrize("kind", ["ties", "one value", "distinct", "nulls"])
def test_spread_positions_equal_plain_windows(spark, segments, keys, kind):
    rng = random.Random(5)
    value = {
        "ties": lambda i: 0 if i % 3 == 0 else rng.randrange(6),
        "one value": lambda i: 7,
        "distinct": lambda i: i,
        "nulls": lambda i: None if i % 3 == 0 else rng.randrange(4),
    }[kind]
    rows = [(i, "hot" if i % 3 else rng.choice("abc"), value(i)) for i in range(200)]
    df = spark.createDataFrame(rows, "id bigint, k string, v int")
    order, tie_break = [("v", False)], [("id", True)]
    spread = spread_positions(df, order, tie_break, keys, segments)
    assert sorted_text(spread) == sorted_text(plain_positions(df, order, tie_break, keys))


def test_spread_positions_of_nothing(spark):
    nothing = spark.createDataFrame([], "id bigint, v int")
    assert spread_positions(nothing, [("v", True)], [("id", True)], segments=3).count() == 0


@pytest.mark.parametrize("rows", [1, 3, 4, 7, 10, 23])
def test_ntile_and_percent_rank_formulas(spark, rows):
    df = spark.range(rows).selectExpr("id", "id DIV 2 AS v")
    numbered = plain_positions(df, [("v", False)], [("id", True)])
    found = numbered.select("id", ntile(4).alias("a"), ntile(10).alias("b"), percent_rank_reversed().alias("p"))
    wanted = df.selectExpr(
        "id",
        "CAST(ntile(4) OVER (ORDER BY v DESC, id) AS BIGINT) AS a",
        "CAST(ntile(10) OVER (ORDER BY v DESC, id) AS BIGINT) AS b",
        "percent_rank() OVER (ORDER BY v) AS p",
    )
    assert sorted_text(found) == sorted_text(wanted)


def crowd(spark, seed: int, rows: int = 400):
    """Times in microseconds around minute and hour borders; customer 0 holds a third of the rows."""
    rng = random.Random(seed)
    near = [0, 1, 999_999, 59_000_000, 60_000_000, 60_999_999, 61_000_000, 3_599_999_999, 3_600_000_000, 3_661_000_000]
    data = [
        (
            i,
            0 if i % 3 == 0 else rng.randrange(1, 60),
            rng.choice(near) + rng.choice([0, 0, 1, rng.randrange(200_000_000)]) if i % 2 else rng.randrange(40_000_000_000),
            rng.random() < 0.7,
        )
        for i in range(rows)
    ]
    micros = F.make_dt_interval(secs=(F.col("us") / 1_000_000).cast("decimal(18,6)"))
    df = spark.createDataFrame(data, "id bigint, k int, us bigint, ok boolean")
    return data, df.withColumn("ts", F.lit("2024-03-10").cast("timestamp_ntz") + micros)


def close(a, b, within) -> bool:
    return abs(a[2] - b[2]) // 1_000_000 <= within


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("within", [0, 60])
def test_close_neighbours_equal_all_pairs(spark, seed, within):
    data, df = crowd(spark, seed)
    wanted = sorted(a[0] for a in data if any(a[0] != b[0] and a[1] == b[1] and close(a, b, within) for b in data))
    for key_limit in (None, 50, 0):
        found = rows_with_close_neighbour(df, "k", "ts", within, key_limit)
        assert sorted(rows_of(found, "id")) == wanted
        assert found.columns == df.columns
    assert sorted(rows_of(crowded_close_neighbours(df, "k", "ts", within, stretch=61), "id")) == wanted


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("within", [0, 60])
def test_earlier_arrivals_equal_all_pairs(spark, seed, within):
    data, df = crowd(spark, seed)
    wanted = sorted(
        a[0]
        for a in data
        if a[0] % 2 and any(b[3] and b[0] < a[0] and a[1] == b[1] and close(a, b, within) for b in data)
    )
    for key_limit in (None, 50, 0):
        found = rows_after_close_arrival(df, "k", "ts", "id", within, F.col("ok"), F.col("id") % 2 == 1, key_limit)
        assert sorted(rows_of(found, "id")) == wanted


@pytest.mark.parametrize("seed", [1, 2])
def test_trailing_counts_equal_all_pairs(spark, seed):
    data, df = crowd(spark, seed)
    wanted = {(a[1], a[2]): sum(a[1] == b[1] and 0 <= a[2] - b[2] <= 3_600_000_000 for b in data) for a in data}
    found = trailing_counts(df, "k", "ts", 3600).join(df.select("k", "ts", "us").distinct(), ["k", "ts"])
    assert {(k, us): n for k, us, n in rows_of(found, "k", "us", "n")} == wanted


def test_recent_rows_of_an_hour_and_an_instant_that_one_customer_fills(spark):
    """A third of all rows at one instant, and many instants within one hour, in several segments each."""
    instant, hour = 7_200_000_000, 50_000_000_000
    data = [(i, 0, instant) for i in range(300)] + [(1000 + i, 0, hour + i * 3_000_000) for i in range(1300)]
    data += [(5000 + i, 1 + i % 3, i * 900_000_000) for i in range(60)]
    micros = F.make_dt_interval(secs=(F.col("us") / 1_000_000).cast("decimal(18,6)"))
    df = spark.createDataFrame(data, "id bigint, k int, us bigint").withColumn("ts", F.lit("2024-03-10").cast("timestamp_ntz") + micros)
    df = df.withColumn("v", F.col("id"))
    added = ["id", "previous_value", "rolling_value", "recent_rows"]
    plain = plain_sequence(df, "k", "ts", ["id"], "v", 5, 3600)
    spread = spread_sequence(df, "k", "ts", ["id"], "v", 5, 3600, segments=9)
    assert sorted(map(repr, rows_of(spread, *added))) == sorted(map(repr, rows_of(plain, *added)))
    assert max(rows_of(spread.filter("k = 0"), "recent_rows")) == 1201


def test_neighbours_do_not_depend_on_the_session_zone(spark):
    """02:30 to 03:30 does not exist in New York on this day; the difference stays 60 minutes."""
    df = spark.sql(
        "SELECT * FROM VALUES (1, 0, TIMESTAMP_NTZ'2024-03-10 01:59:30'), (2, 0, TIMESTAMP_NTZ'2024-03-10 03:00:10'),"
        "(3, 1, TIMESTAMP_NTZ'2024-03-10 02:30:00'), (4, 1, TIMESTAMP_NTZ'2024-03-10 02:30:59') AS t(id, k, ts)"
    )
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        for key_limit in (None, 0):
            assert sorted(rows_of(rows_with_close_neighbour(df, "k", "ts", 60, key_limit), "id")) == [3, 4]
            every = F.lit(True)
            assert rows_of(rows_after_close_arrival(df, "k", "ts", "id", 60, every, every, key_limit), "id") == [4]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_size_checks(spark):
    df = spark.range(10).selectExpr("id DIV 6 AS k")
    assert rows_of(hot_keys(df, "k", 5)) == [(0,)]
    assert most_rows_per_key(df, "k") == 6 and most_rows_per_key(df.limit(0), "k") == 0
    ordinary, hot = split_hot(df, "k", 5)
    assert (ordinary.count(), hot.count()) == (4, 6)
    assert split_hot(df, "k", 6)[1] is None and split_hot(df, "k", None)[1] is None


def test_rows_choose_the_form(spark, monkeypatch):
    """Above the limit no window without a partition key is left in the plan."""
    from aisle.plans import positions as module

    df = spark.range(50).selectExpr("id", "id % 7 AS v")
    order, tie_break = [("v", True)], [("id", True)]

    def plan(**options) -> str:
        return module.positions(df, order, tie_break, **options)._jdf.queryExecution().toString()

    assert "SinglePartition" in plan()
    monkeypatch.setattr(module, "SINGLE_TASK_ROWS", 20)
    spread = module.positions(df, order, tie_break)
    assert "segment" in spread._jdf.queryExecution().toString()
    assert sorted_text(spread) == sorted_text(plain_positions(df, order, tie_break))
