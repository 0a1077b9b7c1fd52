"""Stored tables changed partition by partition."""

from __future__ import annotations

from pathlib import Path

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from aisle.operators import changes
from aisle.sources import versions

SCHEMA = "transaction_id bigint, status string, month string"
SALES = [(i, "pending", f"2024-{1 + i % 4:02d}") for i in range(40)] + [(100, "pending", None), (101, "completed", "2024-01")]


def stored(spark, tmp_path, sales=SALES):
    table = versions.Stored(str(tmp_path / "sales"), SCHEMA, "month", "transaction_id")
    versions.create(spark.createDataFrame(sales, SCHEMA), table)
    return table


def now(spark, table):
    return sorted(rows_of(versions.read(spark, table)), key=str)


def cancel(spark, ids, months=None):
    if months is None:
        return spark.createDataFrame([(i, "cancelled") for i in ids], "transaction_id bigint, status string")
    return spark.createDataFrame([(i, "cancelled", m) for i, m in zip(ids, months, strict=True)], SCHEMA)


def after(ids):
    return sorted([(i, "cancelled" if i in ids else s, m) for i, s, m in SALES], key=str)


def update(new, rows):
    return changes.update_status(new.select("transaction_id", "status"), rows)


def spoil(table, write, month):
    """Make the files of one stored month unreadable."""
    files = list(Path(table.folder, "rows", f"write={write}", f"month={month}").glob("*.parquet"))
    assert files
    for file in files:
        file.write_bytes(b"no parquet")
        file.with_name(f".{file.name}.crc").unlink(missing_ok=True)


def test_a_change_rewrites_only_the_months_it_touches(spark, tmp_path):
    table = stored(spark, tmp_path)
    _, before = versions.manifest(spark, table)
    assert versions.rewrite(cancel(spark, [1, 5, 100, 999]), table, "one", update) == ["", "2024-02"]
    version, held = versions.manifest(spark, table)
    assert version == 2 and {p for p in held if held[p] != before[p]} == {"", "2024-02"}
    assert now(spark, table) == after({1, 5, 100})


def test_untouched_months_are_not_read(spark, tmp_path):
    table = stored(spark, tmp_path)
    _, held = versions.manifest(spark, table)
    spoil(table, held["2024-03"], "2024-03")
    assert versions.rewrite(cancel(spark, [1, 5], ["2024-02"] * 2), table, "one", update) == ["2024-02"]
    with pytest.raises(Exception, match="2024-03|parquet"):
        versions.read(spark, table).count()
    _, held = versions.manifest(spark, table)
    rows = versions._rows(spark, table, {"2024-02": held["2024-02"]})
    assert sorted(rows_of(rows.drop("write"))) == sorted(r for r in after({1, 5}) if r[2] == "2024-02")


def test_a_broken_or_repeated_change_shows_once(spark, tmp_path):
    table = stored(spark, tmp_path)
    lost = lambda new, rows: rows.withColumn("status", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        versions.rewrite(cancel(spark, [1]), table, "one", lost)
    assert now(spark, table) == after(set())
    assert versions.rewrite(cancel(spark, [1]), table, "one", update) == ["2024-02"]
    assert versions.rewrite(cancel(spark, [2]), table, "one", update) is None
    assert now(spark, table) == after({1})


def test_rows_may_go_come_and_not_stray(spark, tmp_path):
    table = stored(spark, tmp_path)
    ids = [i for i, _, m in SALES if m == "2024-02"]
    delete = lambda new, rows: rows.join(new.select("transaction_id"), "transaction_id", "left_anti")
    assert versions.rewrite(cancel(spark, ids), table, "delete", delete) == ["2024-02"]
    assert now(spark, table) == sorted([r for r in SALES if r[2] != "2024-02"], key=str)
    add = lambda new, rows: rows.unionByName(new)
    assert versions.rewrite(cancel(spark, [7, 8], ["2024-02", "2025-01"]), table, "add", add) == ["2024-02", "2025-01"]
    assert versions.read(spark, table).filter("month in ('2024-02', '2025-01')").count() == 2
    held = now(spark, table)
    with pytest.raises(ValueError, match="2030-01"):
        versions.rewrite(cancel(spark, [0]), table, "stray", lambda new, rows: rows.withColumn("month", F.lit("2030-01")))
    assert now(spark, table) == held
    assert versions.rewrite(cancel(spark, [999]), table, "nothing", update) == [] and now(spark, table) == held


def test_empty_tables_have_versions(spark, tmp_path):
    table = stored(spark, tmp_path, [])
    assert versions.manifest(spark, table) == (1, {}) and now(spark, table) == []
    assert versions.rewrite(cancel(spark, [1]), table, "one", update) == []
    assert versions.rewrite(cancel(spark, [1], ["2024-01"]), table, "two", lambda new, rows: rows.unionByName(new)) == ["2024-01"]
    assert now(spark, table) == [(1, "cancelled", "2024-01")]
