"""Stored tables that change by rewriting the partitions a change touches, and no others.

Rows lie below ``rows/write=<fresh id>/<part>=<value>``. A version is one small table below ``versions`` that names
the write holding each partition; readers follow the newest one. A change reads the touched partitions, writes them
anew and then adds a version: untouched partitions go on where they are, a change broken before its version shows
nothing, and one that is repeated under its name changes nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VERSIONS = "place string, write string, batch string, version bigint"


class Stored(NamedTuple):
    """Where a table lies, its columns, and the column among them whose values are its partitions (a string)."""

    folder: str
    schema: str
    part: str
    key: str


def _place(part: str) -> Column:
    return F.coalesce(F.col(part).cast("string"), F.lit(""))  # a folder can't tell NULL from the empty text


def _versions(spark: SparkSession, table: Stored) -> DataFrame:
    try:
        return spark.read.schema(VERSIONS).parquet(f"{table.folder}/versions")
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], VERSIONS)


def manifest(spark: SparkSession, table: Stored) -> tuple[int, dict[str, str]]:
    """Number of the newest version, 0 without any, and the write of each partition: a line per partition."""
    rows = _versions(spark, table)
    last = rows.agg(F.max("version")).first()[0] or 0
    held = rows.filter((F.col("version") == last) & F.col("write").isNotNull()).select("place", "write").collect()
    return last, {row["place"]: row["write"] for row in held}


def _rows(spark: SparkSession, table: Stored, held: dict[str, str]) -> DataFrame:
    """Rows of the given partitions with the ``write`` they lie in; folders of others are pruned, not read."""
    if not held:
        return spark.createDataFrame([], f"{table.schema}, write string")
    rows = spark.read.schema(f"{table.schema}, write string").parquet(f"{table.folder}/rows")
    wanted = [f"{write}/{place}" for place, write in held.items()]
    return rows.filter(F.concat(F.col("write"), F.lit("/"), _place(table.part)).isin(wanted))


def read(spark: SparkSession, table: Stored, *, with_write: bool = False) -> DataFrame:
    """All rows of the newest version."""
    rows = _rows(spark, table, manifest(spark, table)[1])
    return rows if with_write else rows.drop("write")


def _write(rows: DataFrame, table: Stored) -> tuple[str, list[str]]:
    """Store rows under a fresh write; its name and partitions. A large partition is cut by ranges of the key."""
    write = uuid.uuid4().hex
    path = f"{table.folder}/rows/write={write}"
    by = [table.part, table.key]
    rows.repartitionByRange(*by).sortWithinPartitions(*by).write.partitionBy(table.part).parquet(path)
    try:
        back = rows.sparkSession.read.schema(table.schema).parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return write, []
    return write, [row[0] for row in back.select(_place(table.part)).distinct().collect()]


def _commit(spark: SparkSession, table: Stored, version: int, held: dict[str, str], batch: str) -> None:
    # a table without partitions has a line too, so that its version and batch are known
    lines = [(place, write, batch) for place, write in sorted(held.items())] or [(None, None, batch)]
    named = spark.createDataFrame(lines, "place string, write string, batch string")
    # overwritten, as a try that broke while it wrote its version may have left an empty folder
    named.coalesce(1).write.mode("overwrite").parquet(f"{table.folder}/versions/version={version}")


def is_made(spark: SparkSession, table: Stored, batch: str) -> bool:
    return not _versions(spark, table).filter(F.col("batch") == batch).isEmpty()


def create(rows: DataFrame, table: Stored, batch: str = "created") -> None:
    """Store a whole table as its next version."""
    spark = rows.sparkSession
    last, _ = manifest(spark, table)
    write, places = _write(rows, table)
    _commit(spark, table, last + 1, dict.fromkeys(places, write), batch)


def touched_places(changes: DataFrame, table: Stored, held: dict[str, str]) -> list[str]:
    """Partitions with rows that the changes are about: a line per partition.

    Changes that carry the partition column say so themselves, also of partitions yet to come. Otherwise the key
    column alone is read of all partitions and reduced to the keys changed.
    """
    if table.part in changes.columns:
        return [row[0] for row in changes.select(_place(table.part)).distinct().collect()]
    keys = changes.select(table.key).distinct()
    found = _rows(changes.sparkSession, table, held).select(table.key, _place(table.part).alias("place"))
    return [row[0] for row in found.join(keys, table.key, "left_semi").select("place").distinct().collect()]


def rewrite(
    changes: DataFrame, table: Stored, batch: str, change: Callable[[DataFrame, DataFrame], DataFrame]
) -> list[str] | None:
    """Make a change in the partitions it touches; their values, or None if ``batch`` was made before.

    ``change`` gets the changes and the rows of those partitions and returns their new rows: updated, fewer or more.
    A row may not move to a partition that is not touched; then nothing is changed and an error tells the
    partition. One writer per folder at a time. What broken tries left behind is never read.
    """
    spark = changes.sparkSession
    if is_made(spark, table, batch):
        return None
    last, held = manifest(spark, table)
    touched = sorted(touched_places(changes, table, held))
    rest = {place: write for place, write in held.items() if place not in touched}
    places: list[str] = []
    write = ""
    if touched:
        old = _rows(spark, table, {place: held[place] for place in touched if place in held}).drop("write")
        write, places = _write(change(changes, old).select(*old.columns), table)
        astray = sorted(set(places) - set(touched))
        if astray:
            raise ValueError(f"rows moved to {table.part} {', '.join(astray[:10])}, which the changes do not touch")
    _commit(spark, table, last + 1, rest | dict.fromkeys(places, write), batch)
    return touched
