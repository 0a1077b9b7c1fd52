"""Data-quality checks standing in for the constraints a database would enforce."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from aisle.schemas import DOMAINS, FOREIGN_KEYS, MAX_LENGTHS, TABLES, UNIQUE_KEYS


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def check_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key values held by more than one row, with the number of rows."""
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).filter(F.col("copies") > 1)


def check_unique_keys(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Duplicated values and surplus rows per declared key; no row for a clean key."""
    parts = []
    for name, df in tables.items():
        for key in UNIQUE_KEYS[name]:
            found = check_keys(df, key).agg(
                F.count("*").alias("duplicated"), F.sum(F.col("copies") - 1).alias("surplus")
            )
            parts.append(
                found.select(F.lit(name).alias("table"), F.lit(", ".join(key)).alias("key"), "duplicated", "surplus")
            )
    return _union(parts).filter(F.col("duplicated") > 0)


def orphans(child: DataFrame, column: str, parent: DataFrame, parent_key: str | None = None) -> DataFrame:
    """Child key values without a parent, with their number of rows.

    Child rows are counted per key before the join; a NULL refers to nothing and is no orphan.
    """
    held = child.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("rows"))
    known = parent.select(F.col(parent_key or column).alias(column))
    return held.join(known, column, "left_anti")


def check_foreign_keys(tables: Mapping[str, DataFrame], foreign_keys=FOREIGN_KEYS) -> DataFrame:
    """Orphans of every foreign key whose two tables are given."""
    parts = [
        orphans(tables[fk.child], fk.column, tables[fk.parent]).select(
            F.lit(fk.child).alias("child"),
            F.lit(fk.column).alias("column"),
            F.col(fk.column).cast("string").alias("key"),
            "rows",
        )
        for fk in foreign_keys
        if fk.child in tables and fk.parent in tables
    ]
    return _union(parts)


def check_domains(
    df: DataFrame,
    *,
    required: Sequence[str] = (),
    allowed: Mapping[str, Sequence] | None = None,
    longest: Mapping[str, int] | None = None,
) -> DataFrame:
    """Rows breaking a rule, one output row per (row, rule), with ``column`` and ``problem`` added."""
    tests = [(c, F.col(c).isNull(), "null") for c in required]
    tests += [
        (c, F.col(c).isNotNull() & ~F.col(c).isin(*values), "not allowed") for c, values in (allowed or {}).items()
    ]
    tests += [(c, F.length(c) > size, "too long") for c, size in (longest or {}).items()]
    found = F.array(
        *[
            F.when(test, F.struct(F.lit(c).alias("column"), F.lit(problem).alias("problem")))
            for c, test, problem in tests
        ]
    )
    broken = F.lit(False)
    for _, test, _ in tests:
        broken = broken | test
    exploded = df.filter(broken).select(*df.columns, F.explode(found).alias("found"))
    return exploded.filter(F.col("found").isNotNull()).select(*df.columns, "found.*")


def check_table(name: str, df: DataFrame) -> DataFrame:
    """:func:`check_domains` with the declared rules of a retail table."""
    schema: StructType = TABLES[name]
    return check_domains(
        df,
        required=[f.name for f in schema.fields if not f.nullable],
        allowed=DOMAINS.get(name),
        longest=MAX_LENGTHS.get(name),
    )
