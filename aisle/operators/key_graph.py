"""Deleting and renaming keys over the whole graph of foreign keys.

One deletion set over several tables acts like one DELETE statement per table, children first, in which each row
stands for itself: a row that a remaining child of a restricting key refers to is refused, together with what its
deletion would have cascaded to. Keys are semi-joined to each child, so a child is read once per key; of a child that
restricts only its different parents' keys move.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aisle.operators.changes import cascade_key_update
from aisle.schemas import FOREIGN_KEYS, UNIQUE_KEYS, ForeignKey
from aisle.session import materialise, stored

OUTCOMES = ["table", "key", "outcome", "cause"]


class Changed(NamedTuple):
    """The tables as they are to be stored, and one row per requested or cascaded key with what became of it."""

    tables: dict[str, DataFrame]
    outcomes: DataFrame


def key_of(table: str) -> str:
    return UNIQUE_KEYS[table][0][0]


def children_first(names: list[str], keys: list[ForeignKey] = FOREIGN_KEYS) -> list[str]:
    """Table names ordered so that every child comes before its parents; a cycle of keys is an error."""
    left, ordered = sorted(names), []
    while left:
        free = [n for n in left if not any(k.parent == n and k.child in left and k.child != n for k in keys)]
        if not free:
            raise ValueError(f"foreign keys of {', '.join(left)} form a cycle")
        ordered += free
        left = [n for n in left if n not in free]
    return ordered


def _links(tables: Mapping[str, DataFrame], parent: str, keys: list[ForeignKey]) -> list[ForeignKey]:
    return [k for k in keys if k.parent == parent and k.child in tables]


def _referring(tables: Mapping[str, DataFrame], link: ForeignKey, parents: DataFrame) -> DataFrame:
    """Child rows of the given parent ``key``s: their own ``child_key`` and the parent's ``key``."""
    child = tables[link.child].select(F.col(key_of(link.child)).alias("child_key"), F.col(link.column).alias("key"))
    return child.join(parents, "key", "left_semi")


def _holding(tables: Mapping[str, DataFrame], table: str, keys: list[ForeignKey]) -> list[ForeignKey]:
    """Links by which a row of the table may be held: restricting ones, and cascading ones to a table with children."""
    return [k for k in _links(tables, table, keys) if k.on_delete == "restrict" or _links(tables, k.child, keys)]


def _looked_at(tables: Mapping[str, DataFrame], parents: list[str], keys: list[ForeignKey]) -> set[str]:
    """Tables that are read when keys of the ``parents`` are judged and deleted."""
    found, left = set(parents), list(parents)
    while left:
        for link in _links(tables, left.pop(), keys):
            if link.on_delete == "cascade" and link.child not in found:
                left.append(link.child)
            found.add(link.child)
    return found


def held_back(tables: Mapping[str, DataFrame], table: str, wanted: DataFrame, keys: list[ForeignKey] = FOREIGN_KEYS) -> DataFrame:
    """Of the ``wanted`` (key) rows of a table those that can't go, with the first ``cause`` by name.

    A restricting child holds its parent; a cascading child holds it if the child itself is held.
    """
    found = []
    for link in _holding(tables, table, keys):
        if link.on_delete == "restrict":
            held = tables[link.child].select(F.col(link.column).alias("key")).distinct().join(wanted, "key", "left_semi")
        else:
            rows = _referring(tables, link, wanted)
            below = held_back(tables, link.child, rows.select(F.col("child_key").alias("key")).distinct(), keys)
            held = rows.join(below.select(F.col("key").alias("child_key")), "child_key", "left_semi").select("key").distinct()
        found.append(held.withColumn("cause", F.lit(f"{link.child}.{link.column}")))
    if not found:
        return wanted.limit(0).withColumn("cause", F.lit(None).cast("string"))
    return reduce(DataFrame.unionByName, found).groupBy("key").agg(F.min("cause").alias("cause"))


def _outcome(table: str, keys: DataFrame, outcome: str, cause: str | None = None) -> DataFrame:
    why = F.col("cause") if "cause" in keys.columns else F.lit(cause).cast("string")
    return keys.select(
        F.lit(table).alias("table"), F.col("key").cast("string").alias("key"), F.lit(outcome).alias("outcome"), why.alias("cause")
    )


def _drop(
    left: dict[str, DataFrame], seen: dict[str, DataFrame], table: str, gone: DataFrame, cause: str | None, keys: list[ForeignKey]
) -> list[DataFrame]:
    """Remove rows by ``key`` and, below them, what their keys cascade to; the outcomes.

    ``left`` has the tables to be stored, ``seen`` their rows as judgements read them.
    """
    told = [_outcome(table, gone, "deleted", cause)]
    for link in _links(seen, table, keys):
        if link.on_delete == "cascade":
            rows = stored(_referring(seen, link, gone).select(F.col("child_key").alias("key")).distinct(), "cascaded-keys")
            told += _drop(left, seen, link.child, rows, f"{table}.{link.column}", keys)
    own = key_of(table)
    for rows in (left, seen):
        rows[table] = rows[table].join(gone.select(F.col("key").alias("gone_key")), F.col(own) == F.col("gone_key"), "left_anti")
    return told


def delete_keys(
    tables: Mapping[str, DataFrame], requested: Mapping[str, DataFrame], keys: list[ForeignKey] = FOREIGN_KEYS
) -> Changed:
    """``tables`` without the rows whose keys are ``requested`` (table name to a DataFrame with its key column).

    Each requested key is deleted, refused (``cause`` names the child column that holds it) or unknown; NULL
    and repeated requests count as none and one. A row already gone by a cascade is told as that. What a table
    loses is stored before the next table is looked at, and so are the keys it keeps if they are looked at again, so
    plans don't grow along the graph. ``tables`` are read several times: one that is a join should be stored before.
    """
    left, seen, told = dict(tables), dict(tables), []
    order = children_first([name for name in tables if name in requested], keys)
    for at, table in enumerate(order):
        own = key_of(table)
        asked = requested[table].select(F.col(own).alias("key")).filter("key IS NOT NULL").distinct()
        held_by = lambda rows: rows.select(F.col(own).alias("key")).join(asked, "key", "left_semi").distinct()  # noqa: B023, E731
        marked = asked.join(held_by(tables[table]).withColumn("known", F.lit(True)), "key", "left")
        if seen[table] is tables[table]:
            marked = marked.withColumn("present", F.col("known"))
        else:
            marked = marked.join(held_by(seen[table]).withColumn("present", F.lit(True)), "key", "left")
        marked = stored(marked, "asked-keys")
        told.append(_outcome(table, marked.filter("known IS NULL"), "unknown"))
        gone = present = marked.filter("present").select("key")
        if _holding(seen, table, keys):
            judged = stored(present.join(held_back(seen, table, present, keys), "key", "left"), "judged-keys")
            told.append(_outcome(table, judged.filter("cause IS NOT NULL"), "refused"))
            gone = judged.filter("cause IS NULL").select("key")
        before = dict(seen)
        told += _drop(left, seen, table, gone, None, keys)
        for name in _looked_at(seen, order[at + 1 :], keys):
            if seen[name] is not before[name]:
                used = {key_of(name)} | {k.column for k in keys if k.child == name}
                seen[name] = stored(seen[name].select(*[c for c in seen[name].columns if c in used]), "kept-keys")
    return Changed(left, reduce(DataFrame.unionByName, told))


def rename_keys(
    tables: Mapping[str, DataFrame], table: str, mapping: DataFrame, keys: list[ForeignKey] = FOREIGN_KEYS
) -> Changed:
    """A table's keys changed by ``mapping`` (its key column and ``new_key``), children following.

    Refused are a key mapped twice, two keys given one new key, and a new key that any row held before; unknown
    and NULL keys change nothing. Renaming a key to itself is no change. No child row is lost or multiplied.
    """
    own = key_of(table)
    asked = (
        mapping.select(F.col(own).alias("key"), "new_key")
        .filter("key IS NOT NULL AND new_key IS NOT NULL AND key <> new_key")
        .distinct()
    )
    targets = asked.groupBy("new_key").agg((F.count("*") > 1).alias("shared"))
    per_key = asked.groupBy("key").agg((F.count("*") > 1).alias("repeated"), F.min("new_key").alias("new_key"))
    held = tables[table].select(F.col(own).alias("new_key")).join(asked.select("new_key"), "new_key", "left_semi").distinct()
    stored = tables[table].select(F.col(own).alias("key")).join(asked.select("key"), "key", "left_semi").distinct()
    cause = (
        F.when(F.col("repeated"), "repeated key")
        .when(F.col("taken").isNotNull(), "new key in use")
        .when(F.col("shared"), "new key wanted twice")
    )
    judged = materialise(
        per_key.join(stored.withColumn("known", F.lit(True)), "key", "left")
        .join(targets, "new_key", "left")
        .join(held.withColumn("taken", F.lit(True)), "new_key", "left")
        .select("key", "new_key", "known", cause.alias("cause"))
    )
    good = judged.filter("known AND cause IS NULL")
    told = [
        _outcome(table, good, "renamed"),
        _outcome(table, judged.filter("known AND cause IS NOT NULL"), "refused"),
        _outcome(table, judged.filter("known IS NULL").drop("cause"), "unknown"),
    ]
    changed = dict(tables)
    for name, column in [(table, own)] + [(k.child, k.column) for k in _links(tables, table, keys)]:
        changed[name] = cascade_key_update(changed[name], good.select(F.col("key").alias(column), "new_key"), column)
    return Changed(changed, reduce(DataFrame.unionByName, told))
