"""Changes to stored tables as joins: appends with validation, keyed updates, cascades.

Every function returns the rows to store; nothing is written here. Tables are files, so a changed
table is written as a new version next to the old one and the caller switches over.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aisle.plans.positions import positions
from aisle.schemas import AMOUNT, PAYMENT_METHODS, PRICE, STATUSES


class Checked(NamedTuple):
    """Rows to append and rows turned away; the latter name the first failed check in ``problem``."""

    accepted: DataFrame
    rejected: DataFrame


def _check(batch: DataFrame, required: list[str], rules: list[tuple[Column, str]]) -> Checked:
    """Split ``batch`` by required columns and failure rules; an absent column counts as missing.

    The accepting side is a plain conjunction, so each test can move down to the scan it belongs to.
    """
    for column in required:
        if column not in batch.columns:
            batch = batch.withColumn(column, F.lit(None).cast("string"))
    good = F.lit(True)
    for column in required:
        good = good & F.col(column).isNotNull()
    for fails, _ in rules:
        good = good & ~fails
    tests = [(F.col(c).isNull(), f"missing {c}") for c in required] + rules
    problem = F.coalesce(*[F.when(fails, message) for fails, message in tests])
    rejected = batch.withColumn("problem", problem).filter(F.col("problem").isNotNull())
    return Checked(batch.filter(good), rejected)


def _or_default(df: DataFrame, column: str, value: Column) -> Column:
    return F.coalesce(F.col(column), value) if column in df.columns else value


def with_next_ids(rows: DataFrame, table: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Number ``rows`` after the largest stored key, in the given order."""
    last = table.agg(F.max(key)).first()[0] or 0
    numbered = positions(rows, [(c, True) for c in order], [])
    return numbered.select((F.col("row_no") + last).alias(key), *rows.columns)


def with_missing_ids(table: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``table`` with its NULL keys numbered after the largest one; rows added by an upsert have none."""
    kept, new = table.filter(F.col(key).isNotNull()), table.filter(F.col(key).isNull())
    return kept.unionByName(with_next_ids(new.drop(key), kept, key, order).select(*table.columns))


def _with_parents(batch: DataFrame, parents: dict[str, DataFrame]) -> tuple[DataFrame, list[tuple[Column, str]]]:
    """Mark which keys exist among their parents; the rules that refuse the others.

    Parents are reduced to the batch's keys first, so a small batch costs each parent one narrow scan.
    """
    rules = []
    for key, parent in parents.items():
        if key in batch.columns:
            asked = batch.select(key).distinct()
            held = parent.select(key).join(asked, key, "left_semi").distinct().withColumn(f"has_{key}", F.lit(True))
            batch = batch.join(held, key, "left")
            rules.append((F.col(f"has_{key}").isNull(), f"unknown {key}"))
    return batch, rules


def _without_marks(found: Checked, batch: DataFrame) -> Checked:
    marks = [c for c in found.accepted.columns if c.startswith("has_") and c not in batch.columns]
    return Checked(found.accepted.drop(*marks), found.rejected.drop(*marks))


def append_transactions(batch: DataFrame, at: Column | None = None, tables: Mapping[str, DataFrame] | None = None) -> Checked:
    """Validated sales with their total and status 'completed'.

    Total is quantity times price in decimal; a price or total that its column cannot hold is rejected. The
    date is the batch's own where present, else ``at``, else now. Ids are the batch's own if it has them.
    With ``tables`` customers, products, stores and employees must be known.
    """
    required = ["customer_id", "product_id", "store_id", "employee_id", "quantity", "unit_price", "payment_method"]
    parents = {"customer_id": "customers", "product_id": "products", "store_id": "stores", "employee_id": "employees"}
    held = {key: tables[name] for key, name in parents.items() if tables is not None and name in tables}
    marked, unknown = _with_parents(batch, held)
    price = F.col("unit_price").try_cast(PRICE)
    total = F.expr("try_multiply(CAST(quantity AS decimal(20,0)), try_cast(unit_price AS decimal(10,2)))").try_cast(AMOUNT)
    found = _check(
        marked,
        required,
        [
            (F.col("quantity") < 1, "quantity below 1"),
            (F.col("unit_price") <= 0, "price not above 0"),
            (~F.col("payment_method").isin(*PAYMENT_METHODS), "unknown payment_method"),
            *unknown,
            (price.isNull(), "price out of range"),
            (total.isNull(), "total out of range"),
        ],
    )
    good, bad = _without_marks(found, batch)
    now = at if at is not None else F.localtimestamp()
    accepted = good.select(
        *[c for c in ("transaction_id",) if c in good.columns],
        "customer_id",
        "product_id",
        "store_id",
        "employee_id",
        "quantity",
        price.alias("unit_price"),
        total.alias("total_amount"),
        _or_default(good, "transaction_date", now).alias("transaction_date"),
        "payment_method",
        F.lit("completed").alias("status"),
    )
    return Checked(accepted, bad)


def append_products(batch: DataFrame, at: Column | None = None, categories: DataFrame | None = None) -> Checked:
    """Products to add: all five fields are required, the category must be one of ``categories`` if given."""
    required = ["product_name", "category_id", "price", "stock_quantity", "reorder_level"]
    marked, unknown = _with_parents(batch, {} if categories is None else {"category_id": categories})
    found = _check(marked, required, [*unknown, (F.col("price").try_cast(PRICE).isNull(), "price out of range")])
    good, bad = _without_marks(found, batch)
    now = at if at is not None else F.localtimestamp()
    accepted = good.select(
        *[c for c in ("product_id",) if c in good.columns],
        "product_name",
        "category_id",
        F.col("price").try_cast(PRICE).alias("price"),
        "stock_quantity",
        "reorder_level",
        _or_default(good, "created_at", now).alias("created_at"),
    )
    return Checked(accepted, bad)


def append_customers(batch: DataFrame, customers: DataFrame, at: Column | None = None) -> Checked:
    """Customers to add: name and email required, e-mail unique within the batch and the table.

    Of several rows with one e-mail the smallest (name, phone, ...) is kept, whatever the row order; every
    other row is rejected with all its fields, as are all rows of an address already stored. Equal rows are
    counted before they move.
    """
    good, bad = _check(batch, ["name", "email"], [])
    now = at if at is not None else F.localtimestamp()
    own = [c for c in ("customer_id",) if c in good.columns]
    filled = good.select(
        *own,
        "name",
        "email",
        *[_or_default(good, c, F.lit("")).alias(c) for c in ("phone", "address", "city")],
        _or_default(good, "country", F.lit("USA")).alias("country"),
        _or_default(good, "created_at", now).alias("created_at"),
    )
    row = F.struct("name", *[c for c in filled.columns if c not in ("name", "email")])
    counted = filled.select("email", row.alias("row")).groupBy("email", "row").agg(F.count("*").alias("copies"))
    first = counted.groupBy("email").agg(F.min("row").alias("first"))
    # stored addresses reduced to the batch's, so that a small batch costs the table one scan
    stored = customers.select("email").join(first.select("email"), "email", "left_semi").distinct()
    chosen = first.join(stored.withColumn("stored", F.lit(True)), "email", "left")
    accepted = chosen.filter(F.col("stored").isNull()).select("email", "first.*").select(*filled.columns)
    refused = counted.join(chosen, "email").withColumn(
        "times", F.col("copies") - F.when(F.col("stored").isNull() & (F.col("row") == F.col("first")), 1).otherwise(0)
    )
    turned_away = refused.filter("times > 0").select(
        "email",
        "row.*",
        F.when(F.col("stored").isNotNull(), F.lit("email already stored"))
        .otherwise(F.lit("email repeated in batch"))
        .alias("problem"),
        F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("times"))).alias("copy"),
    )
    return Checked(accepted, bad.unionByName(turned_away.drop("copy"), allowMissingColumns=True))


def last_values(changes: DataFrame, key: str, order: str | None) -> DataFrame:
    """One row per key: of each column the last value that is not NULL by ``order``.

    Without an order a key that is repeated is left out, as nothing says which change is the last; see
    :func:`repeated_changes`. Equal rows are one change.
    """
    values = [c for c in changes.columns if c not in (key, order)]
    if order is None:
        once = changes.distinct()
        single = once.groupBy(key).agg(F.count("*").alias("changes"), *[F.max(c).alias(c) for c in values])
        return single.filter("changes = 1").drop("changes")
    latest = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct(F.col(order), F.col(c).alias("value")))).getField("value")
    return changes.groupBy(key).agg(*[latest(c).alias(c) for c in values])


def repeated_changes(changes: DataFrame, key: str) -> DataFrame:
    """Different changes of one key that come without an order, with the ``problem``; none of them is made."""
    repeated = changes.distinct().groupBy(key).count().filter("count > 1").select(key)
    return changes.join(repeated, key, "left_semi").withColumn("problem", F.lit(f"{key} repeated without an order"))


def update_products(changes: DataFrame, products: DataFrame, order: str | None = None) -> DataFrame:
    """Products with the given name, price, stock and reorder level; NULL keeps the old value.

    ``changes`` has product_id and any of the four columns; ``order`` names a column by which several changes
    of one product follow one another, so that of each field the last given value stays.
    """
    editable = [c for c in ("product_name", "price", "stock_quantity", "reorder_level") if c in changes.columns]
    new = last_values(changes.select("product_id", *([order] if order else []), *editable), "product_id", order).select(
        "product_id", *[F.col(c).alias(f"new_{c}") for c in editable]
    )
    kind = dict(zip(products.columns, [f.dataType for f in products.schema.fields], strict=True))
    return products.join(new, "product_id", "left").select(
        *[
            F.coalesce(F.col(f"new_{c}").cast(kind[c]), F.col(c)).alias(c) if c in editable else F.col(c)
            for c in products.columns
        ]
    )


def unknown_flags(ids: DataFrame, flags: DataFrame) -> DataFrame:
    """Ids to resolve that no flag has, with the ``problem``."""
    return ids.join(flags.select("flag_id"), "flag_id", "left_anti").withColumn("problem", F.lit("unknown flag_id"))


def resolve_flags(flags: DataFrame, ids: DataFrame) -> DataFrame:
    """Flags with resolved = 1 for the given flag ids."""
    done = ids.select("flag_id").distinct().withColumn("done", F.lit(True))
    resolved = F.when(F.col("done").isNotNull(), 1).otherwise(F.col("resolved"))
    return flags.join(done, "flag_id", "left").select(
        *[resolved.alias(c) if c == "resolved" else F.col(c) for c in flags.columns]
    )


def update_status(changes: DataFrame, transactions: DataFrame, order: str | None = None) -> DataFrame:
    """Transactions with the status of ``changes`` (transaction_id, status) where it is a valid one.

    ``order`` names a column by which the last of several changes to one transaction is taken.
    :func:`rejected_status` has the changes that are not made.
    """
    valid = changes.filter(F.col("status").isin(*STATUSES))
    wanted = ["transaction_id", "status", *([order] if order else [])]
    new = last_values(valid.select(*wanted), "transaction_id", order).withColumnRenamed("status", "new_status")
    status = F.coalesce("new_status", "status")
    return transactions.join(new, "transaction_id", "left").select(
        *[status.alias(c) if c == "status" else F.col(c) for c in transactions.columns]
    )


def rejected_status(changes: DataFrame, transactions: DataFrame) -> DataFrame:
    """Changes with a status that does not exist or of a transaction that does not, whole, with the ``problem``."""
    known = transactions.select("transaction_id").join(changes.select("transaction_id"), "transaction_id", "left_semi")
    marked = changes.join(known.distinct().withColumn("known", F.lit(True)), "transaction_id", "left")
    problem = (
        F.when(F.col("status").isNull(), "missing status")
        .when(~F.col("status").isin(*STATUSES), "unknown status")
        .when(F.col("known").isNull(), "unknown transaction_id")
    )
    found = marked.withColumn("problem", problem).filter(F.col("problem").isNotNull())
    return found.select(*changes.columns, "problem")


def cascade_delete(child: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """Child rows left after their deleted parents' rows go."""
    return child.join(deleted.select(key).distinct(), key, "left_anti")


def restrict_delete(parents: DataFrame, child: DataFrame, key: str) -> DataFrame:
    """Parents that may not be deleted because children refer to them.

    Children are first reduced to those of the given parents, usually few.
    """
    held = child.select(key).join(parents.select(key), key, "left_semi").distinct()
    return parents.join(held, key, "left_semi")


def cascade_key_update(child: DataFrame, mapping: DataFrame, key: str) -> DataFrame:
    """Child rows following renamed parents; ``mapping`` has ``key`` and ``new_key``."""
    follow = F.coalesce("new_key", key)
    return child.join(mapping.select(key, "new_key"), key, "left").select(
        *[follow.alias(c) if c == key else F.col(c) for c in child.columns]
    )
