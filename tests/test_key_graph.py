"""Deletions and renames over the key graph against statements carried out row by row."""

from __future__ import annotations

import random

import pytest
from conftest import rows_of

from aisle.operators import key_graph
from aisle.schemas import FOREIGN_KEYS, ForeignKey


def by_hand(rows: dict[str, list[dict]], requested: dict[str, set]):
    """One row at a time, children first."""
    rows, told = {t: list(r) for t, r in rows.items()}, set()
    links = [k for k in FOREIGN_KEYS if k.child in rows and k.parent in rows]

    def blocked(table, key):
        found = []
        for link in links:
            if link.parent == table:
                below = [r for r in rows[link.child] if r[link.column] == key]
                own = key_graph.key_of(link.child)
                if below and (link.on_delete == "restrict" or any(blocked(link.child, r[own]) for r in below)):
                    found.append(f"{link.child}.{link.column}")
        return min(found, default=None)

    def drop(table, key, cause):
        told.add((table, str(key), "deleted", cause))
        for link in links:
            if link.parent == table and link.on_delete == "cascade":
                own = key_graph.key_of(link.child)
                for below in [r[own] for r in rows[link.child] if r[link.column] == key]:
                    drop(link.child, below, f"{table}.{link.column}")
        rows[table] = [r for r in rows[table] if r[key_graph.key_of(table)] != key]

    at_start = {t: {r[key_graph.key_of(t)] for r in rs} for t, rs in rows.items()}
    for table in key_graph.children_first(list(requested)):
        present = {r[key_graph.key_of(table)] for r in rows[table]}
        causes = {key: blocked(table, key) for key in requested[table] & present}
        for key in requested[table] - at_start[table]:
            told.add((table, str(key), "unknown", None))
        for key, cause in causes.items():
            if cause:
                told.add((table, str(key), "refused", cause))
            else:
                drop(table, key, None)
    return {t: {r[key_graph.key_of(t)] for r in rs} for t, rs in rows.items()}, told


def test_one_set_goes_through_all_levels(spark, shop):
    pick = random.Random(3)
    sets = {
        "transactions": {i for i in range(1, 15) if i not in (6, 9)} | {99},
        "products": {1, 2, 3, 4, 5, 6},
        "customers": {1, 2, 3, 4, 7},
        "stores": {1, 2, 3},
        "categories": {1, 3},
        "employees": {1, 3},
    }
    requested = {
        table: spark.createDataFrame([(k,) for k in pick.sample(sorted(keys), len(keys))] + [(None,), (min(keys),)], f"{key_graph.key_of(table)} bigint")
        for table, keys in sets.items()
    }
    rows = {name: [r.asDict() for r in df.collect()] for name, df in shop.items()}
    left, told = by_hand(rows, sets)
    found = key_graph.delete_keys(shop, requested)
    outcomes = rows_of(found.outcomes)
    assert set(outcomes) == told and len(outcomes) == len(told)
    assert {o for _, _, o, _ in outcomes} == {"deleted", "refused", "unknown"}
    assert {t for t, _, o, c in outcomes if o == "deleted" and c} == {"fraud_flags", "demand_forecast"}
    for name, df in found.tables.items():
        assert sorted(rows_of(df, key_graph.key_of(name))) == sorted(left[name]), name
        assert df.columns == shop[name].columns


def test_a_held_grandchild_holds_the_cascade(spark):
    keys = [ForeignKey("transactions", "customer_id", "customers", "cascade"), ForeignKey("fraud_flags", "transaction_id", "transactions", "restrict")]
    tables = {
        "customers": spark.createDataFrame([(1,), (2,)], "customer_id bigint"),
        "transactions": spark.createDataFrame([(10, 1), (20, 2), (21, 2)], "transaction_id bigint, customer_id bigint"),
        "fraud_flags": spark.createDataFrame([(100, 10)], "flag_id bigint, transaction_id bigint"),
    }
    found = key_graph.delete_keys(tables, {"customers": tables["customers"]}, keys)
    assert set(rows_of(found.outcomes)) == {
        ("customers", "1", "refused", "transactions.customer_id"), ("customers", "2", "deleted", None),
        ("transactions", "20", "deleted", "customers.customer_id"), ("transactions", "21", "deleted", "customers.customer_id"),
    }
    assert rows_of(found.tables["transactions"], "transaction_id") == [10]


def test_cycles_are_refused_and_children_lead():
    order = key_graph.children_first(list({k.child for k in FOREIGN_KEYS} | {k.parent for k in FOREIGN_KEYS}))
    assert all(order.index(k.child) < order.index(k.parent) for k in FOREIGN_KEYS)
    with pytest.raises(ValueError, match="cycle"):
        key_graph.children_first(["a", "b"], [ForeignKey("a", "x", "b", "cascade"), ForeignKey("b", "x", "a", "cascade")])


def test_renames_reach_every_child(spark, shop):
    mapping = spark.createDataFrame(
        [(1, 10), (2, 3), (3, 30), (3, 31), (4, 40), (5, 40), (6, 6), (77, 78), (None, 5)], "product_id bigint, new_key bigint"
    )
    found = key_graph.rename_keys(shop, "products", mapping)
    assert set(rows_of(found.outcomes)) == {
        ("products", "1", "renamed", None), ("products", "2", "refused", "new key in use"), ("products", "3", "refused", "repeated key"),
        ("products", "4", "refused", "new key wanted twice"), ("products", "5", "refused", "new key wanted twice"),
        ("products", "77", "unknown", None),
    }
    assert sorted(rows_of(found.tables["products"], "product_id")) == [2, 3, 4, 5, 6, 10]
    for name in ("transactions", "demand_forecast", "inventory_log"):
        before, after = rows_of(shop[name], "product_id"), rows_of(found.tables[name], "product_id")
        assert sorted(after) == sorted(10 if p == 1 else p for p in before), name


def test_what_became_of_keys_is_told_from_stored_keys(spark, shop):
    """No table is joined again to tell the outcomes, and a restricting child's rows don't move to be looked at."""
    requested = {"transactions": shop["transactions"].filter("quantity < 20"), "customers": shop["customers"], "products": shop["products"]}
    found = key_graph.delete_keys(shop, requested)
    assert "Join" not in found.outcomes._jdf.queryExecution().optimizedPlan().toString()
    rows = {name: [r.asDict() for r in df.collect()] for name, df in shop.items()}
    sets = {name: set(rows_of(df, key_graph.key_of(name))) for name, df in requested.items()}
    assert set(rows_of(found.outcomes)) == by_hand(rows, sets)[1]
    held = key_graph.held_back(shop, "customers", shop["customers"].selectExpr("customer_id AS key"))
    plan = held._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" in plan[plan.index("LeftSemi") :]
