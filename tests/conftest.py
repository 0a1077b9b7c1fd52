from __future__ import annotations

import datetime as dt
import sys
from decimal import Decimal
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tools")]

from aisle.schemas import TABLES  # noqa: E402
from aisle.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[8]",
        spark__sql__shuffle__partitions="8",
        spark__driver__memory="6g",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")),
        spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def when(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text)


def money(text) -> Decimal:
    return Decimal(text)


START = when("2023-01-01 00:00:00")

CATEGORIES = [(1, "Toys", "play"), (2, "Pantry", None), (3, "Garden", "outside")]
CUSTOMERS = [
    (i, name, f"{name.lower()}@shop.test", "", "", city, "USA", START)
    for i, name, city in [
        (1, "Ada", "Lyon"),
        (2, "Ben", "Oslo"),
        (3, "Cy", "Lyon"),
        (4, "Di", "Rome"),
        (5, "Eve", "Oslo"),
        (6, "Flo", "Rome"),
    ]
]
STORES = [(1, "Shop North", "Oslo", "N", "Max"), (2, "Shop South", "Rome", "S", None), (3, "Shop East", "Riga", None, None)]
EMPLOYEES = [(1, "Zed", 1, "till", dt.date(2022, 5, 1)), (2, "Amy", 2, None, None), (3, "Kim", 1, "lead", None)]
PRODUCTS = [
    (1, "Kite", 1, money("50.00"), 400, 10, START),
    (2, "Blocks", 1, money("25.00"), 10, 10, START),
    (3, "Honey", 2, money("10.00"), 0, 5, START),
    (4, "Rice", 2, money("2.50"), 5, 10, START),
    (5, "Spade", 3, money("30.00"), 12, 10, START),
    (6, "Seeds", 3, money("1.00"), 3, 0, START),
]

# (id, customer, product, store, quantity, total, time, status)
_SALES = [
    (1, 1, 1, 1, 30, "5000.00", "2024-01-31 10:00:00", "completed"),  # neither limit exceeded
    (2, 1, 1, 1, 31, "5000.01", "2024-02-29 23:59:59", "completed"),  # both just exceeded
    (3, 2, 2, 1, 1, "1500.00", "2024-03-01 04:59:59", "completed"),  # last second of the night
    (4, 2, 2, 1, 1, "1500.00", "2024-03-02 05:00:00", "completed"),  # first second after it
    (5, 2, 2, 2, 1, "1000.00", "2024-03-03 00:00:00", "completed"),  # night, limit not exceeded
    (6, 3, 4, 2, 8, "20.00", "2024-04-10 12:00:00", "completed"),
    (7, 3, 4, 2, 1, "2.50", "2024-04-10 12:01:00", "completed"),  # 60 s later
    (8, 3, 4, 2, 1, "2.50", "2024-04-10 12:02:01", "completed"),  # 61 s later
    (9, 4, 3, 2, 2, "20.00", "2024-05-05 09:00:00", "completed"),
    (10, 4, 3, 2, 2, "20.00", "2024-05-05 09:00:10", "pending"),  # in the burst, not completed
    (11, 4, 3, 2, 2, "20.00", "2024-05-05 09:00:20", "completed"),
    (12, 5, 6, 1, 20, "20.00", "2024-05-31 23:59:59", "completed"),
    (13, 6, 5, 2, 1, "30.00", "2024-05-06 10:00:00", "refunded"),  # only sale of its product and customer
    (14, 5, 6, 1, 40, "40.00", "2024-05-07 01:00:00", "cancelled"),
]
TRANSACTIONS = [
    (i, c, p, s, 1, q, (money(total) / q).quantize(money("0.01")), money(total), when(at), "cash", status)
    for i, c, p, s, q, total, at, status in _SALES
]
FLAGS = [
    (1, 2, "High transaction amount: $5,000.01 exceeds $5000 threshold", when("2024-03-01 00:00:00"), "critical", 1),
    (2, 3, "Manual review", when("2024-03-02 00:00:00"), "low", 0),
    (3, 3, "Late-night high-value transaction: $1,500.00 at 04:59:59", when("2024-03-03 00:00:00"), "high", 0),
]
FORECAST = [
    (1, 1, dt.date(2024, 6, 1), money("10.00"), None, None),
    (2, 1, dt.date(2024, 5, 1), money("8.00"), money("10.00"), money("80.00")),
    (3, 2, dt.date(2024, 5, 1), money("3.00"), money("3.00"), money("100.00")),
]
LOG = [
    (1, 1, 1, "restock", 50, when("2024-01-15 08:00:00"), "delivery"),
    (2, 4, 2, "damage", -3, when("2024-02-15 08:00:00"), None),
]
ROWS = {
    "categories": CATEGORIES,
    "customers": CUSTOMERS,
    "stores": STORES,
    "employees": EMPLOYEES,
    "products": PRODUCTS,
    "transactions": TRANSACTIONS,
    "fraud_flags": FLAGS,
    "demand_forecast": FORECAST,
    "inventory_log": LOG,
}


@pytest.fixture(scope="session")
def shop(spark):
    """Retail tables with the boundary cases, read back from storage."""
    return {name: spark.createDataFrame(rows, TABLES[name]) for name, rows in ROWS.items()}


@pytest.fixture(scope="session")
def empty(spark):
    return {name: spark.createDataFrame([], schema) for name, schema in TABLES.items()}


def rows_of(df, *columns) -> list[tuple]:
    """Rows as tuples in stored order, single columns unwrapped."""
    rows = [tuple(r) for r in (df.select(*columns) if columns else df).collect()]
    return [r[0] for r in rows] if len(columns) == 1 else rows
