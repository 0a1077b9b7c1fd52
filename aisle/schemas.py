"""Retail model: table schemas, keys, foreign keys and value domains."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql.types import (
    DateType,
    DecimalType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)

_INT = IntegerType()
_KEY = LongType()  # surrogate keys outgrow 32 bits at cluster scale
_TEXT = StringType()
_WHEN = TimestampNTZType()
_DAY = DateType()
PRICE = DecimalType(10, 2)
AMOUNT = DecimalType(12, 2)
PERCENT = DecimalType(5, 2)


def _table(required: dict, optional: dict | None = None, order: list[str] | None = None) -> StructType:
    fields = {name: StructField(name, kind, False) for name, kind in required.items()}
    fields.update({name: StructField(name, kind, True) for name, kind in (optional or {}).items()})
    return StructType([fields[name] for name in (order or fields)])


TABLES: dict[str, StructType] = {
    "categories": _table({"category_id": _KEY, "category_name": _TEXT}, {"description": _TEXT}),
    "customers": _table(
        {"customer_id": _KEY, "name": _TEXT, "email": _TEXT, "created_at": _WHEN},
        {"phone": _TEXT, "address": _TEXT, "city": _TEXT, "country": _TEXT},
        ["customer_id", "name", "email", "phone", "address", "city", "country", "created_at"],
    ),
    "stores": _table(
        {"store_id": _KEY, "store_name": _TEXT, "city": _TEXT},
        {"region": _TEXT, "manager_name": _TEXT},
    ),
    "employees": _table(
        {"employee_id": _KEY, "name": _TEXT, "store_id": _KEY},
        {"role": _TEXT, "hire_date": _DAY},
    ),
    "products": _table(
        {
            "product_id": _KEY,
            "product_name": _TEXT,
            "category_id": _KEY,
            "price": PRICE,
            "stock_quantity": _INT,
            "reorder_level": _INT,
            "created_at": _WHEN,
        }
    ),
    "transactions": _table(
        {
            "transaction_id": _KEY,
            "customer_id": _KEY,
            "product_id": _KEY,
            "store_id": _KEY,
            "employee_id": _KEY,
            "quantity": _INT,
            "unit_price": PRICE,
            "total_amount": AMOUNT,
            "transaction_date": _WHEN,
            "payment_method": _TEXT,
            "status": _TEXT,
        }
    ),
    "fraud_flags": _table(
        {
            "flag_id": _KEY,
            "transaction_id": _KEY,
            "flag_reason": _TEXT,
            "flagged_at": _WHEN,
            "severity": _TEXT,
            "resolved": _INT,
        }
    ),
    "demand_forecast": _table(
        {"forecast_id": _KEY, "product_id": _KEY, "forecast_date": _DAY, "predicted_demand": PRICE},
        {"actual_demand": PRICE, "accuracy_pct": PERCENT},
    ),
    "inventory_log": _table(
        {
            "log_id": _KEY,
            "product_id": _KEY,
            "store_id": _KEY,
            "change_type": _TEXT,
            "quantity_change": _INT,
            "log_date": _WHEN,
        },
        {"notes": _TEXT},
    ),
}

UNIQUE_KEYS: dict[str, list[tuple[str, ...]]] = {
    "categories": [("category_id",), ("category_name",)],
    "customers": [("customer_id",), ("email",)],
    "stores": [("store_id",)],
    "employees": [("employee_id",)],
    "products": [("product_id",)],
    "transactions": [("transaction_id",)],
    "fraud_flags": [("flag_id",)],
    "demand_forecast": [("forecast_id",), ("product_id", "forecast_date")],
    "inventory_log": [("log_id",)],
}


class ForeignKey(NamedTuple):
    child: str
    column: str
    parent: str
    on_delete: str  # "restrict" or "cascade"; key updates always cascade


FOREIGN_KEYS = [
    ForeignKey("employees", "store_id", "stores", "restrict"),
    ForeignKey("products", "category_id", "categories", "restrict"),
    ForeignKey("transactions", "customer_id", "customers", "restrict"),
    ForeignKey("transactions", "product_id", "products", "restrict"),
    ForeignKey("transactions", "store_id", "stores", "restrict"),
    ForeignKey("transactions", "employee_id", "employees", "restrict"),
    ForeignKey("fraud_flags", "transaction_id", "transactions", "cascade"),
    ForeignKey("demand_forecast", "product_id", "products", "cascade"),
    ForeignKey("inventory_log", "product_id", "products", "restrict"),
    ForeignKey("inventory_log", "store_id", "stores", "restrict"),
]

# The value sets and text lengths the tables accept.
PAYMENT_METHODS = ("cash", "credit_card", "debit_card", "online", "gift_card")
STATUSES = ("completed", "pending", "refunded", "cancelled")
SEVERITIES = ("low", "medium", "high", "critical")
CHANGE_TYPES = ("sale", "restock", "adjustment", "return", "damage")

DOMAINS: dict[str, dict[str, tuple]] = {
    "transactions": {"payment_method": PAYMENT_METHODS, "status": STATUSES},
    "fraud_flags": {"severity": SEVERITIES, "resolved": (0, 1)},
    "inventory_log": {"change_type": CHANGE_TYPES},
}

MAX_LENGTHS: dict[str, dict[str, int]] = {
    "categories": {"category_name": 100},
    "customers": {"name": 100, "email": 150, "phone": 20, "address": 255, "city": 100, "country": 100},
    "stores": {"store_name": 150, "city": 100, "region": 100, "manager_name": 100},
    "employees": {"name": 100, "role": 80},
    "products": {"product_name": 150},
    "fraud_flags": {"flag_reason": 255},
    "inventory_log": {"notes": 255},
}
