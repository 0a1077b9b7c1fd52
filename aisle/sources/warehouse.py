"""Adapter: the order warehouse tables seen through the retail model.

Two grains of transactions exist. Line items joined to their orders carry products, stores and
prices but only calendar days; events carry exact times and serve the rules that need a clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)

from aisle.functions.money import amount, price

_TYPES = {
    "int": IntegerType(),
    "bigint": LongType(),
    "double": DoubleType(),
    "string": StringType(),
    "timestamp": TimestampNTZType(),
}
_COLUMNS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp",
    "events": "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string",
}
SCHEMAS: dict[str, StructType] = {
    name: StructType([StructField(c.split()[0], _TYPES[c.split()[1]], True) for c in columns.split(", ")])
    for name, columns in _COLUMNS.items()
}

# Warehouse codes and the retail values they stand for.
STATUS_CODES = {"F": "completed", "O": "pending", "P": "refunded"}
PRIORITY_METHODS = {
    "1-URGENT": "online",
    "2-HIGH": "credit_card",
    "3-MEDIUM": "debit_card",
    "4-NOT SPECIFIED": "cash",
    "5-LOW": "gift_card",
}
REORDER_LEVEL = 10


def translated(column: Column, codes: dict[str, str]) -> Column:
    result = F.lit(None).cast("string")
    for code, meaning in reversed(codes.items()):
        result = F.when(column == code, meaning).otherwise(result)
    return result


class Warehouse:
    """Lazy retail views over a folder of warehouse Parquet files."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.folder}/{name}.parquet")

    def transactions(self, status: str | None = None) -> DataFrame:
        """Line items with their order. ``status`` filters on the stored code, below the join."""
        orders = self.raw("orders")
        if status is not None:
            codes = [code for code, meaning in STATUS_CODES.items() if meaning == status]
            orders = orders.filter(F.col("o_orderstatus").isin(*codes))
        quantity, total = F.col("l_quantity").cast("int"), amount(F.col("l_extendedprice"))
        return (
            self.raw("lineitem")
            .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .select(
                F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("transaction_id"),
                F.col("o_custkey").alias("customer_id"),
                F.col("l_partkey").alias("product_id"),
                F.col("l_suppkey").alias("store_id"),
                quantity.alias("quantity"),
                price(total / quantity).alias("unit_price"),
                total.alias("total_amount"),
                F.col("o_orderdate").alias("transaction_date"),
                translated(F.col("o_orderpriority"), PRIORITY_METHODS).alias("payment_method"),
                translated(F.col("o_orderstatus"), STATUS_CODES).alias("status"),
            )
        )

    def completed(self) -> DataFrame:
        return self.transactions("completed")

    def events(self) -> DataFrame:
        """Events as transactions: the amount is the value, quantity and product the logged number."""
        return event_transactions(self.raw("events"))

    def customers(self, with_city: bool = False) -> DataFrame:
        rows = self.raw("customer").select(
            F.col("c_custkey").alias("customer_id"),
            F.col("c_name").alias("name"),
            F.concat(F.translate(F.lower("c_name"), "#", "."), F.lit("@example.com")).alias("email"),
            F.col("c_nationkey").alias("n_nationkey"),
        )
        if not with_city:
            return rows.drop("n_nationkey")
        nations = self.raw("nation").select("n_nationkey", F.col("n_name").alias("city"))
        return rows.join(nations, "n_nationkey").drop("n_nationkey")

    def products(self) -> DataFrame:
        return self.raw("part").select(
            F.col("p_partkey").alias("product_id"),
            F.col("p_name").alias("product_name"),
            F.col("p_type").alias("category_id"),
            F.col("p_type").alias("category_name"),
            price(F.col("p_retailprice")).alias("price"),
            F.col("p_size").alias("stock_quantity"),
            F.lit(REORDER_LEVEL).alias("reorder_level"),
        )

    def categories(self) -> DataFrame:
        return self.raw("part").select(
            F.col("p_type").alias("category_id"), F.col("p_type").alias("category_name")
        ).distinct()

    def stores(self, with_city: bool = False) -> DataFrame:
        """Names alone unless asked: joined to raw transactions, a side that is itself a join is
        estimated far too large and costs a shuffle of the transactions."""
        if not with_city:
            return self.raw("supplier").select(
                F.col("s_suppkey").alias("store_id"), F.col("s_name").alias("store_name")
            )
        nations, regions = self.raw("nation"), self.raw("region")
        return (
            self.raw("supplier")
            .join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
            .join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
            .select(
                F.col("s_suppkey").alias("store_id"),
                F.col("s_name").alias("store_name"),
                F.col("n_name").alias("city"),
                F.col("r_name").alias("region"),
            )
        )


def event_transactions(events: DataFrame) -> DataFrame:
    """Batch or streaming events in transaction shape; an 'error' event is a cancelled sale."""
    number = F.regexp_extract("props", '"k": *([0-9]+)', 1).cast("int")
    return events.select(
        F.col("event_id").alias("transaction_id"),
        F.col("user_id").alias("customer_id"),
        number.cast("bigint").alias("product_id"),
        number.cast("bigint").alias("store_id"),
        number.alias("quantity"),
        amount(F.col("value")).alias("total_amount"),
        F.col("ts").alias("transaction_date"),
        F.lit("online").alias("payment_method"),
        F.when(F.col("event_type") == "error", "cancelled").otherwise("completed").alias("status"),
    )
