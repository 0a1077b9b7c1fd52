"""Named queries over the warehouse tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, IntegerType, ShortType

from aisle.sources.warehouse import Warehouse

# The retail views of aisle.sources.warehouse, written as SQL on their own.
MODEL_SQL = """
WITH tx AS (
    SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS transaction_id,
           o_custkey AS customer_id, l_partkey AS product_id, l_suppkey AS store_id,
           CAST(l_quantity AS BIGINT) AS quantity,
           CAST(l_extendedprice AS DECIMAL(12,2)) AS total_amount,
           o_orderdate AS transaction_date,
           CASE o_orderpriority WHEN '1-URGENT' THEN 'online' WHEN '2-HIGH' THEN 'credit_card'
                WHEN '3-MEDIUM' THEN 'debit_card' WHEN '4-NOT SPECIFIED' THEN 'cash'
                WHEN '5-LOW' THEN 'gift_card' END AS payment_method,
           CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending'
                WHEN 'P' THEN 'refunded' END AS status
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey
), sold AS (
    SELECT * FROM tx WHERE status = 'completed'
), priced AS (
    SELECT *, ((2 * CAST(total_amount * 100 AS BIGINT) + quantity) // (2 * quantity)) / 100.0 AS unit_price
    FROM tx
), ev AS (
    SELECT event_id AS transaction_id, user_id AS customer_id,
           CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS product_id,
           CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS quantity,
           CAST(value AS DECIMAL(12,2)) AS total_amount, ts AS transaction_date,
           CASE WHEN event_type = 'error' THEN 'cancelled' ELSE 'completed' END AS status
    FROM events
), products AS (
    SELECT p_partkey AS product_id, p_name AS product_name, p_type AS category_name,
           CAST(p_retailprice AS DECIMAL(10,2)) AS price, CAST(p_size AS BIGINT) AS stock_quantity,
           CAST(10 AS BIGINT) AS reorder_level
    FROM part
), stores AS (
    SELECT s_suppkey AS store_id, s_name AS store_name, n_name AS city, r_name AS region
    FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
), customers AS (
    SELECT c_custkey AS customer_id, c_name AS name,
           replace(lower(c_name), '#', '.') || '@example.com' AS email, n_name AS city
    FROM customer JOIN nation ON c_nationkey = n_nationkey
)
"""


class Entry(NamedTuple):
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


ENTRIES: dict[str, Entry] = {}


def comparable(df: DataFrame) -> DataFrame:
    """Decimals as doubles and small integers as bigints, the types the SQL side returns."""

    def shown(field):
        if isinstance(field.dataType, DecimalType):
            return F.col(field.name).cast("double").alias(field.name)
        if isinstance(field.dataType, (IntegerType, ShortType)):
            return F.col(field.name).cast("bigint").alias(field.name)
        return F.col(field.name)

    return df.select(*[shown(field) for field in df.schema.fields])


def query(sql: str | None = None, model: str = MODEL_SQL):
    """Register a function of a :class:`Warehouse` under its name; ``sql`` follows the model views."""

    def register(function: Callable[[Warehouse], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return comparable(function(Warehouse(spark, folder)))

        run.__name__ = function.__name__
        run.__doc__ = function.__doc__
        if function.__name__ in ENTRIES:
            raise ValueError(f"query {function.__name__} is registered twice")
        ENTRIES[function.__name__] = Entry(run, None if sql is None else model.strip() + "\n" + sql.strip())
        return function

    return register
