"""Stored tables: reading, bulk loading, counting, exporting."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DecimalType, StructField, StructType, TimestampNTZType, TimestampType

from aisle.schemas import TABLES

LISTED_BY = {"categories": "category_name", "stores": "store_name"}


def nullable(schema: StructType) -> StructType:
    """The schema as files deliver it; NOT NULL is a quality check, not a read option."""
    return StructType([StructField(f.name, f.dataType, True) for f in schema.fields])


def scan(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One retail table; the declared schema saves an inference pass over the files."""
    return spark.read.schema(nullable(TABLES[name])).parquet(f"{folder}/{name}")


def scan_all(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {name: scan(spark, folder, name) for name in TABLES}


def listing(df: DataFrame, name: str) -> DataFrame:
    """Categories or stores in order of their name."""
    return df.orderBy(LISTED_BY[name])


def load_seed(
    spark: SparkSession,
    source: str,
    target: str,
    *,
    format: str = "csv",
    schemas: Mapping[str, StructType] = TABLES,
) -> dict[str, DataFrame]:
    """Bulk-load ``source/<table>`` files into Parquet tables; a malformed row stops the load."""
    loaded = {}
    for name, schema in schemas.items():
        reader = spark.read.schema(nullable(schema)).option("mode", "FAILFAST")
        if format == "csv":
            reader = reader.option("header", True)
        reader.format(format).load(f"{source}/{name}").write.mode("overwrite").parquet(f"{target}/{name}")
        loaded[name] = spark.read.schema(nullable(schema)).parquet(f"{target}/{name}")
    return loaded


def write_transactions(df: DataFrame, path: str, *, mode: str = "append") -> None:
    """Store transactions by month with customers kept together inside the files.

    Range partitioning on (month, customer, time) gives even files even when one month or one
    customer is large, and row-group statistics that a customer or date filter can skip by.
    """
    by = ["month", "customer_id", "transaction_date"]
    (
        df.withColumn("month", F.date_format("transaction_date", "yyyy-MM"))
        .repartitionByRange(*by)
        .sortWithinPartitions(*by)
        .write.partitionBy("month")
        .mode(mode)
        .parquet(path)
    )


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per table: name and number of rows."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def json_ready(df: DataFrame) -> DataFrame:
    """Decimals as doubles, dates and times as ISO text (fractions of a second only where present)."""

    def shown(field: StructField):
        column = F.col(field.name)
        if isinstance(field.dataType, DecimalType):
            return column.cast("double").alias(field.name)
        if isinstance(field.dataType, DateType):
            return F.date_format(column, "yyyy-MM-dd").alias(field.name)
        if isinstance(field.dataType, (TimestampNTZType, TimestampType)):
            whole = F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss")
            micros = F.date_format(column, "SSSSSS")
            return F.when(micros == "000000", whole).otherwise(F.concat(whole, F.lit("."), micros)).alias(field.name)
        return column

    return df.select(*[shown(field) for field in df.schema.fields])


def export_json(df: DataFrame, path: str, *, mode: str = "overwrite") -> None:
    """One JSON object per row, NULL fields included."""
    json_ready(df).write.mode(mode).option("ignoreNullFields", False).json(path)
