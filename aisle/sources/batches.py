"""Batches that appear in several stored tables at once, or not at all.

Every try of a batch writes its rows below ``write=<fresh id>`` folders of the tables. One row in ``commits``,
written last, names the try that counts; readers take only what a commit names. A batch broken between two tables
shows nothing, and one that comes again after its commit changes nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aisle.session import stored

COMMITS = "batch string, write string"


def commits(spark: SparkSession, folder: str) -> DataFrame:
    """One row per committed batch; none in a folder without any."""
    try:
        return spark.read.schema(COMMITS).parquet(f"{folder}/commits").select("batch", "write")
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], COMMITS)


def is_committed(spark: SparkSession, folder: str, batch: str) -> bool:
    return not commits(spark, folder).filter(F.col("batch") == batch).isEmpty()


def write_batch(spark: SparkSession, folder: str, batch: str, parts: Mapping[str, DataFrame]) -> bool:
    """Store the rows of one batch in the tables named by ``parts``; False if it had been stored before.

    One writer per folder at a time. What broken tries left behind is never read.
    """
    if is_committed(spark, folder, batch):
        return False
    write = uuid.uuid4().hex
    for name, df in parts.items():
        df.write.mode("error").parquet(f"{folder}/{name}/write={write}")
    marker = spark.range(1).select(F.lit(write).alias("write"))
    # overwritten, as a try that broke while it wrote its commit may have left an empty folder
    marker.coalesce(1).write.mode("overwrite").parquet(f"{folder}/commits/batch={batch}")
    return True


def read_batches(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    """The rows of all committed batches of one table; folders of other tries are pruned, not read."""
    try:
        rows = spark.read.schema(f"{schema}, write string").parquet(f"{folder}/{name}")
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    return rows.join(commits(spark, folder).select("write"), "write", "left_semi").drop("write")


def append_batch(rows: DataFrame, folder: str, name: str, batch: str, key: str, schema: str) -> DataFrame:
    """Append one batch of a table whose ``key`` is unique; the refused rows, whole, with their ``problem``.

    Refused are rows without a key, of a key that another batch stored, and all rows of a key that the batch
    repeats. The table's keys are reduced to those of the batch before they are compared; the keys found bad are
    stored, so they are looked for once and only they move when the rows are told apart, if they are few. A batch that was
    stored before is not stored again, and the answer is then what it was refused for the first time.
    """
    spark = rows.sparkSession
    mine = commits(spark, folder).filter(F.col("batch") == batch).select("write")
    try:
        held = spark.read.schema(f"{schema}, write string").parquet(f"{folder}/{name}")
        held = held.join(commits(spark, folder).select("write"), "write", "left_semi").join(mine, "write", "left_anti").select(key)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        held = spark.createDataFrame([], rows.select(key).schema)
    asked = rows.groupBy(key).agg(F.count("*").alias("times"))
    held = held.join(asked.select(key), key, "left_semi").distinct().withColumn("held", F.lit(True))
    bad = (
        asked.join(held, key, "left")
        .withColumn(
            "problem",
            F.when(F.col("held"), f"{key} already stored").when(F.col("times") > 1, f"{key} repeated in batch"),
        )
        .filter(f"problem IS NOT NULL AND `{key}` IS NOT NULL")
        .select(key, "problem")
    )
    bad = stored(bad, "refused-keys")
    judged = rows.join(bad, key, "left").select(
        *rows.columns, F.when(F.col(key).isNull(), f"missing {key}").otherwise(F.col("problem")).alias("problem")
    )
    write_batch(spark, folder, batch, {name: judged.filter("problem IS NULL").drop("problem")})
    return judged.filter("problem IS NOT NULL")
