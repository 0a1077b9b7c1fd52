"""Arrival rules and the stock ledger over a stream of new transactions.

One ``foreachBatch`` writer per stream. Flags, stock log and sold units of a batch appear together, by one
commit (:mod:`aisle.sources.batches`); the history of the rapid rule lies in partitions named after the
batch and is overwritten, so a batch repeated after a failure replaces its own rows. Nothing is dropped for being late: the rapid rule looks up stored history instead of
keeping windowed state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from aisle.functions.dates import seconds
from aisle.operators.fraud import DEFAULT, FLAG_COLUMNS, RAPID, SEVERITY, Thresholds, reason_text, row_rule_flags
from aisle.operators.inventory import sale_log, sold_units, subtract_sold
from aisle.plans.neighbours import rows_after_close_arrival
from aisle.plans.sizes import KEY_ROWS
from aisle.sources.batches import read_batches, write_batch

FILES_PER_DAY = 4
HISTORY_COLUMNS = ["transaction_id", "customer_id", "transaction_date", "status"]
HISTORY_SCHEMA = "transaction_id bigint, customer_id bigint, transaction_date timestamp_ntz, status string"


def stream_row_rules(transactions: DataFrame, limits: Thresholds = DEFAULT) -> DataFrame:
    """Flags of the single-row rules, whatever the status. Stateless: works on a stream as on a table."""
    return row_rule_flags(transactions, limits).select(*FLAG_COLUMNS)


def rapid_arrivals(
    new: DataFrame,
    earlier: DataFrame | None,
    limits: Thresholds = DEFAULT,
    key_limit: int | None = KEY_ROWS,
) -> DataFrame:
    """Flags for new rows that follow, in order of arrival, a close completed sale of their customer.

    Within ``new`` arrival is the order of transaction_id; all of ``earlier`` came before. Only the
    newcomer is flagged, whatever its own status.
    """

    def shaped(df: DataFrame, batch: int) -> DataFrame:
        arrival = F.struct(F.lit(batch).alias("batch"), F.col("transaction_id").alias("id"))
        return df.select(*HISTORY_COLUMNS, arrival.alias("arrival"))

    rows = shaped(new, 1)
    completed = F.col("status") == "completed"
    if earlier is not None:
        rows = rows.unionByName(shaped(earlier.filter(completed), 0))
    close = rows_after_close_arrival(
        rows,
        "customer_id",
        "transaction_date",
        "arrival",
        limits.rapid_seconds,
        candidate=completed,
        wanted=F.col("arrival.batch") == 1,
        key_limit=key_limit,
    )
    return close.select(
        "transaction_id",
        F.lit(RAPID).alias("rule"),
        reason_text(RAPID, limits).alias("flag_reason"),
        F.lit(SEVERITY[RAPID]).alias("severity"),
    )


def _by_day(rows: DataFrame) -> DataFrame:
    """Rows of a day in at most FILES_PER_DAY tasks, so that a batch adds few files to a day."""
    return rows.repartition("day", F.pmod(F.xxhash64("transaction_id"), F.lit(FILES_PER_DAY)))


def _replace_batch(df: DataFrame, batch_id: int, path: str, partitions: tuple[str, ...] = ()) -> None:
    (
        df.withColumn("batch_id", F.lit(batch_id))
        .write.partitionBy(*partitions, "batch_id")
        .mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .parquet(path)
    )


def _earlier_history(batch: DataFrame, batch_id: int, path: str, limits: Thresholds) -> DataFrame | None:
    """Stored rows of earlier batches on the days this batch can reach.

    Only those days' folders are listed, however long the history. The days collected here are the
    distinct calendar days of one batch and their neighbours; its own days have just been written.
    """
    ts, reach = F.col("transaction_date"), seconds(limits.rapid_seconds + 1)
    near = F.array(*[F.to_date(at) for at in (ts - reach, ts, ts + reach)])
    days = [row[0] for row in batch.select(F.explode(near).alias("day")).distinct().filter("day IS NOT NULL").collect()]
    if not days:
        return None
    folders = ",".join(sorted(day.isoformat() for day in days))
    stored = (
        batch.sparkSession.read.schema(f"{HISTORY_SCHEMA}, day date, batch_id bigint")
        .option("basePath", path)
        .parquet(f"{path}/day={{{folders}}}")
    )
    return stored.filter(F.col("batch_id") < batch_id)


def arrival_writer(folder: str, limits: Thresholds = DEFAULT, *, rapid: bool = True, stock: bool = True):
    """``foreachBatch`` function writing below ``folder``:

    ``history`` (by day), ``flags``, ``sale_log`` and ``sold`` (units per product and batch), and ``commits``,
    by which the last three of a batch count from one moment on.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            flags = stream_row_rules(batch, limits)
            if rapid:
                history = f"{folder}/history"
                rows = batch.select(*HISTORY_COLUMNS, F.to_date("transaction_date").alias("day"))
                _replace_batch(_by_day(rows), batch_id, history, ("day",))
                earlier = _earlier_history(batch, batch_id, history, limits)
                flags = flags.unionByName(rapid_arrivals(batch, earlier, limits))
            parts = {"flags": flags}
            if stock:
                parts |= {"sale_log": sale_log(batch), "sold": sold_units(batch)}
            write_batch(batch.sparkSession, folder, str(batch_id), parts)
        finally:
            batch.unpersist()

    return write


def start_arrivals(
    transactions: DataFrame, folder: str, limits: Thresholds = DEFAULT, *, rapid: bool = True, stock: bool = True
) -> StreamingQuery:
    """Process all available transactions of a stream, then stop.

    The source sets the size of a batch (``maxFilesPerTrigger`` or ``maxBytesPerTrigger``); a batch is persisted
    while it is written and its days are listed, so the backlog must not come as one.
    """
    return (
        transactions.writeStream.foreachBatch(arrival_writer(folder, limits, rapid=rapid, stock=stock))
        .option("checkpointLocation", f"{folder}/progress")
        .trigger(availableNow=True)
        .start()
    )


def arrival_flags(spark: SparkSession, folder: str) -> DataFrame:
    schema = "transaction_id bigint, rule string, flag_reason string, severity string"
    return read_batches(spark, folder, "flags", schema).select(*FLAG_COLUMNS)


def arrival_sale_log(spark: SparkSession, folder: str) -> DataFrame:
    schema = (
        "product_id bigint, store_id bigint, change_type string, quantity_change int, "
        "log_date timestamp_ntz, notes string"
    )
    return read_batches(spark, folder, "sale_log", schema)


def stock_after_arrivals(spark: SparkSession, folder: str, products: DataFrame) -> DataFrame:
    """Products with the units of every batch so far taken off their opening stock."""
    ledger = read_batches(spark, folder, "sold", "product_id bigint, sold bigint")
    return subtract_sold(products, ledger.groupBy("product_id").agg(F.sum("sold").alias("sold")))
