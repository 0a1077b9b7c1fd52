"""Queries: events replayed as a stream, results read back from what the stream stored."""

from __future__ import annotations

from pyspark.sql import functions as F

from aisle.catalog.fraud import EVENT_LIMITS
from aisle.catalog.registry import query
from aisle.session import scratch_path
from aisle.sources.warehouse import SCHEMAS, event_transactions
from aisle.streaming import arrivals


LEAST_BATCHES = 3
BATCH_ROWS = 1_000_000


def arrival_files(w) -> str:
    """The events as files in order of arrival, one after another, each a batch of a bounded size."""
    events = w.raw("events")
    low, high, rows = events.agg(F.min("event_id"), F.max("event_id"), F.count("*")).first()
    folder, parts = scratch_path(w.spark, "events"), max(LEAST_BATCHES, (rows or 0) // BATCH_ROWS + 1)
    step = ((high or 0) - (low or 0)) // parts + 1
    for part in range(parts):
        start = (low or 0) + part * step
        arrived = events.filter(F.col("event_id").between(start, start + step - 1))
        arrived.repartition(1).write.mode("append").parquet(folder)
    return folder


def replay(w, **options) -> str:
    """Run the arrival writer over all events, a file per batch; returns the folder it wrote."""
    source = w.spark.readStream.schema(SCHEMAS["events"]).option("maxFilesPerTrigger", 1)
    events = source.parquet(arrival_files(w))
    folder = scratch_path(w.spark, "arrivals")
    arrivals.start_arrivals(event_transactions(events), folder, EVENT_LIMITS, **options).awaitTermination()
    return folder


ROW_RULES_SQL = """
SELECT transaction_id, 'high_amount' AS rule, 'High transaction amount: $'
       || format('{:,.2f}', CAST(total_amount AS DOUBLE)) || ' exceeds $200 threshold' AS flag_reason,
       'critical' AS severity
FROM ev WHERE total_amount > 200
UNION ALL
SELECT transaction_id, 'quantity', 'Unusual quantity: ' || quantity || ' units in a single transaction', 'medium'
FROM ev WHERE quantity > 95
UNION ALL
SELECT transaction_id, 'late_night', 'Late-night high-value transaction: $'
       || format('{:,.2f}', CAST(total_amount AS DOUBLE)) || ' at ' || strftime(transaction_date, '%H:%M:%S'), 'high'
FROM ev WHERE hour(transaction_date) BETWEEN 0 AND 4 AND total_amount > 100
"""
RAPID_SQL = """
SELECT transaction_id, 'rapid' AS rule, 'Rapid successive transaction: customer #' || customer_id
       || ' made multiple purchases within 60 seconds' AS flag_reason, 'high' AS severity
FROM ev n WHERE EXISTS (
    SELECT 1 FROM ev o WHERE o.customer_id = n.customer_id AND o.transaction_id < n.transaction_id
    AND o.status = 'completed' AND abs(date_sub('second', o.transaction_date, n.transaction_date)) <= 60)
"""


@query(ROW_RULES_SQL)
def stream_row_rules(w):
    folder = replay(w, rapid=False, stock=False)
    return arrivals.arrival_flags(w.spark, folder)


@query(RAPID_SQL)
def stream_rapid(w):
    folder = replay(w, stock=False)
    return arrivals.arrival_flags(w.spark, folder).filter("rule = 'rapid'")


@query(RAPID_SQL)
def rapid_arrivals(w):
    """The batch form of the arrival rule over the whole history."""
    return arrivals.rapid_arrivals(w.events(), None, EVENT_LIMITS)


@query(RAPID_SQL)
def rapid_arrivals_crowded(w):
    """The same with every customer treated as too large for one task."""
    return arrivals.rapid_arrivals(w.events(), None, EVENT_LIMITS, key_limit=0)


@query("""
SELECT product_id, product_id AS store_id, 'sale' AS change_type, -quantity AS quantity_change,
       transaction_date AS log_date, 'Auto-logged from transaction #' || transaction_id AS notes
FROM ev WHERE status = 'completed'
""")
def stream_sale_log(w):
    folder = replay(w, rapid=False)
    return arrivals.arrival_sale_log(w.spark, folder)


@query("""
SELECT product_id, product_name, CAST(stock_quantity - COALESCE(units, 0) AS BIGINT) AS stock_quantity
FROM products LEFT JOIN (
    SELECT product_id, SUM(quantity) AS units FROM ev WHERE status = 'completed' GROUP BY product_id
) USING (product_id)
""")
def stream_stock(w):
    folder = replay(w, rapid=False)
    rows = arrivals.stock_after_arrivals(w.spark, folder, w.products())
    return rows.select("product_id", "product_name", "stock_quantity")
