"""Queries: fraud rules, flag reports and customer behaviour, mostly over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from aisle.catalog.registry import query
from aisle.operators import fraud, sales
from aisle.operators.fraud import Thresholds
from aisle.session import materialise

EVENT_LIMITS = Thresholds(high_amount=200, quantity=95, night_amount=100)
LINE_LIMITS = Thresholds(high_amount=104000, quantity=45)

RULES_SQL = """
, high AS (
    SELECT transaction_id, 'high_amount' AS rule, 'High transaction amount: $'
           || format('{:,.2f}', CAST(total_amount AS DOUBLE)) || ' exceeds $200 threshold' AS flag_reason,
           'critical' AS severity
    FROM ev WHERE total_amount > 200 AND status = 'completed'
), night AS (
    SELECT transaction_id, 'late_night' AS rule, 'Late-night high-value transaction: $'
           || format('{:,.2f}', CAST(total_amount AS DOUBLE)) || ' at ' || strftime(transaction_date, '%H:%M:%S')
           AS flag_reason, 'high' AS severity
    FROM ev WHERE hour(transaction_date) BETWEEN 0 AND 4 AND total_amount > 100 AND status = 'completed'
), bulk AS (
    SELECT transaction_id, 'quantity' AS rule, 'Unusual quantity: ' || quantity || ' units of "' || product_name
           || '" in single transaction' AS flag_reason, 'medium' AS severity
    FROM ev JOIN products USING (product_id) WHERE quantity > 95 AND status = 'completed'
), rapid AS (
    SELECT DISTINCT b.transaction_id, 'rapid' AS rule, 'Rapid successive transaction: customer #' || b.customer_id
           || ' made multiple purchases within 60 seconds' AS flag_reason, 'high' AS severity
    FROM ev a JOIN ev b ON a.customer_id = b.customer_id AND a.transaction_id <> b.transaction_id
         AND abs(date_sub('second', a.transaction_date, b.transaction_date)) <= 60
    WHERE a.status = 'completed' AND b.status = 'completed'
), stored AS (
    SELECT * FROM high WHERE transaction_id IN
        (SELECT transaction_id FROM ev WHERE transaction_date < TIMESTAMP '2024-01-11')
), found AS (
    SELECT * FROM high UNION ALL SELECT * FROM rapid UNION ALL SELECT * FROM bulk UNION ALL SELECT * FROM night
), fresh AS (
    SELECT * FROM found f WHERE NOT EXISTS
        (SELECT 1 FROM stored s WHERE s.transaction_id = f.transaction_id AND s.rule = f.rule)
), flags AS (
    SELECT f.transaction_id * 4 + CASE rule WHEN 'high_amount' THEN 0 WHEN 'rapid' THEN 1
               WHEN 'quantity' THEN 2 ELSE 3 END AS flag_id,
           f.transaction_id, rule, flag_reason, severity, e.ts AS flagged_at,
           CASE WHEN e.event_type IN ('signup', 'view') THEN 1 ELSE 0 END AS resolved
    FROM found f JOIN events e ON e.event_id = f.transaction_id
)
"""


def stored_flags(w):
    """High-amount flags raised before 11 January, standing for an earlier run."""
    early = w.events().filter(F.col("transaction_date") < F.lit("2024-01-11").cast("timestamp_ntz"))
    return fraud.rule_high_amount(early, None, EVENT_LIMITS)


def flags(w):
    """All flags on events as a stored table; signups and views count as resolved."""
    found = fraud.detect_fraud(w.events(), w.products(), None, EVENT_LIMITS)
    rule_no = F.array_position(F.array(*[F.lit(r) for r in fraud.RULES]), F.col("rule")) - 1
    event = w.raw("events").select(F.col("event_id").alias("transaction_id"), "ts", "event_type")
    return found.join(event, "transaction_id").select(
        (F.col("transaction_id") * 4 + rule_no).alias("flag_id"),
        "transaction_id",
        "rule",
        "flag_reason",
        "severity",
        F.col("ts").alias("flagged_at"),
        F.col("event_type").isin("signup", "view").cast("int").alias("resolved"),
    )


@query(RULES_SQL + "SELECT * FROM high")
def rule_high_amount(w):
    return fraud.rule_high_amount(w.events(), None, EVENT_LIMITS)


@query(RULES_SQL + "SELECT * FROM night")
def rule_late_night(w):
    return fraud.rule_late_night(w.events(), None, EVENT_LIMITS)


@query(RULES_SQL + "SELECT * FROM rapid")
def rule_rapid(w):
    return fraud.rule_rapid(w.events(), None, EVENT_LIMITS)


@query(RULES_SQL + "SELECT * FROM rapid")
def rule_rapid_crowded(w):
    """The same rule with every customer treated as too large for one task."""
    return fraud.rule_rapid(w.events(), None, EVENT_LIMITS, key_limit=0)


@query("""
SELECT transaction_id, 'quantity' AS rule, 'Unusual quantity: ' || quantity || ' units of "' || product_name
       || '" in single transaction' AS flag_reason, 'medium' AS severity
FROM sold JOIN products USING (product_id) WHERE quantity > 45
""")
def rule_quantity(w):
    return fraud.rule_quantity(w.completed(), w.products(), None, LINE_LIMITS)


@query(RULES_SQL + "SELECT * FROM fresh")
def detect_fraud(w):
    return fraud.detect_fraud(w.events(), w.products(), stored_flags(w), EVENT_LIMITS)


@query(RULES_SQL + """
SELECT rule, COUNT(*) AS new_flags_inserted FROM fresh GROUP BY rule
UNION ALL SELECT 'total', COUNT(*) FROM fresh
""")
def new_flag_count(w):
    return fraud.new_flag_count(
        fraud.detect_fraud(w.events(), w.products(), stored_flags(w), EVENT_LIMITS)
    )


@query("SELECT 'total' AS rule, CAST(0 AS BIGINT) AS new_flags_inserted")
def new_flag_count_second_run(w):
    """All flags of the first run are stored: the second finds none and says so."""
    first = fraud.detect_fraud(w.events(), w.products(), None, EVENT_LIMITS)
    stored = first.select("transaction_id", "flag_reason")
    return fraud.new_flag_count(fraud.detect_fraud(w.events(), w.products(), stored, EVENT_LIMITS))


@query(RULES_SQL + """
SELECT (SELECT MAX(flag_id) FROM flags WHERE rule = 'high_amount') + row_number() OVER (ORDER BY
           CASE rule WHEN 'high_amount' THEN 1 WHEN 'rapid' THEN 2 WHEN 'quantity' THEN 3 ELSE 4 END,
           transaction_id) AS flag_id,
       transaction_id, flag_reason, TIMESTAMP '2024-02-01' AS flagged_at, severity, CAST(0 AS BIGINT) AS resolved
FROM found WHERE rule <> 'high_amount'
""")
def flag_rows(w):
    """Flags of a second run numbered after the stored high-amount ones."""
    stored = flags(w).filter("rule = 'high_amount'")
    new = fraud.detect_fraud(w.events(), w.products(), stored, EVENT_LIMITS)
    return fraud.flag_rows(new, stored, F.lit("2024-02-01").cast("timestamp_ntz"))


# Reports over flags


@query(RULES_SQL + "SELECT COUNT(*) AS fraud_count FROM flags WHERE resolved = 0")
def open_fraud_count(w):
    return sales.open_fraud_count(flags(w))


STATS_SQL = """
SELECT COUNT(*) AS total_flagged, CAST(SUM(resolved) AS BIGINT) AS resolved_count,
       CAST(SUM(1 - resolved) AS BIGINT) AS pending_count,
       CAST(SUM(CASE WHEN severity = 'critical' AND resolved = 0 THEN 1 ELSE 0 END) AS BIGINT) AS critical_pending,
       CAST(SUM(CASE WHEN severity = 'high' AND resolved = 0 THEN 1 ELSE 0 END) AS BIGINT) AS high_pending,
       CAST(SUM(CASE WHEN severity = 'medium' AND resolved = 0 THEN 1 ELSE 0 END) AS BIGINT) AS medium_pending,
       CAST(SUM(CASE WHEN severity = 'low' AND resolved = 0 THEN 1 ELSE 0 END) AS BIGINT) AS low_pending
FROM flags
"""


@query(RULES_SQL + STATS_SQL)
def fraud_stats(w):
    return fraud.fraud_stats(flags(w))


@query(RULES_SQL + f"""
SELECT CASE WHEN critical_pending > 0 THEN 'critical' WHEN high_pending > 0 THEN 'high' END AS alert_level,
       COALESCE(critical_pending, 0) AS critical_pending, COALESCE(high_pending, 0) AS high_pending
FROM ({STATS_SQL})
""")
def fraud_alert_level(w):
    return fraud.fraud_alert_level(flags(w))


@query(RULES_SQL + "SELECT severity, CAST(resolved AS BIGINT) AS resolved, COUNT(*) AS flags FROM flags GROUP BY 1, 2")
def flags_by_severity(w):
    return fraud.flags_by_severity(flags(w))


@query(RULES_SQL + """
SELECT f.flag_id, f.transaction_id, f.rule, f.flag_reason, f.severity, f.flagged_at,
       CAST(f.resolved AS BIGINT) AS resolved, CAST(e.total_amount AS DOUBLE) AS total_amount,
       e.transaction_date, 'online' AS payment_method, e.quantity, c.name AS customer_name, p.product_name,
       s.store_name
FROM flags f JOIN ev e USING (transaction_id) JOIN customers c USING (customer_id)
JOIN products p USING (product_id) JOIN stores s ON s.store_id = e.product_id
WHERE f.severity = 'high' AND f.resolved = 0
""")
def fraud_flag_detail(w):
    return fraud.fraud_flag_detail(
        flags(w), w.events(), w.customers(), w.products(), w.stores(), severity="high", resolved=0
    )


# Behaviour per customer

ANALYSIS_SQL = """
SELECT r.transaction_id, customer_id, customers.name AS customer_name, product_id, product_name, store_id, store_name, CAST(total_amount AS DOUBLE) AS total_amount,
       transaction_date, 'online' AS payment_method, quantity, prev_transaction_date,
       CAST(prev_amount AS DOUBLE) AS prev_amount, CAST(rolling AS DOUBLE) AS rolling_5tx_total, tx_count_last_hour,
       date_sub('second', prev_transaction_date, transaction_date) AS seconds_since_last,
       CASE WHEN total_amount > 200 THEN 'HIGH_AMOUNT'
            WHEN date_sub('second', prev_transaction_date, transaction_date) <= 60 THEN 'RAPID_SUCCESSION'
            WHEN quantity > 95 THEN 'UNUSUAL_QUANTITY'
            WHEN hour(transaction_date) BETWEEN 0 AND 4 AND total_amount > 100 THEN 'LATE_NIGHT_HIGH_VALUE'
            ELSE 'NORMAL' END AS fraud_indicator,
       {flag}.flag_id, {flag}.flag_reason, {flag}.severity, CAST({flag}.resolved AS BIGINT) AS resolved
"""
WINDOWS_SQL = """
       LAG(transaction_date) OVER w AS prev_transaction_date, LAG(total_amount) OVER w AS prev_amount,
       SUM(total_amount) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS rolling,
       COUNT(*) OVER (PARTITION BY customer_id ORDER BY transaction_date
           RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS tx_count_last_hour
"""
AFTER_SQL = RULES_SQL + f"""
, r AS (
    SELECT e.*, f.flag_id, f.flag_reason, f.severity, f.resolved, {WINDOWS_SQL}
    FROM ev e LEFT JOIN flags f USING (transaction_id)
    WINDOW w AS (PARTITION BY customer_id ORDER BY transaction_date, transaction_id, flag_id NULLS FIRST)
)
{ANALYSIS_SQL.format(flag="r")}
FROM r JOIN customers USING (customer_id) JOIN products USING (product_id) JOIN stores ON store_id = product_id
"""
BEFORE_SQL = RULES_SQL + f"""
, r AS (
    SELECT *, {WINDOWS_SQL} FROM ev
    WINDOW w AS (PARTITION BY customer_id ORDER BY transaction_date, transaction_id)
)
{ANALYSIS_SQL.format(flag="f")}
FROM r JOIN customers USING (customer_id) JOIN products USING (product_id) JOIN stores ON store_id = product_id
LEFT JOIN flags f USING (transaction_id)
"""


@query(AFTER_SQL)
def fraud_analysis(w):
    return fraud.fraud_analysis(
        w.events(), materialise(flags(w)), w.customers(), w.products(), w.stores(), limits=EVENT_LIMITS
    )


@query(BEFORE_SQL)
def fraud_analysis_before_flags(w):
    return fraud.fraud_analysis(
        w.events(), materialise(flags(w)), w.customers(), w.products(), w.stores(), limits=EVENT_LIMITS, windows="before_flags"
    )


@query(AFTER_SQL)
def fraud_analysis_spread(w):
    """The same view with every customer treated as too large for one task."""
    return fraud.fraud_analysis(
        w.events(), materialise(flags(w)), w.customers(), w.products(), w.stores(), limits=EVENT_LIMITS, key_limit=0
    )
