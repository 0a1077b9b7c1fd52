"""Queries: stock reports, movements and demand forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from aisle.catalog.registry import query
from aisle.operators import demand, inventory

AS_OF = "2001-08-01"
FORECAST_DAY = "2001-06-15"  # the month after it already has stored forecasts for some products
CARTON = 10

# Stock after all sales from an opening stock in cartons: plenty, low, empty and oversold all occur.
SHELF = f"""
, gone AS (
    SELECT product_id, SUM(quantity) AS units FROM sold GROUP BY product_id
), shelf AS (
    SELECT product_id, product_name, category_name,
           CAST(stock_quantity * {CARTON} - COALESCE(units, 0) AS BIGINT) AS stock_quantity, reorder_level
    FROM products LEFT JOIN gone USING (product_id)
)
"""


def shelf(w):
    opening = w.products().withColumn("stock_quantity", F.col("stock_quantity") * CARTON)
    return inventory.apply_sales_to_stock(opening, w.completed())


@query(SHELF + "SELECT product_id, stock_quantity, reorder_level FROM shelf")
def apply_sales_to_stock(w):
    return shelf(w).select("product_id", "stock_quantity", "reorder_level")


@query("""
SELECT product_id, product_name, category_name, stock_quantity, reorder_level,
       reorder_level - stock_quantity AS units_needed
FROM products WHERE stock_quantity <= reorder_level
""")
def low_stock(w):
    return inventory.low_stock(w.products().drop("category_name"), w.categories())


@query(SHELF + """
SELECT product_id, stock_quantity,
       CAST(CASE WHEN stock_quantity <= reorder_level THEN 1 ELSE 0 END AS BIGINT) AS low_stock
FROM shelf
""")
def low_stock_flag(w):
    return inventory.low_stock_flag(shelf(w)).select("product_id", "stock_quantity", "low_stock")


@query(SHELF + """
SELECT product_id, stock_quantity,
       CASE WHEN stock_quantity <= reorder_level THEN 'REORDER NEEDED' ELSE 'OK' END AS stock_status
FROM shelf
""")
def stock_status(w):
    return inventory.stock_status(shelf(w)).select("product_id", "stock_quantity", "stock_status")


@query(SHELF + "SELECT product_id, product_name, stock_quantity FROM shelf WHERE stock_quantity = 0")
def out_of_stock(w):
    return inventory.out_of_stock(shelf(w)).select("product_id", "product_name", "stock_quantity")


@query(SHELF + """
SELECT product_id, CASE WHEN stock_quantity = 0 THEN 'Out of Stock'
       WHEN stock_quantity <= reorder_level THEN 'Low Stock' ELSE 'In Stock' END AS stock_label
FROM shelf
""")
def stock_label(w):
    return inventory.stock_label(shelf(w)).select("product_id", "stock_label")


@query(SHELF + """
SELECT product_id, stock_quantity,
       CASE WHEN reorder_level > 0 THEN least(100, CAST(floor(
           CAST(stock_quantity AS DOUBLE) / (CAST(reorder_level AS DOUBLE) * 3) * 100 + 0.5) AS BIGINT))
       ELSE 100 END AS stock_fill_pct
FROM shelf
""")
def stock_fill_pct(w):
    return inventory.stock_fill_pct(shelf(w)).select("product_id", "stock_quantity", "stock_fill_pct")


ALERT_SQL = """
, low AS (
    SELECT *, CASE WHEN stock_quantity = 0 THEN 'out_of_stock' ELSE 'low_stock' END AS level
    FROM {table} WHERE stock_quantity = 0 OR stock_quantity <= reorder_level
), listed AS (
    SELECT *, row_number() OVER (ORDER BY product_name, product_id) AS n, COUNT(*) OVER () AS alerts
    FROM low WHERE level = (SELECT MAX(level) FROM low)
)
SELECT level, CAST((n - 1) // {size} AS BIGINT) AS part, alerts, string_agg(product_name, ', ' ORDER BY n) AS names
FROM listed GROUP BY level, (n - 1) // {size}, alerts
"""


@query(ALERT_SQL.format(table="products", size=1000))
def stock_alert_list(w):
    return inventory.stock_alert_list(w.products())


@query(SHELF + ALERT_SQL.format(table="shelf", size=10))
def stock_alert_list_spread(w):
    return inventory.stock_alert_list(shelf(w), names_per_row=10, spread=True)


@query("""
SELECT product_id, product_name, stock_quantity AS opening_stock, CAST(COALESCE(units, 0) AS BIGINT) AS units_sold,
       CAST(stock_quantity - COALESCE(units, 0) AS BIGINT) AS stock_quantity, reorder_level,
       CASE WHEN stock_quantity - COALESCE(units, 0) <= reorder_level THEN 'REORDER NEEDED' ELSE 'OK' END
           AS stock_status
FROM products LEFT JOIN (SELECT product_id, SUM(quantity) AS units FROM sold GROUP BY product_id) USING (product_id)
""")
def stock_position(w):
    return inventory.stock_position(w.products(), w.completed())


@query("""
SELECT product_id, store_id, 'sale' AS change_type, -quantity AS quantity_change, transaction_date AS log_date,
       'Auto-logged from transaction #' || transaction_id AS notes
FROM sold
""")
def sale_log(w):
    return inventory.sale_log(w.completed())


@query("""
SELECT t.transaction_id AS log_id, p.product_name, s.store_name, 'sale' AS change_type,
       -t.quantity AS quantity_change, t.transaction_date AS log_date,
       'Auto-logged from transaction #' || t.transaction_id AS notes
FROM sold t JOIN products p USING (product_id) JOIN stores s USING (store_id)
ORDER BY t.transaction_date DESC, t.transaction_id LIMIT 200
""")
def inventory_history(w):
    log = inventory.sale_log(w.completed()).withColumn("log_id", F.element_at(F.split("notes", "#"), 2))
    return inventory.inventory_history(log, w.products(), w.stores())


@query("""
SELECT product_id, CAST(stock_quantity + COALESCE(back, 0) AS BIGINT) AS stock_quantity
FROM products LEFT JOIN (
    SELECT l_partkey AS product_id, SUM(CAST(l_quantity AS BIGINT)) AS back
    FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_partkey
) USING (product_id)
""")
def restock(w):
    """Returned line items put back on the shelf."""
    returned = w.raw("lineitem").filter("l_returnflag = 'R'").select(
        F.col("l_partkey").alias("product_id"), F.col("l_quantity").cast("int").alias("quantity")
    )
    return inventory.restock(w.products(), returned).select("product_id", "stock_quantity")


# Demand

TRAILING = "transaction_date >= DATE '{day}' - INTERVAL 3 MONTH"
MEAN_SQL = """
SELECT product_id, (200 * CAST(SUM(q) AS BIGINT) + COUNT(*)) // (2 * COUNT(*)) / 100.0 AS mean
FROM (SELECT product_id, date_trunc('month', transaction_date) AS m, SUM(quantity) AS q
      FROM sold WHERE {where} GROUP BY 1, 2)
GROUP BY product_id
"""
FORECAST_CTE = """
, months AS (
    SELECT product_id, CAST(date_trunc('month', transaction_date) AS DATE) AS forecast_date,
           CAST(SUM(quantity) AS BIGINT) AS q
    FROM sold GROUP BY 1, 2
), past AS (
    SELECT *, CAST(SUM(q) OVER before AS BIGINT) AS units, COUNT(*) OVER before AS n
    FROM months
    WINDOW before AS (PARTITION BY product_id ORDER BY forecast_date ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)
), cents AS (
    SELECT product_id, forecast_date, 100 * q AS actual, (200 * units + n) // (2 * n) AS predicted
    FROM past WHERE n > 0
), forecast AS (
    SELECT product_id, forecast_date, predicted / 100.0 AS predicted_demand, actual / 100.0 AS actual_demand,
           (20000 * least(predicted, actual) + greatest(predicted, actual))
               // (2 * greatest(predicted, actual)) / 100.0 AS accuracy_pct
    FROM cents
)
"""


@query("""
SELECT product_id, CAST(date_trunc('month', transaction_date) AS DATE) AS month_start,
       CAST(SUM(quantity) AS BIGINT) AS monthly_qty
FROM sold WHERE transaction_date >= DATE '2001-08-01' - INTERVAL 3 MONTH GROUP BY 1, 2
""")
def monthly_demand(w):
    return demand.monthly_demand(w.completed(), AS_OF)


@query(f"""
SELECT product_id, DATE '2001-09-01' AS forecast_date, COALESCE(mean, 0) AS predicted_demand
FROM products LEFT JOIN ({MEAN_SQL.format(where=TRAILING.format(day=AS_OF))}) USING (product_id)
""")
def forecast_demand(w):
    return demand.forecast_demand(w.completed(), w.products(), AS_OF)


@query(f"""
SELECT product_id, DATE '2001-09-01' AS forecast_date, COALESCE(mean, 0) AS predicted_demand
FROM products LEFT JOIN ({MEAN_SQL.format(
    where="transaction_date >= DATE '2001-05-01' AND transaction_date < DATE '2001-08-01'")}) USING (product_id)
""")
def forecast_complete_months(w):
    return demand.forecast_demand(w.completed(), w.products(), AS_OF, complete_months=True)


@query(FORECAST_CTE + f"""
, fresh AS (
    SELECT product_id, DATE '2001-07-01' AS forecast_date, COALESCE(mean, 0) AS new_demand
    FROM products LEFT JOIN ({MEAN_SQL.format(where=TRAILING.format(day=FORECAST_DAY))}) USING (product_id)
)
SELECT product_id, forecast_date, COALESCE(new_demand, predicted_demand) AS predicted_demand, actual_demand,
       accuracy_pct
FROM forecast FULL JOIN fresh USING (product_id, forecast_date)
""")
def upsert_forecast(w):
    sold = w.completed()
    fresh = demand.forecast_demand(sold, w.products(), FORECAST_DAY)
    return demand.upsert_forecast(fresh, demand.rolling_forecast(sold))


@query(FORECAST_CTE + "SELECT * FROM forecast")
def forecast_accuracy(w):
    return demand.rolling_forecast(w.completed())


@query(FORECAST_CTE + f"""
, fresh AS (
    SELECT product_id, DATE '2001-07-01' AS forecast_date,
           CAST(round(COALESCE(mean, 0) * 100) AS BIGINT) AS predicted
    FROM products LEFT JOIN ({MEAN_SQL.format(where=TRAILING.format(day=FORECAST_DAY))}) USING (product_id)
), both_sides AS (
    SELECT product_id, forecast_date, predicted, 100 * q AS actual
    FROM fresh LEFT JOIN months USING (product_id, forecast_date)
)
SELECT product_id, forecast_date, predicted / 100.0 AS predicted_demand, actual / 100.0 AS actual_demand,
       CASE WHEN greatest(predicted, actual) > 0 AND actual IS NOT NULL THEN
           (20000 * least(predicted, actual) + greatest(predicted, actual))
               // (2 * greatest(predicted, actual)) / 100.0 END AS accuracy_pct
FROM both_sides
""")
def record_actuals(w):
    """Forecasts for July filled with what July then sold."""
    sold = w.completed()
    return demand.record_actuals(demand.forecast_demand(sold, w.products(), FORECAST_DAY), sold)


@query(FORECAST_CTE + """
SELECT product_id, forecast_date, accuracy_pct,
       CASE WHEN accuracy_pct >= 90 THEN 'good' WHEN accuracy_pct >= 75 THEN 'fair' ELSE 'poor' END AS accuracy_band
FROM forecast
""")
def accuracy_band(w):
    rows = demand.accuracy_band(demand.rolling_forecast(w.completed()))
    return rows.select("product_id", "forecast_date", "accuracy_pct", "accuracy_band")


HISTORY_SQL = """
SELECT f.product_id, f.forecast_date, f.predicted_demand, f.actual_demand, f.accuracy_pct, p.product_name,
       p.stock_quantity, p.reorder_level,
       CASE WHEN p.stock_quantity <= p.reorder_level THEN 'REORDER NEEDED' ELSE 'OK' END AS stock_status
FROM forecast f JOIN products p USING (product_id)
"""


@query(FORECAST_CTE + HISTORY_SQL + "QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY forecast_date DESC) <= 12")
def forecast_history(w):
    return demand.forecast_history(demand.rolling_forecast(w.completed()), w.products())


@query(FORECAST_CTE + HISTORY_SQL)
def forecast_history_all(w):
    return demand.forecast_history_all(demand.rolling_forecast(w.completed()), w.products())
