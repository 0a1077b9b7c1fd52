"""Queries: sales reports, rankings and listings over line-item transactions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from aisle.catalog.registry import query
from aisle.functions.labels import short_label, without_prefix
from aisle.operators import filters, paging, ranking, sales
from aisle.operators.fraud import HIGH_AMOUNT, QUANTITY, Thresholds, row_rule_flags
from aisle.plans.positions import positions
from aisle.session import stored

START, END, AS_OF = "2000-01-01", "2000-12-31", "2001-08-01"
DETAIL_SQL = """
SELECT t.transaction_id, t.transaction_date, c.name AS customer_name, p.product_name, p.category_name,
       s.store_name, t.quantity, t.unit_price, CAST(t.total_amount AS DOUBLE) AS total_amount,
       t.payment_method, t.status
FROM priced t JOIN customers c USING (customer_id) JOIN products p USING (product_id)
JOIN stores s USING (store_id)
"""
FLAGGED_SQL = """
SELECT t.transaction_id, t.transaction_date, c.name AS customer_name, p.product_name, s.store_name,
       t.quantity, t.unit_price, CAST(t.total_amount AS DOUBLE) AS total_amount, t.payment_method, t.status,
       CAST(CASE WHEN EXISTS (SELECT 1 FROM flagged f WHERE f.transaction_id = t.transaction_id)
            THEN 1 ELSE 0 END AS BIGINT) AS is_flagged
FROM priced t JOIN customers c USING (customer_id) JOIN products p USING (product_id)
JOIN stores s USING (store_id)
"""
FLAGGED_CTE = ", flagged AS (SELECT transaction_id FROM sold WHERE total_amount > 104000 OR quantity > 45)"


def flags(w):
    """Flags on line items, by limits that fit their amounts."""
    limits = Thresholds(high_amount=104000, quantity=45)
    return row_rule_flags(w.completed(), limits, (HIGH_AMOUNT, QUANTITY))


# Filters


@query("SELECT transaction_id, customer_id, CAST(total_amount AS DOUBLE) AS total_amount FROM sold")
def completed_sales(w):
    return filters.completed_sales(w.transactions()).select("transaction_id", "customer_id", "total_amount")


@query(
    "SELECT transaction_id, transaction_date, status FROM tx "
    "WHERE CAST(transaction_date AS DATE) BETWEEN DATE '2000-01-01' AND DATE '2000-12-31'"
)
def between_dates(w):
    rows = filters.between_dates(w.transactions(), START, END)
    return rows.select("transaction_id", "transaction_date", "status")


@query(
    "SELECT transaction_id, transaction_date FROM tx "
    "WHERE transaction_date >= DATE '2001-08-01' - INTERVAL 3 MONTH"
)
def trailing_months(w):
    rows = filters.trailing_months(w.transactions(), AS_OF, 3)
    return rows.select("transaction_id", "transaction_date")


@query(
    "SELECT transaction_id, store_id, payment_method, status FROM tx "
    "WHERE store_id = 7 AND payment_method = 'online'"
)
def optional_filters(w):
    rows = filters.matching(w.transactions(), store_id=7, payment_method="online", status=None)
    return rows.select("transaction_id", "store_id", "payment_method", "status")


@query(DETAIL_SQL + "WHERE t.status = 'completed' AND contains(lower(concat_ws(' ', c.name, p.product_name, "
       "p.category_name, s.store_name, t.payment_method)), 'red widget promo supplier')")
def search_rows(w):
    rows = sales.sales_rows(w.completed(), w.customers(), w.products(), w.stores())
    shown = ["customer_name", "product_name", "category_name", "store_name", "payment_method"]
    return filters.search_rows(rows, "Red Widget PROMO Supplier", shown)


@query("SELECT product_id, product_name, category_name FROM products WHERE product_name LIKE 'red%'")
def prefix_filter(w):
    rows = filters.with_prefix(w.products(), "product_name", "red")
    return rows.select("product_id", "product_name", "category_name")


# Headline figures


@query("""
SELECT CAST(COALESCE(SUM(total_amount), 0) AS DOUBLE) AS total_revenue, COUNT(*) AS total_transactions,
       CAST(COALESCE(SUM(quantity), 0) AS BIGINT) AS total_units_sold,
       COUNT(DISTINCT customer_id) AS unique_customers
FROM sold
""")
def dashboard_kpis(w):
    return sales.dashboard_kpis(w.completed())


@query("SELECT COUNT(*) AS low_stock_count FROM products WHERE stock_quantity <= reorder_level")
def low_stock_count(w):
    return sales.low_stock_count(w.products())


@query("""
SELECT strftime(transaction_date, '%Y-%m') AS month, CAST(SUM(total_amount) AS DOUBLE) AS revenue,
       COUNT(*) AS transactions
FROM sold WHERE transaction_date >= DATE '2001-08-01' - INTERVAL 12 MONTH
GROUP BY 1
""")
def monthly_trend(w):
    return sales.monthly_trend(w.completed(), AS_OF)


@query("""
SELECT COUNT(*) AS total_transactions, CAST(SUM(total_amount) AS DOUBLE) AS total_revenue,
       CAST(SUM(total_amount) AS DOUBLE) / COUNT(*) AS avg_transaction_value,
       CAST(SUM(quantity) AS BIGINT) AS total_units_sold, COUNT(DISTINCT customer_id) AS unique_customers
FROM sold WHERE CAST(transaction_date AS DATE) BETWEEN DATE '2000-01-01' AND DATE '2000-12-31'
""")
def summary_kpis(w):
    return sales.summary_kpis(w.completed(), START, END)


# Products


@query("""
SELECT product_id, product_name, category_name, CAST(SUM(quantity) AS BIGINT) AS units_sold,
       CAST(SUM(total_amount) AS DOUBLE) AS revenue, COUNT(*) AS transaction_count
FROM sold JOIN products USING (product_id)
GROUP BY product_id, product_name, category_name
ORDER BY SUM(total_amount) DESC, product_id LIMIT 10
""")
def top_products(w):
    return sales.top_products(w.completed(), w.products(), 10)


@query("""
SELECT product_id, product_name, category_name, CAST(SUM(quantity) AS BIGINT) AS units_sold,
       CAST(SUM(total_amount) AS DOUBLE) AS revenue
FROM sold JOIN products USING (product_id)
WHERE CAST(transaction_date AS DATE) BETWEEN DATE '2000-01-01' AND DATE '2000-12-31'
GROUP BY product_id, product_name, category_name
ORDER BY SUM(total_amount) DESC, product_id LIMIT 5
""")
def summary_top_products(w):
    return sales.summary_top_products(w.completed(), w.products(), START, END)


@query("""
SELECT category_name, CAST(SUM(total_amount) AS DOUBLE) AS revenue, CAST(SUM(quantity) AS BIGINT) AS units_sold
FROM sold JOIN products USING (product_id)
WHERE CAST(transaction_date AS DATE) BETWEEN DATE '2000-01-01' AND DATE '2000-12-31'
GROUP BY category_name
""")
def revenue_by_category(w):
    return sales.revenue_by_category(w.completed(), w.products().drop("category_name"), w.categories(), start=START, end=END)


@query("""
SELECT category_name, CAST(SUM(total_amount) AS DOUBLE) AS revenue, CAST(SUM(quantity) AS BIGINT) AS units_sold,
       CAST(SUM(total_amount) AS DOUBLE) * 100 / CAST(SUM(SUM(total_amount)) OVER () AS DOUBLE) AS share_pct
FROM sold JOIN products USING (product_id) GROUP BY category_name
""")
def category_revenue_share(w):
    return sales.category_revenue_share(w.completed(), w.products())


@query("SELECT DISTINCT category_name FROM products")
def distinct_categories(w):
    return sales.distinct_categories(w.products())


@query("""
SELECT product_id, product_name, category_name, CAST(price AS DOUBLE) AS price, stock_quantity, reorder_level,
       CAST(CASE WHEN stock_quantity <= reorder_level THEN 1 ELSE 0 END AS BIGINT) AS low_stock
FROM products
""")
def product_catalog(w):
    return sales.product_catalog(w.products().drop("category_name"), w.categories())


# Stores and customers


PERFORMANCE_SQL = """
SELECT s.store_id, s.store_name, s.city, s.region, COUNT(t.transaction_id) AS total_transactions,
       CAST(COALESCE(SUM(t.total_amount), 0) AS DOUBLE) AS total_revenue,
       COALESCE(CAST(SUM(t.total_amount) AS DOUBLE) / COUNT(t.transaction_id), 0) AS avg_transaction,
       COUNT(DISTINCT t.customer_id) AS unique_customers
FROM stores s LEFT JOIN sold t ON s.store_id = t.store_id {period}
GROUP BY s.store_id, s.store_name, s.city, s.region
"""


@query(PERFORMANCE_SQL.format(period=""))
def store_performance(w):
    return sales.store_performance(w.stores(with_city=True), w.completed())


@query(PERFORMANCE_SQL.format(
    period="AND CAST(t.transaction_date AS DATE) BETWEEN DATE '2000-01-01' AND DATE '2000-01-02'"))
def store_performance_in_period(w):
    """Two days, so that some stores have no sale and must still appear."""
    two_days = filters.between_dates(w.completed(), START, "2000-01-02")
    return sales.store_performance(w.stores(with_city=True), two_days)


@query("""
SELECT store_id, store_name, city, region, COUNT(*) AS transaction_count,
       CAST(SUM(total_amount) AS DOUBLE) AS revenue
FROM sold JOIN stores USING (store_id)
WHERE CAST(transaction_date AS DATE) BETWEEN DATE '2000-01-01' AND DATE '2000-12-31'
GROUP BY store_id, store_name, city, region
ORDER BY SUM(total_amount) DESC, store_id LIMIT 5
""")
def summary_top_stores(w):
    return sales.summary_top_stores(w.completed(), w.stores(with_city=True), START, END)


@query("SELECT store_id, store_name, city, region FROM stores")
def store_listing(w):
    from aisle.sources.tables import listing

    return listing(w.stores(with_city=True), "stores")


SPEND_SQL = """
SELECT c.customer_id, c.name, c.email, c.city, COUNT(t.transaction_id) AS total_transactions,
       CAST(COALESCE(SUM(t.total_amount), 0) AS DOUBLE) AS total_spent
FROM customers c LEFT JOIN sold t ON c.customer_id = t.customer_id {period}
GROUP BY c.customer_id, c.name, c.email, c.city
"""


@query(SPEND_SQL.format(period=""))
def customer_spend(w):
    return sales.customer_spend(w.customers(with_city=True), w.completed())


@query(SPEND_SQL.format(
    period="AND CAST(t.transaction_date AS DATE) BETWEEN DATE '2000-01-01' AND DATE '2000-12-31'"))
def customer_spend_in_period(w):
    """One year, so that customers without a sale appear."""
    return sales.customer_spend(w.customers(with_city=True), filters.between_dates(w.completed(), START, END))


# Rankings


RANKING_SQL = """
SELECT product_id, product_name, category_name, CAST(SUM(quantity) AS BIGINT) AS total_units_sold,
       CAST(SUM(total_amount) AS DOUBLE) AS total_revenue,
       RANK() OVER (ORDER BY SUM(total_amount) DESC) AS revenue_rank,
       RANK() OVER (PARTITION BY category_name ORDER BY SUM(total_amount) DESC) AS category_rank,
       DENSE_RANK() OVER (ORDER BY SUM(quantity) DESC) AS units_rank
FROM sold JOIN products USING (product_id) GROUP BY product_id, product_name, category_name
"""


@query(RANKING_SQL)
def sales_ranking(w):
    return ranking.sales_ranking(w.completed(), w.products())


@query(RANKING_SQL)
def sales_ranking_spread(w):
    """The same ranks without any single-task window."""
    return ranking.sales_ranking(w.completed(), w.products(), spread=True)


@query("""
SELECT transaction_id, quantity,
       ROW_NUMBER() OVER (ORDER BY quantity DESC, transaction_id) AS row_no,
       RANK() OVER (ORDER BY quantity DESC) AS rank_no,
       DENSE_RANK() OVER (ORDER BY quantity DESC) AS dense_no,
       COUNT(*) OVER (ORDER BY quantity DESC) AS last_peer,
       COUNT(*) OVER () AS group_rows
FROM sold
""")
def global_rank(w):
    """Every sale ranked by quantity: 50 values, so tie runs cross many segments."""
    rows = w.completed().select("transaction_id", "quantity")
    return positions(rows, [("quantity", False)], [("transaction_id", True)], spread=True)


RUNNING_SQL = """
, daily AS (
    SELECT store_id, CAST(transaction_date AS DATE) AS sale_date, SUM(total_amount) AS revenue
    FROM sold GROUP BY 1, 2
)
SELECT store_id, store_name, city, sale_date, CAST(revenue AS DOUBLE) AS daily_revenue,
       CAST(SUM(revenue) OVER (PARTITION BY store_id ORDER BY sale_date
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS running_total,
       CAST(SUM(revenue) OVER recent AS DOUBLE) / COUNT(*) OVER recent AS rolling_7day_avg
FROM daily JOIN stores USING (store_id)
"""


@query(RUNNING_SQL + "WINDOW recent AS (PARTITION BY store_id ORDER BY sale_date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)")
def running_total(w):
    return ranking.running_total(w.completed(), w.stores(with_city=True))


@query(RUNNING_SQL + "WINDOW recent AS (PARTITION BY store_id ORDER BY sale_date "
       "RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW)")
def running_total_calendar(w):
    return ranking.running_total(w.completed(), w.stores(with_city=True), calendar=True)


SPENDING_SQL = """
, spend AS (
    SELECT customer_id, COUNT(*) AS n, SUM(total_amount) AS spent, MAX(total_amount) AS most
    FROM sold GROUP BY customer_id
), tiled AS (
    SELECT *, NTILE(4) OVER (ORDER BY spent DESC, customer_id) AS quartile,
           NTILE(10) OVER (ORDER BY spent DESC, customer_id) AS decile,
           PERCENT_RANK() OVER (ORDER BY spent) AS percentile
    FROM spend
)
SELECT customer_id, name AS customer_name, city, n AS total_transactions, CAST(spent AS DOUBLE) AS total_spent,
       CAST(spent AS DOUBLE) / n AS avg_transaction, CAST(most AS DOUBLE) AS max_transaction,
       quartile AS spending_quartile, decile AS spending_decile, percentile AS spending_percentile,
       CASE quartile WHEN 1 THEN 'Platinum' WHEN 2 THEN 'Gold' WHEN 3 THEN 'Silver' ELSE 'Bronze' END
           AS customer_tier
FROM tiled JOIN customers USING (customer_id)
"""


@query(SPENDING_SQL)
def customer_spending(w):
    return ranking.customer_spending(w.completed(), w.customers(with_city=True))


@query(SPENDING_SQL)
def customer_spending_spread(w):
    return ranking.customer_spending(w.completed(), w.customers(with_city=True), spread=True)


# Listings


@query(DETAIL_SQL + """
WHERE t.status = 'completed' AND CAST(t.transaction_date AS DATE) BETWEEN DATE '2000-01-01' AND DATE '2000-12-31'
ORDER BY t.transaction_date DESC, t.transaction_id LIMIT 500
""")
def sales_detail(w):
    return sales.sales_detail(
        w.completed(), w.customers(), w.products().drop("category_name"), w.stores(), w.categories(), start=START, end=END
    )


@query(DETAIL_SQL + """
WHERE t.status = 'completed' AND p.category_name = 'PROMO' AND t.store_id = 3
ORDER BY t.transaction_date DESC, t.transaction_id LIMIT 500
""")
def sales_detail_filtered(w):
    return sales.sales_detail(
        w.completed(), w.customers(), w.products(), w.stores(), store_id=3, category_id="PROMO"
    )


@query(DETAIL_SQL + "WHERE t.status = 'completed' ORDER BY t.transaction_date DESC, t.transaction_id LIMIT 25 OFFSET 600")
def sales_page(w):
    """Page 25 of 25 sales, of all there are: the page is cut from the facts before names are joined."""
    page = paging.page_rows(w.completed(), paging.NEWEST, paging.BY_ID, 25, paging.SALES_PAGE)
    return sales.sales_detail(page, w.customers(), w.products(), w.stores(), limit=None)


@query("""
SELECT CAST(SUM(total_amount) AS DOUBLE) AS revenue, COUNT(*) AS sales, CAST(SUM(quantity) AS BIGINT) AS units,
       CAST(SUM(total_amount) AS DOUBLE) / COUNT(*) AS average
FROM sold WHERE CAST(transaction_date AS DATE) BETWEEN DATE '2000-01-01' AND DATE '2000-12-31'
""")
def sales_page_summary(w):
    """Figures of a year's sales, all of them."""
    rows = sales.sales_rows(w.completed(), w.customers(), w.products(), w.stores(), start=START, end=END)
    return sales.sales_page_summary(rows)


@query("""
SELECT product_name, CAST(SUM(total_amount) AS DOUBLE) AS revenue
FROM sold JOIN products USING (product_id) GROUP BY product_name
ORDER BY SUM(total_amount) DESC, product_name LIMIT 8
""")
def top_products_by_name(w):
    """Sales are summed per product before its name is joined, then once more per name."""
    per_product = sales.product_sales(w.completed()).withColumnRenamed("revenue", "total_amount")
    named = per_product.join(w.products().select("product_id", "product_name"), "product_id")
    return sales.top_products_by_name(named)


@query(FLAGGED_CTE + FLAGGED_SQL)
def transactions_flagged(w):
    return paging.transactions_flagged(w.transactions(), w.customers(), w.products(), w.stores(), flags(w))


@query(FLAGGED_CTE + FLAGGED_SQL + "ORDER BY t.transaction_date DESC, t.transaction_id LIMIT 20 OFFSET 40")
def paginate(w):
    page = paging.transactions_page(
        w.transactions(), w.customers(), w.products(), w.stores(), flags(w), page=3, per_page=20, most=paging.MAX_PER_PAGE
    )
    return page.rows


@query("""
SELECT CAST(3 AS BIGINT) AS page, CAST(20 AS BIGINT) AS per_page, COUNT(*) AS total,
       CAST(ceil(COUNT(*) / 20.0) AS BIGINT) AS pages, least(41, COUNT(*)) AS first_row,
       least(60, COUNT(*)) AS last_row
FROM tx
""")
def page_totals(w):
    return paging.page_totals(w.transactions(), 3, 20)


@query("""
SELECT transaction_id, transaction_date, CAST(total_amount AS DOUBLE) AS total_amount FROM tx
ORDER BY transaction_date DESC, transaction_id LIMIT 100 OFFSET 40000
""")
def paginate_deep(w):
    """Page 401 of 100: too far for a bounded top-k, so counts between split points find its range first.

    Each round reads the listing twice, so line items and orders are joined once and stored.
    """
    rows = stored(w.transactions().select("transaction_id", "transaction_date", "total_amount"), "listing")
    return paging.page_rows(rows, paging.NEWEST, paging.BY_ID, 401, 100)


@query("""
SELECT transaction_id, transaction_date FROM tx
WHERE transaction_date < DATE '2000-06-30' OR (transaction_date = DATE '2000-06-30' AND transaction_id > '5')
ORDER BY transaction_date DESC, transaction_id LIMIT 20
""")
def page_after(w):
    rows = w.transactions().select("transaction_id", "transaction_date")
    return paging.page_after(rows, dt.datetime(2000, 6, 30), "5", 20)


@query("SELECT product_id, CAST(price AS DOUBLE) AS price FROM products")
def resort(w):
    return paging.resorted(w.products().select("product_id", "price"), "price", ascending=False)


@query("""
SELECT store_id, replace(store_name, 'Supplier#', '') AS label,
       CASE WHEN length(store_name) > 12 THEN substring(store_name, 1, 12) || '…' ELSE store_name END AS short
FROM stores
""")
def chart_labels(w):
    return w.stores().select(
        "store_id",
        without_prefix(F.col("store_name"), "Supplier#").alias("label"),
        short_label(F.col("store_name"), 12).alias("short"),
    )
