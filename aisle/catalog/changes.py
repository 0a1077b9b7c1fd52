"""Queries: loading and exporting, quality checks, and changes to stored tables."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aisle.catalog.fraud import LINE_LIMITS, RULES_SQL, flags
from aisle.catalog.registry import query
from aisle.functions.money import price
from aisle.operators import changes, demand, filters, fraud, key_graph, quality, sales
from aisle.schemas import ForeignKey
from aisle.session import scratch_path, stored
from aisle.sources import batches, tables, versions
from aisle.sources.warehouse import SCHEMAS

RAW_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
AT = "2002-01-01"

# Sources and sinks


@query("SELECT DISTINCT category_name AS category_id, category_name FROM products")
def scan_categories(w):
    return tables.listing(w.categories(), "categories")


@query("SELECT customer_id, name, email, city FROM customers")
def scan_customers(w):
    return w.customers(with_city=True)


@query("""
SELECT product_id, product_name, category_name AS category_id, category_name, CAST(price AS DOUBLE) AS price,
       stock_quantity, reorder_level
FROM products
""")
def scan_products(w):
    return w.products()


@query("""
SELECT transaction_id, customer_id, product_id, store_id, quantity, unit_price,
       CAST(total_amount AS DOUBLE) AS total_amount, transaction_date, payment_method, status
FROM priced
""")
def scan_transactions(w):
    return w.transactions()


def staff(w):
    """Customers as employees, each of the store numbered like their nation."""
    return w.raw("customer").select(
        F.col("c_custkey").alias("employee_id"),
        F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("role"),
        F.col("c_nationkey").cast("bigint").alias("store_id"),
    )


STAFF_SQL = """
SELECT c_custkey AS employee_id, c_name AS name, c_mktsegment AS role, CAST(c_nationkey AS BIGINT) AS store_id,
       store_name
FROM customer JOIN stores ON store_id = c_nationkey
"""


@query(STAFF_SQL)
def employee_directory(w):
    return sales.employee_directory(staff(w), w.stores())


@query(STAFF_SQL + "WHERE c_nationkey = 7")
def employees_of_store(w):
    return filters.employees_of_store(sales.employee_directory(staff(w), w.stores()), 7)


@query(" UNION ALL ".join(f"SELECT '{name}' AS \"table\", COUNT(*) AS n FROM {name}" for name in RAW_TABLES), model="")
def table_counts(w):
    return tables.table_counts({name: w.raw(name) for name in RAW_TABLES})


SEED_AMOUNTS = {
    "region": "r_regionkey", "nation": "n_nationkey", "supplier": "s_nationkey", "customer": "c_acctbal",
    "orders": "o_totalprice", "lineitem": "l_extendedprice", "events": "value",
}


@query(" UNION ALL ".join(
    f"SELECT '{name}' AS \"table\", COUNT(*) AS n, CAST(SUM(CAST({column} AS DECIMAL(18,2))) AS DOUBLE) AS amount FROM {name}"
    for name, column in SEED_AMOUNTS.items()
), model="")
def load_seed(w):
    """Dimension and fact tables exported as CSV and bulk-loaded again: rows and sums of each."""
    source, target = scratch_path(w.spark, "seed"), scratch_path(w.spark, "tables")
    schemas = {name: SCHEMAS[name] for name in SEED_AMOUNTS}
    for name in schemas:
        w.raw(name).write.option("header", True).csv(f"{source}/{name}")
    loaded = tables.load_seed(w.spark, source, target, schemas=schemas)
    sums = [
        df.agg(F.count("*").alias("n"), F.sum(F.col(SEED_AMOUNTS[name]).cast("decimal(18,2)")).cast("double").alias("amount"))
        .select(F.lit(name).alias("table"), "n", "amount")
        for name, df in loaded.items()
    ]
    return reduce(DataFrame.unionByName, sums)


@query("""
SELECT strftime(transaction_date, '%Y-%m') AS month, COUNT(*) AS sales, CAST(SUM(total_amount) AS DOUBLE) AS revenue
FROM sold WHERE transaction_date >= DATE '2000-01-01' AND transaction_date < DATE '2000-07-01' GROUP BY 1
""")
def stored_months(w):
    """Half a year read back from the by-month layout; the other months' folders are not opened."""
    path = scratch_path(w.spark, "transactions")
    tables.write_transactions(w.completed(), path)
    fields = "transaction_id string, total_amount decimal(12,2), month string"
    stored = w.spark.read.schema(fields).parquet(path).filter(F.col("month").cast("string").between("2000-01", "2000-06"))
    return stored.groupBy(F.col("month").cast("string").alias("month")).agg(
        F.count("*").alias("sales"), F.sum("total_amount").alias("revenue")
    )


@query("""
SELECT transaction_id, quantity, CAST(total_amount AS DOUBLE) AS total_amount,
       strftime(transaction_date, '%Y-%m-%d') AS day,
       strftime(transaction_date, '%Y-%m-%dT%H:%M:%S.%f') AS transaction_date
FROM ev WHERE status = 'completed'
""")
def export_json(w):
    path = scratch_path(w.spark, "export")
    rows = w.events().filter("status = 'completed'").select(
        "transaction_id", "quantity", "total_amount", F.to_date("transaction_date").alias("day"), "transaction_date"
    )
    tables.export_json(rows, path)
    return w.spark.read.schema(
        "transaction_id bigint, quantity bigint, total_amount double, day string, transaction_date string"
    ).json(path)


# Checks


@query("""
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, COUNT(*) AS copies
FROM lineitem GROUP BY ALL HAVING COUNT(*) > 1
""", model="")
def check_keys(w):
    return quality.check_keys(w.raw("lineitem"), ["l_orderkey", "l_linenumber"])


@query("""
SELECT 'transactions' AS child, 'customer_id' AS "column", CAST(customer_id AS VARCHAR) AS key, COUNT(*) AS rows
FROM tx WHERE customer_id NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate < DATE '1995-03-01')
GROUP BY customer_id
""")
def check_foreign_keys(w):
    """Against customers known by March 1995 the later ones are orphans; products all resolve."""
    early = w.raw("orders").filter(F.col("o_orderdate") < F.lit("1995-03-01").cast("date"))
    parents = {
        "transactions": w.transactions(),
        "customers": early.select(F.col("o_custkey").alias("customer_id")).distinct(),
        "products": w.products(),
    }
    return quality.check_foreign_keys(
        parents,
        [
            ForeignKey("transactions", "customer_id", "customers", "restrict"),
            ForeignKey("transactions", "product_id", "products", "restrict"),
        ],
    )


@query("""
SELECT transaction_id, 'status' AS "column", 'not allowed' AS problem FROM tx WHERE status NOT IN ('completed', 'pending')
UNION ALL
SELECT transaction_id, 'payment_method', 'not allowed' FROM tx
WHERE payment_method NOT IN ('cash', 'credit_card', 'debit_card', 'online')
UNION ALL
SELECT transaction_id, 'transaction_id', 'too long' FROM tx WHERE length(transaction_id) > 14
""")
def check_domains(w):
    found = quality.check_domains(
        w.transactions().select("transaction_id", "status", "payment_method"),
        required=["transaction_id", "status"],
        allowed={
            "status": ("completed", "pending"),
            "payment_method": ("cash", "credit_card", "debit_card", "online"),
        },
        longest={"transaction_id": 14},
    )
    return found.select("transaction_id", "column", "problem")


# Appends


def sale_batch(w):
    """Line items as incoming sales: single units become empty ones, gift cards lack an employee."""
    rows = w.transactions().drop("status", "total_amount")
    employee = F.when(F.col("payment_method") != "gift_card", F.col("store_id"))
    return rows.withColumn("quantity", F.col("quantity") - 1).withColumn("employee_id", employee)


@query("""
SELECT transaction_id, customer_id, product_id, store_id, store_id AS employee_id, quantity - 1 AS quantity,
       unit_price, ((quantity - 1) * CAST(round(unit_price * 100) AS BIGINT)) / 100.0 AS total_amount,
       transaction_date, payment_method, 'completed' AS status
FROM priced WHERE quantity > 1 AND payment_method <> 'gift_card'
""")
def append_transactions(w):
    return changes.append_transactions(sale_batch(w)).accepted


@query("""
SELECT transaction_id, CASE WHEN payment_method = 'gift_card' THEN 'missing employee_id'
       WHEN quantity = 1 THEN 'quantity below 1' ELSE 'unknown customer_id' END AS problem
FROM tx WHERE quantity = 1 OR payment_method = 'gift_card'
   OR customer_id NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate < DATE '1995-03-01')
""")
def reject_transactions(w):
    """Against the customers known by March 1995 later ones are orphans."""
    early = w.raw("orders").filter(F.col("o_orderdate") < F.lit("1995-03-01").cast("date"))
    known = {"customers": early.select(F.col("o_custkey").alias("customer_id")), "products": w.products()}
    return changes.append_transactions(sale_batch(w), tables=known).rejected.select("transaction_id", "problem")


@query("""
SELECT p_partkey AS product_id, p_name AS product_name, p_type AS category_id,
       CAST(CAST(p_retailprice AS DECIMAL(10,2)) AS DOUBLE) AS price,
       CAST(p_size AS BIGINT) AS stock_quantity,
       CAST(10 AS BIGINT) AS reorder_level, TIMESTAMP '2002-01-01' AS created_at
FROM part WHERE p_size BETWEEN 10 AND 40
""", model="")
def append_products(w):
    """Parts as new products: large ones come without a price, small ones without a stock; both are refused."""
    size = F.col("p_size")
    batch = w.raw("part").select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_name").alias("product_name"),
        F.col("p_type").alias("category_id"),
        F.when(size <= 40, F.col("p_retailprice")).alias("price"),
        F.when(size >= 10, size).alias("stock_quantity"),
        F.lit(10).alias("reorder_level"),
    )
    return changes.append_products(batch, F.lit(AT).cast("timestamp_ntz")).accepted


def customer_batch(w):
    """Suppliers signing up: in ASIA with one shared address per city, elsewhere with a customer's."""
    own = F.concat(F.lit("customer."), F.substring("store_name", 10, 20), F.lit("@example.com"))
    shared = F.concat(F.lit("desk."), F.lower("city"), F.lit("@example.com"))
    return w.stores(with_city=True).select(
        F.col("store_name").alias("name"),
        F.when(F.col("region") == "ASIA", shared).otherwise(own).alias("email"),
        "city",
    )


@query("""
SELECT 'desk.' || lower(city) || '@example.com' AS email, MIN(store_name) AS name, '' AS phone, '' AS address, city,
       'USA' AS country, TIMESTAMP '2002-01-01' AS created_at
FROM stores WHERE region = 'ASIA' GROUP BY city
""")
def append_customers(w):
    at = F.lit(AT).cast("timestamp_ntz")
    return changes.append_customers(customer_batch(w), w.customers(), at).accepted


@query("""
SELECT 'customer.' || substring(store_name, 10, 20) || '@example.com' AS email, store_name AS name, city,
       'email already stored' AS problem
FROM stores WHERE region <> 'ASIA'
UNION ALL
SELECT 'desk.' || lower(city) || '@example.com', store_name, city, 'email repeated in batch'
FROM (SELECT *, row_number() OVER (PARTITION BY city ORDER BY store_name) AS nth FROM stores WHERE region = 'ASIA')
WHERE nth > 1
""")
def reject_customers(w):
    at = F.lit(AT).cast("timestamp_ntz")
    return changes.append_customers(customer_batch(w), w.customers(), at).rejected.select("email", "name", "city", "problem")


# Keyed updates


@query("""
, named AS (
    SELECT product_id, arg_max(status || ' ' || product_id, transaction_date) AS product_name FROM sold
    WHERE quantity > 40 GROUP BY product_id
), dear AS (
    SELECT product_id, MAX(unit_price) AS price FROM priced WHERE status = 'completed' AND quantity <= 40 GROUP BY product_id
)
SELECT p.product_id, COALESCE(n.product_name, p.product_name) AS product_name,
       COALESCE(d.price, CAST(p.price AS DOUBLE)) AS price
FROM products p LEFT JOIN named n USING (product_id) LEFT JOIN dear d USING (product_id)
""")
def update_products_in_turn(w):
    """Every sale changes one field of its product, large ones the name, others the price in rising order."""
    large = F.col("quantity") > 40
    rows = w.completed().select(
        "product_id",
        F.when(large, F.concat_ws(" ", "status", F.col("product_id").cast("string"))).alias("product_name"),
        F.when(~large, price(F.col("unit_price"))).alias("price"),
        F.coalesce(F.when(~large, price(F.col("unit_price"))), F.lit(0)).alias("turn"),
    )
    return changes.update_products(rows, w.products(), "turn").select("product_id", "product_name", "price")


@query("""
, dearest AS (
    SELECT product_id, MAX(unit_price) AS price FROM priced WHERE status = 'completed' GROUP BY product_id
)
SELECT p.product_id, p.product_name, COALESCE(d.price, CAST(p.price AS DOUBLE)) AS price, p.stock_quantity
FROM products p LEFT JOIN dearest d USING (product_id)
""")
def update_products(w):
    """Prices set to the highest one ever paid; the empty stock column keeps old values."""
    new = w.completed().groupBy("product_id").agg(price(F.max("unit_price")).alias("price"))
    updated = changes.update_products(new.withColumn("stock_quantity", F.lit(None).cast("int")), w.products())
    return updated.select("product_id", "product_name", "price", "stock_quantity")


@query("""
SELECT transaction_id,
       CASE WHEN status = 'pending' AND transaction_date < DATE '1996-01-01' THEN 'cancelled' ELSE status END AS status
FROM tx
""")
def update_status(w):
    """Orders still pending from 1995 are cancelled."""
    old = filters.between_dates(w.transactions("pending"), None, "1995-12-31")
    new = old.select("transaction_id", F.lit("cancelled").alias("status"))
    return changes.update_status(new, w.transactions()).select("transaction_id", "status")


@query("""
, old AS (
    SELECT transaction_id, status, transaction_date, strftime(transaction_date, '%Y-%m') AS month FROM tx
)
SELECT transaction_id, month, month IN (SELECT month FROM old WHERE status = 'pending' AND transaction_date < DATE '1996-01-01') AS rewritten,
       CASE WHEN status = 'pending' AND transaction_date < DATE '1996-01-01' THEN 'cancelled' ELSE status END AS status
FROM old
""")
def update_status_stored(w):
    """The same orders cancelled where they are stored by month, twice; only months that hold some are rewritten."""
    rows = w.transactions()
    month = F.date_format("transaction_date", "yyyy-MM").alias("month")
    stored = versions.Stored(
        scratch_path(w.spark, "by-month"), "transaction_id string, status string, month string", "month", "transaction_id"
    )
    versions.create(rows.select("transaction_id", "status", month), stored)
    first = set(versions.manifest(w.spark, stored)[1].values())
    old = filters.between_dates(w.transactions("pending"), None, "1995-12-31")
    new = old.select("transaction_id", F.lit("cancelled").alias("status"))
    for _ in range(2):
        versions.rewrite(new, stored, "cancel old orders", changes.update_status)
    found = versions.read(w.spark, stored, with_write=True)
    return found.select("transaction_id", "month", (~F.col("write").isin(first)).alias("rewritten"), "status")


@query(RULES_SQL + """
SELECT flag_id, severity, CAST(CASE WHEN flagged_at < TIMESTAMP '2024-01-15' THEN 1 ELSE resolved END AS BIGINT)
       AS resolved
FROM flags
""")
def resolve_flags(w):
    stored = flags(w)
    old = stored.filter(F.col("flagged_at") < F.lit("2024-01-15").cast("timestamp_ntz")).select("flag_id")
    return changes.resolve_flags(stored, old).select("flag_id", "severity", "resolved")


@query("SELECT DISTINCT o_orderkey AS product_id FROM orders WHERE o_orderkey NOT IN (SELECT product_id FROM products)")
def unknown_products(w):
    """Order numbers asked for as product ids."""
    ids = w.raw("orders").select(F.col("o_orderkey").alias("product_id")).distinct()
    return demand.unknown_products(ids, w.products())


@query("""
SELECT transaction_id, CAST(total_amount AS DOUBLE) AS total_amount, 'stored' AS problem FROM tx
WHERE status IN ('completed', 'refunded')
UNION ALL SELECT transaction_id, CAST(total_amount AS DOUBLE), 'transaction_id already stored' FROM tx
WHERE status = 'completed' AND quantity > 40
""")
def append_batches(w):
    """Two batches appended, the second twice; it brings large sales of the first again, which are refused."""
    folder, schema = scratch_path(w.spark, "appended"), "transaction_id string, total_amount decimal(12,2)"
    rows = stored(w.transactions().select("transaction_id", "total_amount", "status", "quantity"), "sales")
    first, again = rows.filter("status = 'completed'"), "status = 'refunded' OR (status = 'completed' AND quantity > 40)"
    for batch, new in (("first", first), ("second", rows.filter(again)), ("second", rows.filter(again))):
        sent = new.select("transaction_id", "total_amount")
        refused = batches.append_batch(sent, folder, "transactions", batch, "transaction_id", schema)
    kept = batches.read_batches(w.spark, folder, "transactions", schema).withColumn("problem", F.lit("stored"))
    return kept.unionByName(refused)


# Cascades


@query("SELECT transaction_id, 'quantity' AS rule FROM tx WHERE quantity > 45 AND status <> 'refunded'")
def cascade_delete(w):
    """Quantity flags left after the refunded transactions are deleted."""
    found = fraud.row_rule_flags(w.transactions(), LINE_LIMITS, (fraud.QUANTITY,))
    return changes.cascade_delete(found, w.transactions("refunded"), "transaction_id").select("transaction_id", "rule")


@query("""
SELECT product_id FROM products
WHERE product_id IN (SELECT product_id FROM tx WHERE quantity > 45 AND status = 'refunded')
""")
def restrict_delete(w):
    """Products kept from being deleted by large refunded sales."""
    large = fraud.row_rule_flags(w.transactions("refunded"), LINE_LIMITS, (fraud.QUANTITY,))
    return changes.restrict_delete(w.products().select("product_id"), large, "product_id")


@query("""
SELECT s_suppkey, CAST(CASE WHEN r_name = 'ASIA' THEN n_nationkey + 100 ELSE n_nationkey END AS BIGINT) AS s_nationkey
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
""", model="")
def cascade_key_update(w):
    """The keys of ASIA's nations are renumbered and suppliers follow."""
    asia = w.raw("region").filter("r_name = 'ASIA'")
    mapping = w.raw("nation").join(asia, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").alias("s_nationkey"), (F.col("n_nationkey") + 100).alias("new_key")
    )
    return changes.cascade_key_update(w.raw("supplier"), mapping, "s_nationkey").select("s_suppkey", "s_nationkey")


def keyed_tables(w, sales):
    """Sales with their parents, a forecast row per product, and flags on quantities above 40."""
    limits = replace(LINE_LIMITS, quantity=40)
    flagged = fraud.row_rule_flags(sales, limits, (fraud.QUANTITY,)).select("transaction_id")
    return {
        "categories": w.categories(),
        "products": w.products(),
        "customers": w.customers(),
        "stores": w.stores(),
        "transactions": sales,
        "fraud_flags": flagged.withColumn("flag_id", F.col("transaction_id")),
        "demand_forecast": w.products().select(F.col("product_id").alias("forecast_id"), "product_id"),
    }


@query("""
, kept AS (SELECT * FROM tx WHERE status = 'completed' AND quantity > 45),
asked AS (SELECT product_id, category_name FROM products WHERE stock_quantity <= 25),
lost AS (SELECT product_id FROM asked WHERE product_id NOT IN (SELECT product_id FROM kept)),
types AS (SELECT DISTINCT category_name FROM products),
held AS (SELECT DISTINCT category_name FROM products WHERE product_id NOT IN (SELECT product_id FROM lost))
SELECT DISTINCT 'transactions' AS "table", transaction_id AS key, 'deleted' AS outcome, CAST(NULL AS VARCHAR) AS cause
FROM tx WHERE status <> 'completed' OR quantity <= 45
UNION ALL SELECT DISTINCT 'fraud_flags', transaction_id, 'deleted', 'transactions.transaction_id' FROM tx
WHERE quantity > 40 AND (status <> 'completed' OR quantity <= 45)
UNION ALL SELECT 'products', CAST(product_id AS VARCHAR), 'deleted', NULL FROM lost
UNION ALL SELECT 'demand_forecast', CAST(product_id AS VARCHAR), 'deleted', 'products.product_id' FROM lost
UNION ALL SELECT 'products', CAST(product_id AS VARCHAR), 'refused', 'transactions.product_id' FROM asked
WHERE product_id IN (SELECT product_id FROM kept)
UNION ALL SELECT 'categories', category_name, CASE WHEN category_name IN (SELECT * FROM held) THEN 'refused' ELSE 'deleted' END,
       CASE WHEN category_name IN (SELECT * FROM held) THEN 'products.category_id' END FROM types
UNION ALL SELECT 'customers', CAST(customer_id AS VARCHAR),
       CASE WHEN customer_id IN (SELECT customer_id FROM kept) THEN 'refused' ELSE 'deleted' END,
       CASE WHEN customer_id IN (SELECT customer_id FROM kept) THEN 'transactions.customer_id' END FROM customers
UNION ALL SELECT 'stores', CAST(store_id AS VARCHAR),
       CASE WHEN store_id IN (SELECT store_id FROM kept) THEN 'refused' ELSE 'deleted' END,
       CASE WHEN store_id IN (SELECT store_id FROM kept) THEN 'transactions.store_id' END FROM stores
""")
def delete_keys(w):
    """All but the large completed sales go, with the small products and every category, customer and store they leave free."""
    keys = ("transaction_id", "customer_id", "product_id", "store_id", "quantity", "total_amount", "status")
    tables = keyed_tables(w, stored(w.transactions().select(*keys), "sales"))
    requested = {name: tables[name] for name in ("categories", "customers", "stores")}
    requested["products"] = tables["products"].filter("stock_quantity <= 25")
    requested["transactions"] = tables["transactions"].filter("status <> 'completed' OR quantity <= 45")
    return key_graph.delete_keys(tables, requested).outcomes


@query("""
, renamed AS (
    SELECT product_id AS old_id, CASE WHEN stock_quantity <= 25 THEN product_id + 1000000000000
           WHEN product_id + 1 NOT IN (SELECT product_id FROM products) THEN product_id + 1 ELSE product_id END AS new_id
    FROM products
)
SELECT 'transactions' AS "table", transaction_id AS key, CAST(new_id AS BIGINT) AS product_id
FROM tx JOIN renamed ON product_id = old_id
UNION ALL SELECT 'demand_forecast', CAST(old_id AS VARCHAR), CAST(new_id AS BIGINT) FROM renamed
UNION ALL SELECT 'products', CAST(new_id AS VARCHAR), CAST(new_id AS BIGINT) FROM renamed
""")
def rename_keys(w):
    """Small products get far keys, the others ask for the next key, which is mostly in use; children follow."""
    tables = {name: df for name, df in keyed_tables(w, w.transactions()).items() if name in ("products", "transactions", "demand_forecast")}
    far = F.when(F.col("stock_quantity") <= 25, F.lit(10**12)).otherwise(1)
    mapping = tables["products"].select("product_id", (F.col("product_id") + far).alias("new_key"))
    changed = key_graph.rename_keys(tables, "products", mapping).tables
    keys = {"transactions": "transaction_id", "demand_forecast": "forecast_id", "products": "product_id"}
    parts = [changed[t].select(F.lit(t).alias("table"), F.col(k).cast("string").alias("key"), "product_id") for t, k in keys.items()]
    return reduce(DataFrame.unionByName, parts)
