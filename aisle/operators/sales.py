"""Sales reports: headline figures, trends, rankings by product, store and customer, listings.

Facts are aggregated on their own key before any dimension is joined, so the join sees one row per
key and a key holding a large share of the rows has already been combined on the map side. No
dimension is broadcast by hint: Spark decides from measured sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aisle.functions.dates import Day, month_label
from aisle.functions.labels import is_low, low_stock_flag
from aisle.functions.money import average
from aisle.operators.filters import between_dates, completed_sales, matching, trailing_months

LISTING_LIMIT = 500
TOP_PRODUCTS_MAX = 20


def limited(rows: DataFrame, limit: int | None, most: int | None = None) -> DataFrame:
    """The first ``limit`` rows, all for None. A limit below 1 or above a stated ``most`` is an error."""
    if most is not None and (limit is None or limit > most):
        raise ValueError(f"limit must be at most {most}")
    if limit is None:
        return rows
    if limit < 1:
        raise ValueError("limit must be at least 1")
    return rows.limit(limit)


def with_category(products: DataFrame, categories: DataFrame | None = None) -> DataFrame:
    """Products with their category name; a table that already carries it is returned as is."""
    if categories is None:
        return products
    return products.join(categories.select("category_id", "category_name"), "category_id")


def _or_zero(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(0)).alias(column)


# Headline figures


def dashboard_kpis(transactions: DataFrame) -> DataFrame:
    """Revenue, rows, units and customers over completed sales; zeros when there are none."""
    return completed_sales(transactions).agg(
        F.coalesce(F.sum("total_amount"), F.lit(0)).alias("total_revenue"),
        F.count("*").alias("total_transactions"),
        F.coalesce(F.sum("quantity"), F.lit(0)).alias("total_units_sold"),
        F.countDistinct("customer_id").alias("unique_customers"),
    )


def open_fraud_count(flags: DataFrame) -> DataFrame:
    return flags.filter(F.col("resolved") == 0).agg(F.count("*").alias("fraud_count"))


def low_stock_count(products: DataFrame) -> DataFrame:
    low = products.filter(is_low(F.col("stock_quantity"), F.col("reorder_level")))
    return low.agg(F.count("*").alias("low_stock_count"))


def monthly_trend(transactions: DataFrame, as_of: Day | None = None, months: int = 12) -> DataFrame:
    """Revenue and rows per calendar month over the trailing months, oldest first."""
    recent = trailing_months(completed_sales(transactions), as_of, months)
    return (
        recent.groupBy(month_label(F.col("transaction_date")).alias("month"))
        .agg(F.sum("total_amount").alias("revenue"), F.count("*").alias("transactions"))
        .orderBy("month")
    )


def sales_summary(
    transactions: DataFrame,
    products: DataFrame,
    stores: DataFrame,
    start: Day,
    end: Day,
    categories: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """The three result sets of the period summary."""
    return {
        "kpis": summary_kpis(transactions, start, end),
        "top_products": summary_top_products(transactions, products, start, end, categories),
        "top_stores": summary_top_stores(transactions, stores, start, end),
    }


def summary_kpis(transactions: DataFrame, start: Day, end: Day) -> DataFrame:
    """Period figures; unlike the dashboard, sums and averages are NULL when nothing matches."""
    period = between_dates(completed_sales(transactions), start, end)
    return period.agg(
        F.count("*").alias("total_transactions"),
        F.sum("total_amount").alias("total_revenue"),
        average(F.sum("total_amount"), F.count("*")).alias("avg_transaction_value"),
        F.sum("quantity").alias("total_units_sold"),
        F.countDistinct("customer_id").alias("unique_customers"),
    )


# Products


def product_sales(transactions: DataFrame) -> DataFrame:
    """Units, revenue and rows per product over completed sales."""
    return (
        completed_sales(transactions)
        .groupBy("product_id")
        .agg(
            F.sum("quantity").alias("units_sold"),
            F.sum("total_amount").alias("revenue"),
            F.count("*").alias("transaction_count"),
        )
    )


def top_products(
    transactions: DataFrame,
    products: DataFrame,
    limit: int | None = 10,
    categories: DataFrame | None = None,
    most: int | None = None,
) -> DataFrame:
    """Best sellers by revenue; ``most`` is a limit that callers may not exceed."""
    named = with_category(products, categories).select("product_id", "product_name", "category_name")
    best = product_sales(transactions).join(named, "product_id").orderBy(F.desc("revenue"), "product_id")
    return limited(best, limit, most).select(
        "product_id", "product_name", "category_name", "units_sold", "revenue", "transaction_count"
    )


def summary_top_products(
    transactions: DataFrame,
    products: DataFrame,
    start: Day,
    end: Day,
    categories: DataFrame | None = None,
    limit: int | None = 5,
) -> DataFrame:
    period = between_dates(transactions, start, end)
    return top_products(period, products, limit, categories).drop("transaction_count")


def revenue_by_category(
    transactions: DataFrame,
    products: DataFrame,
    categories: DataFrame | None = None,
    *,
    start: Day | None = None,
    end: Day | None = None,
    store_id=None,
    category_id=None,
) -> DataFrame:
    """Revenue and units per category, largest first, with the listing's filters."""
    period = matching(between_dates(transactions, start, end), store_id=store_id)
    wanted = matching(with_category(products, categories), category_id=category_id)
    return (
        product_sales(period)
        .join(wanted.select("product_id", "category_name"), "product_id")
        .groupBy("category_name")
        .agg(F.sum("revenue").alias("revenue"), F.sum("units_sold").alias("units_sold"))
        .orderBy(F.desc("revenue"), "category_name")
    )


def category_revenue_share(
    transactions: DataFrame, products: DataFrame, categories: DataFrame | None = None
) -> DataFrame:
    """Category revenue with its percent of the total.

    The total is windowed over the aggregated rows, one per category.
    """
    revenue = revenue_by_category(transactions, products, categories)
    total = F.sum("revenue").over(Window.partitionBy())
    share = F.col("revenue").cast("double") * 100 / total.cast("double")
    return revenue.select("category_name", "revenue", "units_sold", share.alias("share_pct")).orderBy(
        F.desc("revenue"), "category_name"
    )


def distinct_categories(products: DataFrame) -> DataFrame:
    return products.select("category_name").distinct().orderBy("category_name")


def product_catalog(products: DataFrame, categories: DataFrame | None = None) -> DataFrame:
    """Products with category and low-stock flag, ordered by name."""
    return (
        with_category(products, categories)
        .select(
            "product_id",
            "product_name",
            "category_name",
            "price",
            "stock_quantity",
            "reorder_level",
            low_stock_flag(F.col("stock_quantity"), F.col("reorder_level")).alias("low_stock"),
            *[c for c in ("created_at",) if c in products.columns],
        )
        .orderBy("product_name", "product_id")
    )


# Stores and customers


def store_performance(stores: DataFrame, transactions: DataFrame) -> DataFrame:
    """Figures per store, stores without completed sales included."""
    per_store = (
        completed_sales(transactions)
        .groupBy("store_id")
        .agg(
            F.count("*").alias("total_transactions"),
            F.sum("total_amount").alias("total_revenue"),
            F.countDistinct("customer_id").alias("unique_customers"),
        )
    )
    mean = F.coalesce(average(F.col("total_revenue"), F.col("total_transactions")), F.lit(0.0))
    shown = [c for c in ("store_id", "store_name", "city", "region", "manager_name") if c in stores.columns]
    return (
        stores.select(*shown)
        .join(per_store, "store_id", "left")
        .select(
            *shown,
            _or_zero("total_transactions"),
            _or_zero("total_revenue"),
            mean.alias("avg_transaction"),
            _or_zero("unique_customers"),
        )
        .orderBy(F.desc("total_revenue"), "store_id")
    )


def summary_top_stores(
    transactions: DataFrame, stores: DataFrame, start: Day, end: Day, limit: int | None = 5
) -> DataFrame:
    """Best stores of the period by revenue."""
    per_store = (
        between_dates(completed_sales(transactions), start, end)
        .groupBy("store_id")
        .agg(F.count("*").alias("transaction_count"), F.sum("total_amount").alias("revenue"))
    )
    best = per_store.join(stores.select("store_id", "store_name", "city", "region"), "store_id")
    return limited(best.orderBy(F.desc("revenue"), "store_id"), limit).select(
        "store_id", "store_name", "city", "region", "transaction_count", "revenue"
    )


def customer_spend(customers: DataFrame, transactions: DataFrame) -> DataFrame:
    """Rows and spend per customer, largest first, customers without sales included."""
    per_customer = (
        completed_sales(transactions)
        .groupBy("customer_id")
        .agg(F.count("*").alias("total_transactions"), F.sum("total_amount").alias("total_spent"))
    )
    shown = [
        c
        for c in ("customer_id", "name", "email", "phone", "city", "country", "created_at")
        if c in customers.columns
    ]
    return (
        customers.select(*shown)
        .join(per_customer, "customer_id", "left")
        .select(*shown, _or_zero("total_transactions"), _or_zero("total_spent"))
        .orderBy(F.desc("total_spent"), "customer_id")
    )


# Listings

DETAIL_COLUMNS = [
    "transaction_id",
    "transaction_date",
    "customer_name",
    "product_name",
    "category_name",
    "store_name",
    "quantity",
    "unit_price",
    "total_amount",
    "payment_method",
    "status",
]


def newest_first() -> list[Column]:
    return [F.desc("transaction_date"), F.asc("transaction_id")]


def with_dimensions(
    transactions: DataFrame, customers: DataFrame, products: DataFrame, stores: DataFrame
) -> DataFrame:
    """Customer, product and store names joined to transactions."""
    return (
        transactions.join(
            customers.select("customer_id", F.col("name").alias("customer_name")), "customer_id"
        )
        .join(products, "product_id")
        .join(stores.select("store_id", "store_name"), "store_id")
    )


def sales_rows(
    transactions: DataFrame,
    customers: DataFrame,
    products: DataFrame,
    stores: DataFrame,
    categories: DataFrame | None = None,
    *,
    start: Day | None = None,
    end: Day | None = None,
    store_id=None,
    category_id=None,
) -> DataFrame:
    """Every completed sale with its names, unordered."""
    sales = matching(between_dates(completed_sales(transactions), start, end), store_id=store_id)
    wanted = matching(with_category(products, categories), category_id=category_id)
    named = wanted.select("product_id", "product_name", "category_name")
    return with_dimensions(sales, customers, named, stores).select(*DETAIL_COLUMNS)


def sales_detail(
    transactions: DataFrame,
    customers: DataFrame,
    products: DataFrame,
    stores: DataFrame,
    categories: DataFrame | None = None,
    *,
    start: Day | None = None,
    end: Day | None = None,
    store_id=None,
    category_id=None,
    limit: int | None = LISTING_LIMIT,
    enforced_keys: bool = True,
) -> DataFrame:
    """The newest completed sales with their names; all of them for ``limit=None``.

    The schema makes every foreign key of a transaction mandatory and enforced, so the newest rows
    can be chosen before the dimensions are joined: the joins then see ``limit`` rows. Pass
    ``enforced_keys=False`` for data that does not pass the foreign-key check. A category filter
    needs the products, which are then joined first.
    """
    options = {"start": start, "end": end, "store_id": store_id}
    if enforced_keys:
        newest = matching(between_dates(completed_sales(transactions), start, end), store_id=store_id)
        if category_id is not None:
            of_category = matching(products, category_id=category_id).select("product_id")
            newest = newest.join(of_category, "product_id", "left_semi")
        transactions = newest if limit is None else limited(newest.orderBy(*newest_first()), limit)
        options = {}
    rows = sales_rows(transactions, customers, products, stores, categories, category_id=category_id, **options)
    return limited(rows.orderBy(*newest_first()), limit)


def sales_page_summary(sales: DataFrame) -> DataFrame:
    """Revenue, rows, units and average of a whole listing; zeros for an empty one."""
    return sales.agg(
        F.coalesce(F.sum("total_amount"), F.lit(0)).alias("revenue"),
        F.count("*").alias("sales"),
        F.coalesce(F.sum("quantity"), F.lit(0)).alias("units"),
        F.coalesce(average(F.sum("total_amount"), F.count("*")), F.lit(0.0)).alias("average"),
    )


def top_products_by_name(sales: DataFrame, limit: int | None = 8) -> DataFrame:
    """Revenue per product name of a whole listing."""
    per_name = sales.groupBy("product_name").agg(F.sum("total_amount").alias("revenue"))
    return limited(per_name.orderBy(F.desc("revenue"), "product_name"), limit)


def employee_directory(employees: DataFrame, stores: DataFrame) -> DataFrame:
    """Employees with their store, ordered by name; keeps store_id for filtering."""
    return (
        employees.join(stores.select("store_id", "store_name"), "store_id")
        .select("employee_id", "name", "role", "store_id", "store_name")
        .orderBy("name", "employee_id")
    )
