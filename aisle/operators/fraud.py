"""Fraud rules over stored transactions, flag reports and the per-customer analysis view.

The rules that look at one row are tested in a single scan. The rapid-succession rule orders each
customer's sales in time and treats very large customers apart, see :mod:`aisle.plans.neighbours`.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aisle.functions.dates import clock_text, hour_between, seconds_between
from aisle.functions.labels import fraud_indicator
from aisle.functions.money import money_text
from aisle.operators.filters import completed_sales, matching
from aisle.plans.neighbours import rows_with_close_neighbour
from aisle.plans.positions import positions
from aisle.plans.sequences import plain_sequence, spread_sequence
from aisle.plans.sizes import KEY_ROWS, most_rows_per_key, split_hot
from aisle.session import materialise

HIGH_AMOUNT, RAPID, QUANTITY, LATE_NIGHT = "high_amount", "rapid", "quantity", "late_night"
RULES = (HIGH_AMOUNT, RAPID, QUANTITY, LATE_NIGHT)  # in the order their flags are stored

# Severities and the text a reason starts with, by which existing flags are matched.
SEVERITY = {HIGH_AMOUNT: "critical", RAPID: "high", QUANTITY: "medium", LATE_NIGHT: "high"}
PREFIX = {
    HIGH_AMOUNT: "High transaction amount",
    RAPID: "Rapid successive transaction",
    QUANTITY: "Unusual quantity",
    LATE_NIGHT: "Late-night high-value",
}


@dataclass(frozen=True)
class Thresholds:
    """Rule limits; a row must exceed an amount or quantity, seconds and hours are inclusive."""

    high_amount: int = 5000
    quantity: int = 30
    night_amount: int = 1000
    night_hours: tuple[int, int] = (0, 4)
    rapid_seconds: int = 60


DEFAULT = Thresholds()
FLAG_COLUMNS = ["transaction_id", "rule", "flag_reason", "severity"]


def rule_conditions(limits: Thresholds) -> dict[str, Column]:
    amount = F.col("total_amount")
    return {
        HIGH_AMOUNT: amount > limits.high_amount,
        QUANTITY: F.col("quantity") > limits.quantity,
        LATE_NIGHT: hour_between(F.col("transaction_date"), *limits.night_hours)
        & (amount > limits.night_amount),
    }


def reason_text(rule: str, limits: Thresholds, product_name: Column | None = None) -> Column:
    """The reason stored with a flag; the quantity text names the product when one is given."""
    amount = money_text(F.col("total_amount"))
    if rule == HIGH_AMOUNT:
        return F.concat(
            F.lit(f"{PREFIX[HIGH_AMOUNT]}: $"), amount, F.lit(f" exceeds ${limits.high_amount} threshold")
        )
    if rule == RAPID:
        return F.concat(
            F.lit(f"{PREFIX[RAPID]}: customer #"),
            F.col("customer_id").cast("string"),
            F.lit(f" made multiple purchases within {limits.rapid_seconds} seconds"),
        )
    if rule == LATE_NIGHT:
        at = clock_text(F.col("transaction_date"))
        return F.concat(F.lit(f"{PREFIX[LATE_NIGHT]} transaction: $"), amount, F.lit(" at "), at)
    start = F.concat(F.lit(f"{PREFIX[QUANTITY]}: "), F.col("quantity").cast("string"))
    if product_name is None:
        return F.concat(start, F.lit(" units in a single transaction"))
    return F.concat(start, F.lit(' units of "'), product_name, F.lit('" in single transaction'))


def row_rule_flags(
    transactions: DataFrame, limits: Thresholds = DEFAULT, rules: tuple[str, ...] = (HIGH_AMOUNT, QUANTITY, LATE_NIGHT)
) -> DataFrame:
    """Flags of the single-row rules: one scan, one output row per matching rule.

    No status check and no product text; FLAG_COLUMNS plus product_id and quantity.
    """
    conditions = {rule: test for rule, test in rule_conditions(limits).items() if rule in rules}
    any_rule = F.lit(False)
    for test in conditions.values():
        any_rule = any_rule | test
    found = F.array(
        *[
            F.when(
                test,
                F.struct(
                    F.lit(rule).alias("rule"),
                    reason_text(rule, limits).alias("flag_reason"),
                    F.lit(SEVERITY[rule]).alias("severity"),
                ),
            )
            for rule, test in conditions.items()
        ]
    )
    return (
        transactions.filter(any_rule)
        .select("transaction_id", "product_id", "quantity", F.explode(found).alias("flag"))
        .filter(F.col("flag").isNotNull())
        .select("transaction_id", "flag.*", "product_id", "quantity")
    )


def flag_rules(flags: DataFrame) -> DataFrame:
    """(transaction_id, rule) of stored flags, the rule read from the start of the reason."""
    rule = F.lit(None).cast("string")
    for name in reversed(RULES):
        rule = F.when(F.col("flag_reason").startswith(PREFIX[name]), name).otherwise(rule)
    return flags.select("transaction_id", rule.alias("rule")).filter(F.col("rule").isNotNull())


def not_yet_flagged(found: DataFrame, flags: DataFrame | None) -> DataFrame:
    if flags is None:
        return found
    return found.join(flag_rules(flags), ["transaction_id", "rule"], "left_anti")


def rule_high_amount(
    transactions: DataFrame, flags: DataFrame | None = None, limits: Thresholds = DEFAULT
) -> DataFrame:
    found = row_rule_flags(completed_sales(transactions), limits, (HIGH_AMOUNT,))
    return not_yet_flagged(found.select(*FLAG_COLUMNS), flags)


def rule_late_night(
    transactions: DataFrame, flags: DataFrame | None = None, limits: Thresholds = DEFAULT
) -> DataFrame:
    found = row_rule_flags(completed_sales(transactions), limits, (LATE_NIGHT,))
    return not_yet_flagged(found.select(*FLAG_COLUMNS), flags)


def rule_quantity(
    transactions: DataFrame, products: DataFrame, flags: DataFrame | None = None, limits: Thresholds = DEFAULT
) -> DataFrame:
    found = row_rule_flags(completed_sales(transactions), limits, (QUANTITY,))
    return not_yet_flagged(_name_products(found, products, limits), flags)


def rule_rapid(
    transactions: DataFrame,
    flags: DataFrame | None = None,
    limits: Thresholds = DEFAULT,
    key_limit: int | None = KEY_ROWS,
) -> DataFrame:
    """Every completed sale with another of the same customer within the rapid window."""
    sales = completed_sales(transactions).select("transaction_id", "customer_id", "transaction_date")
    close = rows_with_close_neighbour(
        sales, "customer_id", "transaction_date", limits.rapid_seconds, key_limit
    )
    found = close.select(
        "transaction_id",
        F.lit(RAPID).alias("rule"),
        reason_text(RAPID, limits).alias("flag_reason"),
        F.lit(SEVERITY[RAPID]).alias("severity"),
    )
    return not_yet_flagged(found, flags)


def _name_products(found: DataFrame, products: DataFrame, limits: Thresholds) -> DataFrame:
    """Put the product name into quantity reasons; such a flag needs its product to exist."""
    names = products.select("product_id", "product_name")
    reason = reason_text(QUANTITY, limits, F.col("product_name"))
    named = found.filter(F.col("rule") == QUANTITY).join(names.filter("product_name IS NOT NULL"), "product_id")
    others = found.filter(F.col("rule") != QUANTITY).select(*FLAG_COLUMNS)
    return others.unionByName(named.select("transaction_id", "rule", reason.alias("flag_reason"), "severity"))


def detect_fraud(
    transactions: DataFrame,
    products: DataFrame | None = None,
    flags: DataFrame | None = None,
    limits: Thresholds = DEFAULT,
) -> DataFrame:
    """New flags of all four rules over completed sales.

    A (transaction, rule) already in ``flags`` is not flagged again, so a second run adds nothing.
    Without ``products`` the quantity reason leaves the product out.
    """
    found = row_rule_flags(completed_sales(transactions), limits)
    found = found.select(*FLAG_COLUMNS) if products is None else _name_products(found, products, limits)
    return not_yet_flagged(found.unionByName(rule_rapid(transactions, None, limits)), flags)


def new_flag_count(new_flags: DataFrame) -> DataFrame:
    """Rows per rule and, under 'total', over all: 0 when nothing is new."""
    per_rule = new_flags.groupBy("rule").agg(F.count("*").alias("new_flags_inserted"))
    total = per_rule.agg(F.coalesce(F.sum("new_flags_inserted"), F.lit(0)).alias("new_flags_inserted"))
    return per_rule.unionByName(total.select(F.lit("total").alias("rule"), "new_flags_inserted"))


def flag_rows(new_flags: DataFrame, flags: DataFrame, flagged_at: Column | None = None) -> DataFrame:
    """New flags as rows to append: ids continue after the largest stored one.

    The flags are stored first, as detecting them again for every step of the numbering would cost
    more than writing them.
    """
    new_flags = materialise(new_flags)
    last = flags.agg(F.max("flag_id")).first()[0] or 0
    rank = F.array_position(F.array(*[F.lit(r) for r in RULES]), F.col("rule"))
    numbered = positions(
        new_flags.withColumn("rule_no", rank), [("rule_no", True), ("transaction_id", True)], []
    )
    return numbered.select(
        (F.col("row_no") + last).alias("flag_id"),
        "transaction_id",
        "flag_reason",
        (flagged_at if flagged_at is not None else F.localtimestamp()).alias("flagged_at"),
        "severity",
        F.lit(0).alias("resolved"),
    )


# Flag reports


def fraud_stats(flags: DataFrame) -> DataFrame:
    """Conditional counts; NULL, not zero, over an empty table except for the total."""

    def matches(test: Column) -> Column:
        return F.sum(F.when(test, 1).otherwise(0))

    open_flag = F.col("resolved") == 0
    return flags.agg(
        F.count("*").alias("total_flagged"),
        matches(F.col("resolved") == 1).alias("resolved_count"),
        matches(open_flag).alias("pending_count"),
        *[
            matches(open_flag & (F.col("severity") == level)).alias(f"{level}_pending")
            for level in ("critical", "high", "medium", "low")
        ],
    )


def fraud_alert_level(flags: DataFrame) -> DataFrame:
    """'critical' while critical flags are open, else 'high' while high ones are, else NULL."""
    return fraud_stats(flags).select(
        F.when(F.col("critical_pending") > 0, "critical")
        .when(F.col("high_pending") > 0, "high")
        .alias("alert_level"),
        F.coalesce("critical_pending", F.lit(0)).alias("critical_pending"),
        F.coalesce("high_pending", F.lit(0)).alias("high_pending"),
    )


def flags_by_severity(flags: DataFrame) -> DataFrame:
    return flags.groupBy("severity", "resolved").agg(F.count("*").alias("flags"))


def fraud_flag_detail(
    flags: DataFrame,
    transactions: DataFrame,
    customers: DataFrame,
    products: DataFrame | None = None,
    stores: DataFrame | None = None,
    *,
    severity: str | None = None,
    resolved: int | None = None,
) -> DataFrame:
    """Flags with their transaction and names, newest flag first."""
    sale = ["total_amount", "transaction_date", "payment_method", "quantity"]
    rows = matching(flags, severity=severity, resolved=resolved).join(
        transactions.select("transaction_id", "customer_id", "product_id", "store_id", *sale), "transaction_id"
    )
    return (
        _with_names(rows, customers, products, stores)
        .drop("customer_id", "product_id", "store_id")
        .orderBy(F.desc("flagged_at"), "flag_id")
    )


def _with_names(
    df: DataFrame, customers: DataFrame, products: DataFrame | None, stores: DataFrame | None
) -> DataFrame:
    """Inner joins to whichever dimensions exist for the data."""
    df = df.join(customers.select("customer_id", F.col("name").alias("customer_name")), "customer_id")
    if products is not None:
        df = df.join(products.select("product_id", "product_name"), "product_id")
    if stores is not None:
        df = df.join(stores.select("store_id", "store_name"), "store_id")
    return df


def fraud_analysis(
    transactions: DataFrame,
    flags: DataFrame,
    customers: DataFrame,
    products: DataFrame | None = None,
    stores: DataFrame | None = None,
    *,
    limits: Thresholds = DEFAULT,
    windows: str = "after_flags",
    key_limit: int | None = KEY_ROWS,
) -> DataFrame:
    """Each transaction with its flags and the customer's recent behaviour.

    The published view computes its windows after joining flags, so a transaction with two flags
    counts twice and its copy looks like an instant repeat; ``windows="before_flags"`` computes them
    over transactions alone. Customers above ``key_limit`` rows are windowed in segments; the two
    kinds part before any join, and names are joined last, where rows already lie by customer.
    """
    if windows not in ("after_flags", "before_flags"):
        raise ValueError("windows must be 'after_flags' or 'before_flags'")
    flag = flags.select("transaction_id", "flag_id", "flag_reason", "severity", "resolved")
    columns = ["transaction_id", "customer_id", "total_amount", "transaction_date", "payment_method", "quantity"]
    columns += ["product_id"] if products is not None else []
    columns += ["store_id"] if stores is not None else []
    tie_break = ["transaction_id", "flag_id"] if windows == "after_flags" else ["transaction_id"]
    if windows == "after_flags" and key_limit is not None:
        # a customer's rows after the join are at most this many times its transactions
        key_limit //= max(1, most_rows_per_key(flags, "transaction_id"))
    since_last = seconds_between(F.col("previous_ts"), F.col("transaction_date"))
    indicator = fraud_indicator(
        F.col("total_amount"),
        F.col("seconds_since_last"),
        F.col("quantity"),
        F.col("transaction_date"),
        high_amount=limits.high_amount,
        rapid_seconds=limits.rapid_seconds,
        high_quantity=limits.quantity,
        night_amount=limits.night_amount,
        night_hours=limits.night_hours,
    )

    def analysed(rows: DataFrame, sequence: Callable[..., DataFrame]) -> DataFrame:
        if windows == "after_flags":
            rows = rows.join(flag, "transaction_id", "left")
        rows = sequence(rows, "customer_id", "transaction_date", tie_break, "total_amount", rows=5, seconds=3600)
        rows = rows.withColumn("seconds_since_last", since_last).withColumn("fraud_indicator", indicator)
        if windows == "before_flags":
            rows = rows.join(flag, "transaction_id", "left")
        return _with_names(rows, customers, products, stores)

    ordinary, hot = split_hot(transactions.select(*columns), "customer_id", key_limit)
    result = analysed(ordinary, plain_sequence)
    if hot is not None:
        result = result.unionByName(analysed(hot, spread_sequence))
    return result.withColumnsRenamed(
        {
            "previous_ts": "prev_transaction_date",
            "previous_value": "prev_amount",
            "rolling_value": "rolling_5tx_total",
            "recent_rows": "tx_count_last_hour",
        }
    )
