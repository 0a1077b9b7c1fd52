from __future__ import annotations

import random
from decimal import Decimal

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from aisle.operators import fraud
from aisle.operators.fraud import Thresholds


def pairs(df) -> list[tuple]:
    return sorted(rows_of(df, "transaction_id", "rule"))


EXPECTED = [
    (2, "high_amount"),
    (2, "quantity"),
    (3, "late_night"),
    (6, "rapid"),
    (7, "rapid"),
    (9, "rapid"),
    (11, "rapid"),
]


def test_rules_at_their_limits(shop):
    tx, products = shop["transactions"], shop["products"]
    assert pairs(fraud.rule_high_amount(tx)) == [(2, "high_amount")]
    assert pairs(fraud.rule_late_night(tx)) == [(3, "late_night")]
    assert pairs(fraud.rule_quantity(tx, products)) == [(2, "quantity")]
    for key_limit in (None, 0):
        assert pairs(fraud.rule_rapid(tx, key_limit=key_limit)) == [p for p in EXPECTED if p[1] == "rapid"]


def test_reasons_and_severities(shop):
    found = {(t, r): (reason, s) for t, r, reason, s in rows_of(fraud.detect_fraud(shop["transactions"], shop["products"]))}
    assert sorted(found) == EXPECTED
    assert found[2, "high_amount"] == ("High transaction amount: $5,000.01 exceeds $5000 threshold", "critical")
    assert found[2, "quantity"] == ('Unusual quantity: 31 units of "Kite" in single transaction', "medium")
    assert found[3, "late_night"] == ("Late-night high-value transaction: $1,500.00 at 04:59:59", "high")
    assert found[7, "rapid"] == (
        "Rapid successive transaction: customer #3 made multiple purchases within 60 seconds",
        "high",
    )


def test_stored_flags_are_not_repeated_and_second_run_adds_nothing(shop):
    tx, products, stored = shop["transactions"], shop["products"], shop["fraud_flags"]
    new = fraud.detect_fraud(tx, products, stored)
    assert pairs(new) == [p for p in EXPECTED if p not in [(2, "high_amount"), (3, "late_night")]]
    rows = fraud.flag_rows(new, stored)
    assert rows_of(rows.orderBy("flag_id"), "flag_id", "transaction_id")[0] == (4, 6)
    assert sorted(rows_of(rows, "flag_id")) == [4, 5, 6, 7, 8]
    again = fraud.detect_fraud(tx, products, stored.unionByName(rows))
    assert again.count() == 0


def test_counts_per_rule_and_total(shop):
    found = dict(rows_of(fraud.new_flag_count(fraud.detect_fraud(shop["transactions"], shop["products"]))))
    assert found == {"high_amount": 1, "quantity": 1, "late_night": 1, "rapid": 4, "total": 7}


def test_quantity_flag_needs_its_product(shop):
    known = shop["products"].filter("product_id <> 1")
    assert fraud.rule_quantity(shop["transactions"], known).count() == 0
    assert (2, "high_amount") in pairs(fraud.detect_fraud(shop["transactions"], known))


def test_stats_zero_and_null(shop, empty):
    found = fraud.fraud_stats(shop["fraud_flags"]).first().asDict()
    assert found == {
        "total_flagged": 3,
        "resolved_count": 1,
        "pending_count": 2,
        "critical_pending": 0,
        "high_pending": 1,
        "medium_pending": 0,
        "low_pending": 1,
    }
    nothing = fraud.fraud_stats(empty["fraud_flags"]).first()
    assert nothing["total_flagged"] == 0 and nothing["pending_count"] is None
    assert fraud.fraud_alert_level(shop["fraud_flags"]).first()["alert_level"] == "high"
    assert fraud.fraud_alert_level(empty["fraud_flags"]).first()["alert_level"] is None
    reopened = shop["fraud_flags"].withColumn("resolved", F.lit(0))
    assert fraud.fraud_alert_level(reopened).first()["alert_level"] == "critical"


def test_flags_by_severity_and_detail(shop):
    assert sorted(rows_of(fraud.flags_by_severity(shop["fraud_flags"]))) == [("critical", 1, 1), ("high", 0, 1), ("low", 0, 1)]
    detail = fraud.fraud_flag_detail(
        shop["fraud_flags"], shop["transactions"], shop["customers"], shop["products"], shop["stores"], resolved=0
    )
    assert rows_of(detail, "flag_id", "customer_name", "product_name", "store_name") == [
        (3, "Ben", "Blocks", "Shop North"),
        (2, "Ben", "Blocks", "Shop North"),
    ]


def analysis(shop, **options):
    return fraud.fraud_analysis(
        shop["transactions"], shop["fraud_flags"], shop["customers"], shop["products"], shop["stores"], **options
    )


@pytest.mark.parametrize("key_limit", [None, 100, 0])
def test_analysis_after_flags_repeats_flagged_rows(shop, key_limit):
    found = rows_of(
        analysis(shop, key_limit=key_limit).filter("customer_id = 2").orderBy("transaction_date", "flag_id"),
        "transaction_id", "flag_id", "seconds_since_last", "rolling_5tx_total", "tx_count_last_hour", "fraud_indicator",
    )
    assert found[:2] == [
        (3, 2, None, Decimal("1500.00"), 2, "LATE_NIGHT_HIGH_VALUE"),
        (3, 3, 0, Decimal("3000.00"), 2, "RAPID_SUCCESSION"),
    ]
    assert len(found) == 4 and found[2][4] == 1


@pytest.mark.parametrize("key_limit", [None, 0])
def test_analysis_before_flags_is_clean(shop, key_limit):
    rows = analysis(shop, windows="before_flags", key_limit=key_limit)
    found = {(r["transaction_id"], r["flag_id"]): r for r in rows.collect()}
    assert found[3, 2]["fraud_indicator"] == found[3, 3]["fraud_indicator"] == "LATE_NIGHT_HIGH_VALUE"
    assert found[2, 1]["fraud_indicator"] == "HIGH_AMOUNT"
    assert found[7, None]["seconds_since_last"] == 60 and found[7, None]["fraud_indicator"] == "RAPID_SUCCESSION"
    assert found[8, None]["seconds_since_last"] == 61 and found[8, None]["fraud_indicator"] == "NORMAL"
    assert found[10, None]["fraud_indicator"] == "RAPID_SUCCESSION"  # any status takes part
    assert len(found) == 15
    with pytest.raises(ValueError):
        analysis(shop, windows="sideways")


@pytest.mark.parametrize("seed", [1, 2])
def test_busy_customer_analysis_matches_plain_windows(spark, seed):
    """One customer with a third of all rows, many at the same instant: both forms agree."""
    rng = random.Random(seed)
    rows = [
        (i, 0 if i % 3 == 0 else rng.randrange(1, 20), rng.choice([0, 3600, rng.randrange(20_000)]), rng.randrange(1, 9))
        for i in range(900)
    ]
    tx = spark.createDataFrame(rows, "transaction_id bigint, customer_id bigint, at int, quantity int").select(
        "transaction_id",
        "customer_id",
        "quantity",
        (F.col("quantity") * 100).cast("decimal(12,2)").alias("total_amount"),
        (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("at"))).alias("transaction_date"),
        F.lit("cash").alias("payment_method"),
    )
    flags = tx.filter("transaction_id % 50 < 2").selectExpr(
        "transaction_id", "explode(array(1, 2)) AS flag_id", "'x' AS flag_reason", "'low' AS severity", "0 AS resolved"
    )
    people = spark.range(20).selectExpr("id AS customer_id", "'n' AS name")
    plain = sorted(map(repr, fraud.fraud_analysis(tx, flags, people, key_limit=None).collect()))
    assert len(plain) > 900
    mixed = fraud.fraud_analysis(tx, flags, people, key_limit=100)
    assert sorted(map(repr, mixed.collect())) == plain
    spread = fraud.fraud_analysis(tx, flags, people, key_limit=0)
    assert sorted(map(repr, spread.collect())) == plain


def test_thresholds_are_parameters(shop):
    low = Thresholds(high_amount=1000, quantity=7, night_amount=500, night_hours=(0, 5), rapid_seconds=61)
    assert pairs(fraud.rule_high_amount(shop["transactions"], None, low))[0] == (1, "high_amount")
    assert (8, "rapid") in pairs(fraud.rule_rapid(shop["transactions"], None, low))
    assert (4, "late_night") in pairs(fraud.rule_late_night(shop["transactions"], None, low))
