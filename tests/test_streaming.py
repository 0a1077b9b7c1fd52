from __future__ import annotations

import random
from pathlib import Path

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

import __spark_entry__ as contract
from aisle.catalog import streams
from aisle.operators import inventory
from aisle.operators.fraud import row_rule_flags
from aisle.sources.warehouse import Warehouse
from aisle.streaming import arrivals

COLUMNS = ["transaction_id", "customer_id", "product_id", "store_id", "quantity", "total_amount", "transaction_date", "status"]


def key(rows):
    return sorted(rows_of(rows, "transaction_id", "rule", "flag_reason", "severity"))


@pytest.fixture()
def sales(spark):
    rng = random.Random(3)
    rows = [
        (i, 0 if i % 3 == 0 else rng.randrange(1, 9), rng.randrange(1, 6), 1, rng.randrange(1, 40), rng.randrange(1, 9000),
         rng.randrange(0, 9000), "completed" if rng.random() < 0.8 else "pending")
        for i in range(240)
    ]
    df = spark.createDataFrame(rows, "transaction_id bigint, customer_id bigint, product_id bigint, store_id bigint, quantity int, amount int, at int, status string")
    ts = F.lit("2024-01-31 22:40:00").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("at"))
    return df.select("*", F.col("amount").cast("decimal(12,2)").alias("total_amount"), ts.alias("transaction_date")).select(*COLUMNS).persist()


def test_arrival_rules_at_their_limits(shop):
    found = key(arrivals.stream_row_rules(shop["transactions"]))
    assert [(t, r) for t, r, *_ in found] == [(2, "high_amount"), (2, "quantity"), (3, "late_night"), (14, "quantity")]
    assert found[1][2] == "Unusual quantity: 31 units in a single transaction"
    for key_limit in (None, 0):
        rapid = arrivals.rapid_arrivals(shop["transactions"], None, key_limit=key_limit)
        # only newcomers, whatever their own status; 10 follows 9, 11 follows 9 and not the pending 10
        assert sorted(rows_of(rapid, "transaction_id")) == [7, 10, 11]


def test_a_pending_row_does_not_make_others_rapid(shop):
    rows = shop["transactions"].filter("transaction_id IN (10, 11)")
    assert arrivals.rapid_arrivals(rows, None).count() == 0


def replay(sales, folder, batches, **options):
    write = arrivals.arrival_writer(str(folder), **options)
    for number, batch in enumerate(batches):
        write(batch, number)


@pytest.mark.skipif(not Path(contract.SMOKE_FOLDER).is_dir(), reason="the warehouse files are not here")
def test_registered_replays_take_several_batches(spark):
    folder = streams.replay(Warehouse(spark, contract.SMOKE_FOLDER), stock=False)
    batches = spark.read.parquet(f"{folder}/history").select("batch_id").distinct().count()
    assert batches >= streams.LEAST_BATCHES


def test_batches_equal_one_pass_and_repeats_change_nothing(spark, sales, shop, tmp_path):
    parts = [sales.filter(F.col("transaction_id").between(a, a + 79)) for a in (0, 80, 160)]
    replay(sales, tmp_path, parts)
    wanted = key(row_rule_flags(sales).unionByName(arrivals.rapid_arrivals(sales, None), allowMissingColumns=True))
    assert any(rule == "rapid" for _, rule, *_ in wanted)
    assert key(arrivals.arrival_flags(spark, str(tmp_path))) == wanted
    arrivals.arrival_writer(str(tmp_path))(parts[1], 1)
    arrivals.arrival_writer(str(tmp_path))(parts[2], 2)
    assert key(arrivals.arrival_flags(spark, str(tmp_path))) == wanted
    stored = arrivals.stock_after_arrivals(spark, str(tmp_path), shop["products"])
    direct = inventory.apply_sales_to_stock(shop["products"], sales)
    assert sorted(map(repr, stored.collect())) == sorted(map(repr, direct.collect()))
    log = arrivals.arrival_sale_log(spark, str(tmp_path))
    assert sorted(map(repr, log.collect())) == sorted(map(repr, inventory.sale_log(sales).collect()))


def test_late_rows_are_matched_against_everything_stored(spark, sales, tmp_path):
    """Rows arriving in reverse order of time: each is compared with all that came before it."""
    late = sales.withColumn("transaction_id", F.lit(239) - F.col("transaction_id"))
    parts = [late.filter(F.col("transaction_id").between(a, a + 119)) for a in (0, 120)]
    replay(late, tmp_path, parts, stock=False)
    wanted = sorted(rows_of(arrivals.rapid_arrivals(late, None), "transaction_id"))
    found = arrivals.arrival_flags(spark, str(tmp_path)).filter("rule = 'rapid'")
    assert sorted(rows_of(found, "transaction_id")) == wanted


def test_empty_batch(spark, sales, tmp_path):
    replay(sales, tmp_path, [sales.limit(0), sales.limit(10)])
    assert arrivals.arrival_flags(spark, str(tmp_path)).count() >= 0


def test_stream_over_files(spark, sales, tmp_path):
    for number, start in enumerate((0, 80, 160)):
        part = sales.filter(F.col("transaction_id").between(start, start + 79))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(sales.schema).parquet(str(tmp_path / "in"))
        arrivals.start_arrivals(stream, str(tmp_path / "out")).awaitTermination()
    flags = arrivals.arrival_flags(spark, str(tmp_path / "out"))
    wanted = row_rule_flags(sales).unionByName(arrivals.rapid_arrivals(sales, None), allowMissingColumns=True)
    assert key(flags) == key(wanted)
    history = spark.read.parquet(str(tmp_path / "out" / "history"))
    assert history.count() == 240 and history.select("batch_id").distinct().count() == 3


def test_row_rules_on_a_plain_stream(spark, sales, tmp_path):
    sales.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(sales.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    query = (
        arrivals.stream_row_rules(stream)
        .writeStream.format("memory").queryName("row_rules").outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert key(spark.table("row_rules")) == key(arrivals.stream_row_rules(sales))
