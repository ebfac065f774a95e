"""Streams over several micro-batches give what the batch report gives, also after a replay."""

import datetime as dt

from fixture import rows
from pyspark.sql import functions as F

from depotwise.operators import shipping
from depotwise.policy import SHIPMENT_LIFECYCLE
from depotwise.schema import TABLES
from depotwise.session import work_path
from depotwise.streaming import live, sinks


MOVES = "warehouse_id long, product_id long, units long"


def stream_of(spark, df, table, files=4):
    """The rows of a table as a stream of several small batches."""
    path = work_path(spark, f"stream-{table}")
    df.repartition(files, df.columns[0]).write.parquet(path)
    return live.table_stream(spark, path, table, files_per_batch=1)


def test_click_counts(spark, seed):
    stream = live.live_click_counts(stream_of(spark, seed["click"], "click"), seed["tracking_link"])
    out = sinks.run_available(stream, "clicks", "update")
    got = sinks.latest_per_key(sinks.read_batches(spark, out, stream.schema), ["link_id", "platform", "country"])
    assert rows(got, "link_id", "country", "clicks") == rows(live.live_click_counts(seed["click"], seed["tracking_link"]), "link_id", "country", "clicks")


def test_click_windows_and_repeats(spark, seed):
    twice = seed["click"].unionByName(seed["click"])
    distinct = live.without_repeats(stream_of(spark, twice, "click", 1), "30 days")
    out = sinks.run_available(distinct, "distinct", "append")
    assert sinks.read_batches(spark, out, distinct.schema).count() == 14
    windows = live.windowed_click_counts(stream_of(spark, seed["click"], "click"), "1 day", "30 days")
    out = sinks.run_available(windows, "windows", "update")
    got = sinks.latest_per_key(sinks.read_batches(spark, out, windows.schema), ["window_start", "link_id"])
    want = seed["click"].groupBy(F.date_trunc("day", "click_time").cast("timestamp_ntz"), "link_id").count()
    assert rows(got) == rows(want)


def test_current_status(spark, seed):
    stream = live.current_shipment_status(stream_of(spark, seed["shipment_status"], "shipment_status"))
    out = sinks.run_available(stream, "status", "update")
    got = sinks.latest_per_key(sinks.read_batches(spark, out, stream.schema), ["shipment_id"])
    assert rows(got, "shipment_id", "status") == rows(shipping.latest_status(seed), "shipment_id", "status")


def test_stock_balance_counts_a_replayed_batch_once(spark, seed):
    out = work_path(spark, "deltas")
    moves = seed["inventory"].select("warehouse_id", "product_id", F.col("quantity").alias("units"))
    write = sinks.batch_folder_writer(out, live.stock_deltas)
    for batch_id in (0, 1, 1):
        write(moves, batch_id)
    deltas = sinks.read_batches(spark, out, live.stock_deltas(moves).schema)
    got = live.stock_balance(seed["inventory"], deltas)
    assert rows(got, "warehouse_id", "product_id", "quantity") == rows(
        seed["inventory"].select("warehouse_id", "product_id", F.col("quantity").cast("long") * 3)
    )


def test_audit_trail(spark, seed):
    changes = spark.createDataFrame([(1, "order", "insert", 5), (2, "order", "delete", 5)], "change_id long, table_name string, operation string, record_id long")
    rows_ = live.audit_trail(changes.withColumn("changed_at", F.current_timestamp().cast("timestamp_ntz")))
    assert rows(rows_, "log_id", "operation") == [(1, "INSERT"), (2, "DELETE")]


def test_delivered_shipments_leave_the_state(spark):
    """Forty shipments, one delivered each day: the state holds those on the way and what may still be late."""
    at = lambda day: dt.datetime(2026, 1, 1) + dt.timedelta(days=day)
    rows_ = [(i * 4 + step, i, None, name, at(i + step / 4)) for i in range(40) for step, name in enumerate(SHIPMENT_LIFECYCLE)]
    rows_ = [r for r in rows_ if r[1] != 7 or r[3] != "Delivered"]  # one that never arrives
    path = work_path(spark, "stream-deliveries")
    for day in range(0, 41, 2):
        some = [r for r in rows_ if at(day) <= r[4] < at(day + 2)]
        spark.createDataFrame(some, TABLES["shipment_status"].struct).coalesce(1).write.mode("append").parquet(path) if some else None
    stream = live.open_shipment_status(live.table_stream(spark, path, "shipment_status", files_per_batch=1), "2 days")
    out = work_path(spark, "deliveries")
    query = sinks.start(stream, out, "update")
    query.awaitTermination()
    sizes = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    got = sinks.latest_per_key(sinks.read_batches(spark, out, stream.schema), ["shipment_id"])
    assert {r.shipment_id: r.status for r in got.collect()} == {i: "Delivered" if i != 7 else "Out For Delivery" for i in range(40)}
    assert len(sizes) > 10 and max(sizes) < 40 and sizes[-1] < 20


def test_open_shipments_run_in_a_session_with_another_state_store(spark):
    """Three shipments of two groups, late and repeated rows; the session's own settings stay."""
    other = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
    mine = spark.conf.get(sinks.STATE_STORE)
    at = lambda hour: dt.datetime(2026, 1, 1) + dt.timedelta(hours=hour)
    path = work_path(spark, "stream-open")
    for batch in (
        [(1, 1, None, "Packed", at(0)), (2, 2, "A", "Packed", at(1))],
        [(4, 1, "B", "Delivered", at(4)), (3, 1, "B", "Shipped", at(2)), (5, 5000, "C", "Packed", at(3)), (2, 2, "A", "Packed", at(1))],
    ):
        spark.createDataFrame(batch, TABLES["shipment_status"].struct).coalesce(1).write.mode("append").parquet(path)
    stream = live.open_shipment_status(live.table_stream(spark, path, "shipment_status", files_per_batch=1))
    spark.conf.set(sinks.STATE_STORE, other)
    try:
        out = sinks.run_available(stream, "open", "update", settings=sinks.KEYED_STATE)
        assert spark.conf.get(sinks.STATE_STORE) == other
    finally:
        spark.conf.set(sinks.STATE_STORE, mine)
    got = sinks.latest_per_key(sinks.read_batches(spark, out, stream.schema), ["shipment_id"])
    assert {(r.shipment_id, r.status_id, r.status, r.location, r.updated_time) for r in got.collect()} == {
        (1, 4, "Delivered", "B", at(4)), (2, 2, "Packed", "A", at(1)), (5000, 5, "Packed", "C", at(3)),
    }


def test_a_log_of_many_batches_reads_few_folders(spark):
    log = sinks.DeltaLog(spark, work_path(spark, "log"), live.stock_deltas(spark.createDataFrame([], MOVES)).schema, live.stock_deltas, every=3)
    total = 0
    for batch in range(11):
        for _ in range(2 if batch % 4 == 1 else 1):  # some batches are tried twice
            log.write(spark.createDataFrame([(1, 1, batch + 1), (1, batch % 2, 1)], MOVES), batch)
        total += batch + 1
        assert len(log._parts()) <= 4
    log.write(spark.createDataFrame([(1, 1, 999)], MOVES), 2)  # long merged
    assert log.mark() >= 7
    assert rows(log.read()) == [(1, 0, 6), (1, 1, total + 5)]
    # a merge that was cut off leaves the log as it was
    log._files.mkdirs(log._path("merged/upto=99"))
    assert log.mark() < 99 and rows(log.read()) == [(1, 0, 6), (1, 1, total + 5)]
