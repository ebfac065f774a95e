"""Streams run over the test tables until everything available is processed."""

from __future__ import annotations

from pyspark.sql import functions as F

from depotwise.plans.reports import Inputs, Report
from depotwise.session import work_path
from depotwise.sources.star import star_domain
from depotwise.streaming import live, sinks


def _streamed(x: Inputs, *tables: str):
    return star_domain(x.spark, x.root, streamed=tables)


def _updates(x: Inputs, stream, name: str, keys: list[str], settings: dict[str, str] | None = None):
    out = sinks.run_available(stream, name, "update", settings=settings)
    return sinks.latest_per_key(sinks.read_batches(x.spark, out, stream.schema), keys)


def _live_clicks(x: Inputs):
    stream = live.live_click_counts(_streamed(x, "events")["click"], x.domain["tracking_link"])
    return _updates(x, stream, "live-clicks", ["link_id", "platform", "country"])


def _windowed_clicks(x: Inputs):
    stream = live.windowed_click_counts(_streamed(x, "events")["click"])
    return _updates(x, stream, "windowed-clicks", ["window_start", "link_id"])


def _distinct_clicks(x: Inputs):
    clicks = _streamed(x, "events")["click"]
    stream = live.without_repeats(clicks.union(clicks))
    out = sinks.run_available(stream, "distinct-clicks", "append")
    return sinks.read_batches(x.spark, out, stream.schema).select("click_id", "link_id", "click_time")


def _current_status(x: Inputs):
    stream = live.current_shipment_status(_streamed(x, "orders")["shipment_status"])
    return _updates(x, stream, "shipment-status", ["shipment_id"]).drop("status_id")


def _open_status(x: Inputs):
    stream = live.open_shipment_status(_streamed(x, "orders")["shipment_status"])
    return _updates(x, stream, "open-shipments", ["shipment_id"], sinks.KEYED_STATE).drop("status_id")


def _stock_stream(x: Inputs):
    moved = lambda d: d["stock_transfer"].select(
        F.col("to_warehouse_id").alias("warehouse_id"), "product_id", F.col("quantity").cast("bigint").alias("units")
    )
    schema = live.stock_deltas(moved(x.domain)).schema
    log = sinks.DeltaLog(x.spark, work_path(x.spark, "stock-deltas"), schema, live.stock_deltas)
    sinks.run_into(moved(_streamed(x, "lineitem")), log)
    return live.stock_balance(x.domain["inventory"], log.read())


def _audit_stream(x: Inputs):
    logged = _streamed(x, "events")["audit_log"].select(
        F.col("log_id").alias("change_id"), "table_name", F.lower("operation").alias("operation"), "record_id",
        F.col("log_time").alias("changed_at"),
    )
    stream = live.audit_trail(logged)
    out = sinks.run_available(stream, "audit", "append")
    return sinks.read_batches(x.spark, out, stream.schema).drop(sinks.BATCH)


REPORTS = {
    "stream_click_counts": Report(
        _live_clicks,
        """SELECT l.link_id, l.platform, coalesce(nullif(k.country, ''), 'Unknown') AS country, count(*) AS clicks
           FROM d_click AS k JOIN d_tracking_link AS l USING (link_id) GROUP BY 1, 2, 3""",
    ),
    "stream_click_windows": Report(
        _windowed_clicks,
        """SELECT date_trunc('hour', click_time) AS window_start, link_id, count(*) AS clicks FROM d_click GROUP BY 1, 2""",
    ),
    "stream_distinct_clicks": Report(_distinct_clicks, "SELECT click_id, link_id, click_time FROM d_click"),
    "stream_shipment_status": Report(
        _current_status, "SELECT shipment_id, updated_time, status, location FROM s_latest"
    ),
    "stream_open_shipments": Report(_open_status, "SELECT shipment_id, updated_time, status, location FROM s_latest"),
    "stream_stock_balance": Report(
        _stock_stream,
        """SELECT warehouse_id, product_id, sum(units)::BIGINT AS quantity FROM (
             SELECT warehouse_id, product_id, quantity AS units FROM d_inventory
             UNION ALL SELECT to_warehouse_id, product_id, quantity FROM d_stock_transfer) AS q GROUP BY 1, 2""",
    ),
    "stream_audit_trail": Report(_audit_stream, "SELECT * FROM d_audit_log"),
}
