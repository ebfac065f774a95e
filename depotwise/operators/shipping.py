"""Shipments: latest status, board, timeline, pending report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depotwise.functions import columns as C
from depotwise.operators import tables
from depotwise.operators.stock import Moment
from depotwise.policy import SHIPMENT_LIFECYCLE, UNKNOWN
from depotwise.sources.domain import Domain


def latest_status(d: Domain, shipments: DataFrame | None = None) -> DataFrame:
    """Newest status row per shipment; among equal times the higher id wins. A maximum over a struct
    combines before the shuffle, where a row number would sort every shipment's history."""
    history = d["shipment_status"]
    if shipments is not None:
        history = history.join(shipments, "shipment_id", "left_semi")
    newest = F.max(F.struct("updated_time", "status_id", "status", "location")).alias("newest")
    return (
        history.groupBy("shipment_id")
        .agg(newest)
        .select("shipment_id", "newest.status", "newest.location", "newest.updated_time")
    )


def pending_shipments(d: Domain, as_of: Moment) -> DataFrame:
    """Shipments without a final status and how many whole days they have been under way."""
    # distinct combines before the shuffle, so a shipment with very many rows is one row after it
    done = d["shipment_status"].where(F.col("status") == SHIPMENT_LIFECYCLE[-1]).select("shipment_id").distinct()
    return (
        d["shipment"]
        .join(done, "shipment_id", "left_anti")
        .select(
            "shipment_id", "tracking_code",
            C.whole_days("shipment_date", C.moment(as_of)).alias("days_pending"),
        )
    )


def shipment_board(d: Domain) -> DataFrame:
    """Every shipment with latest status, last change, board column and the next step."""
    owners = d["order"].join(d["customer"].select("customer_id", F.col("name").alias("customer_name")), "customer_id")
    return (
        d["shipment"]
        .join(latest_status(d), "shipment_id", "left")
        .join(owners.select("order_id", "customer_name"), "order_id", "left")
        .select(
            "shipment_id", "order_id", "tracking_code",
            F.coalesce("customer_name", F.lit(UNKNOWN)).alias("customer_name"), "status",
            F.coalesce("updated_time", "shipment_date").alias("updated_time"),
            C.shipment_bucket("status").alias("bucket"), C.next_status("status").alias("next_status"),
        )
    )


def shipment_timeline(d: Domain, codes: DataFrame | None = None) -> DataFrame:
    """Four lifecycle steps per shipment with the first time and place each was reached. One
    grouping per shipment finds all of them; the four fixed steps are then unfolded."""
    shipments = d["shipment"].select("shipment_id", "tracking_code")
    history = d["shipment_status"]
    if codes is not None:
        shipments = shipments.join(codes.select("tracking_code"), "tracking_code", "left_semi")
        history = history.join(shipments.select("shipment_id"), "shipment_id", "left_semi")
    event = F.struct("updated_time", "status_id", "status", "location")
    reached = history.groupBy("shipment_id").agg(
        F.max(event)["status"].alias("current"),
        *[F.min(F.when(F.col("status") == s, event)).alias(f"s{i}") for i, s in enumerate(SHIPMENT_LIFECYCLE)],
    )
    steps = F.array(
        *[
            F.struct(
                F.lit(i + 1).alias("position"),
                F.lit(s).alias("step"),
                F.col(f"s{i}.updated_time").alias("reached_at"),
                F.col(f"s{i}.location").alias("location"),
                F.when(F.col("current") == s, "current")
                .when(F.col(f"s{i}").isNotNull(), "done")
                .otherwise("")
                .alias("state"),
            )
            for i, s in enumerate(SHIPMENT_LIFECYCLE)
        ]
    )
    return shipments.join(reached, "shipment_id", "left").select("tracking_code", F.inline(steps))


def shipments_by_status(d: Domain) -> DataFrame:
    """Shipments per latest status, all four statuses present."""
    counts = latest_status(d).groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    domain = d["shipment_status"].sparkSession.createDataFrame(
        list(enumerate(SHIPMENT_LIFECYCLE, 1)), "position int, status string"
    )
    return domain.join(counts, "status", "left").select(
        "position", "status", F.coalesce("n", F.lit(0)).cast("bigint").alias("shipments")
    )


def recent_shipments(d: Domain, limit: int = 5) -> DataFrame:
    recent = tables.top(d["shipment"], limit, F.col("shipment_date").desc(), F.col("shipment_id").desc())
    return (
        recent.join(latest_status(d, recent.select("shipment_id")), "shipment_id", "left")
        .select("tracking_code", "order_id", "status", "shipment_date")
    )


def audit_search(d: Domain, table: str | None = None, operation: str | None = None, limit: int | None = None) -> DataFrame:
    """Entries of a table and operation; with ``limit`` the newest of them."""
    found = d["audit_log"]
    if table is not None:
        found = found.where(F.col("table_name") == table)
    if operation is not None:
        found = found.where(F.col("operation") == operation)
    return found if limit is None else tables.top(found, limit, F.col("log_time").desc(), F.col("log_id").desc())
