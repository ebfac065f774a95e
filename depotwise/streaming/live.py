"""Continuous versions of the live reports. Each takes a streaming DataFrame (or a batch one, with
the same result) and returns the transformed one; ``sinks`` runs them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from depotwise.functions import columns as C
from depotwise.operators.stock import STOCK_KEY
from depotwise.policy import LIVE_REFRESH, SHIPMENT_LIFECYCLE, UNKNOWN
from depotwise.schema import TABLES
from depotwise.sources.domain import conform

LIVE_TRIGGER = {"processingTime": LIVE_REFRESH}


def table_stream(spark: SparkSession, path: str, table: str, files_per_batch: int | None = None) -> DataFrame:
    """New files of a domain table as a stream."""
    reader = spark.readStream.schema(TABLES[table].struct)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def live_click_counts(clicks: DataFrame, links: DataFrame) -> DataFrame:
    """Running clicks per link, platform and country (update mode). The links are a static side,
    read again with each batch; state holds one counter per group."""
    named = clicks.join(links.select("link_id", "platform"), "link_id")
    return named.groupBy("link_id", "platform", C.known("country", UNKNOWN).alias("country")).agg(
        F.count(F.lit(1)).alias("clicks")
    )


def _event_time(clicks: DataFrame, lateness: str) -> DataFrame:
    """Watermarks need a zoned time; sessions run in UTC, so the instant keeps its wall-clock value."""
    return clicks.withColumn("event_time", F.col("click_time").cast("timestamp")).withWatermark("event_time", lateness)


def windowed_click_counts(clicks: DataFrame, width: str = "1 hour", lateness: str = "2 hours") -> DataFrame:
    """Clicks per link and event-time window. Windows older than the lateness bound are final and
    leave the state."""
    return (
        _event_time(clicks, lateness)
        .groupBy(F.window("event_time", width).alias("w"), "link_id")
        .agg(F.count(F.lit(1)).alias("clicks"))
        .select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "link_id", "clicks")
    )


def without_repeats(clicks: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Clicks delivered more than once within the lateness bound, once."""
    return _event_time(clicks, lateness).dropDuplicatesWithinWatermark(["click_id"]).drop("event_time")


def current_shipment_status(statuses: DataFrame) -> DataFrame:
    """Newest status per shipment (update mode): the state is one (time, id, status) per shipment,
    and out-of-order events cannot set a shipment back."""
    newest = F.max(F.struct("updated_time", "status_id", "status", "location")).alias("newest")
    return (
        statuses.groupBy("shipment_id")
        .agg(newest)
        .select("shipment_id", "newest.updated_time", "newest.status_id", "newest.status", "newest.location")
    )


TOGETHER = 1024  # shipments with neighbouring ids whose state is one row of lists, so that the worker is asked once for all of them
NOTHING = -(1 << 63)  # stands for a missing number, below all others
STATUS = "shipment_id bigint, at bigint, status_id bigint, status string, location string"
STATUS_NAMES = [part.split()[0] for part in STATUS.split(", ")]
STATUS_LISTS = ", ".join("{} array<{}>".format(*part.split()) for part in STATUS.split(", "))


class _UntilDelivered(StatefulProcessor):
    """The newest statuses of up to TOGETHER shipments, each kept until it is delivered and nothing late can come for it
    any more. The timer is that of the first to go."""

    def __init__(self, lateness: pd.Timedelta):
        self.lateness = lateness // pd.Timedelta(1, "us")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", STATUS_LISTS)

    def _known(self) -> pd.DataFrame:
        return pd.DataFrame(dict(zip(STATUS_NAMES, self.open.get() or [[]] * len(STATUS_NAMES), strict=True)))

    def _keep(self, newest: pd.DataFrame) -> None:
        if len(newest):
            self.open.update(tuple(newest[c].astype(object).where(newest[c].notna(), None).tolist() for c in STATUS_NAMES))
        else:
            self.open.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        ended = newest.loc[newest["status"] == SHIPMENT_LIFECYCLE[-1], "at"]
        if len(ended):
            self.handle.registerTimer((int(ended.min()) + self.lateness) // 1000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = self._known()
        every = pd.concat([part[STATUS_NAMES] for part in rows] + [known] * (len(known) > 0), ignore_index=True)
        every["fresh"] = every.index < len(every) - len(known)
        # of equals the last stays, which is what is known already
        newest = every.sort_values(["at", "status_id"], kind="stable").drop_duplicates("shipment_id", keep="last")
        fresh = newest.loc[newest["fresh"], STATUS_NAMES]
        if len(fresh):
            self._keep(newest[STATUS_NAMES])
            yield fresh

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        known = self._known()
        over = (known["at"] + self.lateness) // 1000 <= expiredTimerInfo.getExpiryTimeInMs()
        self._keep(known[~((known["status"] == SHIPMENT_LIFECYCLE[-1]) & over)])
        yield from ()

    def close(self) -> None:
        pass


def open_shipment_status(statuses: DataFrame, lateness: str = "2 days") -> DataFrame:
    """Like ``current_shipment_status``, with a state that ends: a delivered shipment is dropped once events are
    `lateness` past its delivery, so the state holds open shipments only. Rows that come later than that are ignored.
    Needs ``sinks.KEYED_STATE``. The Python worker is asked once for TOGETHER ids and batch."""
    timed = statuses.select("shipment_id", F.col("updated_time").cast("timestamp").alias("updated_time"), "status_id", "status", "location")
    named = timed.withWatermark("updated_time", lateness).select(
        F.expr(f"shipment_id div {TOGETHER}").alias("group"), "shipment_id", "updated_time",
        F.coalesce(F.unix_micros("updated_time"), F.lit(NOTHING)).alias("at"), F.coalesce("status_id", F.lit(NOTHING)).alias("status_id"), "status", "location",
    )
    kept = named.groupBy("group").transformWithStateInPandas(
        statefulProcessor=_UntilDelivered(pd.Timedelta(lateness)), outputStructType=STATUS, outputMode="Update", timeMode="EventTime"
    )
    at, status_id = [F.nullif(c, F.lit(NOTHING)) for c in ("at", "status_id")]
    return kept.select("shipment_id", F.timestamp_micros(at).cast("timestamp_ntz").alias("updated_time"), status_id.alias("status_id"), "status", "location")


def stock_deltas(moves: DataFrame) -> DataFrame:
    """What one micro-batch of movements (warehouse_id, product_id, units) adds up to. Used as
    ``prepare`` of a sink: batches are logged as deltas, not as rewritten snapshots."""
    return moves.groupBy(*STOCK_KEY).agg(F.sum("units").cast("bigint").alias("units"))


def stock_balance(opening: DataFrame, deltas: DataFrame) -> DataFrame:
    """Stock after the opening snapshot and all logged batches. Each batch folder counts once however
    often the batch was retried."""
    start = opening.select(*STOCK_KEY, F.col("quantity").cast("bigint").alias("units"))
    return (
        start.unionByName(deltas.select(*STOCK_KEY, "units"))
        .groupBy(*STOCK_KEY)
        .agg(F.sum("units").alias("quantity"))
    )


def audit_trail(changes: DataFrame) -> DataFrame:
    """Change-feed rows (change_id, table_name, operation, record_id, changed_at) as audit rows, one
    per change."""
    rows = changes.select(
        F.col("change_id").alias("log_id"), "table_name", F.upper("operation").alias("operation"), "record_id",
        F.col("changed_at").alias("log_time"),
    )
    return conform(rows, "audit_log")
