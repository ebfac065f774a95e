"""Orders from request to shipment as one job: prices, stock, attribution, shipments with their first status.

An order is placed as a whole or not at all. Requests take turns by arrival (requested_at, request_id), and the lines
of a request by line_no; each line is routed with what earlier ones have left."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depotwise.functions.numbering import highest, number_rows
from depotwise.operators.allocation import serve_orders
from depotwise.operators.mutations import apply_deltas, create_shipments, first_reason, stamp_hub
from depotwise.operators.stock import STOCK_KEY, Moment
from depotwise.policy import SHIPMENT_LIFECYCLE, AgePolicy
from depotwise.session import materialise
from depotwise.sources.domain import Domain


@dataclass(frozen=True)
class Checkout:
    """Rows to append to each table, the next inventory, (key, reason) of the requests that got no order, and
    the hub that each item is taken from (order_id, order_item_id, warehouse_id, product_id, quantity)."""

    orders: DataFrame
    items: DataFrame
    attributions: DataFrame
    shipments: DataFrame
    statuses: DataFrame
    inventory: DataFrame
    rejected: DataFrame
    picked: DataFrame


def _checked(d: Domain, requests: DataFrame, lines: DataFrame) -> DataFrame:
    """The requests with the first thing that is wrong with them or one of their lines."""
    products = d["product"].select("product_id", F.lit(True).alias("_product"))
    bad = first_reason(
        (F.col("_product").isNull(), "unknown product"),
        (F.col("quantity").isNull() | (F.col("quantity") <= 0), "quantity not positive"),
        (F.col("line_no").isNull(), "no line number"),
    )
    per_request = lines.join(products, "product_id", "left").groupBy("request_id").agg(
        F.min(F.when(bad.isNotNull(), F.struct("line_no", bad.alias("reason")))).alias("_bad"),
        F.count(F.lit(1)).alias("_lines"), F.count_distinct("line_no").alias("_places"),
    )
    customers = d["customer"].select("customer_id", F.lit(True).alias("_customer"))
    links = d["tracking_link"].select("link_id", F.lit(True).alias("_link"))
    times = requests.groupBy("request_id").agg(F.count(F.lit(1)).alias("_times"))
    joined = (
        requests.select("request_id", "customer_id", "link_id", "requested_at")
        .join(times, "request_id", "left")
        .join(per_request, "request_id", "left")
        .join(customers, "customer_id", "left")
        .join(links, "link_id", "left")
    )
    reason = F.coalesce(
        first_reason(
            (F.col("request_id").isNull(), "no request id"),
            (F.col("_times") > 1, "request id not unique"),
            (F.col("_lines").isNull(), "no lines"),
            (F.col("_lines") > F.col("_places"), "line number not unique"),
        ),
        F.col("_bad.reason"),
        first_reason(
            (F.col("_customer").isNull(), "unknown customer"),
            (F.col("link_id").isNotNull() & F.col("_link").isNull(), "unknown link"),
            (F.col("requested_at").isNull(), "no time"),
        ),
    )
    return joined.select("request_id", "customer_id", "link_id", "requested_at", reason.alias("reason"))


def checkout(d: Domain, requests: DataFrame, lines: DataFrame, as_of: Moment, policy: AgePolicy = AgePolicy()) -> Checkout:
    """Place ``requests`` (request_id, customer_id, link_id?, requested_at) with their ``lines`` (request_id, line_no,
    product_id, quantity), with stock aged at ``as_of``. A request whose lines don't all find a hub that holds
    them is rejected with the reason of its first such line, and leaves the stock to later ones. Order numbers follow
    arrival, item numbers orders and lines."""
    checked = materialise(_checked(d, requests, lines), "checked-requests")
    sound = checked.where(F.col("reason").isNull()).drop("reason")
    asked = lines.join(sound.select("request_id", "requested_at"), "request_id")
    served = serve_orders(
        d,
        asked.select(
            F.col("request_id").alias("order_id"), F.col("line_no").alias("order_item_id"), "product_id", "quantity",
            F.col("requested_at").alias("order_date"),
        ),
        as_of, policy,
    )
    served = materialise(served.select(F.col("order_id").alias("request_id"), F.col("order_item_id").alias("line_no"), "product_id", "quantity", "warehouse_id", "reason"), "served-lines")
    failed = (
        served.where(F.col("reason").isNotNull())
        .groupBy("request_id")
        .agg(F.min(F.struct("line_no", "reason")).alias("first"))
        .select("request_id", F.col("first.reason").alias("reason"))
    )
    failed = materialise(failed, "failed-requests")
    rejected = checked.where(F.col("reason").isNotNull()).select("request_id", "reason").unionByName(failed)

    granted = sound.join(failed, "request_id", "left_anti")
    placed = materialise(number_rows(granted, ["requested_at", "request_id"], highest(d["order"], "order_id"), "order_id"), "placed-orders")
    prices = d["product"].select("product_id", F.col("price").alias("unit_price"))
    shipped = served.join(placed.select("request_id", "order_id"), "request_id")
    shipped = materialise(
        number_rows(shipped, ["order_id", "line_no"], highest(d["order_item"], "order_item_id"), "order_item_id").join(prices, "product_id"), "shipped-items"
    )
    through = number_rows(placed.where(F.col("link_id").isNotNull()), ["order_id"], highest(d["order_attribution"], "attribution_id"), "attribution_id")
    orders = placed.select("order_id", "customer_id", F.col("requested_at").alias("order_date"), F.lit("PLACED").alias("status"))
    made = create_shipments(d, orders)
    hubs = made.shipments.select("shipment_id", "order_id").join(stamp_hub(shipped, d["warehouse"]), "order_id").select("shipment_id", "source_hub")
    first = F.col("status") == SHIPMENT_LIFECYCLE[0]
    statuses = made.statuses.join(hubs, "shipment_id", "left").withColumn("location", F.when(first, F.col("source_hub")).otherwise(F.col("location")))
    return Checkout(
        orders=orders,
        items=shipped.select("order_item_id", "order_id", "product_id", "quantity", "unit_price"),
        attributions=through.select("attribution_id", "order_id", "link_id", F.col("requested_at").alias("attributed_time")),
        shipments=made.shipments,
        statuses=statuses.select(made.statuses.columns),
        inventory=apply_deltas(d["inventory"], shipped.groupBy(*STOCK_KEY).agg((-F.sum("quantity")).alias("units"))),
        rejected=rejected.select(F.col("request_id").alias("key"), "reason"),
        picked=shipped.select("order_id", "order_item_id", *STOCK_KEY, "quantity"),
    )
