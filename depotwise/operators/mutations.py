"""Writes as batch jobs: a snapshot and a batch of requests give the next snapshot.

Nothing is updated in place. Every function returns the rows to append or the whole next version of a
table, and requests that break a rule come back with the reason instead of aborting the batch."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depotwise.functions import columns as C
from depotwise.functions.numbering import highest, number_rows
from depotwise.functions.running import running, running_total
from depotwise.operators.acceptance import accepted_in_turn
from depotwise.operators.shipping import latest_status
from depotwise.operators.stock import STOCK_KEY, Moment, remaining_lots
from depotwise.policy import MULTIPLE_HUBS, PLATFORMS, SHIPMENT_LIFECYCLE
from depotwise.session import materialise
from depotwise.sources.domain import Domain


def first_reason(*rules: tuple[Column, str]) -> Column:
    """Reason of the first broken rule, null when all hold."""
    return F.coalesce(*[F.when(F.coalesce(broken, F.lit(False)), F.lit(reason)) for broken, reason in rules])


def _rejected(checked: DataFrame, key: str) -> DataFrame:
    return checked.where(F.col("reason").isNotNull()).select(F.col(key).alias("key"), "reason")


def _accepted(checked: DataFrame) -> DataFrame:
    return checked.where(F.col("reason").isNull()).drop("reason")


# ---- inventory ----------------------------------------------------------------------


def purchase_deltas(d: Domain, purchases: DataFrame) -> DataFrame:
    """Units that the items of some purchases bring in, per stock row."""
    hubs = purchases.select("purchase_id", "warehouse_id")
    return (
        d["purchase_item"].join(hubs, "purchase_id").groupBy(*STOCK_KEY).agg(F.sum("quantity").alias("units"))
    )


def apply_deltas(inventory: DataFrame, deltas: DataFrame) -> DataFrame:
    """Next inventory after signed ``units`` per (hub, product). Existing rows change, missing ones
    are created; both happen in one grouping, no join decides between update and insert."""
    old = inventory.select(*STOCK_KEY, "inventory_id", F.col("quantity").cast("bigint").alias("units"))
    moved = deltas.select(*STOCK_KEY, F.lit(None).cast("bigint").alias("inventory_id"), F.col("units").cast("bigint"))
    merged = old.unionByName(moved).groupBy(*STOCK_KEY).agg(
        F.max("inventory_id").alias("inventory_id"), F.sum("units").cast("int").alias("quantity")
    )
    known = merged.where(F.col("inventory_id").isNotNull())
    added = merged.where(F.col("inventory_id").isNull()).drop("inventory_id")
    numbered = number_rows(added, STOCK_KEY, highest(inventory, "inventory_id"), "inventory_id")
    columns = ["inventory_id", *STOCK_KEY, "quantity"]
    return known.select(columns).unionByName(numbered.select(columns))


def apply_purchases(d: Domain, purchases: DataFrame) -> DataFrame:
    """Inventory after the given purchases have arrived."""
    return apply_deltas(d["inventory"], purchase_deltas(d, purchases))


@dataclass(frozen=True)
class Arrivals:
    inventory: DataFrame
    received: DataFrame
    rejected: DataFrame


def receive_purchases(d: Domain, purchases: DataFrame) -> Arrivals:
    """Inventory after the given purchases have arrived, as far as their hubs have room. Purchases take turns
    by date and id; one is received as a whole or not at all, and a refused one takes no room. ``received``
    names (purchase_id) those that were; purchases without lines, or for a hub that is not known, bring nothing and are rejected."""
    hubs = d["warehouse"].select("warehouse_id", F.lit(True).alias("_hub"))
    totals = d["purchase_item"].join(purchases.select("purchase_id"), "purchase_id", "left_semi").groupBy("purchase_id").agg(F.sum("quantity").alias("units"))
    checked = purchases.join(totals, "purchase_id", "left").join(hubs, "warehouse_id", "left").withColumn(
        "reason", first_reason((F.col("units").isNull(), "purchase without lines"), (F.col("_hub").isNull(), "unknown hub"))
    )
    checked = materialise(checked.select("purchase_id", "warehouse_id", "purchase_date", "units", "reason"), "arrivals")
    turns = materialise(number_rows(_accepted(checked), ["purchase_date", "purchase_id"], F.lit(0), "turn"), "arrival-turns")
    entries = turns.select(
        F.col("turn").alias("request_id"), F.lit(1).alias("kind"), "warehouse_id", F.lit(None).cast("bigint").alias("product_id"), "units"
    )
    outcome = accepted_in_turn(entries, room_limits(d, "hub full")).withColumnRenamed("request_id", "turn")
    turns = materialise(turns.join(outcome, "turn"), "arrival-outcome")
    received = _accepted(turns).select("purchase_id", "warehouse_id")
    rejected = _rejected(checked, "purchase_id").unionByName(_rejected(turns, "purchase_id"))
    return Arrivals(apply_deltas(d["inventory"], purchase_deltas(d, received)), received.select("purchase_id"), rejected)


@dataclass(frozen=True)
class Reversal:
    inventory: DataFrame
    reversed_ids: DataFrame
    rejected: DataFrame
    purchases: DataFrame
    items: DataFrame


def stock_limits(d: Domain, reason: str) -> DataFrame:
    """What requests may take of each stock row."""
    return d["inventory"].select(
        F.lit(0).alias("kind"), *STOCK_KEY, F.col("quantity").cast("bigint").alias("room"), F.lit(reason).alias("reason")
    )


def room_limits(d: Domain, reason: str) -> DataFrame:
    """The free room of each hub."""
    used = d["inventory"].groupBy("warehouse_id").agg(F.sum("quantity").alias("used"))
    free = F.col("capacity_units").cast("bigint") - F.coalesce("used", F.lit(0))
    return d["warehouse"].join(used, "warehouse_id", "left").select(
        F.lit(1).alias("kind"), "warehouse_id", F.lit(None).cast("bigint").alias("product_id"), free.alias("room"), F.lit(reason).alias("reason")
    )


def reverse_purchases(d: Domain, ids: DataFrame) -> Reversal:
    """Undo purchases (purchase_id) in id order, each as a whole if the stock of all its lines is there at
    its turn; a refused one changes nothing. Ids without a purchase, or without lines, are rejected.
    ``purchases`` and ``items`` are the next tables, without what was reversed."""
    asked = ids.select("purchase_id").distinct()
    lines = (
        d["purchase_item"]
        .join(asked, "purchase_id", "left_semi")
        .join(d["purchase"].select("purchase_id", "warehouse_id"), "purchase_id")
        .groupBy("purchase_id", *STOCK_KEY)
        .agg(F.sum("quantity").alias("units"))
    )
    lines = materialise(lines, "reversal-lines")
    entries = lines.select(F.col("purchase_id").alias("request_id"), F.lit(0).alias("kind"), *STOCK_KEY, "units")
    outcome = materialise(accepted_in_turn(entries, stock_limits(d, "stock already sold or moved")), "reversal-outcome")
    reversed_ids = outcome.where(F.col("reason").isNull()).select(F.col("request_id").alias("purchase_id"))
    deltas = lines.join(reversed_ids, "purchase_id", "left_semi").select(*STOCK_KEY, (-F.col("units")).alias("units"))
    missing = (
        asked.join(lines.select("purchase_id").distinct(), "purchase_id", "left_anti")
        .join(d["purchase"].select("purchase_id", F.lit(True).alias("_known")), "purchase_id", "left")
        .select(
            F.col("purchase_id").alias("key"),
            F.when(F.col("_known"), "purchase without lines").otherwise("unknown purchase").alias("reason"),
        )
    )
    rejected = outcome.where(F.col("reason").isNotNull()).select(F.col("request_id").alias("key"), "reason").unionByName(missing)
    left = lambda name: d[name].join(reversed_ids, "purchase_id", "left_anti")
    return Reversal(apply_deltas(d["inventory"], deltas), reversed_ids, rejected, left("purchase"), left("purchase_item"))


# ---- placement -----------------------------------------------------------------------


@dataclass(frozen=True)
class OrderPlacement:
    orders: DataFrame
    items: DataFrame
    attributions: DataFrame
    rejected: DataFrame


def _numbered(requests: DataFrame, base: Column, out: str) -> DataFrame:
    return number_rows(requests, ["requested_at", "request_id"], base, out)


def place_orders(d: Domain, requests: DataFrame) -> OrderPlacement:
    """One single-line order per request (request_id, customer_id, link_id?, product_id, quantity,
    requested_at) at the product's current price; attributed when it came through a link. Order
    numbers follow arrival."""
    prices = d["product"].select("product_id", "price")
    customers = d["customer"].select("customer_id", F.lit(True).alias("_customer"))
    links = d["tracking_link"].select("link_id", F.lit(True).alias("_link"))
    checked = (
        requests.join(prices, "product_id", "left")
        .join(customers, "customer_id", "left")
        .join(links, "link_id", "left")
        .withColumn(
            "reason",
            first_reason(
                (F.col("price").isNull(), "unknown product"),
                (F.col("quantity").isNull() | (F.col("quantity") <= 0), "quantity not positive"),
                (F.col("_customer").isNull(), "unknown customer"),
                (F.col("link_id").isNotNull() & F.col("_link").isNull(), "unknown link"),
                (F.col("requested_at").isNull(), "no time"),
            ),
        )
    )
    checked = materialise(checked, "order-requests")
    placed = materialise(_numbered(_accepted(checked), highest(d["order"], "order_id"), "order_id"), "placed-orders")
    first_item = highest(d["order_item"], "order_item_id") - highest(d["order"], "order_id")
    first_attribution = highest(d["order_attribution"], "attribution_id") - highest(d["order"], "order_id")
    orders = placed.select("order_id", "customer_id", F.col("requested_at").alias("order_date"), F.lit("PLACED").alias("status"))
    items = placed.select(
        (F.col("order_id") + first_item).alias("order_item_id"), "order_id", "product_id", "quantity",
        F.col("price").alias("unit_price"),
    )
    attributions = placed.where(F.col("link_id").isNotNull()).select(
        (F.col("order_id") + first_attribution).alias("attribution_id"), "order_id", "link_id",
        F.col("requested_at").alias("attributed_time"),
    )
    return OrderPlacement(orders, items, attributions, _rejected(checked, "request_id"))


@dataclass(frozen=True)
class PurchasePlacement:
    purchases: DataFrame
    items: DataFrame
    rejected: DataFrame


def place_purchases(d: Domain, requests: DataFrame) -> PurchasePlacement:
    """One single-line purchase per request (request_id, supplier_id, warehouse_id, product_id,
    quantity, unit_cost, requested_at), if its hub has room for it at its turn. Turns and numbers
    follow arrival; a refused request takes no room."""
    owners = d["product"].select("product_id", F.col("supplier_id").alias("_owner"))
    hubs = d["warehouse"].select("warehouse_id", F.lit(True).alias("_hub"))
    checked = (
        requests.join(owners, "product_id", "left")
        .join(hubs, "warehouse_id", "left")
        .withColumn(
            "reason",
            first_reason(
                (F.col("_owner").isNull(), "unknown product"),
                (F.col("_hub").isNull(), "unknown hub"),
                (~F.col("_owner").eqNullSafe(F.col("supplier_id")), "product of another supplier"),
                (F.col("quantity").isNull() | (F.col("quantity") <= 0), "quantity not positive"),
                (F.col("unit_cost").isNull() | (F.col("unit_cost") < 0), "negative cost"),
                (F.col("requested_at").isNull(), "no time"),
            ),
        )
    )
    checked = materialise(checked, "purchase-requests")
    turns = materialise(_numbered(_accepted(checked), F.lit(0), "turn"), "purchase-turns")
    entries = turns.select(
        F.col("turn").alias("request_id"), F.lit(1).alias("kind"), "warehouse_id", F.lit(None).cast("bigint").alias("product_id"),
        F.col("quantity").cast("bigint").alias("units"),
    )
    outcome = accepted_in_turn(entries, room_limits(d, "hub full")).withColumnRenamed("request_id", "turn")
    turns = materialise(turns.join(outcome, "turn"), "purchase-outcome")
    placed = materialise(
        _numbered(_accepted(turns), highest(d["purchase"], "purchase_id"), "purchase_id"), "placed-purchases"
    )
    first_item = highest(d["purchase_item"], "purchase_item_id") - highest(d["purchase"], "purchase_id")
    purchases = placed.select(
        "purchase_id", "supplier_id", "warehouse_id", F.col("requested_at").alias("purchase_date")
    )
    items = placed.select(
        (F.col("purchase_id") + first_item).alias("purchase_item_id"), "purchase_id", "product_id", "quantity", "unit_cost"
    )
    return PurchasePlacement(purchases, items, _rejected(checked, "request_id").unionByName(_rejected(turns, "request_id")))


def place_purchase_orders(d: Domain, requests: DataFrame, lines: DataFrame) -> PurchasePlacement:
    """Purchases of any number of lines: requests (request_id, supplier_id, warehouse_id, requested_at), lines
    (request_id, line_no, product_id, quantity, unit_cost). A purchase is placed as a whole if all its lines are sound and its hub
    has room for all of them at its turn. The first thing that is wrong is the reason: of the request, then of its
    lines by number."""
    owners = d["product"].select("product_id", F.col("supplier_id").alias("_owner"))
    hubs = d["warehouse"].select("warehouse_id", F.lit(True).alias("_hub"))
    asked = lines.join(requests.select("request_id", "supplier_id"), "request_id").join(owners, "product_id", "left")
    bad = first_reason(
        (F.col("_owner").isNull(), "unknown product"),
        (~F.col("_owner").eqNullSafe(F.col("supplier_id")), "product of another supplier"),
        (F.col("quantity").isNull() | (F.col("quantity") <= 0), "quantity not positive"),
        (F.col("unit_cost").isNull() | (F.col("unit_cost") < 0), "negative cost"),
        (F.col("line_no").isNull(), "no line number"),
    )
    per_request = asked.groupBy("request_id").agg(
        F.min(F.when(bad.isNotNull(), F.struct("line_no", bad.alias("reason")))).alias("_bad"),
        F.sum(F.col("quantity").cast("bigint")).alias("units"),
    )
    times = requests.groupBy("request_id").agg(F.count(F.lit(1)).alias("_times"))
    checked = requests.join(times, "request_id", "left").join(per_request, "request_id", "left").join(hubs, "warehouse_id", "left").withColumn(
        "reason",
        F.coalesce(
            first_reason(
                (F.col("request_id").isNull(), "no request id"), (F.col("_times") > 1, "request id not unique"),
                (F.col("_hub").isNull(), "unknown hub"), (F.col("requested_at").isNull(), "no time"), (F.col("units").isNull() & F.col("_bad").isNull(), "no lines"),
            ),
            F.col("_bad.reason"),
        ),
    )
    checked = materialise(checked.select("request_id", "supplier_id", "warehouse_id", "requested_at", "units", "reason"), "purchase-requests")
    turns = materialise(_numbered(_accepted(checked), F.lit(0), "turn"), "purchase-turns")
    entries = turns.select(
        F.col("turn").alias("request_id"), F.lit(1).alias("kind"), "warehouse_id", F.lit(None).cast("bigint").alias("product_id"), "units"
    )
    outcome = accepted_in_turn(entries, room_limits(d, "hub full")).withColumnRenamed("request_id", "turn")
    turns = materialise(turns.join(outcome, "turn"), "purchase-outcome")
    placed = materialise(_numbered(_accepted(turns), highest(d["purchase"], "purchase_id"), "purchase_id"), "placed-purchases")
    kept = lines.join(placed.select("request_id", "purchase_id"), "request_id")
    items = number_rows(kept, ["purchase_id", "line_no"], highest(d["purchase_item"], "purchase_item_id"), "purchase_item_id")
    return PurchasePlacement(
        placed.select("purchase_id", "supplier_id", "warehouse_id", F.col("requested_at").alias("purchase_date")),
        items.select("purchase_item_id", "purchase_id", "product_id", "quantity", "unit_cost"),
        _rejected(checked, "request_id").unionByName(_rejected(turns, "request_id")),
    )


# ---- transfers -----------------------------------------------------------------------


@dataclass(frozen=True)
class Transfers:
    transfers: DataFrame
    inventory: DataFrame
    rejected: DataFrame


def overlaps(wanted: DataFrame, held: DataFrame, keys: list[str]) -> DataFrame:
    """Pieces (key columns, wanted, held, units) that the rows of two sides have in common when each side
    is laid end to end in its own order. Both have the key columns, `pos` (to order by), `units` and `data`
    (a struct that is passed on).

    Every row starts at the sum of the units before it. The starts of both sides are put in one order,
    each carries the last row of either side forward, and what the two share from there on is a piece: one
    row for each start and no join of the sides."""
    sides = []
    for side, rows in (("w", wanted), ("h", held)):
        at = running(rows, keys, ["pos"], {"hi": ("sum", "units")}).withColumn("lo", F.col("hi") - F.col("units"))
        own = F.struct("lo", "hi", "data")
        other = lambda name, side=side, own=own: (own if name == side else F.lit(None)).alias(name)
        sides.append(at.select(*keys, "lo", F.lit(side).alias("side"), other("w"), other("h")))
    typed = sides[0].unionByName(sides[1])
    carried = running(typed, keys, ["lo", "side"], {"last_w": ("max", "w"), "last_h": ("max", "h")})
    units = F.least("last_w.hi", "last_h.hi") - F.col("lo")
    carried = carried.where(F.col("last_w").isNotNull() & F.col("last_h").isNotNull())
    return carried.select(*keys, F.col("last_w.data").alias("wanted"), F.col("last_h.data").alias("held"), units.alias("units")).where("units > 0")


def transfer_stock(d: Domain, requests: DataFrame, as_of: Moment) -> Transfers:
    """Move stock between hubs (request_id, product_id, from_warehouse_id, to_warehouse_id,
    quantity). Requests are served in id order: one is granted if at its turn the source has the units
    and the destination the room, counting what granted requests before it took and brought; a refused
    one changes nothing. Each move takes the oldest lots of its source and every piece keeps its arrival
    date; units without a lot, and units that came in the same batch, start their age at ``as_of``."""
    source = ["warehouse_id", "product_id"]
    stock = d["inventory"].select(*STOCK_KEY, F.col("quantity").alias("on_hand"))
    hubs = d["warehouse"].select(F.col("warehouse_id").alias("to_warehouse_id"), F.lit(True).alias("_hub"))
    named = requests.withColumns(
        {"warehouse_id": F.col("from_warehouse_id"), "units": F.col("quantity").cast("bigint")}
    )
    arrivals = named.select(F.col("to_warehouse_id").alias("warehouse_id"), "product_id", F.lit(True).alias("_coming")).distinct()
    formed = (
        named.join(stock, source, "left")
        .join(arrivals, source, "left")
        .join(hubs, "to_warehouse_id", "left")
        .withColumn(
            "reason",
            first_reason(
                (F.col("units").isNull() | (F.col("units") <= 0), "quantity not positive"),
                (F.col("from_warehouse_id") == F.col("to_warehouse_id"), "same hub"),
                (F.col("on_hand").isNull() & F.col("_coming").isNull(), "no stock row"),
                (F.col("_hub").isNull(), "unknown hub"),
            ),
        )
    )
    formed = materialise(formed, "transfer-requests")
    fit = _accepted(formed)
    entry = lambda kind, hub, product, units: F.struct(
        F.lit(kind).alias("kind"), F.col(hub).cast("bigint").alias("warehouse_id"), product.cast("bigint").alias("product_id"), units.alias("units")
    )
    units, product, none = F.col("units"), F.col("product_id"), F.lit(None)
    entries = fit.select(
        "request_id",
        F.inline(
            F.array(
                entry(0, "from_warehouse_id", product, units), entry(0, "to_warehouse_id", product, -units),
                entry(1, "to_warehouse_id", none, units), entry(1, "from_warehouse_id", none, -units),
            )
        ),
    )
    # a stock row that only arrivals make has no units of its own
    bare = entries.where("kind = 0").select(*STOCK_KEY).distinct().join(stock, STOCK_KEY, "left_anti")
    limits = stock_limits(d, "not enough stock").unionByName(room_limits(d, "destination full")).unionByName(
        bare.select(F.lit(0).alias("kind"), *STOCK_KEY, F.lit(0).cast("bigint").alias("room"), F.lit("not enough stock").alias("reason"))
    )
    outcome = materialise(accepted_in_turn(entries, limits), "transfer-outcome")
    granted = fit.join(outcome.where(F.col("reason").isNull()).drop("reason"), "request_id").select("request_id", *source, "to_warehouse_id", "units")
    granted = materialise(granted, "transfer-granted")
    rejected = _rejected(formed, "request_id").unionByName(
        outcome.where(F.col("reason").isNotNull()).select(F.col("request_id").alias("key"), "reason")
    )

    lots = (
        remaining_lots(d)
        .join(granted.select(*source).distinct(), source, "left_semi")
        .groupBy(*source, "received_date")
        .agg(F.sum("units").alias("units"))
    )
    wanted = granted.select(*source, F.col("request_id").alias("pos"), "units", F.struct("request_id", "to_warehouse_id").alias("data"))
    held = lots.select(*source, F.col("received_date").alias("pos"), "units", F.struct("received_date").alias("data"))
    pieces = overlaps(wanted, held, source).select(
        F.col("wanted.request_id").alias("request_id"), *source, F.col("wanted.to_warehouse_id").alias("to_warehouse_id"),
        F.col("held.received_date").alias("received_date"), "units",
    )
    pieces = materialise(pieces, "transfer-pieces")
    dated = pieces.groupBy("request_id").agg(F.sum("units").alias("dated"))
    undated = (
        granted.join(dated, "request_id", "left")
        .withColumn("units", F.col("units") - F.coalesce("dated", F.lit(0)))
        .where(F.col("units") > 0)
        .select("request_id", *source, "to_warehouse_id", C.moment(as_of).alias("received_date"), "units")
    )
    numbered = number_rows(
        pieces.unionByName(undated), ["request_id", "received_date"], highest(d["stock_transfer"], "transfer_id"), "transfer_id"
    )
    transfers = numbered.select(
        "transfer_id", F.col("warehouse_id").alias("from_warehouse_id"), "to_warehouse_id", "product_id",
        F.col("units").cast("int").alias("quantity"), C.moment(as_of).alias("transfer_date"),
        F.col("received_date").alias("origin_date"),
    )
    deltas = granted.select(*STOCK_KEY, (-F.col("units")).alias("units")).unionByName(
        granted.select(F.col("to_warehouse_id").alias("warehouse_id"), "product_id", "units")
    )
    return Transfers(transfers, apply_deltas(d["inventory"], deltas), rejected)


# ---- shipments -----------------------------------------------------------------------


@dataclass(frozen=True)
class Shipments:
    shipments: DataFrame
    statuses: DataFrame


def create_shipments(d: Domain, orders: DataFrame) -> Shipments:
    """A shipment with tracking code and a first 'Packed' status for every new order. Ids continue
    the existing ones in order-number steps."""
    base = highest(d["shipment"], "shipment_id")
    first_status = highest(d["shipment_status"], "status_id")
    made = number_rows(orders.select("order_id", "order_date"), ["order_id"], base, "shipment_id")
    shipments = made.select(
        "shipment_id", "order_id", C.tracking_code("shipment_id").alias("tracking_code"),
        F.col("order_date").alias("shipment_date"),
    )
    statuses = made.select(
        (F.col("shipment_id") - base + first_status).alias("status_id"), "shipment_id",
        F.lit(None).cast("string").alias("location"), F.lit(SHIPMENT_LIFECYCLE[0]).alias("status"),
        F.col("order_date").alias("updated_time"),
    )
    return Shipments(shipments, statuses)


def advance_shipments(d: Domain, shipments: DataFrame, as_of: Moment) -> DataFrame:
    """Status rows that move the given shipments (shipment_id) one lifecycle step on. Finished
    shipments and ones without a status stay as they are."""
    current = latest_status(d, shipments.select("shipment_id"))
    moved = current.select("shipment_id", C.next_status("status").alias("status")).where(F.col("status").isNotNull())
    numbered = number_rows(moved, ["shipment_id"], highest(d["shipment_status"], "status_id"), "status_id")
    return numbered.select(
        "status_id", "shipment_id", F.lit(None).cast("string").alias("location"), "status",
        C.moment(as_of).alias("updated_time"),
    )


def stamp_hub(allocation: DataFrame, warehouse: DataFrame) -> DataFrame:
    """Hub name per order from its allocated lines (order_id, warehouse_id): the one hub, or a mark
    that there were several. Min and max decide that without collecting hubs."""
    names = warehouse.select("warehouse_id", "name")
    return (
        allocation.where(F.col("warehouse_id").isNotNull())
        .groupBy("order_id")
        .agg(F.min("warehouse_id").alias("warehouse_id"), F.max("warehouse_id").alias("_last"))
        .join(names, "warehouse_id", "left")
        .select(
            "order_id",
            F.when(F.col("warehouse_id") == F.col("_last"), F.col("name")).otherwise(MULTIPLE_HUBS).alias("source_hub"),
        )
    )


def stamp_statuses(d: Domain, stamps: DataFrame) -> DataFrame:
    """Status history with the hub written on the 'Packed' rows of stamped orders. A row that
    already names another hub becomes a several-hubs row."""
    single = stamps.groupBy("order_id").agg(F.min("source_hub").alias("source_hub"), F.max("source_hub").alias("_last"))
    single = single.select("order_id", F.when(F.col("source_hub").eqNullSafe(F.col("_last")), F.col("source_hub")).otherwise(MULTIPLE_HUBS).alias("source_hub"))
    target = d["shipment"].select("shipment_id", "order_id").join(single, "order_id").select("shipment_id", "source_hub")
    here, hub = F.col("location"), F.col("source_hub")
    stamped = F.when(here.isNull() | (here == hub), hub).otherwise(MULTIPLE_HUBS)
    location = F.when(hub.isNotNull() & (F.col("status") == SHIPMENT_LIFECYCLE[0]), stamped).otherwise(here)
    columns = d["shipment_status"].columns
    return d["shipment_status"].join(target, "shipment_id", "left").withColumn("location", location).select(columns)


# ---- campaigns and customers ---------------------------------------------------------


@dataclass(frozen=True)
class Links:
    links: DataFrame
    rejected: DataFrame


def generate_links(d: Domain, campaigns: DataFrame, seed: str) -> Links:
    """A tracking link per chosen platform of new campaigns (campaign_id, product_id, platforms).
    Unknown or missing platforms are rejected.

    Codes are short, so with many links some coincide. Rather than drawing again until none does,
    further links of a code get ``-n`` appended, n going on from the highest one in use, whichever links
    have been deleted since. The suffix makes codes unique in one pass."""
    drafts = campaigns.select("campaign_id", "product_id", F.explode_outer("platforms").alias("platform"))
    known = F.coalesce(F.col("platform").isin(*PLATFORMS), F.lit(False))
    rejected = drafts.where(~known).select(
        F.col("campaign_id").alias("key"), F.concat(F.lit("unknown platform: "), F.coalesce("platform", F.lit("none"))).alias("reason")
    )
    code = C.short_code("platform", F.concat_ws("|", F.lit(seed), F.col("campaign_id"), F.col("platform")))
    drafts = drafts.where(known).withColumn("base", code)
    in_use = F.regexp_extract("short_code", r"^([A-Z]+-[0-9A-F]{5})(-[0-9]+)?$", 1)
    suffix = F.regexp_extract("short_code", r"^[A-Z]+-[0-9A-F]{5}-([0-9]{1,18})$", 1)
    taken = (
        d["tracking_link"]
        .select(in_use.alias("base"), F.coalesce(F.nullif(suffix, F.lit("")).cast("bigint"), F.lit(1)).alias("nth"))
        .where(F.col("base") != "")
        .groupBy("base")
        .agg(F.max("nth").alias("taken"))
    )
    counted = running_total(drafts.withColumn("one", F.lit(1)), ["base"], ["campaign_id", "platform"], "one", out="nth").join(taken, "base", "left")
    nth = F.col("nth") + F.coalesce("taken", F.lit(0))
    coded = counted.withColumn(
        "short_code", F.when(nth == 1, F.col("base")).otherwise(F.concat("base", F.lit("-"), nth.cast("string")))
    )
    numbered = number_rows(coded, ["campaign_id", "platform"], highest(d["tracking_link"], "link_id"), "link_id")
    links = numbered.select(
        "link_id", "campaign_id", "platform", "short_code", C.product_url("product_id").alias("destination_url")
    )
    return Links(links, rejected)


@dataclass(frozen=True)
class Customers:
    inserts: DataFrame
    resolved: DataFrame
    rejected: DataFrame


def upsert_customers(d: Domain, requests: DataFrame) -> Customers:
    """Guests (request_id, name, contact) matched to the customer with the same contact, or created
    once per new contact under the first name given. ``resolved`` gives each accepted request its
    customer. Where several customers share a contact the lowest id is used. Guests without a contact
    are rejected."""
    known = (
        d["customer"].where(F.col("contact").isNotNull()).groupBy("contact").agg(F.min("customer_id").alias("customer_id"))
    )
    named = requests.select("request_id", F.trim("name").alias("name"), F.nullif(F.trim("contact"), F.lit("")).alias("contact"))
    rejected = named.where(F.col("contact").isNull()).select(F.col("request_id").alias("key"), F.lit("no contact").alias("reason"))
    guests = named.where(F.col("contact").isNotNull())
    fresh = (
        guests.join(known, "contact", "left_anti")
        .groupBy("contact")
        .agg(F.min(F.struct("request_id", "name")).alias("first"))
        .select("contact", "first.request_id", "first.name")
    )
    inserts = number_rows(fresh, ["request_id", "contact"], highest(d["customer"], "customer_id"), "customer_id")
    inserts = materialise(inserts.select("customer_id", "name", "contact"), "new-customers")
    everyone = known.unionByName(inserts.select("contact", "customer_id"))
    return Customers(inserts, guests.join(everyone, "contact", "left").select("request_id", "customer_id"), rejected)


@dataclass(frozen=True)
class CustomerEdit:
    customers: DataFrame
    blocked: DataFrame


def edit_customers(d: Domain, edits: DataFrame, deletes: DataFrame) -> CustomerEdit:
    """Next customer table after edits (customer_id, name, contact) and deletes (customer_id). Of several
    edits of a customer the last by ``edited_at`` holds, or without that column the largest by name and
    contact, so that a customer stays one row.
    Customers that an order or a click still refers to cannot be deleted and are reported."""
    doomed = deletes.select("customer_id").distinct()
    used = d["order"].select("customer_id").unionByName(d["click"].select("customer_id")).distinct()
    blocked = doomed.join(used, "customer_id", "left_semi")
    gone = doomed.join(used, "customer_id", "left_anti")
    text = lambda c: F.trim(c)
    when = [F.col(c) for c in ("edited_at",) if c in edits.columns]
    last = edits.groupBy("customer_id").agg(F.max(F.struct(*when, "name", "contact")).alias("last")).select("customer_id", "last.name", "last.contact")
    changes = last.select(
        "customer_id", text("name").alias("new_name"), F.nullif(text("contact"), F.lit("")).alias("new_contact"),
        F.lit(True).alias("edited"),
    )
    customers = (
        d["customer"]
        .join(gone, "customer_id", "left_anti")
        .join(changes, "customer_id", "left")
        .select(
            "customer_id", F.when(F.col("edited"), F.col("new_name")).otherwise(F.col("name")).alias("name"),
            F.when(F.col("edited"), F.col("new_contact")).otherwise(F.col("contact")).alias("contact"),
        )
    )
    return CustomerEdit(customers, blocked.withColumn("reason", F.lit("still referenced")))


# ---- audit and rewrites --------------------------------------------------------------


def audit_diff(before: DataFrame, after: DataFrame, key: str, table: str, as_of: Moment) -> DataFrame:
    """Audit rows for the difference of two snapshots. Both are tagged and grouped by key, which is
    a full outer comparison in one shuffle. Several changes between the snapshots show as one."""
    values = [c for c in before.columns if c != key]
    tag = lambda df, side: df.select(key, F.lit(side).alias("side"), F.struct(*values).alias("v"))
    pick = lambda side: F.max(F.when(F.col("side") == side, F.col("v")))
    both = tag(before, 0).unionByName(tag(after.select(before.columns), 1)).groupBy(key).agg(
        pick(0).alias("old"), pick(1).alias("new")
    )
    operation = (
        F.when(F.col("old").isNull(), "INSERT")
        .when(F.col("new").isNull(), "DELETE")
        .when(~F.col("old").eqNullSafe(F.col("new")), "UPDATE")
    )
    return both.select(
        F.lit(table).alias("table_name"), operation.alias("operation"), F.col(key).alias("record_id"),
        C.moment(as_of).alias("log_time"),
    ).where(F.col("operation").isNotNull())


def backdate(df: DataFrame, key: str, when: str, ages: DataFrame, as_of: Moment) -> DataFrame:
    """``df`` with the time column of the listed keys (key, days) set to ``days`` before ``as_of``. Of
    several entries of a key the largest number of days holds."""
    columns = df.columns
    moved = C.moment(as_of) - F.make_dt_interval(days=F.col("days").cast("int"))
    return (
        df.join(ages.groupBy(key).agg(F.max("days").alias("days")), key, "left")
        .withColumn(when, F.when(F.col("days").isNotNull(), moved).otherwise(F.col(when)))
        .select(columns)
    )
