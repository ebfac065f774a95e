"""Stock age, capacity, storage rent, stock levels and stock movements per hub."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depotwise.functions import columns as C
from depotwise.functions.running import BEFORE, Blocked, blocked, running_total, take_in_order
from depotwise.policy import LOW_STOCK_THRESHOLD, AgePolicy, CapacityPolicy, RentPolicy
from depotwise.sources.domain import Domain

Moment = dt.datetime | str | Column
STOCK_KEY = ["warehouse_id", "product_id"]


def rent_rates(d: Domain, policy: RentPolicy = RentPolicy()) -> DataFrame:
    """Every hub with the daily rate its size earns."""
    return d["warehouse"].select(
        "warehouse_id", "name", "capacity_units",
        C.rent_rate("capacity_units", policy).alias("rent_per_unit_day"),
    )


def all_lots(d: Domain) -> DataFrame:
    """Arrivals of stock: purchased lots, and transferred lots under the date they carry along."""
    bought = (
        d["purchase_item"]
        .join(d["purchase"], "purchase_id")
        .select(
            *STOCK_KEY,
            F.col("purchase_date").alias("received_date"),
            "quantity",
            F.lit("P").alias("lot_kind"),
            F.col("purchase_item_id").alias("lot_id"),
        )
    )
    moved = d["stock_transfer"].select(
        F.col("to_warehouse_id").alias("warehouse_id"),
        "product_id",
        F.col("origin_date").alias("received_date"),
        "quantity",
        F.lit("T").alias("lot_kind"),
        F.col("transfer_id").alias("lot_id"),
    )
    return bought.unionByName(moved)


LOT_ORDER = ["received_date", "lot_kind", "lot_id"]


def lots_in_blocks(d: Domain) -> Blocked:
    """All arrivals, newest first, in blocks that know how many units came after them."""
    return blocked(all_lots(d), STOCK_KEY, LOT_ORDER, {"newer": ("sum", "quantity")}, descending=True)


def remaining_lots(d: Domain, lots: Blocked | None = None) -> DataFrame:
    """Lots still on hand. Stock leaves oldest first, so what is left of a (hub, product) is its
    newest ``inventory.quantity`` units. ``lots`` may be a stored layout of the arrivals (``sources.layout``).

    Blocks of lots that lie entirely behind the on-hand window are dropped on the pre-aggregated block
    totals, before any lot is joined."""
    cut = lots or lots_in_blocks(d)
    newer = F.coalesce(F.col(f"{BEFORE}_newer"), F.lit(0))
    on_hand = d["inventory"].select(*STOCK_KEY, F.col("quantity").alias("on_hand"))
    open_blocks = (
        cut.blocks.join(on_hand, STOCK_KEY)
        .where(newer < F.col("on_hand"))
        .select(*cut.on, newer.alias("newer"), "on_hand")
    )
    upto = F.col("newer") + F.sum("quantity").over(cut.within())
    units = take_in_order(F.col("quantity"), upto, F.col("on_hand")).cast("int")
    return (
        cut.join(open_blocks)
        .select(*STOCK_KEY, "received_date", units.alias("units"))
        .where(F.col("units") > 0)
    )


def aged_lots(d: Domain, as_of: Moment, policy: AgePolicy = AgePolicy(), lots: Blocked | None = None) -> DataFrame:
    """Remaining lots with their age in days and rent multiplier."""
    days = F.greatest(C.whole_days("received_date", C.moment(as_of)), F.lit(0))
    return (
        remaining_lots(d, lots)
        .withColumn("days_stored", days)
        .withColumn("rent_multiplier", C.age_multiplier("days_stored", policy))
    )


def warehouse_stock_age(
    d: Domain,
    as_of: Moment,
    age_policy: AgePolicy = AgePolicy(),
    rent_policy: RentPolicy = RentPolicy(),
    lots: Blocked | None = None,
) -> DataFrame:
    """One row per lot on hand: age, age band and what it costs per day."""
    hubs = rent_rates(d, rent_policy).select(
        "warehouse_id", F.col("name").alias("warehouse_name"), "rent_per_unit_day"
    )
    products = d["product"].select("product_id", F.col("name").alias("product_name"))
    rent = F.col("units") * F.col("rent_per_unit_day") * F.col("rent_multiplier")
    return (
        aged_lots(d, as_of, age_policy, lots)
        .join(hubs, "warehouse_id")
        .join(products, "product_id")
        .select(
            "warehouse_id", "warehouse_name", "product_id", "product_name", "received_date", "units",
            "days_stored",
            C.age_band("days_stored", age_policy).alias("age_band"),
            "rent_multiplier",
            F.round(rent, 2).cast("decimal(20,2)").alias("daily_rent"),
        )
    )


def stock_age_summary(d: Domain, as_of: Moment, age_policy: AgePolicy = AgePolicy(),
                      rent_policy: RentPolicy = RentPolicy()) -> DataFrame:
    """Units, lots and daily rent per hub and age band."""
    return (
        warehouse_stock_age(d, as_of, age_policy, rent_policy)
        .groupBy("warehouse_id", "warehouse_name", "age_band")
        .agg(
            F.count(F.lit(1)).alias("lots"),
            F.sum("units").alias("units"),
            F.max("days_stored").alias("oldest_days"),
            F.sum("daily_rent").cast("decimal(31,2)").alias("daily_rent"),
        )
    )


def _hub_stock(inventory: DataFrame) -> DataFrame:
    return inventory.groupBy("warehouse_id").agg(F.sum("quantity").alias("units"))


def warehouse_capacity(d: Domain, policy: CapacityPolicy = CapacityPolicy()) -> DataFrame:
    """How full each hub is; a hub without inventory rows is empty, not missing."""
    used = F.coalesce(F.col("units"), F.lit(0)).cast("bigint")
    return (
        d["warehouse"]
        .join(_hub_stock(d["inventory"]), "warehouse_id", "left")
        .withColumn("used_units", used)
        .select(
            "warehouse_id", "name", "location", "capacity_units", "used_units",
            (F.col("capacity_units") - F.col("used_units")).alias("free_units"),
            C.percent("used_units", "capacity_units").alias("utilisation_pct"),
            C.capacity_status("used_units", "capacity_units", policy).alias("capacity_status"),
        )
    )


def warehouse_rent(
    d: Domain,
    as_of: Moment,
    age_policy: AgePolicy = AgePolicy(),
    rent_policy: RentPolicy = RentPolicy(),
) -> DataFrame:
    """Daily bill per hub: the plain rate, the surcharge for old stock, and both. Units on hand
    without any lot behind them are billed at the plain rate."""
    units, days = F.col("units"), F.col("days_stored")
    aged = (
        aged_lots(d, as_of, age_policy)
        .groupBy("warehouse_id")
        .agg(
            F.sum(units).alias("lot_units"),
            F.sum(units * F.col("rent_multiplier")).alias("weighted_units"),
            F.sum(F.when(days > age_policy.overdue_after, units).otherwise(0)).alias("overdue"),
            F.max(days).alias("oldest"),
        )
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    unlotted = F.greatest(zero("units") - zero("lot_units"), F.lit(0))
    bills = (
        rent_rates(d, rent_policy)
        .join(_hub_stock(d["inventory"]), "warehouse_id", "left")
        .join(aged, "warehouse_id", "left")
        .select(
            "warehouse_id", "name", "rent_per_unit_day",
            zero("units").cast("bigint").alias("on_hand_units"),
            zero("overdue").cast("bigint").alias("overdue_units"),
            zero("oldest").cast("int").alias("oldest_days"),
            (zero("weighted_units") + unlotted).cast("decimal(20,1)").alias("billable"),
        )
    )
    rate, on_hand, billable = F.col("rent_per_unit_day"), F.col("on_hand_units"), F.col("billable")
    money = lambda amount, name: F.round(amount, 2).cast("decimal(20,2)").alias(name)
    return bills.select(
        "warehouse_id", "name", "rent_per_unit_day", "on_hand_units", "overdue_units", "oldest_days",
        money(on_hand * rate, "base_daily_rent"),
        money((billable - on_hand) * rate, "surcharge_daily_rent"),
        money(billable * rate, "total_daily_rent"),
        money(billable * rate * rent_policy.days_per_month, "total_monthly_rent"),
    )


def warehouse_overview(
    d: Domain,
    as_of: Moment,
    age_policy: AgePolicy = AgePolicy(),
    rent_policy: RentPolicy = RentPolicy(),
    capacity_policy: CapacityPolicy = CapacityPolicy(),
) -> DataFrame:
    """Capacity and rent side by side, one row per hub."""
    rent = warehouse_rent(d, as_of, age_policy, rent_policy).drop("name", "on_hand_units")
    return warehouse_capacity(d, capacity_policy).join(rent, "warehouse_id")


def low_stock_by_hub(d: Domain, threshold: int = LOW_STOCK_THRESHOLD) -> DataFrame:
    """Stock rows strictly below the threshold; a product may appear once per hub."""
    return (
        d["inventory"]
        .where(F.col("quantity") < threshold)
        .join(d["product"].select("product_id", F.col("name").alias("product_name")), "product_id")
        .select("product_id", "product_name", "quantity")
    )


def low_stock_by_product(d: Domain, threshold: int = LOW_STOCK_THRESHOLD) -> DataFrame:
    """Products whose stock over all hubs is below the threshold."""
    totals = d["inventory"].groupBy("product_id").agg(F.sum("quantity").alias("quantity"))
    return (
        totals.where(F.col("quantity") < threshold)
        .join(d["product"].select("product_id", F.col("name").alias("product_name")), "product_id")
        .select("product_id", "product_name", "quantity")
    )


def stock_levels(d: Domain, search: str = "") -> DataFrame:
    """Current stock rows with product, hub and last restock date (null if never bought there).
    Sorting newest restock first with missing dates last is ``tables.sort_rows`` at the edge."""
    restock = (
        d["purchase_item"]
        .join(d["purchase"], "purchase_id")
        .groupBy(*STOCK_KEY)
        .agg(F.max("purchase_date").alias("last_restock"))
    )
    products = d["product"].select("product_id", F.col("name").alias("product_name"), "category")
    hubs = d["warehouse"].select("warehouse_id", F.col("name").alias("warehouse_name"))
    return (
        d["inventory"]
        .join(restock, STOCK_KEY, "left")
        .join(products, "product_id", "left")
        .join(hubs, "warehouse_id", "left")
        .where(C.matches_text(search, "product_name", "warehouse_name"))
        .select("product_id", "warehouse_id", "product_name", "category", "warehouse_name", "quantity", "last_restock")
    )


def inventory_kpis(d: Domain, threshold: int = LOW_STOCK_THRESHOLD) -> DataFrame:
    """One row: products, units, low rows and empty rows."""
    flag = lambda condition: F.coalesce(F.sum(condition.cast("int")), F.lit(0)).cast("bigint")
    products = d["product"].agg(F.count(F.lit(1))).scalar()
    return d["inventory"].agg(
        F.coalesce(F.sum("quantity"), F.lit(0)).alias("total_stock"),
        flag(F.col("quantity") < threshold).alias("low_rows"),
        flag(F.col("quantity") == 0).alias("out_of_stock_rows"),
    ).select(products.alias("products"), "total_stock", "low_rows", "out_of_stock_rows")


def catalog_stock(d: Domain) -> DataFrame:
    """The public catalog: price, category and whether anything is in stock."""
    totals = d["inventory"].groupBy("product_id").agg(F.sum("quantity").alias("units"))
    stock = F.coalesce(F.col("units"), F.lit(0)).cast("bigint")
    return (
        d["product"]
        .join(totals, "product_id", "left")
        .select(
            "product_id", "name", C.known("category", "Product").alias("category"), "price",
            stock.alias("stock"), (stock > 0).alias("in_stock"),
        )
    )


def transfer_log(d: Domain) -> DataFrame:
    """Transfers with hub and product names and the age the units arrived with."""
    hub = lambda side: d["warehouse"].select(
        F.col("warehouse_id").alias(f"{side}_warehouse_id"), F.col("name").alias(f"{side}_hub")
    )
    return (
        d["stock_transfer"]
        .join(hub("from"), "from_warehouse_id")
        .join(hub("to"), "to_warehouse_id")
        .join(d["product"].select("product_id", F.col("name").alias("product_name")), "product_id")
        .select(
            "transfer_id", "from_hub", "to_hub", "product_name", "quantity", "transfer_date", "origin_date",
            C.whole_days("origin_date", "transfer_date").alias("days_at_move"),
        )
    )


# ---- movements -----------------------------------------------------------------------


def movements(d: Domain, order_hubs: DataFrame | None = None) -> DataFrame:
    """Every signed stock movement. Orders leave the hub they were stamped with; ``order_hubs``
    (order_id, warehouse_id) overrides that, orders without one hub are not attributed."""
    if order_hubs is None:
        packed = d["shipment_status"].where(F.col("status") == "Packed").select("shipment_id", "location")
        hubs = d["warehouse"].select("warehouse_id", F.col("name").alias("location"))
        order_hubs = (
            packed.join(hubs, "location")
            .join(d["shipment"].select("shipment_id", "order_id"), "shipment_id")
            .groupBy("order_id")
            .agg(F.min("warehouse_id").alias("warehouse_id"), F.max("warehouse_id").alias("_other"))
            .where(F.col("warehouse_id") == F.col("_other"))
            .drop("_other")
        )
    row = lambda hub, at, kind, ref, units: [
        F.col(hub).alias("warehouse_id"), "product_id", F.col(at).alias("moved_at"),
        F.lit(kind).alias("kind"), F.col(ref).alias("ref_id"), units.cast("bigint").alias("units"),
    ]
    amount = F.col("quantity")
    transfers = d["stock_transfer"]
    bought = d["purchase_item"].join(d["purchase"], "purchase_id")
    sold = d["order_item"].join(order_hubs, "order_id").join(d["order"], "order_id")
    return (
        bought.select(*row("warehouse_id", "purchase_date", "purchase", "purchase_item_id", amount))
        .unionByName(transfers.select(*row("to_warehouse_id", "transfer_date", "transfer in", "transfer_id", amount)))
        .unionByName(transfers.select(*row("from_warehouse_id", "transfer_date", "transfer out", "transfer_id", -amount)))
        .unionByName(sold.select(*row("warehouse_id", "order_date", "order", "order_item_id", -amount)))
    )


def hub_flow(d: Domain) -> DataFrame:
    """Units in and out per hub and kind of movement."""
    return (
        movements(d)
        .groupBy("warehouse_id", "kind")
        .agg(F.count(F.lit(1)).alias("moves"), F.sum("units").alias("units"))
        .withColumn("direction", F.when(F.col("units") < 0, "out").otherwise("in"))
    )


def movement_balance(d: Domain) -> DataFrame:
    """Balance per (hub, product) after each day with movements. The reduction to days comes first,
    so the running sum walks at most one row per day and key."""
    daily = (
        movements(d)
        .groupBy(*STOCK_KEY, F.col("moved_at").cast("date").alias("day"))
        .agg(F.sum("units").alias("net_units"))
    )
    return running_total(daily, STOCK_KEY, ["day"], "net_units", out="balance")


def ledger_reconciliation(d: Domain, opening: DataFrame | None = None) -> DataFrame:
    """Stock rows whose snapshot differs from opening stock plus all movements. Both sides are
    summed in one grouping, which is a full outer comparison without a join."""
    zero = F.lit(0).cast("bigint")
    snapshot = d["inventory"].select(*STOCK_KEY, F.col("quantity").cast("bigint").alias("s"), zero.alias("l"))
    ledger = movements(d).select(*STOCK_KEY, zero.alias("s"), F.col("units").alias("l"))
    both = snapshot.unionByName(ledger)
    if opening is not None:
        both = both.unionByName(
            opening.select(*STOCK_KEY, zero.alias("s"), F.col("quantity").cast("bigint").alias("l"))
        )
    return (
        both.groupBy(*STOCK_KEY)
        .agg(F.sum("s").alias("snapshot_units"), F.sum("l").alias("ledger_units"))
        .withColumn("difference", F.col("snapshot_units") - F.col("ledger_units"))
        .where(F.col("difference") != 0)
    )


def capacity_headroom(d: Domain, incoming: DataFrame) -> DataFrame:
    """Would the incoming units (warehouse_id, quantity) still fit into each hub?"""
    arriving = incoming.groupBy("warehouse_id").agg(F.sum("quantity").alias("incoming_units"))
    total = F.col("used_units") + F.col("incoming_units")
    return (
        warehouse_capacity(d)
        .join(arriving, "warehouse_id")
        .select(
            "warehouse_id", "name", "capacity_units", "used_units",
            F.greatest(F.col("free_units"), F.lit(0)).alias("free_units"), "incoming_units",
            (total <= F.col("capacity_units")).alias("fits"),
        )
    )
