"""Customer orders: listings, totals, customers and the fulfilment view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from depotwise.functions import columns as C
from depotwise.operators import tables
from depotwise.operators.shipping import latest_status
from depotwise.operators.stock import Moment
from depotwise.policy import DIRECT_SOURCE, UNKNOWN
from depotwise.sources.domain import Domain


def order_totals(d: Domain) -> DataFrame:
    """Units, lines and amount per order that has lines."""
    return d["order_item"].groupBy("order_id").agg(
        F.sum("quantity").alias("units"),
        F.count(F.lit(1)).alias("lines"),
        F.sum(C.line_amount("quantity", "unit_price")).cast("decimal(31,2)").alias("total"),
    )


def _customers(d: Domain) -> DataFrame:
    return d["customer"].select("customer_id", F.col("name").alias("customer_name"))


def order_fulfilment(d: Domain) -> DataFrame:
    """Every order with the hub stamped on its 'Packed' row and its latest status. An order with
    several shipments or several 'Packed' rows appears once for each."""
    packed = (
        d["shipment_status"]
        .where(F.col("status") == "Packed")
        .select("shipment_id", F.col("location").alias("source_hub"))
    )
    hubs = d["warehouse"].select(
        F.col("name").alias("source_hub"), F.col("warehouse_id").alias("source_warehouse_id")
    )
    latest = latest_status(d).select("shipment_id", F.col("status").alias("shipment_status"))
    units = d["order_item"].groupBy("order_id").agg(F.sum("quantity").alias("n"))
    shipments = d["shipment"].select("shipment_id", "order_id", "tracking_code")
    # Status history hangs together by shipment, the rest by order: two groups of co-located joins.
    tracked = shipments.join(packed, "shipment_id", "left").join(latest, "shipment_id", "left")
    return (
        d["order"]
        .join(tracked, "order_id", "left")
        .join(units, "order_id", "left")
        .join(hubs, "source_hub", "left")
        .join(_customers(d), "customer_id")
        .select(
            "order_id", "order_date", "customer_name", "tracking_code", "source_hub", "source_warehouse_id",
            F.coalesce("n", F.lit(0)).cast("bigint").alias("units"), "shipment_status",
        )
    )


def _recent(d: Domain, limit: int) -> DataFrame:
    return tables.top(d["order"], limit, F.col("order_date").desc(), F.col("order_id").desc())


def order_list(d: Domain, orders: DataFrame | None = None) -> DataFrame:
    """Orders with items label, total, source and latest shipment status, one row each: all of them, or
    those of ``orders`` (for example a page, or what a search has left). Items, links and statuses are
    reduced to these orders by semi joins before any grouping.

    A label lists the order's items in line order, so it is as long as the order; ``order_items_of``
    gives the same lines as rows."""
    listed = d["order"] if orders is None else d["order"].join(orders.select("order_id"), "order_id", "left_semi")
    only = (lambda df: df) if orders is None else (lambda df: df.join(orders.select("order_id"), "order_id", "left_semi"))
    products = d["product"].select("product_id", F.coalesce("name", F.lit("Product")).alias("name"))
    item = F.struct("order_item_id", "product_id", F.coalesce("name", F.lit("Product")).alias("name"), "quantity")
    labels = (
        only(d["order_item"])
        .join(products, "product_id", "left")
        .groupBy("order_id")
        .agg(F.sort_array(F.collect_list(item)).alias("items"), F.sum(C.line_amount("quantity", "unit_price")).alias("amount"))
        .select("order_id", "amount", item_label("items").alias("items_label"))
    )
    source = (
        only(d["order_attribution"])
        .join(d["tracking_link"].select("link_id", "platform"), "link_id")
        .groupBy("order_id")
        .agg(F.min("platform").alias("platform"))
    )
    first_shipment = only(d["shipment"]).groupBy("order_id").agg(F.min("shipment_id").alias("shipment_id"))
    status = first_shipment.join(
        latest_status(d, first_shipment.select("shipment_id")), "shipment_id"
    ).select("order_id", F.col("status").alias("shipment_status"))
    return (
        listed.join(labels, "order_id", "left")
        .join(source, "order_id", "left")
        .join(status, "order_id", "left")
        .join(_customers(d), "customer_id", "left")
        .select(
            "order_id", "order_date",
            F.coalesce("customer_name", F.lit(UNKNOWN)).alias("customer_name"),
            F.coalesce("items_label", F.lit("-")).alias("items_label"),
            F.coalesce("amount", F.lit(0)).cast("decimal(31,2)").alias("total"),
            F.coalesce("platform", F.lit(DIRECT_SOURCE)).alias("source"), "shipment_status",
        )
    )


def item_label(items: str):
    """``name ×n, name ×n`` for an array of (.., name, quantity)."""
    text = lambda i: F.concat(i["name"], F.lit(" ×"), i["quantity"].cast("string"))
    return F.array_join(F.transform(items, text), ", ")


def order_list_search(d: Domain, as_of: Moment, text: str = "", days: int | None = None, limit: int | None = None) -> DataFrame:
    """The listing of orders of the last ``days`` by customer name or order number; with ``limit`` the
    newest of them. Search and limit come first, and only what they leave is put together."""
    named = tables.in_range(d["order"], "order_date", as_of, days).join(_customers(d), "customer_id", "left")
    found = tables.search_rows(named, text, "customer_name", "order_id")
    return order_list(d, found if limit is None else tables.top(found, limit, F.col("order_date").desc(), F.col("order_id").desc()))


def order_items_of(d: Domain, orders: DataFrame) -> DataFrame:
    """The lines behind a listing, one row each: the flat form of the item array."""
    products = d["product"].select("product_id", F.col("name").alias("product_name"))
    return (
        d["order_item"]
        .join(orders.select("order_id").distinct(), "order_id", "left_semi")
        .join(products, "product_id", "left")
        .select("order_id", "order_item_id", F.coalesce("product_name", F.lit("Product")).alias("product_name"),
                "quantity", "unit_price")
    )


def recent_orders(d: Domain, limit: int = 5) -> DataFrame:
    recent = _recent(d, limit)
    totals = (
        d["order_item"]
        .join(recent.select("order_id"), "order_id", "left_semi")
        .groupBy("order_id")
        .agg(F.sum(C.line_amount("quantity", "unit_price")).alias("amount"))
    )
    return (
        recent.join(totals, "order_id", "left")
        .join(_customers(d), "customer_id", "left")
        .select(
            "order_id", F.coalesce("customer_name", F.lit("-")).alias("customer_name"),
            F.coalesce("amount", F.lit(0)).cast("decimal(31,2)").alias("total"), "order_date",
        )
    )


def customer_orders(d: Domain, text: str = "") -> DataFrame:
    """Customers with their number of orders, filtered by name or contact."""
    counts = d["order"].groupBy("customer_id").agg(F.count(F.lit(1)).alias("n"))
    return (
        tables.search_rows(d["customer"], text, "name", "contact")
        .join(counts, "customer_id", "left")
        .select("customer_id", "name", "contact", F.coalesce("n", F.lit(0)).cast("bigint").alias("order_count"))
    )


def monthly_orders(d: Domain) -> DataFrame:
    """Orders per calendar month. ``month`` gives the chronological order of the labels."""
    return (
        d["order"]
        .groupBy(C.month_start("order_date").alias("month"))
        .agg(F.count(F.lit(1)).alias("orders"))
        .select("month", C.month_label("month").alias("label"), "orders")
    )


def top_products(d: Domain, limit: int = 5) -> DataFrame:
    """Best-selling product names by revenue; products sharing a name count together. Lines are
    reduced to products before names are joined."""
    sold = d["order_item"].groupBy("product_id").agg(
        F.sum("quantity").alias("u"), F.sum(C.line_amount("quantity", "unit_price")).alias("r")
    )
    names = d["product"].select("product_id", "name")
    by_name = (
        sold.join(names, "product_id", "left")
        .groupBy(F.coalesce("name", F.lit(UNKNOWN)).alias("name"))
        .agg(F.sum("u").alias("units"), F.sum("r").cast("decimal(31,2)").alias("revenue"))
    )
    return tables.top(by_name, limit, F.col("revenue").desc(), F.col("name").asc())


ORDER_WITH_ITEMS = (
    "order_id bigint, order_date timestamp_ntz, customer struct<customer_id: bigint, name: string>, total decimal(31,2), "
    "items array<struct<order_item_id: bigint, product_id: bigint, name: string, quantity: int, unit_price: decimal(10,2)>>"
)


def orders_with_items(d: Domain) -> DataFrame:
    """Every order as one nested row (``ORDER_WITH_ITEMS``): its customer, and its items in line order; an order
    without items has an empty array. An array is as long as the order."""
    products = d["product"].select("product_id", "name")
    item = F.struct("order_item_id", "product_id", "name", "quantity", "unit_price")
    amount = C.line_amount("quantity", "unit_price")
    items = (
        d["order_item"]
        .join(products, "product_id", "left")
        .groupBy("order_id")
        .agg(F.sort_array(F.collect_list(item)).alias("items"), F.sum(amount).alias("total"))
    )
    customers = d["customer"].select("customer_id", F.struct("customer_id", "name").alias("customer"))
    nested = (
        d["order"]
        .join(items, "order_id", "left")
        .join(customers, "customer_id", "left")
        .select("order_id", "order_date", "customer", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("items", F.array()).alias("items"))
    )
    return nested.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(ORDER_WITH_ITEMS).fields])


def store_orders_with_items(d: Domain, path: str) -> None:
    orders_with_items(d).write.mode("overwrite").parquet(path)


def read_orders_with_items(spark: SparkSession, path: str) -> DataFrame:
    """Stored nested orders; a query of some fields of the items reads only these columns of the files."""
    return spark.read.schema(ORDER_WITH_ITEMS).parquet(path)


def items_of(nested: DataFrame) -> DataFrame:
    """The items of nested orders as rows, with their place in the order."""
    return nested.select("order_id", "order_date", F.col("customer.name").alias("customer_name"), "total", F.posexplode("items").alias("place", "item")).select(
        "order_id", "order_date", "customer_name", "total", "place", "item.*"
    )
