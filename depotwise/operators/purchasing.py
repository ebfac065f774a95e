"""Purchases, suppliers and restocking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depotwise.functions import columns as C
from depotwise.operators import tables
from depotwise.operators.stock import Moment
from depotwise.policy import LOW_STOCK_THRESHOLD, PURCHASE_PAGE_SIZE
from depotwise.sources.domain import Domain

EXPORT_HEADERS = ("Date", "Supplier", "Warehouse", "Product", "Qty", "Unit cost", "Total")


def _names(d: Domain, table: str, label: str) -> DataFrame:
    return d[table].select(f"{table}_id", F.col("name").alias(label))


def purchase_history(d: Domain) -> DataFrame:
    """Purchased lines with supplier, hub and product names and their cost."""
    return (
        d["purchase_item"]
        .join(d["purchase"], "purchase_id")
        .join(_names(d, "supplier", "supplier_name"), "supplier_id")
        .join(_names(d, "warehouse", "warehouse_name"), "warehouse_id")
        .join(_names(d, "product", "product_name"), "product_id")
        .select(
            "purchase_item_id", "purchase_id", "purchase_date", "supplier_name", "warehouse_name",
            "product_name", "quantity", "unit_cost", C.line_amount("quantity", "unit_cost").alias("total_cost"),
        )
    )


def purchase_history_search(d: Domain, as_of: Moment, text: str = "", days: int | None = None) -> DataFrame:
    """History within the last ``days`` matching the text in supplier, hub or product name."""
    rows = tables.in_range(purchase_history(d), "purchase_date", as_of, days)
    return tables.search_rows(rows, text, "supplier_name", "warehouse_name", "product_name")


def purchase_page(d: Domain, after: Sequence | None = None, size: int = PURCHASE_PAGE_SIZE) -> DataFrame:
    """One page of history, newest first. ``after`` = (purchase_date, purchase_item_id) last seen."""
    return tables.page_after(purchase_history(d), ["purchase_date", "purchase_item_id"], size, after)


def purchase_history_page(
    d: Domain, as_of: Moment, sort: Sequence[tuple[str, bool]], text: str = "", days: int | None = None,
    after: Sequence | None = None, size: int = PURCHASE_PAGE_SIZE,
) -> DataFrame:
    """One page of the history that a search and a range leave, in a chosen order. ``sort`` lists (column, descending);
    the line's id is added, so that no two rows tie. ``after`` holds the last row's values of these columns and its id."""
    rows = purchase_history_search(d, as_of, text, days)
    return tables.page_by(rows, [*sort, ("purchase_item_id", False)], size, after)


def purchase_export(history: DataFrame, path: str) -> None:
    rows = history.select(
        C.date_label("purchase_date"), "supplier_name", "warehouse_name", "product_name", "quantity",
        "unit_cost", "total_cost",
    )
    tables.write_csv(rows, path, EXPORT_HEADERS)


def purchase_stats(d: Domain) -> DataFrame:
    """One row: purchases, units, spend and distinct products. Both distinct counts come from
    grouped partial sums, so the items are neither expanded nor sorted for them."""
    items = d["purchase_item"]
    amount = C.line_amount("quantity", "unit_cost")
    per_purchase = items.groupBy("purchase_id").agg(
        F.sum("quantity").alias("units"), F.sum(amount).alias("spend")
    )
    products = items.groupBy("product_id").agg(F.lit(1)).agg(F.count(F.lit(1))).scalar()
    return per_purchase.agg(
        F.count(F.lit(1)).alias("purchases"),
        F.coalesce(F.sum("units"), F.lit(0)).alias("units"),
        F.coalesce(F.sum("spend"), F.lit(0)).cast("decimal(31,2)").alias("spend"),
    ).select("purchases", "units", "spend", products.alias("distinct_products"))


def supplier_product_count(d: Domain) -> DataFrame:
    """How many products each supplier has, including those with none."""
    counts = d["product"].groupBy("supplier_id").agg(F.count("product_id").alias("n"))
    return (
        d["supplier"]
        .join(counts, "supplier_id", "left")
        .select("supplier_id", "name", F.coalesce("n", F.lit(0)).cast("bigint").alias("product_count"))
    )


def top_suppliers(d: Domain, limit: int = 5) -> DataFrame:
    return tables.top(
        supplier_product_count(d), limit, F.col("product_count").desc(), F.col("supplier_id").asc()
    )


def duplicate_product_names(d: Domain) -> DataFrame:
    """Products of one supplier whose normalised names collide, with the label that tells them
    apart (price and id)."""
    named = d["product"].withColumn("normal_name", C.normalised_name("name"))
    repeated = (
        named.groupBy("supplier_id", "normal_name")
        .agg(F.count(F.lit(1)).alias("copies"))
        .where(F.col("copies") > 1)
    )
    label = F.concat(
        "name", F.lit(" ("), C.money_label("price"), F.lit(", #"), F.col("product_id").cast("string"), F.lit(")")
    )
    return named.join(repeated, ["supplier_id", "normal_name"]).select(
        "supplier_id", "product_id", "normal_name", "copies", label.alias("label")
    )


def product_choices(d: Domain) -> DataFrame:
    """Products a supplier can be asked for: the plain name, or name with price and id when the
    supplier has several products of that name."""
    labels = duplicate_product_names(d).select("product_id", "label")
    return (
        d["product"]
        .join(labels, "product_id", "left")
        .select("supplier_id", "product_id", F.coalesce("label", "name").alias("label"))
    )


def restock_worklist(d: Domain, threshold: int = LOW_STOCK_THRESHOLD) -> DataFrame:
    """Low stock rows with the supplier to reorder from."""
    low = d["inventory"].where(F.col("quantity") < threshold).select("warehouse_id", "product_id", "quantity")
    products = d["product"].select("product_id", F.col("name").alias("product_name"), "supplier_id")
    return (
        low.join(products, "product_id")
        .join(_names(d, "supplier", "supplier_name"), "supplier_id")
        .select("product_id", "product_name", "warehouse_id", "quantity", "supplier_id", "supplier_name")
    )


def resolve_restock(d: Domain, links: DataFrame) -> DataFrame:
    """Restock links (product_id, supplier_id?) against the catalog: the product's own supplier
    wins over the one in the link, and unknown products are reported."""
    own = d["product"].select("product_id", F.col("supplier_id").alias("own_supplier_id"))
    asked = F.col("supplier_id")
    outcome = (
        F.when(F.col("own_supplier_id").isNull(), "unknown product")
        .when(asked.isNotNull() & (asked != F.col("own_supplier_id")), "supplier corrected")
        .otherwise("ok")
    )
    return links.join(own, "product_id", "left").select(
        "product_id", asked.alias("asked_supplier_id"), F.col("own_supplier_id").alias("supplier_id"),
        outcome.alias("outcome"),
    )


def product_margin(d: Domain) -> DataFrame:
    """Selling price against the quantity-weighted purchase cost. Products never bought have no
    cost and no margin. (The formula is this library's own.)"""
    cost = d["purchase_item"].groupBy("product_id").agg(
        F.sum("quantity").cast("decimal(18,0)").alias("bought"),
        F.sum(C.line_amount("quantity", "unit_cost")).cast("decimal(20,2)").alias("spend"),
    )
    average = F.round(F.col("spend") / F.col("bought"), 2).cast("decimal(18,2)")
    return (
        d["product"]
        .join(cost, "product_id", "left")
        .select("product_id", "name", "price", average.alias("average_cost"))
        .withColumn("margin", (F.col("price") - F.col("average_cost")).cast("decimal(18,2)"))
    )
