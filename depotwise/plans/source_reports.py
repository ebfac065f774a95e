"""Reports that pass data through the sinks and read it back: what was written is what was meant."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depotwise.functions import columns as C
from depotwise.operators import mutations, purchasing, stock, tables
from depotwise.plans.reports import Inputs, Report
from depotwise.plans.trade_reports import HISTORY
from depotwise.session import work_path
from depotwise.sources import domain, layout, textindex
from depotwise.sources.snapshots import SnapshotStore
from depotwise.sources.star import AGE_POLICY, AS_OF

_LISTING = "purchase_item_id bigint, supplier_name string, product_name string, quantity int, total_cost decimal(21,2)"


def _csv(x: Inputs, quote_all: bool):
    """Purchase lines exported as CSV (awkward text included) and read back."""
    rows = purchasing.purchase_history(x.domain).select(
        "purchase_item_id",
        F.concat("supplier_name", F.lit(', "'), "warehouse_name", F.lit('"')).alias("supplier_name"),
        "product_name", "quantity", "total_cost",
    )
    path = work_path(x.spark, "export")
    tables.write_csv(rows, path, quote_all=quote_all)
    return x.spark.read.schema(_LISTING).options(header=True, quote='"', escape='"').csv(path)


def _stored(x: Inputs):
    """Order lines appended to a stored table in two loads and read back through its contract."""
    root, items = work_path(x.spark, "tables"), x.domain["order_item"]
    domain.append(items.where(F.col("quantity") <= 25), root, "order_item")
    domain.append(items.where(F.col("quantity") > 25), root, "order_item")
    return domain.load(x.spark, root)["order_item"]


def _click_log(x: Inputs):
    """New clicks appended to the click log after the existing ones."""
    root, clicks = work_path(x.spark, "tables"), x.domain["click"]
    domain.append(clicks, root, "click")
    domain.append(clicks.where(F.col("customer_id").isNotNull()).withColumn("click_id", -F.col("click_id")), root, "click")
    log = domain.load(x.spark, root)["click"]
    return log.groupBy("link_id").agg(F.count(F.lit(1)).alias("clicks"), F.min("click_id").alias("lowest_id"))


def _indexed(x: Inputs):
    """Customers stored in order of their names, and those among them that a contains-search through the index finds."""
    path = work_path(x.spark, "indexed")
    table, index, fields = f"{path}/customer", f"{path}/files", ["name", "contact"]
    x.domain["customer"].repartitionByRange(16, "name").write.parquet(table)
    textindex.build_index(x.spark, table, index, fields)
    return textindex.search(x.spark, table, index, "R#000000012", fields)


def _laid_out(x: Inputs):
    """Stock age from arrivals that were stored by hub, product and block."""
    name = f"lots_{uuid.uuid4().hex}"
    layout.store_lots(x.domain, name, 8)
    aged = stock.aged_lots(x.domain, AS_OF, AGE_POLICY, layout.stored_lots(x.spark, name))
    return aged.groupBy("warehouse_id", "product_id", "days_stored").agg(F.sum("units").alias("units"))


def _versions(x: Inputs):
    """Stock of each version of a store to which two batches are committed, the second in two attempts."""
    store, stock = SnapshotStore(x.spark, work_path(x.spark, "versions")), x.domain["inventory"]
    first = store.commit(0, replace={"inventory": stock, "purchase": x.domain["purchase"]})
    for _ in range(2):
        store.commit(first, replace={"inventory": mutations.apply_purchases(x.domain, x.domain["purchase"])}, batch=("arrivals", 1))
    at = lambda v: store.read(v)["inventory"].select(F.lit(v).alias("version"), "inventory_id", "quantity")
    return reduce(DataFrame.unionByName, [at(v) for v in store.versions()])


LISTED = """SELECT purchase_item_id, supplier_name || ', "' || warehouse_name || '"' AS supplier_name, product_name,
    quantity, total_cost FROM t_history"""

REPORTS = {
    "csv_export": Report(lambda x: _csv(x, False), LISTED, tables={"t_history": HISTORY}),
    "csv_export_quoted": Report(lambda x: _csv(x, True), LISTED, tables={"t_history": HISTORY}),
    "stored_order_items": Report(
        _stored,
        """SELECT order_item_id, order_id, product_id, quantity::BIGINT AS quantity, unit_price::DOUBLE AS unit_price
           FROM d_order_item""",
    ),
    "click_log_append": Report(
        _click_log,
        """SELECT link_id, count(*) + count(customer_id) AS clicks, min(CASE WHEN customer_id IS NULL THEN click_id
             ELSE -click_id END) AS lowest_id FROM d_click GROUP BY link_id""",
    ),
    "indexed_search": Report(
        _indexed, "SELECT customer_id, name, contact FROM d_customer WHERE contains(lower(name), 'r#000000012') OR contains(contact, 'r#000000012')"
    ),
    "stock_age_from_layout": Report(
        _laid_out,
        """SELECT warehouse_id::BIGINT AS warehouse_id, product_id, days::BIGINT AS days_stored, sum(units)::BIGINT AS units
           FROM s_aged GROUP BY ALL""",
    ),
    "snapshot_versions": Report(
        _versions,
        """SELECT 1::BIGINT AS version, inventory_id, quantity::BIGINT AS quantity FROM d_inventory
           UNION ALL SELECT 2, inventory_id, quantity + coalesce(units, 0)::BIGINT FROM d_inventory LEFT JOIN (
             SELECT warehouse_id, product_id, sum(quantity) AS units FROM d_purchase JOIN d_purchase_item USING (purchase_id)
             GROUP BY 1, 2) AS p USING (warehouse_id, product_id)""",
    ),
    "row_counts": Report(
        lambda x: tables.row_count(x.domain["order_item"]),
        "SELECT count(*) AS rows FROM d_order_item",
    ),
    "presentation_labels": Report(
        lambda x: x.domain["order_item"].join(x.domain["order"], "order_id").select(
            "order_item_id", C.money_label(C.line_amount("quantity", "unit_price")).alias("amount"),
            C.date_label("order_date").alias("day"), C.slug("status").alias("slug"),
        ),
        """SELECT order_item_id, '৳' || format('{{:,.2f}}', (i.quantity * i.unit_price)::DOUBLE) AS amount,
             strftime(o.order_date, '%b %-d, %Y') AS day, 'placed' AS slug
           FROM d_order_item AS i JOIN d_order AS o USING (order_id)""",
    ),
}
