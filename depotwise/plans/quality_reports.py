"""Reports of rows that break an integrity rule. The derived tables obey most contracts, so the
rules run on tables with known faults planted by expressions over every row."""

from __future__ import annotations

from pyspark.sql import functions as F

from depotwise.operators import mutations, quality
from depotwise.plans.mutation_reports import new_campaigns
from depotwise.plans.reports import Inputs, Report


def _faulty(x: Inputs):
    """The domain with faults: negative costs, unknown products, repeated codes, odd statuses, ..."""
    d = x.domain
    n = lambda c, k: F.col(c) % k == 0
    items = d["purchase_item"].withColumns(
        {
            "quantity": F.when(n("purchase_id", 11), -F.col("quantity")).otherwise(F.col("quantity")),
            "unit_cost": F.when(n("purchase_id", 13), -F.col("unit_cost")).otherwise(F.col("unit_cost")),
            "product_id": F.when(n("purchase_id", 17), -F.col("product_id")).otherwise(F.col("product_id")),
        }
    )
    links = d["tracking_link"].withColumns(
        {
            "platform": F.when(n("link_id", 7), F.lit("Fax")).otherwise(F.col("platform")),
            "short_code": F.when(n("link_id", 5), F.lit("SAME")).otherwise(F.col("short_code")),
        }
    )
    transfers = d["stock_transfer"].withColumn(
        "to_warehouse_id", F.when(n("transfer_id", 9), F.col("from_warehouse_id")).otherwise(F.col("to_warehouse_id"))
    )
    return d.replace(purchase_item=items, tracking_link=links, stock_transfer=transfers)


FAULTY = {
    "f_items": """SELECT purchase_item_id, purchase_id,
        CASE WHEN purchase_id % 17 = 0 THEN -product_id ELSE product_id END AS product_id,
        CASE WHEN purchase_id % 11 = 0 THEN -quantity ELSE quantity END AS quantity,
        CASE WHEN purchase_id % 13 = 0 THEN -unit_cost ELSE unit_cost END AS unit_cost FROM d_purchase_item""",
    "f_links": """SELECT link_id, CASE WHEN link_id % 7 = 0 THEN 'Fax' ELSE platform END AS platform,
        CASE WHEN link_id % 5 = 0 THEN 'SAME' ELSE short_code END AS short_code FROM d_tracking_link""",
}


def _summary_of(*tables: str):
    return lambda x: quality.summary(quality.violations(_faulty(x), list(tables)))


REPORTS = {
    "row_rules": Report(
        lambda x: quality.row_violations(_faulty(x), "purchase_item"),
        """SELECT 'positive' AS rule, 'purchase_item' AS "table", CAST(purchase_item_id AS VARCHAR) AS key,
             'quantity = ' || quantity AS detail FROM f_items WHERE quantity <= 0
           UNION ALL SELECT 'non-negative', 'purchase_item', CAST(purchase_item_id AS VARCHAR), 'unit_cost = ' || unit_cost
           FROM f_items WHERE unit_cost < 0""",
        tables=FAULTY,
    ),
    "domain_rules": Report(
        lambda x: quality.row_violations(_faulty(x), "tracking_link"),
        """SELECT 'domain' AS rule, 'tracking_link' AS "table", CAST(link_id AS VARCHAR) AS key,
             'platform = ' || platform AS detail FROM f_links WHERE platform = 'Fax'""",
        tables=FAULTY,
    ),
    "unique_rules": Report(
        lambda x: quality.unique_violations(_faulty(x), "tracking_link"),
        """SELECT 'unique' AS rule, 'tracking_link' AS "table", short_code AS key,
             'short_code occurs ' || count(*) AS detail FROM f_links GROUP BY short_code HAVING count(*) > 1""",
        tables=FAULTY,
    ),
    "reference_rules": Report(
        lambda x: quality.foreign_violations(_faulty(x), "purchase_item"),
        """SELECT 'reference' AS rule, 'purchase_item' AS "table", CAST(purchase_item_id AS VARCHAR) AS key,
             'product_id = ' || product_id AS detail FROM f_items AS i
           WHERE NOT EXISTS (SELECT 1 FROM d_product AS p WHERE p.product_id = i.product_id)""",
        tables=FAULTY,
    ),
    "transfer_rules": Report(
        _summary_of("stock_transfer"),
        """SELECT 'stock_transfer' AS "table", 'different' AS rule, count(*) AS violations
           FROM d_stock_transfer WHERE transfer_id % 9 = 0
           UNION ALL SELECT 'stock_transfer', 'unique', count(*) FROM (SELECT transfer_id FROM d_stock_transfer
             GROUP BY 1 HAVING count(*) > 1) AS q HAVING count(*) > 0""",
        tables=FAULTY,
    ),
    "contract_rules": Report(
        lambda x: quality.summary(quality.violations(x.stored("inventory").domain, ["product", "inventory", "order", "shipment_status", "click"])),
        """SELECT 'click' AS "table", 'reference' AS rule, count(*) AS violations FROM d_click AS k
           WHERE NOT EXISTS (SELECT 1 FROM d_tracking_link AS l WHERE l.link_id = k.link_id)
              OR (customer_id IS NOT NULL AND customer_id NOT IN (SELECT customer_id FROM d_customer))
           HAVING count(*) > 0""",
    ),
    "supplier_mismatches": Report(
        lambda x: quality.supplier_mismatches(x.domain),
        """SELECT 'supplier owns product' AS rule, 'purchase_item' AS "table", CAST(purchase_item_id AS VARCHAR) AS key,
             'product ' || i.product_id || ' of supplier ' || p.supplier_id || ', not ' || h.supplier_id AS detail
           FROM d_purchase_item AS i JOIN d_purchase AS h USING (purchase_id) JOIN d_product AS p USING (product_id)
           WHERE p.supplier_id <> h.supplier_id""",
    ),
    "capacity_below_stock": Report(
        lambda x: quality.capacity_below_stock(
            x.domain,
            x.domain["warehouse"].select(
                "warehouse_id",
                F.when(F.col("warehouse_id") % 4 == 0, F.col("capacity_units") + 1)
                .otherwise(F.expr("capacity_units * 8 div 10"))
                .alias("capacity_units"),
            ),
        ),
        """SELECT 'capacity below stock' AS rule, 'warehouse' AS "table", CAST(warehouse_id AS VARCHAR) AS key,
             'wanted ' || capacity_units * 8 // 10 || ', stored ' || used AS detail
           FROM s_fill WHERE warehouse_id % 4 <> 0 AND capacity_units * 8 // 10 < used""",
        hub="supplier",
    ),
    "capacity_breaches": Report(
        lambda x: quality.capacity_breaches(
            x.domain, mutations.apply_purchases(x.domain, x.domain["purchase"])
        ),
        """SELECT r.warehouse_id, r.product_id, f.capacity_units::BIGINT AS capacity_units, f.used::BIGINT AS used_units,
             greatest(f.capacity_units - f.used, 0)::BIGINT AS free_units, r.units::BIGINT AS added_units
           FROM t_rise AS r JOIN s_fill AS f USING (warehouse_id)
           WHERE f.used + (SELECT sum(x.units) FROM t_rise AS x WHERE x.warehouse_id = r.warehouse_id) > f.capacity_units""",
        hub="supplier",
        tables={
            "t_rise": """SELECT h.warehouse_id, i.product_id, sum(i.quantity) AS units FROM d_purchase AS h
              JOIN d_purchase_item AS i USING (purchase_id) GROUP BY 1, 2"""
        },
    ),
    "request_rules": Report(
        lambda x: quality.request_violations(
            x.domain["order_item"].select(
                "order_item_id",
                (F.col("quantity") - F.col("order_id") % 40).alias("quantity"),
                (F.col("unit_price") - 1000).alias("unit_price"),
            ),
            "order_item_id", cost="unit_price",
        ),
        """SELECT rule, 'request' AS "table", CAST(order_item_id AS VARCHAR) AS key, '' AS detail FROM (
             SELECT order_item_id, 'whole positive quantity' AS rule FROM d_order_item WHERE quantity <= order_id % 40
             UNION ALL SELECT order_item_id, 'whole cost' FROM d_order_item WHERE unit_price <> floor(unit_price)
             UNION ALL SELECT order_item_id, 'non-negative cost' FROM d_order_item WHERE unit_price < 1000) AS q""",
    ),
    "campaign_request_rules": Report(
        lambda x: quality.request_violations(new_campaigns(x), "campaign_id", platforms="platforms"),
        """SELECT 'at least one platform' AS rule, 'request' AS "table", CAST(product_id + 1000000 AS VARCHAR) AS key, '' AS detail
           FROM d_product WHERE product_id % 5 = 0""",
    ),
    "negative_balances": Report(
        lambda x: quality.negative_balances(x.domain),
        """SELECT warehouse_id, product_id, day::VARCHAR AS day, balance::BIGINT AS balance FROM (
             SELECT warehouse_id, product_id, day, sum(net) OVER (PARTITION BY warehouse_id, product_id ORDER BY day) AS balance
             FROM (SELECT warehouse_id, product_id, CAST(moved_at AS DATE) AS day, sum(units) AS net
                   FROM s_moves GROUP BY 1, 2, 3) AS daily) AS running WHERE balance < 0""",
    ),
    "duplicate_contacts": Report(
        lambda x: quality.duplicate_contacts(x.domain),
        """SELECT contact, count(*) AS customers, min(customer_id) AS matched_id FROM d_customer
           WHERE contact IS NOT NULL GROUP BY contact HAVING count(*) > 1""",
    ),
    "duplicate_hub_names": Report(
        lambda x: quality.duplicate_hub_names(
            x.domain.replace(warehouse=x.domain["warehouse"].withColumn("name", F.col("location")))
        ),
        """SELECT location AS name, count(*) AS hubs FROM d_warehouse GROUP BY location HAVING count(*) > 1""",
        hub="supplier",
    ),
}
