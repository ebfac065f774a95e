"""Reports on purchases, suppliers, orders, customers and shipments."""

from __future__ import annotations

from pyspark.sql import functions as F

from depotwise.operators import orders, purchasing, shipping, tables
from depotwise.plans.reports import Inputs, Report
from depotwise.session import work_path
from depotwise.sources.star import AS_OF


def _restock_links(x: Inputs):
    """Links that name each product with the supplier before its own, and some unknown products."""
    asked = F.when(F.col("product_id") % 3 == 0, F.col("supplier_id")).when(
        F.col("product_id") % 3 == 1, F.col("supplier_id") - 1
    )
    return x.domain["product"].select(
        F.when(F.col("product_id") % 50 == 0, -F.col("product_id")).otherwise(F.col("product_id")).alias("product_id"),
        asked.alias("supplier_id"),
    )


def _sorted_stock_page(x: Inputs):
    """First 100 stock rows by product name, ignoring case, with a total order."""
    from depotwise.operators.stock import stock_levels

    rows = stock_levels(x.domain).select("product_id", "warehouse_id", "product_name", "quantity")
    return tables.sort_rows(rows, "product_name", True, "product_id", "warehouse_id").limit(100)


def _next_page(x: Inputs):
    return purchasing.purchase_page(x.domain, after=("2001-07-30 00:00:00", 0))


# (sort, search, days back, last row seen, SQL of the rows that follow, SQL order)
PAGES = {
    "date": (
        [("purchase_date", True)], "", None, ("2001-05-30 00:00:00", 0), "purchase_date <= TIMESTAMP '2001-05-30 00:00:00'",
        "purchase_date DESC",
    ),
    "supplier": (
        [("supplier_name", False), ("quantity", True)], "asia", 730, ("supplier#000000003", 17, 0),
        """contains(lower(supplier_name || '|' || warehouse_name || '|' || product_name), 'asia') AND purchase_date >= {as_of} - to_days(730)
           AND (lower(supplier_name) > 'supplier#000000003' OR lower(supplier_name) = 'supplier#000000003' AND quantity <= 17)""",
        "lower(supplier_name), quantity DESC",
    ),
    "cost": (
        [("total_cost", True), ("product_name", False)], "", 1000, ("40000.00", "M", 5),
        """purchase_date >= {as_of} - to_days(1000) AND (total_cost < 40000 OR total_cost = 40000 AND lower(product_name) > 'm')""",
        "total_cost DESC, lower(product_name)",
    ),
}


def _page(name: str) -> Report:
    sort, text, days, after, follows, order = PAGES[name]
    return Report(
        lambda x: purchasing.purchase_history_page(x.domain, AS_OF, sort, text, days, after),
        f"SELECT * FROM t_history WHERE {follows} ORDER BY {order}, purchase_item_id LIMIT 100", tables={"t_history": HISTORY},
    )


def _nested(x: Inputs):
    path = work_path(x.spark, "nested-orders")
    orders.store_orders_with_items(x.domain, path)
    return orders.items_of(orders.read_orders_with_items(x.spark, path))


HISTORY = """SELECT i.purchase_item_id, i.purchase_id, h.purchase_date, s.name AS supplier_name,
    w.name AS warehouse_name, p.name AS product_name, i.quantity::BIGINT AS quantity,
    i.unit_cost::DOUBLE AS unit_cost, (i.quantity * i.unit_cost)::DOUBLE AS total_cost
    FROM d_purchase AS h, d_purchase_item AS i, d_supplier AS s, d_warehouse AS w, d_product AS p
    WHERE i.purchase_id = h.purchase_id AND s.supplier_id = h.supplier_id
      AND w.warehouse_id = h.warehouse_id AND p.product_id = i.product_id"""

LISTED = """SELECT o.order_id, o.order_date, c.name AS customer_name,
    coalesce(string_agg(p.name || ' ×' || i.quantity, ', ' ORDER BY i.order_item_id, i.product_id), '-') AS items_label,
    coalesce(sum(i.quantity * i.unit_price), 0)::DOUBLE AS total,
    coalesce(min(l.platform), 'Direct') AS source, min(s.status) AS shipment_status
    FROM d_order AS o JOIN d_customer AS c USING (customer_id)
    LEFT JOIN d_order_item AS i ON i.order_id = o.order_id LEFT JOIN d_product AS p ON p.product_id = i.product_id
    LEFT JOIN d_order_attribution AS a ON a.order_id = o.order_id
    LEFT JOIN d_tracking_link AS l ON l.link_id = a.link_id
    LEFT JOIN s_latest AS s ON s.shipment_id = o.order_id GROUP BY o.order_id, o.order_date, c.name"""

REPORTS = {
    "purchase_history": Report(lambda x: purchasing.purchase_history(x.domain), HISTORY),
    "purchase_history_search": Report(
        lambda x: purchasing.purchase_history_search(x.domain, AS_OF, "ASIA", 365),
        """SELECT * FROM t_history WHERE purchase_date >= TIMESTAMP '2000-12-01 00:00:00'
           AND contains(lower(supplier_name || '|' || warehouse_name || '|' || product_name), 'asia')""",
        tables={"t_history": HISTORY},
    ),
    **{f"purchase_history_by_{name}": _page(name) for name in PAGES},
    "orders_with_items": Report(
        _nested,
        """SELECT order_id, order_date, c.name AS customer_name, sum(quantity * unit_price) OVER (PARTITION BY order_id)::DOUBLE AS total,
             row_number() OVER (PARTITION BY order_id ORDER BY order_item_id, product_id, p.name, quantity, unit_price) - 1 AS place,
             order_item_id, product_id, p.name AS name, quantity::BIGINT AS quantity, unit_price::DOUBLE AS unit_price
           FROM d_order JOIN d_customer AS c USING (customer_id) JOIN d_order_item USING (order_id) JOIN d_product AS p USING (product_id)""",
    ),
    "purchase_page": Report(
        _next_page,
        """SELECT * FROM t_history WHERE purchase_date < TIMESTAMP '2001-07-30 00:00:00'
           ORDER BY purchase_date DESC, purchase_item_id DESC LIMIT 100""",
        tables={"t_history": HISTORY},
    ),
    "purchase_stats": Report(
        lambda x: purchasing.purchase_stats(x.domain),
        """SELECT count(DISTINCT purchase_id) AS purchases, sum(quantity)::BIGINT AS units,
             sum(quantity * unit_cost)::DOUBLE AS spend, count(DISTINCT product_id) AS distinct_products
           FROM d_purchase_item""",
    ),
    "supplier_product_count": Report(
        lambda x: purchasing.supplier_product_count(x.domain),
        """SELECT s.supplier_id, s.name, (SELECT count(*) FROM d_product AS p WHERE p.supplier_id = s.supplier_id)
             AS product_count FROM d_supplier AS s""",
    ),
    "top_suppliers": Report(
        lambda x: purchasing.top_suppliers(x.domain),
        """SELECT s.supplier_id, s.name, count(*) AS product_count
           FROM d_supplier AS s JOIN d_product AS p USING (supplier_id) GROUP BY 1, 2
           ORDER BY product_count DESC, s.supplier_id LIMIT 5""",
    ),
    "duplicate_product_names": Report(
        lambda x: purchasing.duplicate_product_names(x.domain).drop("label"),
        """SELECT supplier_id, product_id, lower(name) AS normal_name, copies FROM (
             SELECT *, count(*) OVER (PARTITION BY supplier_id, lower(name)) AS copies FROM d_product) AS q
           WHERE copies > 1""",
    ),
    "product_choices": Report(
        lambda x: purchasing.product_choices(x.domain),
        """SELECT supplier_id, product_id, CASE WHEN copies = 1 THEN name
             ELSE name || ' (৳' || format('{{:,.2f}}', price::DOUBLE) || ', #' || product_id || ')' END AS label
           FROM (SELECT *, count(*) OVER (PARTITION BY supplier_id, lower(name)) AS copies FROM d_product) AS q""",
    ),
    "restock_worklist": Report(
        lambda x: purchasing.restock_worklist(x.domain),
        """SELECT i.product_id, p.name AS product_name, i.warehouse_id, i.quantity::BIGINT AS quantity, p.supplier_id,
             s.name AS supplier_name
           FROM d_inventory AS i JOIN d_product AS p USING (product_id) JOIN d_supplier AS s USING (supplier_id)
           WHERE i.quantity < 10""",
    ),
    "resolve_restock": Report(
        lambda x: purchasing.resolve_restock(x.domain, _restock_links(x)),
        """SELECT CASE WHEN product_id % 50 = 0 THEN -product_id ELSE product_id END AS product_id,
             asked::DOUBLE AS asked_supplier_id,
             (CASE WHEN product_id % 50 <> 0 THEN supplier_id END)::DOUBLE AS supplier_id,
             CASE WHEN product_id % 50 = 0 THEN 'unknown product' WHEN asked <> supplier_id THEN 'supplier corrected'
               ELSE 'ok' END AS outcome
           FROM (SELECT product_id, supplier_id, CASE product_id % 3 WHEN 0 THEN supplier_id WHEN 1 THEN supplier_id - 1
             END AS asked FROM d_product) AS q""",
        optional_ids=("asked_supplier_id", "supplier_id"),
    ),
    "product_margin": Report(
        lambda x: purchasing.product_margin(x.domain),
        """SELECT p.product_id, p.name, p.price::DOUBLE AS price, avg_cost::DOUBLE AS average_cost,
             (p.price - avg_cost)::DOUBLE AS margin
           FROM d_product AS p LEFT JOIN (SELECT product_id,
             CAST(CAST(sum(quantity * unit_cost * 1000) AS HUGEINT) // sum(quantity) AS DECIMAL(18,0)) AS milli
             FROM d_purchase_item GROUP BY 1) AS m USING (product_id),
             LATERAL (SELECT CAST((CAST(milli + 5 AS BIGINT) // 10) * 0.01 AS DECIMAL(18,2)) AS avg_cost) AS v""",
    ),
    "order_fulfilment": Report(
        lambda x: orders.order_fulfilment(x.domain),
        """SELECT o.order_id, o.order_date, c.name AS customer_name, s.tracking_code, p.location AS source_hub,
             w.warehouse_id::DOUBLE AS source_warehouse_id, coalesce(u.units, 0)::BIGINT AS units,
             l.status AS shipment_status
           FROM d_order AS o JOIN d_customer AS c USING (customer_id) LEFT JOIN d_shipment AS s USING (order_id)
           LEFT JOIN (SELECT shipment_id, location FROM d_shipment_status WHERE status = 'Packed') AS p USING (shipment_id)
           LEFT JOIN d_warehouse AS w ON w.name = p.location LEFT JOIN s_latest AS l USING (shipment_id)
           LEFT JOIN (SELECT order_id, sum(quantity) AS units FROM d_order_item GROUP BY 1) AS u USING (order_id)""",
        optional_ids=("source_warehouse_id",),
    ),
    "order_list": Report(lambda x: orders.order_list(x.domain), LISTED),
    "order_list_search": Report(
        lambda x: orders.order_list_search(x.domain, "2001-08-03 12:00:00", "1", 7),
        """SELECT * FROM t_listed WHERE order_date >= TIMESTAMP '2001-07-27 12:00:00'
           AND (contains(lower(customer_name), '1') OR contains(CAST(order_id AS VARCHAR), '1'))""",
        tables={"t_listed": LISTED},
    ),
    "order_list_items": Report(
        lambda x: orders.order_items_of(x.domain, orders.order_list(x.domain)),
        """SELECT o.order_id, i.order_item_id, p.name AS product_name, i.quantity::BIGINT AS quantity,
             i.unit_price::DOUBLE AS unit_price
           FROM d_order AS o JOIN d_order_item AS i USING (order_id) JOIN d_product AS p USING (product_id)""",
    ),
    "order_totals": Report(
        lambda x: orders.order_totals(x.domain),
        """SELECT order_id, sum(quantity)::BIGINT AS units, count(*) AS lines, sum(quantity * unit_price)::DOUBLE AS total
           FROM d_order_item GROUP BY order_id""",
    ),
    "recent_orders": Report(
        lambda x: orders.recent_orders(x.domain),
        """SELECT o.order_id, c.name AS customer_name, coalesce((SELECT sum(quantity * unit_price) FROM d_order_item AS i
             WHERE i.order_id = o.order_id), 0)::DOUBLE AS total, o.order_date
           FROM d_order AS o JOIN d_customer AS c USING (customer_id) ORDER BY o.order_date DESC, o.order_id DESC LIMIT 5""",
    ),
    "customer_orders": Report(
        lambda x: orders.customer_orders(x.domain),
        """SELECT c.customer_id, c.name, c.contact, count(o.order_id) AS order_count
           FROM d_customer AS c LEFT JOIN d_order AS o USING (customer_id) GROUP BY 1, 2, 3""",
    ),
    "customer_search": Report(
        lambda x: orders.customer_orders(x.domain, "012"),
        """SELECT c.customer_id, c.name, c.contact, count(o.order_id) AS order_count
           FROM d_customer AS c LEFT JOIN d_order AS o USING (customer_id)
           WHERE contains(c.name, '012') OR contains(c.contact, '012') GROUP BY 1, 2, 3""",
    ),
    "monthly_orders": Report(
        lambda x: orders.monthly_orders(x.domain),
        """SELECT CAST(CAST(date_trunc('month', order_date) AS DATE) AS VARCHAR) AS month, strftime(min(order_date), '%b %Y') AS label,
             count(*) AS orders FROM d_order GROUP BY 1""",
    ),
    "top_products": Report(
        lambda x: orders.top_products(x.domain),
        """SELECT p.name, sum(i.quantity)::BIGINT AS units, sum(i.quantity * i.unit_price)::DOUBLE AS revenue
           FROM d_order_item AS i JOIN d_product AS p USING (product_id) GROUP BY p.name
           ORDER BY sum(i.quantity * i.unit_price) DESC, p.name LIMIT 5""",
    ),
    "sorted_stock_page": Report(
        _sorted_stock_page,
        """SELECT i.product_id, i.warehouse_id, p.name AS product_name, i.quantity::BIGINT AS quantity
           FROM d_inventory AS i JOIN d_product AS p USING (product_id)
           ORDER BY lower(p.name) DESC NULLS LAST, i.product_id, i.warehouse_id LIMIT 100""",
    ),
    "latest_status": Report(
        lambda x: shipping.latest_status(x.domain),
        "SELECT shipment_id, status, location, updated_time FROM s_latest",
    ),
    "pending_shipments": Report(
        lambda x: shipping.pending_shipments(x.domain, "2001-12-01 06:00:00"),
        """SELECT shipment_id, tracking_code, datesub('day', shipment_date, TIMESTAMP '2001-12-01 06:00:00') AS days_pending
           FROM d_shipment AS s WHERE NOT EXISTS (SELECT 1 FROM d_shipment_status AS t
             WHERE t.shipment_id = s.shipment_id AND t.status = 'Delivered')""",
    ),
    "shipment_board": Report(
        lambda x: shipping.shipment_board(x.domain),
        """SELECT s.shipment_id, s.order_id, s.tracking_code, c.name AS customer_name, l.status,
             coalesce(l.updated_time, s.shipment_date) AS updated_time,
             CASE l.status WHEN 'Packed' THEN 'pending' WHEN 'Delivered' THEN 'delivered' ELSE 'transit' END AS bucket,
             CASE l.status WHEN 'Packed' THEN 'In Transit' WHEN 'In Transit' THEN 'Out For Delivery'
               WHEN 'Out For Delivery' THEN 'Delivered' END AS next_status
           FROM d_shipment AS s JOIN d_order AS o USING (order_id) JOIN d_customer AS c USING (customer_id)
           LEFT JOIN s_latest AS l USING (shipment_id)""",
    ),
    "shipment_timeline": Report(
        lambda x: shipping.shipment_timeline(x.domain),
        """SELECT s.tracking_code, step.position::BIGINT AS position, step.label AS step, f.updated_time AS reached_at,
             f.location, CASE WHEN l.status = step.label THEN 'current' WHEN f.shipment_id IS NOT NULL THEN 'done'
               ELSE '' END AS state
           FROM d_shipment AS s CROSS JOIN (VALUES (1, 'Packed'), (2, 'In Transit'), (3, 'Out For Delivery'),
             (4, 'Delivered')) AS step(position, label)
           LEFT JOIN (SELECT * FROM d_shipment_status QUALIFY row_number() OVER (PARTITION BY shipment_id, status
             ORDER BY updated_time, status_id) = 1) AS f ON f.shipment_id = s.shipment_id AND f.status = step.label
           LEFT JOIN s_latest AS l ON l.shipment_id = s.shipment_id""",
    ),
    "shipments_by_status": Report(
        lambda x: shipping.shipments_by_status(x.domain),
        """SELECT step.position::BIGINT AS position, step.label AS status, count(l.shipment_id) AS shipments
           FROM (VALUES (1, 'Packed'), (2, 'In Transit'), (3, 'Out For Delivery'), (4, 'Delivered')) AS step(position, label)
           LEFT JOIN s_latest AS l ON l.status = step.label GROUP BY 1, 2""",
    ),
    "recent_shipments": Report(
        lambda x: shipping.recent_shipments(x.domain),
        """SELECT s.tracking_code, s.order_id, l.status, s.shipment_date
           FROM d_shipment AS s LEFT JOIN s_latest AS l USING (shipment_id)
           ORDER BY s.shipment_date DESC, s.shipment_id DESC LIMIT 5""",
    ),
    "audit_search": Report(
        lambda x: shipping.audit_search(x.domain, "order", "INSERT"),
        "SELECT * FROM d_audit_log WHERE table_name = 'order' AND operation = 'INSERT'",
    ),
}
