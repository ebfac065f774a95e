"""ANSI SQL definitions of the derived domain tables, for checking results in another engine.

They state the derivations of ``sources.star`` a second time, independently of Spark."""

from __future__ import annotations

import re

HUBS = {"region": "(SELECT count(*) FROM region)", "supplier": "(SELECT count(*) FROM supplier)"}
SUPPLIERS = "(SELECT count(*) FROM supplier)"
AS_OF = "TIMESTAMP '2001-12-01 00:00:00'"

_LINE_ID = "(l_orderkey * 8 + l_linenumber) * 64 + CAST(l_quantity AS BIGINT)"
_IS_TRANSFER = "(l_returnflag = 'R' AND l_linestatus = 'F')"
_IS_PURCHASE = "(l_returnflag = 'A' OR (l_returnflag = 'R' AND l_linestatus = 'O'))"
_K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER)"

_WAREHOUSE = {
    "region": f"""SELECT r_regionkey + 1 AS warehouse_id, 'Hub ' || r_name AS name, r_name AS location,
        CAST({SUPPLIERS} * (1200 + 500 * r_regionkey) AS INTEGER) AS capacity_units FROM region""",
    "supplier": """SELECT s_suppkey + 1 AS warehouse_id, 'Hub ' || s_name AS name,
        'Nation ' || s_nationkey AS location,
        CAST(8000 + (s_suppkey * 1237) % 8000 AS INTEGER) AS capacity_units FROM supplier""",
}

_TABLES = {
    "d_supplier": """SELECT s_suppkey + 1 AS supplier_id, s_name AS name,
        '017' || lpad(CAST(s_suppkey AS VARCHAR), 8, '0') AS phone, 'Nation ' || s_nationkey AS address
        FROM supplier""",
    "d_product": """SELECT p_partkey + 1 AS product_id, p_partkey % {n} + 1 AS supplier_id, p_name AS name,
        p_type AS category, CAST(p_retailprice AS DECIMAL(10,2)) AS price FROM part""",
    "d_warehouse": "{warehouse}",
    "d_purchase": """SELECT o_orderkey + 1 AS purchase_id, o_custkey % {n} + 1 AS supplier_id,
        (o_orderkey * 3 + 1) % {h} + 1 AS warehouse_id, o_orderdate AS purchase_date FROM orders""",
    "d_purchase_item": f"""SELECT {_LINE_ID} AS purchase_item_id, l_orderkey + 1 AS purchase_id,
        l_partkey + 1 AS product_id, CAST(l_quantity AS INTEGER) AS quantity,
        CAST(floor(l_extendedprice / l_quantity) AS DECIMAL(10,2)) AS unit_cost
        FROM lineitem WHERE {_IS_PURCHASE}""",
    "d_stock_transfer": f"""SELECT {_LINE_ID} AS transfer_id, l_suppkey % {{h}} + 1 AS from_warehouse_id,
        (l_suppkey % {{h}} + 1 + l_orderkey % ({{h}} - 1)) % {{h}} + 1 AS to_warehouse_id,
        l_partkey + 1 AS product_id, CAST(l_quantity AS INTEGER) AS quantity, l_shipdate AS transfer_date,
        l_shipdate - to_days(CAST(l_linenumber * 30 AS INTEGER)) AS origin_date
        FROM lineitem WHERE {_IS_TRANSFER}""",
    "d_inventory": """SELECT warehouse_id * 10000000000 + product_id AS inventory_id, warehouse_id, product_id,
        CAST(greatest(sum(units), 0) AS INTEGER) AS quantity FROM (
          SELECT ((purchase_id - 1) * 3 + 1) % {h} + 1 AS warehouse_id, product_id, quantity AS units
          FROM d_purchase_item
          UNION ALL SELECT to_warehouse_id, product_id, quantity FROM d_stock_transfer
          UNION ALL SELECT from_warehouse_id, product_id, -quantity FROM d_stock_transfer
          UNION ALL SELECT (order_id - 1) % {h} + 1, product_id, -quantity FROM d_order_item
        ) AS moves GROUP BY warehouse_id, product_id""",
    "d_customer": """SELECT c_custkey + 1 AS customer_id, c_name AS name, CASE WHEN c_acctbal >= 0
        THEN '01' || lpad(CAST(c_custkey // 2 AS VARCHAR), 9, '0') END AS contact FROM customer""",
    "d_order": """SELECT o_orderkey + 1 AS order_id, o_custkey + 1 AS customer_id, o_orderdate AS order_date,
        'PLACED' AS status FROM orders""",
    "d_order_item": f"""SELECT {_LINE_ID} AS order_item_id, l_orderkey + 1 AS order_id,
        l_partkey + 1 AS product_id, CAST(l_quantity AS INTEGER) AS quantity,
        CAST(CAST(floor(l_extendedprice * 100 / l_quantity) AS DECIMAL(12,0)) * 0.01 AS DECIMAL(10,2)) AS unit_price
        FROM lineitem WHERE l_returnflag = 'N'""",
    "d_campaign": """SELECT s_suppkey + 1 AS campaign_id, s_suppkey + 1 AS product_id,
        'Push NATION_' || s_nationkey AS campaign_name,
        DATE '2001-01-01' + CAST(s_suppkey % 300 AS INTEGER) AS start_date,
        DATE '2001-01-01' + CAST(s_suppkey % 300 + 30 AS INTEGER) AS end_date FROM supplier
        UNION ALL SELECT {n} + r_regionkey + 1, r_regionkey + 1, 'Teaser ' || r_name, NULL, NULL FROM region""",
    "d_tracking_link": """SELECT s_suppkey * 4 + pos + 1 AS link_id, s_suppkey + 1 AS campaign_id, platform,
        prefix || '-' || (s_suppkey + 1) AS short_code,
        CASE WHEN s_suppkey % 2 = 0 THEN '/storefront/product.html?product=' || (s_suppkey + 1)
             ELSE '/shop/' || (s_suppkey + 1) END AS destination_url
        FROM supplier, (VALUES (0, 'Facebook', 'FB'), (1, 'Instagram', 'IG'), (2, 'WhatsApp', 'WA'),
                               (3, 'Email', 'EM')) AS channels(pos, platform, prefix)""",
    "d_click": f"""SELECT event_id AS click_id,
        ((user_id * 100 + {_K}) % {{n}}) * 4 + event_id % 4 + 1 AS link_id, ts AS click_time,
        CASE WHEN {_K} % 10 = 0 THEN NULL WHEN {_K} % 10 = 1 THEN ''
             ELSE 'NATION_' || ({_K} % 25) END AS country,
        CASE {_K} % 7 WHEN 0 THEN 'Mozilla/5.0 (Linux; Android 14; Pixel 8) Mobile'
             WHEN 1 THEN 'Mozilla/5.0 (iPhone; CPU OS 17)' WHEN 2 THEN 'Mozilla/5.0 (iPad; CPU OS 17)'
             WHEN 3 THEN 'Mozilla/5.0 (Windows NT 10.0)' WHEN 4 THEN 'iOS'
             WHEN 5 THEN 'Mozilla/5.0 (Linux; Android 13; tablet)'
             ELSE 'Mozilla/5.0 (Tablet; rv:109)' END AS device,
        CASE WHEN event_id % 4 = 3 THEN user_id + 1 END AS customer_id
        FROM events WHERE event_type = 'click'""",
    "d_order_attribution": """SELECT o_orderkey + 1 AS attribution_id, o_orderkey + 1 AS order_id,
        (o_custkey % {n}) * 4 + o_orderkey % 4 + 1 AS link_id, o_orderdate AS attributed_time
        FROM orders WHERE o_orderpriority = '1-URGENT'""",
    "d_shipment": """SELECT o_orderkey + 1 AS shipment_id, o_orderkey + 1 AS order_id,
        'TRK' || (o_orderkey + 1) AS tracking_code,
        o_orderdate + to_days(CAST(o_orderkey % 3 AS INTEGER)) AS shipment_date FROM orders""",
    "d_shipment_status": """SELECT o_orderkey * 4 + step + 4 AS status_id, o_orderkey + 1 AS shipment_id,
        CASE WHEN step >= 2 THEN 'Customer Area' WHEN o_orderkey % 89 = 0 THEN NULL
             WHEN o_orderkey % 97 = 0 THEN 'Multiple hubs' ELSE w.name END AS location, steps.status,
        o_orderdate + to_days(CAST(o_orderkey % 3 + step // 2 * 2 AS INTEGER)) AS updated_time
        FROM (SELECT *, ['Packed', 'In Transit', 'Out For Delivery', 'Delivered'][step + 1] AS status
          FROM (SELECT o_orderkey, o_orderdate, unnest(range(CASE WHEN o_orderstatus = 'F' THEN 4 WHEN o_orderstatus = 'O' THEN 2
                  WHEN o_orderpriority = '5-LOW' THEN 0 ELSE 1 END)) AS step FROM orders) AS s) AS steps
        JOIN d_warehouse AS w ON w.warehouse_id = o_orderkey % {h} + 1""",
    "d_audit_log": """SELECT event_id AS log_id,
        CASE user_id % 3 WHEN 0 THEN 'order' WHEN 1 THEN 'inventory' ELSE 'purchase' END AS table_name,
        CASE event_type WHEN 'view' THEN 'UPDATE' WHEN 'error' THEN 'DELETE' ELSE 'INSERT' END AS operation,
        user_id AS record_id, ts AS log_time FROM events WHERE event_type <> 'click'""",
    # ---- shared report steps ---------------------------------------------------------
    "s_lots": """SELECT h.warehouse_id, i.product_id, h.purchase_date AS received_date, i.quantity,
        'P' AS kind, i.purchase_item_id AS lot_id
        FROM d_purchase AS h, d_purchase_item AS i WHERE h.purchase_id = i.purchase_id
        UNION ALL SELECT to_warehouse_id, product_id, origin_date, quantity, 'T', transfer_id
        FROM d_stock_transfer""",
    "s_aged": """SELECT stacked.*, CASE WHEN days > 1800 THEN 3.0 WHEN days > 1200 THEN 2.0
          WHEN days > 600 THEN 1.5 ELSE 1.0 END AS factor FROM (
        SELECT lots.warehouse_id, lots.product_id, received_date,
          least(lots.quantity, stock.quantity - newer) AS units,
          greatest(datesub('day', received_date, {as_of}), 0) AS days
        FROM (SELECT *, coalesce(sum(quantity) OVER (PARTITION BY warehouse_id, product_id
                ORDER BY received_date DESC, kind DESC, lot_id DESC
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS newer FROM s_lots) AS lots
        JOIN d_inventory AS stock USING (warehouse_id, product_id)
        WHERE newer < stock.quantity) AS stacked""",
    "s_rate": """SELECT *, CAST(CASE WHEN capacity_units > 14000 THEN 1.50 WHEN capacity_units > 12000 THEN 2.00
        WHEN capacity_units > 9500 THEN 2.50 ELSE 3.00 END AS DECIMAL(10,2)) AS rate FROM d_warehouse""",
    "s_fill": """SELECT h.warehouse_id, h.name, h.location, h.capacity_units, coalesce(sum(quantity), 0) AS used
        FROM d_warehouse AS h LEFT JOIN d_inventory AS i USING (warehouse_id) GROUP BY ALL""",
    "s_capacity": """SELECT *, capacity_units - used AS free,
        round(CAST(used AS DECIMAL(20,4)) * 100 / capacity_units, 1) AS pct,
        CASE WHEN used > capacity_units THEN 'OVER' WHEN used * 10 >= capacity_units * 9 THEN 'CRITICAL'
             WHEN used * 4 >= capacity_units * 3 THEN 'HIGH' ELSE 'OK' END AS fill_status FROM s_fill""",
    "s_bill": """SELECT r.warehouse_id, r.name, r.rate, coalesce(f.used, 0) AS on_hand,
        coalesce(a.overdue, 0) AS overdue, coalesce(a.oldest, 0) AS oldest,
        coalesce(a.weighted, 0) + greatest(coalesce(f.used, 0) - coalesce(a.lotted, 0), 0) AS billable
        FROM s_rate AS r LEFT JOIN s_fill AS f USING (warehouse_id) LEFT JOIN (
          SELECT warehouse_id, sum(units) AS lotted, sum(units * factor) AS weighted,
                 sum(units) FILTER (WHERE days > 600) AS overdue, max(days) AS oldest
          FROM s_aged GROUP BY warehouse_id) AS a USING (warehouse_id)""",
    "s_candidates": """SELECT i.warehouse_id, i.product_id, i.quantity AS on_hand,
        coalesce(sum(a.units * (a.factor - 1)), 0) AS surcharge, coalesce(max(a.days), 0) AS oldest
        FROM d_inventory AS i LEFT JOIN s_aged AS a USING (warehouse_id, product_id) GROUP BY ALL""",
    "s_latest": """SELECT shipment_id, status, location, updated_time FROM d_shipment_status
        QUALIFY row_number() OVER (PARTITION BY shipment_id ORDER BY updated_time DESC, status_id DESC) = 1""",
    "s_attributed": """SELECT link_id, order_id, sum(quantity * unit_price) AS amount
        FROM d_order_attribution LEFT JOIN d_order_item USING (order_id) GROUP BY ALL""",
    "s_link": """SELECT l.*, (SELECT count(*) FROM d_click AS c WHERE c.link_id = l.link_id) AS clicks,
        (SELECT count(*) FROM s_attributed AS a WHERE a.link_id = l.link_id) AS orders,
        (SELECT coalesce(sum(amount), 0) FROM s_attributed AS a WHERE a.link_id = l.link_id) AS revenue
        FROM d_tracking_link AS l""",
    "s_moves": """SELECT warehouse_id, product_id, purchase_date AS moved_at, 'purchase' AS kind, quantity AS units
        FROM d_purchase JOIN d_purchase_item USING (purchase_id)
        UNION ALL SELECT to_warehouse_id, product_id, transfer_date, 'transfer in', quantity FROM d_stock_transfer
        UNION ALL SELECT from_warehouse_id, product_id, transfer_date, 'transfer out', -quantity FROM d_stock_transfer
        UNION ALL SELECT w.warehouse_id, i.product_id, o.order_date, 'order', -i.quantity
        FROM d_order_item AS i JOIN d_order AS o USING (order_id) JOIN d_shipment AS s USING (order_id)
        JOIN d_shipment_status AS p ON p.shipment_id = s.shipment_id AND p.status = 'Packed'
        JOIN d_warehouse AS w ON w.name = p.location""",
}


def with_tables(body: str, hub: str = "region", extra: dict[str, str] | None = None) -> str:
    """``body`` preceded by the definitions it needs, dependencies first."""
    texts = {**_TABLES, **(extra or {})}
    values = {"n": SUPPLIERS, "h": HUBS[hub], "warehouse": _WAREHOUSE[hub], "as_of": AS_OF}
    ordered: list[str] = []
    open_: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\b[a-z]_[a-z_]+\b", text):
            if name in texts and name not in ordered and name not in open_:
                open_.append(name)
                visit(texts[name])
                if name not in ordered:
                    ordered.append(name)

    visit(body)
    fill = lambda text: text.format(**values) if "{" in text else text
    # what is named more than once is computed once
    uses = lambda name: sum(len(re.findall(rf"\b{name}\b", text)) for text in [body, *(texts[t] for t in ordered)])
    how = lambda name: "MATERIALIZED " if (uses(name) > 1 or name == "s_latest") and name not in texts[name] else ""
    ctes = ",\n".join(f"{name} AS {how(name)}({fill(texts[name])})" for name in ordered)
    return (f"WITH RECURSIVE {ctes}\n" if ctes else "") + fill(body)
