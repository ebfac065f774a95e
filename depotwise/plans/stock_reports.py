"""Reports on stock age, capacity, rent, routing and movements."""

from __future__ import annotations

from pyspark.sql import functions as F

from depotwise.operators import routing, stock
from depotwise.plans.reports import Inputs, Report
from depotwise.sources.star import AGE_POLICY, AS_OF, RENT_POLICY


def _arrivals(x: Inputs):
    d = x.domain
    return d["purchase_item"].join(d["purchase"], "purchase_id").select("warehouse_id", "product_id", "quantity")


def _order_lines(x: Inputs):
    return x.domain["order_item"].select("order_item_id", "order_id", "product_id", "quantity")


def _product_requests(x: Inputs):
    return x.domain["product"].select(
        "product_id", (F.col("product_id") % 40 + 1).cast("int").alias("quantity")
    )


def _unrouted(x: Inputs):
    picked = routing.pick_source_warehouse(x.domain, _order_lines(x), AS_OF, AGE_POLICY)
    return routing.rejection_reasons(x.domain, picked.where(F.col("warehouse_id").isNull()))


RANKED = """SELECT i.order_item_id, i.order_id, i.product_id, i.quantity, c.warehouse_id,
    row_number() OVER (PARTITION BY i.order_item_id, i.order_id, i.product_id, i.quantity, i.unit_price
      ORDER BY c.surcharge DESC, c.oldest DESC, c.on_hand DESC, c.warehouse_id) AS place
    FROM d_order_item AS i LEFT JOIN s_candidates AS c
      ON c.product_id = i.product_id AND c.on_hand >= i.quantity"""

REPORTS = {
    "rent_rates": Report(
        lambda x: stock.rent_rates(x.domain, RENT_POLICY),
        """SELECT warehouse_id, name, capacity_units::BIGINT AS capacity_units, rate::DOUBLE AS rent_per_unit_day
           FROM s_rate""",
        hub="supplier",
    ),
    "all_lots": Report(
        lambda x: stock.all_lots(x.domain),
        """SELECT warehouse_id, product_id, received_date, quantity::BIGINT AS quantity, kind AS lot_kind, lot_id
           FROM s_lots""",
    ),
    "warehouse_stock_age": Report(
        lambda x: stock.warehouse_stock_age(x.domain, AS_OF, AGE_POLICY, RENT_POLICY),
        """SELECT a.warehouse_id::BIGINT AS warehouse_id, r.name AS warehouse_name, a.product_id,
             p.name AS product_name, a.received_date, a.units::BIGINT AS units, a.days::BIGINT AS days_stored,
             CASE factor WHEN 3.0 THEN 'Dead stock' WHEN 2.0 THEN 'Stale' WHEN 1.5 THEN 'Aging'
               ELSE 'Fresh' END AS age_band,
             factor::DOUBLE AS rent_multiplier, (a.units * r.rate * factor)::DECIMAL(20,2)::DOUBLE AS daily_rent
           FROM s_aged AS a JOIN s_rate AS r USING (warehouse_id)
           JOIN d_product AS p ON p.product_id = a.product_id""",
    ),
    "stock_age_summary": Report(
        lambda x: stock.stock_age_summary(x.domain, AS_OF, AGE_POLICY, RENT_POLICY),
        """SELECT a.warehouse_id::BIGINT AS warehouse_id, r.name AS warehouse_name,
             CASE WHEN days > 1800 THEN 'Dead stock' WHEN days > 1200 THEN 'Stale'
               WHEN days > 600 THEN 'Aging' ELSE 'Fresh' END AS age_band,
             count(*) AS lots, sum(units)::BIGINT AS units, max(days)::BIGINT AS oldest_days,
             sum((a.units * r.rate * factor)::DECIMAL(20,2))::DOUBLE AS daily_rent
           FROM s_aged AS a JOIN s_rate AS r USING (warehouse_id) GROUP BY 1, 2, 3""",
    ),
    "warehouse_capacity": Report(
        lambda x: stock.warehouse_capacity(x.domain),
        """SELECT warehouse_id, name, location, capacity_units::BIGINT AS capacity_units, used::BIGINT AS used_units,
             free::BIGINT AS free_units, pct::DOUBLE AS utilisation_pct, fill_status AS capacity_status
           FROM s_capacity""",
        hub="supplier",
    ),
    "warehouse_rent": Report(
        lambda x: stock.warehouse_rent(x.domain, AS_OF, AGE_POLICY, RENT_POLICY),
        """SELECT warehouse_id, name, rate::DOUBLE AS rent_per_unit_day, on_hand::BIGINT AS on_hand_units,
             overdue::BIGINT AS overdue_units, oldest::BIGINT AS oldest_days,
             (on_hand * rate)::DECIMAL(20,2)::DOUBLE AS base_daily_rent,
             ((billable - on_hand) * rate)::DECIMAL(20,2)::DOUBLE AS surcharge_daily_rent,
             (billable * rate)::DECIMAL(20,2)::DOUBLE AS total_daily_rent,
             (billable * rate * 30)::DECIMAL(20,2)::DOUBLE AS total_monthly_rent FROM s_bill""",
        hub="supplier",
    ),
    "warehouse_overview": Report(
        lambda x: stock.warehouse_overview(x.domain, AS_OF, AGE_POLICY, RENT_POLICY),
        """SELECT c.warehouse_id, c.name, c.location, c.capacity_units::BIGINT AS capacity_units,
             c.used::BIGINT AS used_units, c.free::BIGINT AS free_units, c.pct::DOUBLE AS utilisation_pct,
             c.fill_status AS capacity_status, b.rate::DOUBLE AS rent_per_unit_day,
             b.overdue::BIGINT AS overdue_units, b.oldest::BIGINT AS oldest_days,
             (on_hand * rate)::DECIMAL(20,2)::DOUBLE AS base_daily_rent,
             ((billable - on_hand) * rate)::DECIMAL(20,2)::DOUBLE AS surcharge_daily_rent,
             (billable * rate)::DECIMAL(20,2)::DOUBLE AS total_daily_rent,
             (billable * rate * 30)::DECIMAL(20,2)::DOUBLE AS total_monthly_rent
           FROM s_capacity AS c JOIN s_bill AS b USING (warehouse_id)""",
        hub="supplier",
    ),
    "pick_source_warehouse": Report(
        lambda x: routing.pick_source_warehouse(x.domain, _order_lines(x), AS_OF, AGE_POLICY),
        """SELECT order_item_id, order_id, product_id, quantity::BIGINT AS quantity, warehouse_id::DOUBLE AS warehouse_id
           FROM t_ranked WHERE place = 1""",
        tables={"t_ranked": RANKED},
        optional_ids=("warehouse_id",),
    ),
    "hub_routing_preview": Report(
        lambda x: routing.hub_routing_preview(x.domain, _product_requests(x), AS_OF, AGE_POLICY),
        """SELECT product_id, quantity::BIGINT AS quantity, warehouse_id, warehouse_name, on_hand::BIGINT AS on_hand,
             oldest::BIGINT AS oldest_days, surcharge::DOUBLE AS surcharge_units, pct::DOUBLE AS utilisation_pct,
             can_fulfil, can_fulfil AND place = 1 AS is_chosen
           FROM (SELECT c.product_id, c.product_id % 40 + 1 AS quantity, c.warehouse_id, f.name AS warehouse_name,
                   c.on_hand, c.oldest, c.surcharge, f.pct, c.on_hand >= c.product_id % 40 + 1 AS can_fulfil,
                   row_number() OVER (PARTITION BY c.product_id ORDER BY c.on_hand >= c.product_id % 40 + 1 DESC,
                     c.surcharge DESC, c.oldest DESC, c.on_hand DESC, c.warehouse_id) AS place
                 FROM s_candidates AS c JOIN s_capacity AS f USING (warehouse_id)) AS q""",
    ),
    "routing_rejections": Report(
        _unrouted,
        """SELECT r.order_item_id, r.order_id, r.product_id, r.quantity::BIGINT AS quantity,
             CAST(NULL AS DOUBLE) AS warehouse_id,
             CASE WHEN coalesce(t.units, 0) = 0 THEN 'no stock' WHEN t.units < r.quantity THEN 'insufficient stock'
               ELSE 'split across hubs' END AS reason
           FROM t_ranked AS r LEFT JOIN (SELECT product_id, sum(quantity) AS units FROM d_inventory
             GROUP BY product_id) AS t USING (product_id) WHERE r.place = 1 AND r.warehouse_id IS NULL""",
        tables={"t_ranked": RANKED},
        optional_ids=("warehouse_id",),
    ),
    "low_stock_by_hub": Report(
        lambda x: stock.low_stock_by_hub(x.domain),
        """SELECT i.product_id, p.name AS product_name, i.quantity::BIGINT AS quantity
           FROM d_inventory AS i, d_product AS p WHERE p.product_id = i.product_id AND i.quantity < 10""",
    ),
    "low_stock_by_product": Report(
        lambda x: stock.low_stock_by_product(x.domain, 100),
        """SELECT product_id, min(p.name) AS product_name, sum(i.quantity)::BIGINT AS quantity
           FROM d_inventory AS i JOIN d_product AS p USING (product_id) GROUP BY product_id
           HAVING sum(i.quantity) < 100""",
    ),
    "stock_levels": Report(
        lambda x: stock.stock_levels(x.domain),
        """SELECT i.product_id, i.warehouse_id, p.name AS product_name, p.category, w.name AS warehouse_name,
             i.quantity::BIGINT AS quantity, (SELECT max(h.purchase_date) FROM d_purchase AS h
               JOIN d_purchase_item AS b USING (purchase_id)
               WHERE h.warehouse_id = i.warehouse_id AND b.product_id = i.product_id) AS last_restock
           FROM d_inventory AS i JOIN d_product AS p USING (product_id) JOIN d_warehouse AS w USING (warehouse_id)""",
    ),
    "stock_search": Report(
        lambda x: stock.stock_levels(x.domain, " Ring").drop("last_restock"),
        """SELECT i.product_id, i.warehouse_id, p.name AS product_name, p.category, w.name AS warehouse_name,
             i.quantity::BIGINT AS quantity
           FROM d_inventory AS i JOIN d_product AS p USING (product_id) JOIN d_warehouse AS w USING (warehouse_id)
           WHERE contains(lower(p.name), 'ring') OR contains(lower(w.name), 'ring')""",
    ),
    "inventory_kpis": Report(
        lambda x: stock.inventory_kpis(x.domain),
        """SELECT (SELECT count(*) FROM d_product) AS products, sum(quantity)::BIGINT AS total_stock,
             count(*) FILTER (WHERE quantity < 10) AS low_rows,
             count(*) FILTER (WHERE quantity = 0) AS out_of_stock_rows FROM d_inventory""",
    ),
    "catalog_stock": Report(
        lambda x: stock.catalog_stock(x.domain),
        """SELECT p.product_id, p.name, coalesce(nullif(p.category, ''), 'Product') AS category,
             p.price::DOUBLE AS price, coalesce(sum(i.quantity), 0)::BIGINT AS stock,
             coalesce(sum(i.quantity), 0) > 0 AS in_stock
           FROM d_product AS p LEFT JOIN d_inventory AS i USING (product_id) GROUP BY ALL""",
    ),
    "transfer_log": Report(
        lambda x: stock.transfer_log(x.domain),
        """SELECT t.transfer_id, a.name AS from_hub, b.name AS to_hub, p.name AS product_name,
             t.quantity::BIGINT AS quantity, t.transfer_date, t.origin_date,
             datesub('day', t.origin_date, t.transfer_date) AS days_at_move
           FROM d_stock_transfer AS t, d_warehouse AS a, d_warehouse AS b, d_product AS p
           WHERE a.warehouse_id = t.from_warehouse_id AND b.warehouse_id = t.to_warehouse_id
             AND p.product_id = t.product_id""",
    ),
    "hub_flow": Report(
        lambda x: stock.hub_flow(x.domain),
        """SELECT warehouse_id, kind, count(*) AS moves, sum(units)::BIGINT AS units,
             CASE WHEN sum(units) < 0 THEN 'out' ELSE 'in' END AS direction FROM s_moves GROUP BY 1, 2""",
    ),
    "movement_balance": Report(
        lambda x: stock.movement_balance(x.domain),
        """SELECT warehouse_id, product_id, day::VARCHAR AS day, net::BIGINT AS net_units, sum(net) OVER (
             PARTITION BY warehouse_id, product_id ORDER BY day)::BIGINT AS balance
           FROM (SELECT warehouse_id, product_id, CAST(moved_at AS DATE) AS day, sum(units) AS net
                 FROM s_moves GROUP BY 1, 2, 3) AS daily""",
    ),
    "ledger_reconciliation": Report(
        lambda x: stock.ledger_reconciliation(x.domain),
        """SELECT warehouse_id, product_id, coalesce(i.quantity, 0)::BIGINT AS snapshot_units,
             coalesce(m.units, 0)::BIGINT AS ledger_units,
             (coalesce(i.quantity, 0) - coalesce(m.units, 0))::BIGINT AS difference
           FROM d_inventory AS i FULL JOIN (SELECT warehouse_id, product_id, sum(units) AS units
             FROM s_moves GROUP BY 1, 2) AS m USING (warehouse_id, product_id)
           WHERE coalesce(i.quantity, 0) <> coalesce(m.units, 0)""",
    ),
    "capacity_headroom": Report(
        lambda x: stock.capacity_headroom(x.domain, _arrivals(x)),
        """SELECT f.warehouse_id, f.name, f.capacity_units::BIGINT AS capacity_units, f.used::BIGINT AS used_units,
             greatest(f.capacity_units - f.used, 0)::BIGINT AS free_units, sum(i.quantity)::BIGINT AS incoming_units,
             f.used + sum(i.quantity) <= f.capacity_units AS fits
           FROM s_fill AS f JOIN d_purchase AS h USING (warehouse_id) JOIN d_purchase_item AS i USING (purchase_id)
           GROUP BY f.warehouse_id, f.name, f.capacity_units, f.used""",
        hub="supplier",
    ),
}
