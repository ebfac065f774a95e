"""Reports of the order path: order lines served one after another, and carts checked out as a whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depotwise.operators import allocation, checkout
from depotwise.plans.mutation_reports import EV
from depotwise.plans.reports import Inputs, Report
from depotwise.sources.star import AGE_POLICY, AS_OF, StarTables


def _allocated(x: Inputs):
    d = x.domain
    lines = d["order_item"].join(d["order"].select("order_id", "order_date"), "order_id")
    return allocation.allocate_orders(d, lines, AS_OF, AGE_POLICY)


def carts(x: Inputs) -> tuple[DataFrame, DataFrame]:
    """A cart of one to three lines for every purchase event, of a twentieth of the products, so that many
    carts want the same stock. Some name an unknown customer, link or product, or no units."""
    t = StarTables(x.spark, x.root)
    bought = t("events").where(F.col("event_type") == "purchase")
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    events = bought.select(F.col("event_id").alias("request_id"), "user_id", F.col("ts").alias("requested_at"), k.alias("k"))
    link = ((F.col("user_id") * 100 + F.col("k")) % t.count("supplier")) * 4 + F.col("request_id") % 4 + 1
    requests = events.select(
        "request_id", F.when(F.col("k") == 11, -1).otherwise(F.col("user_id") + 1).alias("customer_id"),
        F.when(F.col("k") % 3 == 0, F.lit(None)).when(F.col("k") == 7, -1).otherwise(link).alias("link_id"), "requested_at",
    )
    wanted = max(t.count("part") // 20, 1)
    line = F.explode(F.sequence(F.lit(0), (F.col("request_id") % 3).cast("int"))).alias("line_no")
    lines = events.select("request_id", "k", line).select(
        "request_id", "line_no",
        F.when((F.col("k") == 5) & (F.col("line_no") == 1), -1)
        .otherwise((F.col("request_id") * 37 + F.col("k") + F.col("line_no") * 13) % wanted + 1).alias("product_id"),
        ((F.col("k") * 7 + F.col("line_no")) % 45).alias("quantity"),
    )
    return requests, lines


def _checkout(x: Inputs) -> checkout.Checkout:
    return checkout.checkout(x.domain, *carts(x), AS_OF, AGE_POLICY)


def _sold(x: Inputs) -> DataFrame:
    """Every item of the new orders with its order, attribution and shipment."""
    made = _checkout(x)
    shipped = made.shipments.join(made.statuses, "shipment_id").select(
        "shipment_id", "order_id", "tracking_code", "shipment_date", "status_id", "location", F.col("status").alias("shipment_status")
    )
    return (
        made.orders.join(made.items, "order_id")
        .join(made.attributions.drop("attributed_time"), "order_id", "left")
        .join(shipped, "order_id")
    )


# What is left of hub w of a product after `taken` units, as (surcharge, oldest lot, units, lowest id first).
_RANK = """(coalesce(sum(l.extra * (l.units - least(greatest(greatest({taken} - h.loose, 0) - (l.upto - l.units), 0), l.units))), 0),
        coalesce(max(l.days) FILTER (l.upto > greatest({taken} - h.loose, 0)), 0), h.quantity - {taken}, -h.warehouse_id)"""

TABLES = {
    "e_events": EV,
    "o_lots": """SELECT warehouse_id, product_id, days, extra, units, sum(units) OVER (PARTITION BY warehouse_id, product_id
          ORDER BY days DESC)::BIGINT AS upto
        FROM (SELECT warehouse_id, product_id, days, ((factor - 1) * 10)::BIGINT AS extra, sum(units)::BIGINT AS units FROM s_aged GROUP BY ALL) AS q""",
    "o_hubs": """SELECT i.warehouse_id, i.product_id, i.quantity::BIGINT AS quantity, (i.quantity - coalesce(max(l.upto), 0))::BIGINT AS loose
        FROM d_inventory AS i LEFT JOIN o_lots AS l USING (warehouse_id, product_id) WHERE i.quantity > 0
        GROUP BY i.warehouse_id, i.product_id, i.quantity""",
    "o_totals": "SELECT product_id, sum(quantity)::BIGINT AS total FROM o_hubs GROUP BY 1",
    # lines of d_order_item in turn, all products at the same time
    "o_lines": """SELECT order_item_id, order_id, product_id, quantity, row_number() OVER (PARTITION BY product_id
          ORDER BY order_date, order_id, order_item_id, quantity) AS nth
        FROM d_order_item JOIN d_order USING (order_id)""",
    "o_served": f"""SELECT product_id, CAST(0 AS BIGINT) AS nth, list_transform(range({{h}}), lambda i: CAST(0 AS BIGINT)) AS taken,
          CAST(NULL AS BIGINT) AS hub, CAST(NULL AS VARCHAR) AS reason
        FROM (SELECT DISTINCT product_id FROM o_lines) AS q
        UNION ALL SELECT product_id, nth, CASE WHEN hub IS NULL THEN taken
            ELSE list_transform(taken, lambda u, i: u + CASE WHEN i = hub THEN quantity ELSE 0 END) END, hub,
          CASE WHEN hub IS NOT NULL THEN NULL WHEN total = list_sum(taken) THEN 'no stock'
               WHEN total - list_sum(taken) < quantity THEN 'insufficient stock' ELSE 'split across hubs' END
        FROM (SELECT product_id, nth, any_value(taken) AS taken, any_value(quantity) AS quantity, any_value(total) AS total,
                arg_max(warehouse_id, rank) AS hub
              FROM (SELECT s.product_id, n.nth, s.taken, n.quantity, coalesce(t.total, 0) AS total, h.warehouse_id,
                      CASE WHEN h.warehouse_id IS NOT NULL THEN {_RANK.format(taken="s.taken[h.warehouse_id]")} END AS rank
                    FROM o_served AS s JOIN o_lines AS n ON n.product_id = s.product_id AND n.nth = s.nth + 1
                    LEFT JOIN o_totals AS t ON t.product_id = s.product_id
                    LEFT JOIN o_hubs AS h ON h.product_id = s.product_id AND h.quantity - s.taken[h.warehouse_id] >= n.quantity
                    LEFT JOIN o_lots AS l ON l.product_id = h.product_id AND l.warehouse_id = h.warehouse_id
                    GROUP BY s.product_id, n.nth, s.taken, n.quantity, t.total, h.warehouse_id, h.quantity, h.loose) AS ranked
              GROUP BY product_id, nth) AS chosen""",
    # carts, and their sound lines in one sequence
    "c_wanted": "SELECT greatest(count(*) // 20, 1) AS wanted FROM part",
    "c_requests": """SELECT event_id AS request_id, ts, CASE WHEN k = 11 THEN -1 ELSE user_id + 1 END AS customer_id,
          CASE WHEN k % 3 = 0 THEN NULL WHEN k = 7 THEN -1 ELSE ((user_id * 100 + k) % {n}) * 4 + event_id % 4 + 1 END AS link_id
        FROM e_events WHERE event_type = 'purchase'""",
    "c_lines": """SELECT event_id AS request_id, line_no, CASE WHEN k = 5 AND line_no = 1 THEN -1
            ELSE (event_id * 37 + k + line_no * 13) % wanted + 1 END AS product_id, (k * 7 + line_no) % 45 AS quantity
        FROM (SELECT *, unnest(range(event_id % 3 + 1)) AS line_no FROM e_events WHERE event_type = 'purchase') AS e, c_wanted""",
    "c_bad": """SELECT request_id, coalesce(line_reason, CASE WHEN customer_id < 0 THEN 'unknown customer'
            WHEN link_id < 0 THEN 'unknown link' END) AS reason
        FROM c_requests JOIN (SELECT request_id, arg_min(reason, line_no) AS line_reason
          FROM (SELECT *, CASE WHEN product_id < 0 THEN 'unknown product' WHEN quantity = 0 THEN 'quantity not positive' END AS reason
                FROM c_lines) AS q GROUP BY 1) AS f USING (request_id)""",
    "c_turns": """SELECT request_id, line_no, product_id, quantity, row_number() OVER (ORDER BY ts, request_id, line_no) AS n,
          line_no = 0 AS opens
        FROM c_lines JOIN c_requests USING (request_id) JOIN c_bad USING (request_id) WHERE reason IS NULL""",
    # taken: of each (product, hub); kept: the same before the order that is being served; reason: why that order has failed
    "c_served": f"""SELECT CAST(0 AS BIGINT) AS n, list_transform(range(wanted * {{h}}), lambda i: CAST(0 AS BIGINT)) AS taken,
          list_transform(range(wanted * {{h}}), lambda i: CAST(0 AS BIGINT)) AS kept, CAST(NULL AS VARCHAR) AS reason, CAST(NULL AS BIGINT) AS hub
        FROM c_wanted
        UNION ALL SELECT n, CASE WHEN reason IS NOT NULL THEN base WHEN hub IS NULL THEN kept
            ELSE list_transform(base, lambda u, i: u + CASE WHEN i = place + hub THEN quantity ELSE 0 END) END, kept,
          CASE WHEN reason IS NOT NULL THEN reason WHEN hub IS NOT NULL THEN NULL WHEN left_over = 0 THEN 'no stock'
               WHEN left_over < quantity THEN 'insufficient stock' ELSE 'split across hubs' END, hub
        FROM (SELECT n, any_value(base) AS base, any_value(kept) AS kept, any_value(reason) AS reason, any_value(quantity) AS quantity,
                any_value(place) AS place, any_value(left_over) AS left_over, arg_max(warehouse_id, rank) AS hub
              FROM (SELECT q.n, q.base, q.kept, q.reason, q.quantity, q.place, h.warehouse_id,
                      coalesce(t.total, 0) - list_sum(list_slice(q.base, q.place + 1, q.place + {{h}})) AS left_over,
                      CASE WHEN h.warehouse_id IS NOT NULL THEN {_RANK.format(taken="q.base[q.place + h.warehouse_id]")} END AS rank
                    FROM (SELECT e.n, e.product_id, e.quantity, (e.product_id - 1) * {{h}} AS place, s.taken AS base,
                            CASE WHEN e.opens THEN s.taken ELSE s.kept END AS kept, CASE WHEN NOT e.opens THEN s.reason END AS reason
                          FROM c_served AS s JOIN c_turns AS e ON e.n = s.n + 1) AS q
                    LEFT JOIN o_totals AS t ON t.product_id = q.product_id
                    LEFT JOIN o_hubs AS h ON h.product_id = q.product_id AND h.quantity - q.base[q.place + h.warehouse_id] >= q.quantity
                    LEFT JOIN o_lots AS l ON l.product_id = h.product_id AND l.warehouse_id = h.warehouse_id
                    GROUP BY q.n, q.base, q.kept, q.reason, q.quantity, q.place, t.total, h.warehouse_id, h.quantity, h.loose) AS ranked
              GROUP BY n) AS chosen""",
    "c_outcome": """SELECT t.request_id, t.line_no, t.product_id, t.quantity, s.hub, max(s.reason) OVER (PARTITION BY t.request_id) AS failed
        FROM c_turns AS t JOIN c_served AS s USING (n)""",
    "c_failed": "SELECT DISTINCT request_id, failed FROM c_outcome WHERE failed IS NOT NULL",
    "c_placed": """SELECT r.*, (SELECT max(order_id) FROM d_order) + row_number() OVER (ORDER BY ts, request_id) AS order_id,
          row_number() OVER (ORDER BY ts, request_id) AS nth
        FROM c_requests AS r WHERE request_id IN (SELECT request_id FROM c_outcome WHERE failed IS NULL)""",
    "c_stamps": """SELECT request_id, CASE WHEN min(hub) = max(hub) THEN min(w.name) ELSE 'Multiple hubs' END AS location
        FROM c_outcome AS o JOIN d_warehouse AS w ON w.warehouse_id = o.hub WHERE failed IS NULL GROUP BY 1""",
    "c_attributed": """SELECT request_id, (SELECT max(attribution_id) FROM d_order_attribution) + row_number() OVER (ORDER BY order_id)
          AS attribution_id FROM c_placed WHERE link_id IS NOT NULL""",
}


def _report(build, sql: str, optional_ids: tuple[str, ...] = ()) -> Report:
    return Report(build, sql, tables=TABLES, optional_ids=optional_ids)


REPORTS = {
    "allocate_orders": _report(
        lambda x: _allocated(x).lines,
        """SELECT order_item_id, order_id, product_id, quantity::BIGINT AS quantity, hub::DOUBLE AS warehouse_id, reason
           FROM o_served JOIN o_lines USING (product_id, nth)""",
        optional_ids=("warehouse_id",),
    ),
    "allocate_orders_inventory": _report(
        lambda x: _allocated(x).inventory,
        """SELECT inventory_id, i.warehouse_id, i.product_id, i.quantity - coalesce(units, 0)::BIGINT AS quantity FROM d_inventory AS i
           LEFT JOIN (SELECT hub AS warehouse_id, product_id, sum(quantity) AS units FROM o_served JOIN o_lines USING (product_id, nth)
             WHERE hub IS NOT NULL GROUP BY 1, 2) AS s USING (warehouse_id, product_id)""",
    ),
    "checkout": _report(
        _sold,
        """SELECT p.order_id, customer_id, ts AS order_date, 'PLACED' AS status, (SELECT max(order_item_id) FROM d_order_item)
             + row_number() OVER (ORDER BY p.order_id, line_no) AS order_item_id, product_id, quantity::BIGINT AS quantity,
             price::DOUBLE AS unit_price, attribution_id::DOUBLE AS attribution_id, link_id::DOUBLE AS link_id,
             (SELECT max(shipment_id) FROM d_shipment) + nth AS shipment_id, 'TRK' || ((SELECT max(shipment_id) FROM d_shipment) + nth) AS tracking_code,
             ts AS shipment_date, (SELECT max(status_id) FROM d_shipment_status) + nth AS status_id, location, 'Packed' AS shipment_status
           FROM c_placed AS p JOIN c_outcome USING (request_id) JOIN d_product USING (product_id) JOIN c_stamps USING (request_id)
           LEFT JOIN c_attributed USING (request_id)""",
        optional_ids=("attribution_id", "link_id"),
    ),
    "checkout_inventory": _report(
        lambda x: _checkout(x).inventory,
        """SELECT inventory_id, i.warehouse_id, i.product_id, i.quantity - coalesce(units, 0)::BIGINT AS quantity FROM d_inventory AS i
           LEFT JOIN (SELECT hub AS warehouse_id, product_id, sum(quantity) AS units FROM c_outcome WHERE failed IS NULL GROUP BY 1, 2)
             AS s USING (warehouse_id, product_id)""",
    ),
    "checkout_rejected": _report(
        lambda x: _checkout(x).rejected,
        """SELECT request_id AS key, reason FROM c_bad WHERE reason IS NOT NULL
           UNION ALL SELECT request_id, failed FROM c_failed""",
    ),
}
