"""Reports of what batches of requests, derived from the event table, would write."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depotwise.operators import mutations, routing
from depotwise.plans.reports import Inputs, Report
from depotwise.policy import PLATFORMS
from depotwise.sources.star import AGE_POLICY, AS_OF, StarTables

NEW_CUSTOMERS = 10_000_000


def _events(x: Inputs, kind: str) -> DataFrame:
    rows = StarTables(x.spark, x.root)("events").where(F.col("event_type") == kind)
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    return rows.select("event_id", "user_id", "ts", k.alias("k"))


def order_requests(x: Inputs) -> DataFrame:
    t = StarTables(x.spark, x.root)
    link = ((F.col("user_id") * 100 + F.col("k")) % t.count("supplier")) * 4 + F.col("event_id") % 4 + 1
    return _events(x, "purchase").select(
        F.col("event_id").alias("request_id"),
        F.when(F.col("k") == 11, -1).otherwise(F.col("user_id") + 1).alias("customer_id"),
        F.when(F.col("k") % 3 == 0, F.lit(None)).when(F.col("k") == 7, -1).otherwise(link).alias("link_id"),
        F.when(F.col("k") == 5, -1)
        .otherwise((F.col("event_id") * 37 + F.col("k")) % t.count("part") + 1)
        .alias("product_id"),
        (F.col("k") % 6).alias("quantity"),
        F.col("ts").alias("requested_at"),
    )


def purchase_requests(x: Inputs) -> DataFrame:
    t = StarTables(x.spark, x.root)
    product = (F.col("event_id") * 37 + F.col("k")) % t.count("part")
    return _events(x, "purchase").select(
        F.col("event_id").alias("request_id"),
        (product % t.count("supplier") + 1 + F.when(F.col("k") % 10 == 3, 1).otherwise(0)).alias("supplier_id"),
        (F.col("event_id") % 6 + 1).alias("warehouse_id"),
        (product + 1).alias("product_id"),
        (F.col("k") % 20).alias("quantity"),
        (F.col("k") - 2).cast("decimal(10,2)").alias("unit_cost"),
        F.col("ts").alias("requested_at"),
    )


def purchase_orders(x: Inputs) -> tuple[DataFrame, DataFrame]:
    """A purchase of one to four lines for every purchase event, all of its supplier but for some."""
    t = StarTables(x.spark, x.root)
    suppliers, products = t.count("supplier"), t.count("part")
    supplier = (F.col("user_id") * 7 + F.col("k")) % suppliers
    requests = _events(x, "purchase").withColumn("supplier", supplier)
    line = F.explode(F.sequence(F.lit(0), (F.col("event_id") % 4).cast("int"))).alias("line_no")
    first = F.col("supplier") + suppliers * ((F.col("event_id") + F.col("line_no")) % max(products // suppliers, 1))
    lines = requests.select("event_id", "k", "supplier", line).select(
        F.col("event_id").alias("request_id"), "line_no",
        (first + F.when((F.col("k") % 10 == 3) & (F.col("line_no") == 1), 1).otherwise(0) + 1).alias("product_id"),
        ((F.col("k") + F.col("line_no") * 5) % 50 * 4).alias("quantity"), (F.col("k") - 2).cast("decimal(10,2)").alias("unit_cost"),
    )
    return requests.select(
        F.col("event_id").alias("request_id"), (F.col("supplier") + 1).alias("supplier_id"), (F.col("event_id") % 6 + 1).alias("warehouse_id"), F.col("ts").alias("requested_at")
    ), lines


def _ordered(x: Inputs) -> DataFrame:
    made = mutations.place_purchase_orders(x.domain, *purchase_orders(x))
    return made.purchases.join(made.items, "purchase_id")


def _placed(x: Inputs) -> DataFrame:
    made = mutations.place_orders(x.domain, order_requests(x))
    attributed = made.attributions.select("order_id", "link_id")
    return (
        made.orders.join(made.items, "order_id")
        .join(attributed, "order_id", "left")
        .select("order_id", "customer_id", "order_date", "product_id", "quantity", "unit_price", "link_id")
    )


def _purchased(x: Inputs) -> DataFrame:
    made = mutations.place_purchases(x.domain, purchase_requests(x))
    return made.purchases.join(made.items, "purchase_id").drop("purchase_item_id")


def transfer_requests(x: Inputs) -> DataFrame:
    """Two moves per stock row to the next hub; every tenth product asks for too much, and some
    requests are malformed."""
    hubs = StarTables(x.spark, x.root).count("region")
    moves = F.array(
        F.struct(F.lit(0).alias("turn"), F.expr("quantity div 2").alias("units")),
        F.struct(F.lit(1).alias("turn"), F.expr("CASE WHEN product_id % 10 = 0 THEN quantity ELSE quantity div 3 END").alias("units")),
    )
    return (
        x.domain["inventory"]
        .select("inventory_id", "warehouse_id", "product_id", F.inline(moves))
        .select(
            (F.col("inventory_id") * 2 + F.col("turn")).alias("request_id"),
            "product_id",
            F.col("warehouse_id").alias("from_warehouse_id"),
            F.when(F.col("product_id") % 23 == 0, F.col("warehouse_id"))
            .otherwise(F.col("warehouse_id") % hubs + 1)
            .alias("to_warehouse_id"),
            F.col("units").alias("quantity"),
        )
    )


def _reversal(x: Inputs):
    x = x.stored("inventory")
    return mutations.reverse_purchases(x.domain, x.domain["purchase"])


def _transfers(x: Inputs):
    x = x.stored("inventory")
    return mutations.transfer_stock(x.domain, transfer_requests(x), AS_OF)


def _allocation(x: Inputs) -> DataFrame:
    lines = x.domain["order_item"].select("order_item_id", "order_id", "product_id", "quantity")
    return routing.pick_source_warehouse(x.domain, lines, AS_OF, AGE_POLICY)


def new_campaigns(x: Inputs) -> DataFrame:
    chosen = F.slice(F.array(*[F.lit(p) for p in PLATFORMS]), 1, (F.col("product_id") % 5).cast("int"))
    return x.domain["product"].select(
        (F.col("product_id") + 1_000_000).alias("campaign_id"), "product_id", chosen.alias("platforms")
    )


def guest_requests(x: Inputs) -> DataFrame:
    """Check-outs: two thirds give a contact that may be known, the rest a new one."""
    known = F.concat(F.lit("01"), F.lpad(F.col("user_id").cast("string"), 9, "0"))
    new = F.concat(F.lit("09"), F.lpad((F.col("user_id") * 7 + F.col("k") % 4).cast("string"), 9, "0"))
    return _events(x, "signup").select(
        F.col("event_id").alias("request_id"),
        F.concat(F.lit(" Guest "), F.col("event_id").cast("string")).alias("name"),
        F.when(F.col("k") % 3 == 0, new).otherwise(known).alias("contact"),
    )


def _audited(x: Inputs) -> DataFrame:
    """Two whole inventories: all purchases have arrived again, every row has a twin that went and one that came."""
    stock = x.domain["inventory"]
    twins = lambda shift: stock.withColumn("inventory_id", F.col("inventory_id") + shift)
    after = mutations.apply_purchases(x.domain, x.domain["purchase"])
    return mutations.audit_diff(
        stock.unionByName(twins(10**12)), after.unionByName(twins(2 * 10**12)), "inventory_id", "inventory", AS_OF
    )


def _edited(x: Inputs):
    d = x.domain
    edits = d["customer"].where(F.col("customer_id") % 4 == 0).select(
        "customer_id", F.concat(F.lit(" "), F.upper("name")).alias("name"), F.lit("  ").alias("contact")
    )
    deletes = d["customer"].where(F.col("customer_id") % 3 == 0).select("customer_id")
    # every id from this on is of a customer without orders or clicks
    new = d["customer"].select((F.col("customer_id") + NEW_CUSTOMERS).alias("customer_id"), "name", "contact")
    deletes = deletes.unionByName(new.where(F.col("customer_id") % 2 == 0).select("customer_id"))
    d = d.replace(customer=d["customer"].unionByName(new))
    return mutations.edit_customers(d, edits, deletes)


EV = "SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events"
MUTATION_TABLES = {
    "e_events": EV,
    "e_orders": """SELECT *, CASE WHEN price IS NULL THEN 'unknown product' WHEN quantity <= 0 THEN 'quantity not positive'
          WHEN customer_id < 0 THEN 'unknown customer' WHEN link_id < 0 THEN 'unknown link' END AS reason FROM (
        SELECT event_id AS request_id, ts, CASE WHEN k = 11 THEN -1 ELSE user_id + 1 END AS customer_id,
          CASE WHEN k % 3 = 0 THEN NULL WHEN k = 7 THEN -1
            ELSE ((user_id * 100 + k) % {n}) * 4 + event_id % 4 + 1 END AS link_id,
          CASE WHEN k = 5 THEN -1 ELSE (event_id * 37 + k) % (SELECT count(*) FROM part) + 1 END AS product_id,
          k % 6 AS quantity FROM e_events WHERE event_type = 'purchase') AS q LEFT JOIN d_product USING (product_id)""",
    "e_placed": """SELECT *, (SELECT max(order_id) FROM d_order) + row_number() OVER (ORDER BY ts, request_id) AS order_id
        FROM e_orders WHERE reason IS NULL""",
    "e_buys": """SELECT q.*, CASE WHEN warehouse_id = 6 THEN 'unknown hub'
          WHEN supplier_id <> (product_id - 1) % {n} + 1 THEN 'product of another supplier'
          WHEN quantity <= 0 THEN 'quantity not positive' WHEN unit_cost < 0 THEN 'negative cost' END AS reason FROM (
        SELECT event_id AS request_id, ts, p % {n} + 1 + CASE WHEN k % 10 = 3 THEN 1 ELSE 0 END AS supplier_id,
          event_id % 6 + 1 AS warehouse_id, p + 1 AS product_id, k % 20 AS quantity, k - 2 AS unit_cost
        FROM (SELECT *, (event_id * 37 + k) % (SELECT count(*) FROM part) AS p FROM e_events
              WHERE event_type = 'purchase') AS e) AS q""",
    "e_recent": """SELECT purchase_id, warehouse_id, product_id, sum(quantity) AS units FROM d_purchase
        JOIN d_purchase_item USING (purchase_id) GROUP BY 1, 2, 3""",
    "e_bought": """SELECT *, row_number() OVER (PARTITION BY warehouse_id ORDER BY ts, request_id) AS nth
        FROM e_buys WHERE reason IS NULL""",
    "e_filled": """SELECT warehouse_id, CAST(0 AS BIGINT) AS nth, CAST(NULL AS BIGINT) AS request_id, CAST(used AS BIGINT) AS used,
          true AS fits, capacity_units FROM s_fill
        UNION ALL SELECT b.warehouse_id, b.nth, b.request_id,
          CASE WHEN r.used + b.quantity <= r.capacity_units THEN r.used + b.quantity ELSE r.used END,
          r.used + b.quantity <= r.capacity_units, r.capacity_units
        FROM e_filled AS r JOIN e_bought AS b ON b.warehouse_id = r.warehouse_id AND b.nth = r.nth + 1""",
    "e_ranked": """SELECT i.order_item_id, i.order_id, i.product_id, i.quantity, c.warehouse_id,
        row_number() OVER (PARTITION BY i.order_item_id, i.order_id, i.product_id, i.quantity, i.unit_price
          ORDER BY c.surcharge DESC, c.oldest DESC, c.on_hand DESC, c.warehouse_id) AS place
        FROM d_order_item AS i JOIN s_candidates AS c ON c.product_id = i.product_id AND c.on_hand >= i.quantity""",
    "e_stamps": """SELECT order_id, CASE WHEN min(r.warehouse_id) = max(r.warehouse_id) THEN min(w.name)
          ELSE 'Multiple hubs' END AS source_hub
        FROM e_ranked AS r JOIN d_warehouse AS w USING (warehouse_id) WHERE place = 1 GROUP BY 1""",
    "e_codes": """SELECT *, row_number() OVER (PARTITION BY base ORDER BY campaign_id, platform) AS nth FROM (
        SELECT product_id + 1000000 AS campaign_id, product_id, platform, prefix || '-' ||
          upper(substr(md5('spring|' || (product_id + 1000000) || '|' || platform), 1, 5)) AS base
        FROM d_product JOIN (VALUES (1, 'Facebook', 'FB'), (2, 'Instagram', 'IG'), (3, 'WhatsApp', 'WA'),
          (4, 'Email', 'EM')) AS channels(pos, platform, prefix) ON pos <= product_id % 5) AS drafts""",
    "e_customers": """SELECT *, customer_id % 3 = 0 AS doomed FROM d_customer
        UNION ALL SELECT customer_id + 10000000, name, contact, (customer_id + 10000000) % 2 = 0 FROM d_customer""",
    "e_used": """SELECT customer_id FROM d_order UNION SELECT customer_id FROM d_click WHERE customer_id IS NOT NULL""",
    "e_guests": """SELECT event_id AS request_id, 'Guest ' || event_id AS name, CASE WHEN k % 3 = 0
          THEN '09' || lpad(CAST(user_id * 7 + k % 4 AS VARCHAR), 9, '0')
          ELSE '01' || lpad(CAST(user_id AS VARCHAR), 9, '0') END AS contact FROM e_events WHERE event_type = 'signup'""",
    "e_fresh": """SELECT *, (SELECT max(customer_id) FROM d_customer) + row_number() OVER (ORDER BY request_id) AS customer_id
        FROM (SELECT contact, min(request_id) AS request_id, arg_min(name, request_id) AS name FROM e_guests
              WHERE contact NOT IN (SELECT contact FROM d_customer WHERE contact IS NOT NULL) GROUP BY 1) AS f""",
    "w_lines": """SELECT event_id AS request_id, ts, supplier, event_id % 6 + 1 AS warehouse_id, line_no, supplier + {n} * ((event_id + line_no)
            % greatest((SELECT count(*) FROM part) // {n}, 1)) + CASE WHEN k % 10 = 3 AND line_no = 1 THEN 1 ELSE 0 END + 1 AS product_id,
          (k + line_no * 5) % 50 * 4 AS quantity, k - 2 AS unit_cost
        FROM (SELECT *, (user_id * 7 + k) % {n} AS supplier, unnest(range(event_id % 4 + 1)) AS line_no FROM e_events WHERE event_type = 'purchase') AS e""",
    "w_requests": """SELECT request_id, ts, supplier, warehouse_id, sum(quantity)::BIGINT AS units, CASE WHEN warehouse_id = 6 THEN 'unknown hub'
          ELSE arg_min(bad, line_no) END AS reason
        FROM (SELECT *, CASE WHEN product_id > (SELECT count(*) FROM part) THEN 'unknown product'
                WHEN (product_id - 1) % {n} <> supplier THEN 'product of another supplier'
                WHEN quantity = 0 THEN 'quantity not positive' WHEN unit_cost < 0 THEN 'negative cost' END AS bad FROM w_lines) AS q
        GROUP BY 1, 2, 3, 4""",
    "w_turns": """SELECT *, row_number() OVER (PARTITION BY warehouse_id ORDER BY ts, request_id) AS nth FROM w_requests WHERE reason IS NULL""",
    "w_filled": """SELECT warehouse_id, CAST(0 AS BIGINT) AS nth, CAST(used AS BIGINT) AS used, true AS fits, capacity_units FROM s_fill
        UNION ALL SELECT f.warehouse_id, t.nth, CASE WHEN f.used + units <= capacity_units THEN f.used + units ELSE f.used END,
          f.used + units <= capacity_units, capacity_units
        FROM w_filled AS f JOIN w_turns AS t ON t.warehouse_id = f.warehouse_id AND t.nth = f.nth + 1""",
    "w_placed": """SELECT t.*, (SELECT max(purchase_id) FROM d_purchase) + row_number() OVER (ORDER BY ts, request_id) AS purchase_id
        FROM w_turns AS t JOIN w_filled USING (warehouse_id, nth) WHERE fits""",
    "y_turns": """SELECT *, row_number() OVER (PARTITION BY warehouse_id ORDER BY purchase_date, purchase_id) AS nth
        FROM (SELECT purchase_id, warehouse_id, purchase_date, sum(quantity)::BIGINT AS units FROM d_purchase JOIN d_purchase_item USING (purchase_id)
              GROUP BY ALL) AS q""",
    "y_filled": """SELECT warehouse_id, CAST(0 AS BIGINT) AS nth, CAST(used AS BIGINT) AS used, true AS fits, capacity_units FROM s_fill
        UNION ALL SELECT f.warehouse_id, t.nth, CASE WHEN f.used + units <= capacity_units THEN f.used + units ELSE f.used END,
          f.used + units <= capacity_units, capacity_units
        FROM y_filled AS f JOIN y_turns AS t ON t.warehouse_id = f.warehouse_id AND t.nth = f.nth + 1""",
    "y_received": "SELECT purchase_id, fits FROM y_turns JOIN y_filled USING (warehouse_id, nth)",
    # turns of a batch, one after another: `room` holds every stock row (in place (product - 1) * hubs + hub), then every hub's free room
    "v_size": "SELECT count(*) * {h} AS size FROM part",
    "v_room": """SELECT list(room ORDER BY place) AS room FROM (
        SELECT place, coalesce(i.quantity, 0)::BIGINT AS room FROM (SELECT unnest(range(1, size + 1)) AS place FROM v_size) AS p
        LEFT JOIN (SELECT (product_id - 1) * {h} + warehouse_id AS place, quantity FROM d_inventory) AS i USING (place)
        UNION ALL SELECT size + warehouse_id, (capacity_units - used)::BIGINT FROM s_fill, v_size) AS q""",
    "v_bought": """SELECT purchase_id, (product_id - 1) * {h} + warehouse_id AS place, warehouse_id, product_id, sum(quantity)::BIGINT AS units
        FROM d_purchase JOIN d_purchase_item USING (purchase_id) GROUP BY ALL""",
    "v_reversals": """SELECT purchase_id, list(place ORDER BY place) AS places, list(units ORDER BY place) AS units,
        row_number() OVER (ORDER BY purchase_id) AS n FROM v_bought GROUP BY 1""",
    "v_reversed": """SELECT CAST(0 AS BIGINT) AS n, room, true AS granted FROM v_room
        UNION ALL SELECT n, CASE WHEN granted THEN list_transform(room, lambda u, i: u - coalesce(units[list_position(places, i)], 0)) ELSE room END, granted
        FROM (SELECT r.n, s.room, r.places, r.units, list_min(list_transform(r.places, lambda p, i: s.room[p] - r.units[i])) >= 0 AS granted
              FROM v_reversed AS s JOIN v_reversals AS r ON r.n = s.n + 1) AS q""",
    "v_undone": "SELECT purchase_id, granted FROM v_reversals JOIN v_reversed USING (n)",
    "v_moves": """SELECT *, CASE WHEN units <= 0 THEN 'quantity not positive' WHEN source = target THEN 'same hub' END AS bad FROM (
        SELECT inventory_id * 2 + turn AS request_id, product_id, warehouse_id AS source,
          CASE WHEN product_id % 23 = 0 THEN warehouse_id ELSE warehouse_id % {h} + 1 END AS target,
          CASE WHEN turn = 0 THEN quantity // 2 WHEN product_id % 10 = 0 THEN quantity ELSE quantity // 3 END AS units
        FROM d_inventory, (VALUES (0), (1)) AS turns(turn)) AS m""",
    "v_turns": "SELECT *, row_number() OVER (ORDER BY request_id) AS n FROM v_moves WHERE bad IS NULL",
    # a granted move changes four places of `room`: two of the product's stock rows, and the two hubs'
    "v_moved": """SELECT CAST(0 AS BIGINT) AS n, room, CAST(NULL AS VARCHAR) AS reason FROM v_room
        UNION ALL SELECT n, CASE WHEN reason IS NOT NULL THEN room ELSE room[1:p + a - 1] || [room[p + a] + d] || room[p + a + 1:p + b - 1]
            || [room[p + b] - d] || room[p + b + 1:size + a - 1] || [room[size + a] - d] || room[size + a + 1:size + b - 1]
            || [room[size + b] + d] || room[size + b + 1:len(room)] END, reason
        FROM (SELECT t.n, s.room, z.size, (t.product_id - 1) * {h} AS p, least(t.source, t.target) AS a, greatest(t.source, t.target) AS b,
                CASE WHEN t.source < t.target THEN -t.units ELSE t.units END AS d,
                CASE WHEN s.room[(t.product_id - 1) * {h} + t.source] < t.units THEN 'not enough stock'
                     WHEN s.room[z.size + t.target] < t.units THEN 'destination full' END AS reason
              FROM v_moved AS s JOIN v_turns AS t ON t.n = s.n + 1, v_size AS z) AS q""",
    "v_granted": """SELECT t.*, sum(units) OVER (PARTITION BY source, product_id ORDER BY request_id) AS hi
        FROM v_turns AS t JOIN v_moved USING (n) WHERE reason IS NULL""",
    "v_held": """SELECT warehouse_id, product_id, received_date, units, sum(units) OVER (PARTITION BY warehouse_id, product_id
        ORDER BY received_date) AS hi FROM (SELECT warehouse_id, product_id, received_date, sum(units) AS units
          FROM s_aged GROUP BY 1, 2, 3) AS g""",
    "v_pieces": """SELECT g.request_id, g.source, g.target, g.product_id, h.received_date AS origin_date,
          least(g.hi, h.hi) - greatest(g.hi - g.units, h.hi - h.units) AS units
        FROM v_granted AS g JOIN v_held AS h ON h.warehouse_id = g.source AND h.product_id = g.product_id
         AND greatest(g.hi - g.units, h.hi - h.units) < least(g.hi, h.hi)""",
    "v_transfers": """SELECT source, target, product_id, origin_date, units FROM v_pieces
        UNION ALL SELECT g.source, g.target, g.product_id, {as_of}, g.units - coalesce(p.units, 0) FROM v_granted AS g
        LEFT JOIN (SELECT request_id, sum(units) AS units FROM v_pieces GROUP BY 1) AS p USING (request_id)
        WHERE g.units > coalesce(p.units, 0)""",
}


def _report(build, sql: str | None = None, optional_ids: tuple[str, ...] = ()) -> Report:
    return Report(build, sql, tables=MUTATION_TABLES, optional_ids=optional_ids)


REPORTS = {
    "apply_purchases": _report(
        lambda x: mutations.apply_purchases(x.domain, x.domain["purchase"]).drop("inventory_id"),
        """SELECT warehouse_id, product_id, sum(units)::BIGINT AS quantity FROM (
             SELECT warehouse_id, product_id, quantity AS units FROM d_inventory
             UNION ALL SELECT warehouse_id, product_id, units FROM e_recent) AS q GROUP BY 1, 2""",
    ),
    "receive_purchases": _report(
        lambda x: mutations.receive_purchases(x.domain, x.domain["purchase"]).inventory.drop("inventory_id"),
        """SELECT warehouse_id, product_id, sum(units)::BIGINT AS quantity FROM (
             SELECT warehouse_id, product_id, quantity AS units FROM d_inventory
             UNION ALL SELECT warehouse_id, product_id, units FROM e_recent JOIN y_received USING (purchase_id) WHERE fits) AS q GROUP BY 1, 2""",
    ),
    "receive_purchases_rejected": _report(
        lambda x: mutations.receive_purchases(x.domain, x.domain["purchase"]).rejected,
        """SELECT purchase_id AS key, 'hub full' AS reason FROM y_received WHERE NOT fits
           UNION ALL SELECT purchase_id, 'purchase without lines' FROM d_purchase WHERE purchase_id NOT IN (SELECT purchase_id FROM d_purchase_item)""",
    ),
    "place_purchase_orders": _report(
        _ordered,
        """SELECT purchase_id, p.supplier + 1 AS supplier_id, p.warehouse_id, p.ts AS purchase_date, (SELECT max(purchase_item_id) FROM d_purchase_item)
             + row_number() OVER (ORDER BY purchase_id, line_no) AS purchase_item_id, product_id, quantity::BIGINT AS quantity, unit_cost::DOUBLE AS unit_cost
           FROM w_placed AS p JOIN w_lines USING (request_id)""",
    ),
    "place_purchase_orders_rejected": _report(
        lambda x: mutations.place_purchase_orders(x.domain, *purchase_orders(x)).rejected,
        """SELECT request_id AS key, reason FROM w_requests WHERE reason IS NOT NULL
           UNION ALL SELECT request_id, 'hub full' FROM w_turns JOIN w_filled USING (warehouse_id, nth) WHERE NOT fits""",
    ),
    "reverse_purchases": _report(
        lambda x: _reversal(x).inventory,
        """SELECT inventory_id, warehouse_id, product_id, (i.quantity - coalesce(b.units, 0))::BIGINT AS quantity
           FROM d_inventory AS i LEFT JOIN (SELECT warehouse_id, product_id, sum(units) AS units FROM v_bought
             JOIN v_undone USING (purchase_id) WHERE granted GROUP BY 1, 2) AS b USING (warehouse_id, product_id)""",
    ),
    "reverse_purchases_rejected": _report(
        lambda x: _reversal(x).rejected,
        """SELECT purchase_id AS key, 'stock already sold or moved' AS reason FROM v_undone WHERE NOT granted
           UNION ALL SELECT purchase_id, 'purchase without lines' FROM d_purchase WHERE purchase_id NOT IN (SELECT purchase_id FROM v_bought)""",
    ),
    "place_orders": _report(
        _placed,
        """SELECT order_id, customer_id, ts AS order_date, product_id, quantity::BIGINT AS quantity,
             price::DOUBLE AS unit_price, link_id::DOUBLE AS link_id FROM e_placed""",
        optional_ids=("link_id",),
    ),
    "place_orders_rejected": _report(
        lambda x: mutations.place_orders(x.domain, order_requests(x)).rejected,
        "SELECT request_id AS key, reason FROM e_orders WHERE reason IS NOT NULL",
    ),
    "place_purchases": _report(
        _purchased,
        """SELECT (SELECT max(purchase_id) FROM d_purchase) + row_number() OVER (ORDER BY ts, b.request_id) AS purchase_id,
             supplier_id, b.warehouse_id, ts AS purchase_date, product_id, quantity::BIGINT AS quantity,
             unit_cost::DOUBLE AS unit_cost FROM e_bought AS b JOIN e_filled AS f USING (request_id) WHERE fits""",
    ),
    "place_purchases_rejected": _report(
        lambda x: mutations.place_purchases(x.domain, purchase_requests(x)).rejected,
        """SELECT request_id AS key, reason FROM e_buys WHERE reason IS NOT NULL
           UNION ALL SELECT request_id, 'hub full' FROM e_filled WHERE NOT fits""",
    ),
    "transfer_stock": _report(
        lambda x: _transfers(x).transfers.drop("transfer_id"),
        """SELECT source AS from_warehouse_id, target AS to_warehouse_id, product_id, units::BIGINT AS quantity,
             {as_of} AS transfer_date, origin_date FROM v_transfers""",
    ),
    "transfer_stock_inventory": _report(
        lambda x: _transfers(x).inventory.drop("inventory_id"),
        """SELECT warehouse_id, product_id, sum(units)::BIGINT AS quantity FROM (
             SELECT warehouse_id, product_id, quantity AS units FROM d_inventory
             UNION ALL SELECT source, product_id, -units FROM v_granted
             UNION ALL SELECT target, product_id, units FROM v_granted) AS q GROUP BY 1, 2""",
    ),
    "transfer_stock_rejected": _report(
        lambda x: _transfers(x).rejected,
        """SELECT request_id AS key, bad AS reason FROM v_moves WHERE bad IS NOT NULL
           UNION ALL SELECT request_id, reason FROM v_turns JOIN v_moved USING (n) WHERE reason IS NOT NULL""",
    ),
    "create_shipments": _report(
        lambda x: mutations.create_shipments(
            x.domain, mutations.place_orders(x.domain, order_requests(x)).orders
        ).shipments,
        """SELECT m.top + nth AS shipment_id, order_id, 'TRK' || (m.top + nth) AS tracking_code, ts AS shipment_date
           FROM (SELECT *, row_number() OVER (ORDER BY order_id) AS nth FROM e_placed) AS p,
             (SELECT max(shipment_id) AS top FROM d_shipment) AS m""",
    ),
    "create_shipments_statuses": _report(
        lambda x: mutations.create_shipments(
            x.domain, mutations.place_orders(x.domain, order_requests(x)).orders
        ).statuses,
        """SELECT (SELECT max(status_id) FROM d_shipment_status) + nth AS status_id, (SELECT max(shipment_id) FROM d_shipment) + nth
             AS shipment_id, CAST(NULL AS VARCHAR) AS location, 'Packed' AS status, ts AS updated_time
           FROM (SELECT *, row_number() OVER (ORDER BY order_id) AS nth FROM e_placed) AS p""",
    ),
    "advance_shipments": _report(
        lambda x: mutations.advance_shipments(x.domain, x.domain["shipment"], AS_OF),
        """SELECT (SELECT max(status_id) FROM d_shipment_status) + row_number() OVER (ORDER BY shipment_id) AS status_id,
             shipment_id, CAST(NULL AS VARCHAR) AS location, CASE status WHEN 'Packed' THEN 'In Transit'
               WHEN 'In Transit' THEN 'Out For Delivery' ELSE 'Delivered' END AS status, {as_of} AS updated_time
           FROM s_latest WHERE status <> 'Delivered'""",
    ),
    "stamp_hub": _report(
        lambda x: mutations.stamp_hub(_allocation(x), x.domain["warehouse"]), "SELECT order_id, source_hub FROM e_stamps"
    ),
    "stamp_statuses": _report(
        lambda x: mutations.stamp_statuses(x.domain, mutations.stamp_hub(_allocation(x), x.domain["warehouse"])),
        """SELECT t.status_id, t.shipment_id, CASE WHEN t.status <> 'Packed' OR e.source_hub IS NULL THEN t.location
             WHEN t.location IS NULL OR t.location = e.source_hub THEN e.source_hub ELSE 'Multiple hubs' END AS location,
             t.status, t.updated_time
           FROM d_shipment_status AS t JOIN d_shipment AS s USING (shipment_id) LEFT JOIN e_stamps AS e USING (order_id)""",
    ),
    "generate_links": _report(
        lambda x: mutations.generate_links(x.domain, new_campaigns(x), "spring").links,
        """SELECT (SELECT max(link_id) FROM d_tracking_link) + row_number() OVER (ORDER BY campaign_id, platform) AS link_id, campaign_id, platform, base || CASE WHEN nth = 1 THEN '' ELSE '-' || nth END AS short_code,
             '/storefront/product.html?product=' || product_id AS destination_url FROM e_codes""",
    ),
    "upsert_customers": _report(
        lambda x: mutations.upsert_customers(x.domain, guest_requests(x)).inserts,
        "SELECT customer_id, name, contact FROM e_fresh",
    ),
    "upsert_customers_resolved": _report(
        lambda x: mutations.upsert_customers(x.domain, guest_requests(x)).resolved,
        """SELECT g.request_id, coalesce(f.customer_id, (SELECT min(customer_id) FROM d_customer AS c
             WHERE c.contact = g.contact)) AS customer_id FROM e_guests AS g LEFT JOIN e_fresh AS f USING (contact)""",
    ),
    "edit_customers": _report(
        lambda x: _edited(x).customers,
        """SELECT customer_id, CASE WHEN customer_id % 4 = 0 AND customer_id <= 10000000 THEN upper(name) ELSE name END AS name,
             CASE WHEN customer_id % 4 = 0 AND customer_id <= 10000000 THEN NULL ELSE contact END AS contact
           FROM e_customers AS c WHERE NOT (doomed AND customer_id NOT IN (SELECT customer_id FROM e_used))""",
    ),
    "edit_customers_blocked": _report(
        lambda x: _edited(x).blocked,
        """SELECT customer_id, 'still referenced' AS reason FROM e_customers
           WHERE doomed AND customer_id IN (SELECT customer_id FROM e_used)""",
    ),
    "audit_diff": _report(
        _audited,
        """SELECT 'inventory' AS table_name, 'UPDATE' AS operation, inventory_id AS record_id, {as_of} AS log_time
           FROM d_inventory WHERE (warehouse_id, product_id) IN (SELECT (warehouse_id, product_id) FROM e_recent)
           UNION ALL SELECT 'inventory', 'DELETE', inventory_id + 1000000000000, {as_of} FROM d_inventory
           UNION ALL SELECT 'inventory', 'INSERT', inventory_id + 2000000000000, {as_of} FROM d_inventory""",
    ),
    "backdate": _report(
        lambda x: mutations.backdate(
            x.domain["purchase"], "purchase_id", "purchase_date",
            x.domain["purchase"].where(F.col("supplier_id") == 1).select(
                "purchase_id", (F.col("purchase_id") % 120).alias("days")
            ),
            AS_OF,
        ),
        """SELECT purchase_id, supplier_id, warehouse_id, CASE WHEN supplier_id = 1
             THEN {as_of} - to_days(CAST(purchase_id % 120 AS INTEGER)) ELSE purchase_date END AS purchase_date FROM d_purchase""",
    ),
}
