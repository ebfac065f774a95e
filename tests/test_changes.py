"""The change feed: every change of a batch with its images."""

import json
from decimal import Decimal

from fixture import AS_OF, OPENING, ORDERS, PURCHASES, ago, rows, seed_domain, stock_rows

from depotwise.operators import changes, checkout, mutations
from depotwise.streaming import live, sinks

PURCHASE = "request_id long, supplier_id long, warehouse_id long, product_id long, quantity int, unit_cost decimal(10,2), requested_at timestamp_ntz"


def images(fed):
    """(table, operation, record, quantity before, quantity after) in order."""
    quantity = lambda text: json.loads(text).get("quantity") if text else None
    return [(r.table_name, r.operation, r.record_id, quantity(r.before), quantity(r.after)) for r in fed.orderBy("change_id").collect()]


def seed_feed(spark, seed):
    """The demo data from empty tables: purchases, five of them dated back, orders."""
    empty = seed.replace(**{t: seed[t].limit(0) for t in ("purchase", "purchase_item", "inventory", "order", "order_item", "order_attribution", "shipment", "shipment_status")})
    owner = {r.product_id: r.supplier_id for r in seed["product"].collect()}
    wanted = [(i, owner[p], h, p, q, Decimal(c), AS_OF) for i, (h, p, q, c, _) in PURCHASES.items()]
    bought = mutations.place_purchases(empty, spark.createDataFrame(wanted, PURCHASE))
    filled = empty.replace(purchase=bought.purchases, purchase_item=bought.items)
    filled = filled.replace(inventory=mutations.apply_purchases(filled, bought.purchases))
    fed = changes.of_purchases(empty, bought, filled["inventory"], phase=0)
    ages = spark.createDataFrame([(i, days) for i, (*_, days) in PURCHASES.items() if days], "purchase_id long, days int")
    dated = mutations.backdate(filled["purchase"], "purchase_id", "purchase_date", ages, AS_OF)
    fed.append(changes.updated(filled["purchase"], dated, "purchase", "purchase_id", 1, AS_OF))
    at = {r.order_id: r.order_date for r in seed["order"].collect()}
    requests = spark.createDataFrame([(o, c, link, at[o]) for o, (c, link, _, _) in ORDERS.items()], "request_id long, customer_id long, link_id long, requested_at timestamp_ntz")
    lines = spark.createDataFrame([(o, 1, p, q) for o, (_, _, p, q) in ORDERS.items()], "request_id long, line_no long, product_id long, quantity int")
    stocked = filled.replace(purchase=dated)
    sold = checkout.checkout(stocked, requests, lines, AS_OF)
    return changes.feed(*fed, *changes.of_checkout(stocked, sold, phase=2))


def test_the_seed_gives_its_41_audit_rows(spark, seed):
    fed = seed_feed(spark, seed)
    logged = [(r.log_id, r.table_name, r.operation) for r in changes.audit_rows(fed).orderBy("log_id").collect()]
    expected = [("purchase", "INSERT"), ("inventory", "INSERT")] * 12 + [("purchase", "UPDATE")] * 5 + [("order", "INSERT"), ("inventory", "UPDATE")] * 6
    assert logged == [(i, *row) for i, row in enumerate(expected, 1)] and len(logged) == 41
    taken = [(before, after) for table, operation, _, before, after in images(fed)[29:] if table == "inventory"]
    assert taken == [(20, 18), (18, 17), (100, 97), (97, 96), (8, 6), (6, 5)]


def test_several_changes_of_a_row_all_show(spark, seed):
    before = seed.replace(inventory=lambda: seed_domain(spark, inventory=stock_rows(OPENING))["inventory"])
    requests = spark.createDataFrame(
        [(1, 1, 2, 1, 5), (2, 1, 1, 2, 3), (3, 1, 2, 1, 999), (4, 1, 2, 1, 1)],
        "request_id long, product_id long, from_warehouse_id long, to_warehouse_id long, quantity int",
    )
    moved = mutations.transfer_stock(before, requests, AS_OF)
    fed = changes.feed(*changes.of_transfers(before, requests, moved.rejected, moved.inventory, AS_OF))
    assert [row[1:2] + row[3:] for row in images(fed)] == [
        ("UPDATE", 20, 15), ("UPDATE", 40, 45), ("UPDATE", 45, 42), ("UPDATE", 15, 18), ("UPDATE", 18, 17), ("UPDATE", 42, 43),
    ]


def test_reversals(spark, seed):
    before = seed.replace(inventory=lambda: seed_domain(spark, inventory=stock_rows(OPENING))["inventory"])
    undone = mutations.reverse_purchases(before, spark.createDataFrame([(1,), (7,)], "purchase_id long"))
    fed = changes.feed(*changes.of_reversals(before, undone, AS_OF))
    assert [(t, o, b, a) for t, o, _, b, a in images(fed)] == [
        ("inventory", "UPDATE", 40, 0), ("purchase", "DELETE", None, None), ("inventory", "UPDATE", 20, 0), ("purchase", "DELETE", None, None),
    ]
    kept = json.loads(fed.where("table_name = 'purchase'").orderBy("change_id").first().before)
    assert kept["purchase_id"] == 1 and kept["purchase_date"].startswith(str(ago(0).date()))


def test_a_stream_of_changes_is_the_audit_trail(spark, seed, tmp_path):
    fed = seed_feed(spark, seed)
    fed.repartition(3).write.parquet(str(tmp_path / "feed"))
    stream = live.audit_trail(spark.readStream.schema(fed.schema).parquet(str(tmp_path / "feed")))
    out = sinks.run_available(stream, "audit", "append")
    trail = sinks.read_batches(spark, out, stream.schema).drop(sinks.BATCH)
    assert rows(trail) == rows(changes.audit_rows(fed)) and trail.count() == 41
