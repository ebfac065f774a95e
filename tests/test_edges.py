"""Boundaries, ties, missing rows and rejections."""

import datetime as dt
import random
from decimal import Decimal as D

import pytest
from fixture import AS_OF, ago, rows, seed_domain
from pyspark.sql import functions as F

from depotwise.functions import columns as C
from depotwise.operators import campaigns, mutations, orders, purchasing, quality, shipping, stock, tables


def one_column(spark, values, kind="int"):
    return spark.createDataFrame([(v,) for v in values], f"v {kind}")


def evaluate(df, *expressions):
    return [tuple(r) for r in df.select(*expressions).collect()]


def test_tier_edges(spark):
    days = one_column(spark, [0, 30, 31, 60, 61, 90, 91])
    assert evaluate(days, C.age_multiplier("v"), C.age_band("v")) == [
        (D("1.0"), "Fresh"), (D("1.0"), "Fresh"), (D("1.5"), "Aging"), (D("1.5"), "Aging"),
        (D("2.0"), "Stale"), (D("2.0"), "Stale"), (D("3.0"), "Dead stock"),
    ]
    sizes = one_column(spark, [200, 201, 500, 501, 1000, 1001])
    assert [r[0] for r in evaluate(sizes, C.rent_rate("v"))] == [D("3.00"), D("2.50"), D("2.50"), D("2.00"), D("2.00"), D("1.50")]
    used = one_column(spark, [74, 75, 89, 90, 100, 101])
    assert [r[0] for r in evaluate(used, C.capacity_status("v", F.lit(100)))] == ["OK", "HIGH", "HIGH", "CRITICAL", "CRITICAL", "OVER"]


def test_whole_days_truncate_toward_zero(spark):
    times = one_column(spark, [ago(1.99), ago(0.5), ago(-0.5), ago(-1.5)], "timestamp_ntz")
    assert [r[0] for r in evaluate(times, C.whole_days("v", C.moment(AS_OF)))] == [1, 0, 0, -1]


def test_text_rules(spark):
    agents = one_column(spark, ["Linux; Android; tablet", "Mobile", "iPhone", "iPad", "Tablet", "iOS", "", None], "string")
    assert [r[0] for r in evaluate(agents, C.device_bucket("v"))] == [
        "Android", "Android", "iOS", "Tablet", "Tablet", "Desktop", "Desktop", "Desktop",
    ]
    names = one_column(spark, ["  Cotton   T-Shirt ", "--A b--", "", None], "string")
    assert [r[0] for r in evaluate(names, C.normalised_name("v"))] == ["cotton t-shirt", "--a b--", "", ""]
    assert [r[0] for r in evaluate(names, C.slug("v"))] == ["cotton-t-shirt", "a-b", "export", "export"]
    urls = one_column(spark, ["/p?product=1", "/p", "/p?code=OLD&x=1", "/p?code=OLD", "/p#top"], "string")
    assert [r[0] for r in evaluate(urls, C.with_code("v", F.lit("FB 1")))] == [
        "/p?product=1&code=FB+1", "/p?code=FB+1", "/p?x=1&code=FB+1", "/p?code=FB+1", "/p?code=FB+1#top",
    ]
    text = one_column(spark, ["a%b", "aXb", None], "string")
    assert evaluate(text.where(C.matches_text(" A% ", "v")), "v") == [("a%b",)]
    assert evaluate(one_column(spark, [0, 10]), C.conversion_pct(F.lit(1), "v")) == [(D("0.0"),), (D("10.0"),)]


def test_listing_order_puts_missing_last(spark):
    names = one_column(spark, ["b", None, "A", "C"], "string")
    assert [r.v for r in tables.sort_rows(names, "v").collect()] == ["A", "b", "C", None]
    assert [r.v for r in tables.sort_rows(names, "v", descending=True).collect()] == ["C", "b", "A", None]
    numbers = one_column(spark, range(10)).withColumn("id", F.col("v") * 10)
    page = tables.page_after(numbers, ["v", "id"], 3, after=(7, 70))
    assert [r.v for r in page.collect()] == [6, 5, 4]
    assert [r.v for r in tables.page_at(numbers, ["v", "id"], 3, 3).collect()] == [6, 5, 4]


def lots(purchases, stock_rows_, transfers=()):
    """Purchases as (hub, product, quantity, time)."""
    return {
        "purchase": [(i, 1, hub, at) for i, (hub, _, _, at) in enumerate(purchases, 1)],
        "purchase_item": [(i, i, product, q, D(1)) for i, (_, product, q, _) in enumerate(purchases, 1)],
        "inventory": stock_rows_,
        "stock_transfer": list(transfers),
    }


def test_newest_units_remain_and_ties_break_by_kind_then_id(spark):
    same = ago(10)
    d = seed_domain(
        spark,
        **lots(
            [(1, 1, 10, same), (1, 1, 20, same), (1, 2, 5, ago(-3)), (1, 3, 5, ago(200))],
            [(1, 1, 1, 25), (2, 1, 2, 9), (3, 2, 3, 4)],
            [(1, 2, 1, 1, 8, ago(1), same)],
        ),
    )
    # newest first: transfer 8, then lot 2 (20 units, 17 of them inside the 25)
    assert rows(stock.remaining_lots(d).where("product_id = 1"), "units") == [(17,), (8,)]
    # a lot from the future is not older than zero days; 4 of 9 units have no lot
    assert rows(stock.aged_lots(d, AS_OF).where("product_id = 2"), "units", "days_stored") == [(5, 0)]
    # units without a lot are billed at the plain rate, lots without stock are not billed
    rent = rows(stock.warehouse_rent(d, AS_OF), "warehouse_id", "on_hand_units", "surcharge_daily_rent", "total_daily_rent")
    assert rent == [(1, 34, D("0.00"), D("85.00")), (2, 4, D("0.00"), D("12.00"))]


def test_old_lot_arriving_after_sales_stays_behind_newer_units(spark):
    d = seed_domain(
        spark, **lots([(1, 1, 30, ago(5))], [(1, 1, 1, 20)], [(1, 2, 1, 1, 10, ago(0), ago(100))])
    )
    assert rows(stock.remaining_lots(d), "units", "received_date") == [(20, ago(5))]


def test_campaign_without_link_and_link_without_click(spark):
    d = seed_domain(
        spark,
        campaign=[(1, 1, "Linked", None, None), (2, 1, "Linkless", None, None)],
        tracking_link=[(1, 1, "Email", "EM1", None)],
        click=[],
        order_attribution=[(1, 1, 1, AS_OF)],
        order_item=[(1, 1, 1, 2, D(10)), (2, 1, 2, 1, D(5))],
    )
    found = rows(campaigns.campaign_performance(d))
    assert found == [(1, "Linked", "Email", 0, 1, D("25.00")), (2, "Linkless", None, 0, 0, D("0.00"))]


def test_shipment_corner_cases(spark):
    d = seed_domain(
        spark,
        shipment=[(1, 1, "TRK1", ago(2)), (2, 1, "TRK2", ago(1)), (3, 2, "TRK3", ago(1)), (4, 3, "TRK4", ago(-2))],
        shipment_status=[
            (1, 1, "Hub One", "Packed", ago(2)), (2, 1, "Hub One", "In Transit", ago(2)),
            (3, 2, "Hub Two", "Packed", ago(1)), (4, 2, "Multiple hubs", "Packed", ago(1)),
        ],
    )
    assert rows(shipping.latest_status(d), "shipment_id", "status") == [(1, "In Transit"), (2, "Packed")]
    board = rows(shipping.shipment_board(d), "shipment_id", "bucket", "updated_time")
    assert board[2] == (3, "transit", ago(1))
    fulfilment = rows(orders.order_fulfilment(d).where("order_id = 1"), "source_hub", "source_warehouse_id")
    assert fulfilment == [("Hub One", 1), ("Hub Two", 2), ("Multiple hubs", None)]
    assert rows(shipping.pending_shipments(d, AS_OF), "shipment_id", "days_pending")[-1] == (4, -2)


def test_order_list_has_one_row_per_order_however_long(spark):
    d = seed_domain(spark, order_item=[(i, 1, 1, 1 + i % 2, D(1)) for i in range(1, 2501)])
    [listed] = orders.order_list(d).where("order_id = 1").collect()
    assert [int(part.split("×")[1]) for part in listed.items_label.split(", ")] == [1 + i % 2 for i in range(1, 2501)]
    assert listed.total == D("3750.00")


def test_searches_come_before_limits(spark, seed):
    everyone = orders.order_list(seed)
    assert everyone.count() == seed["order"].count()
    newest = orders.order_list_search(seed, AS_OF, "", None, 2)
    assert newest.count() == 2 and newest.select("order_id").exceptAll(everyone.select("order_id")).isEmpty()
    oldest = everyone.orderBy("order_date", "order_id").first()
    found = orders.order_list_search(seed, AS_OF, oldest.customer_name, None)
    assert oldest.order_id in [r.order_id for r in found.collect()]
    log = [(i, "order" if i == 1 else "stock", "INSERT", i, ago(1000 - i)) for i in range(1, 400)]
    d = seed.replace(audit_log=spark.createDataFrame(log, seed["audit_log"].schema))
    assert rows(shipping.audit_search(d, "order", "INSERT"), "log_id") == [(1,)]
    assert rows(shipping.audit_search(d, "stock", limit=2), "log_id") == [(398,), (399,)]


def test_rejections_of_transfers(spark, seed):
    schema = "request_id long, product_id long, from_warehouse_id long, to_warehouse_id long, quantity int"
    asked = [
        (1, 1, 1, 2, None), (2, 1, 1, 2, 0), (3, 1, 1, 1, 5), (4, 9, 1, 2, 5), (5, 3, 1, 2, 97),
        (6, 3, 1, 2, 27), (7, 1, 1, 2, 10),
    ]
    moved = mutations.transfer_stock(seed, spark.createDataFrame(asked, schema), AS_OF)
    assert rows(moved.rejected) == [
        (1, "quantity not positive"), (2, "quantity not positive"), (3, "same hub"), (4, "no stock row"),
        (5, "not enough stock"), (6, "destination full"),
    ]
    assert rows(moved.transfers, "product_id", "quantity") == [(1, 10)]


def test_several_transfers_share_the_lots_in_turn(spark):
    d = seed_domain(
        spark, **lots([(1, 1, 10, ago(50)), (1, 1, 10, ago(20))], [(1, 1, 1, 26)])
    )
    schema = "request_id long, product_id long, from_warehouse_id long, to_warehouse_id long, quantity int"
    moved = mutations.transfer_stock(d, spark.createDataFrame([(1, 1, 1, 2, 6), (2, 1, 1, 2, 8), (3, 1, 1, 2, 9)], schema), AS_OF)
    pieces = rows(moved.transfers, "quantity", "origin_date")
    assert sorted(pieces) == sorted([(6, ago(50)), (4, ago(50)), (4, ago(20)), (6, ago(20)), (3, AS_OF)])
    assert rows(moved.inventory, "warehouse_id", "quantity") == [(1, 3), (2, 23)]
    ids = [r.transfer_id for r in moved.transfers.collect()]
    assert sorted(ids) == [1, 2, 3, 4, 5]


def test_capacity_rules(spark, seed):
    wanted = spark.createDataFrame([(1, 210), (2, 130)], "warehouse_id long, capacity_units int")
    assert rows(quality.capacity_below_stock(seed, wanted), "key") == [("1",)]
    grown = seed.replace(warehouse=spark.createDataFrame([(1, "a", "", 100), (2, "b", "", 150)], seed["warehouse"].schema))
    bigger = spark.createDataFrame([(1, 120)], "warehouse_id long, capacity_units int")
    assert quality.capacity_below_stock(grown, bigger).count() == 0
    after = seed["inventory"].withColumn("quantity", F.when(F.expr("warehouse_id = 2 and product_id = 1"), 50).otherwise(F.col("quantity")))
    assert rows(quality.capacity_breaches(seed, after)) == [(2, 1, 150, 124, 26, 33)]
    drained = grown["inventory"].withColumn("quantity", F.col("quantity") - 1)
    assert quality.capacity_breaches(grown, drained).count() == 0


def test_reversal_refuses_sold_stock(spark, seed):
    ids = spark.createDataFrame([(1,), (7,)], "purchase_id long")
    undone = mutations.reverse_purchases(seed, ids)
    assert rows(undone.rejected, "key") == [(7,)] and rows(undone.reversed_ids) == [(1,)]
    assert rows(undone.inventory.where("product_id = 1"), "warehouse_id", "quantity") == [(1, 0), (2, 17)]


def test_purchases_must_name_the_products_supplier(spark, seed):
    schema = "request_id long, supplier_id long, warehouse_id long, product_id long, quantity int, unit_cost decimal(10,2), requested_at timestamp_ntz"
    asked = [(1, 1, 1, 4, 5, D(1), AS_OF), (2, 2, 1, 4, 5, D(1), AS_OF), (3, 2, 1, 4, 0, D(1), AS_OF), (4, 2, 1, 4, 1, D(-1), AS_OF)]
    made = mutations.place_purchases(seed, spark.createDataFrame(asked, schema))
    assert rows(made.purchases, "purchase_id", "supplier_id") == [(13, 2)]
    assert rows(made.rejected) == [(1, "product of another supplier"), (3, "quantity not positive"), (4, "negative cost")]


def test_customers_match_by_contact(spark, seed):
    d = seed.replace(customer=spark.createDataFrame([(1, "A", "01"), (2, "B", "01"), (3, "C", None)], seed["customer"].schema))
    guests = spark.createDataFrame([(1, "X", " 01 "), (2, "Y", "02"), (3, "Z", "02")], "request_id long, name string, contact string")
    result = mutations.upsert_customers(d, guests)
    assert rows(result.inserts) == [(4, "Y", "02")]
    assert rows(result.resolved) == [(1, 1), (2, 4), (3, 4)] and result.rejected.count() == 0
    lone = spark.createDataFrame([(4, "P", None), (5, "Q", "  "), (6, "R", "03")], guests.schema)
    result = mutations.upsert_customers(d, lone)
    assert rows(result.rejected) == [(4, "no contact"), (5, "no contact")] and rows(result.resolved) == [(6, 4)]
    assert rows(quality.duplicate_contacts(d)) == [("01", 2, 1)]


def test_links_get_unique_codes(spark, seed):
    wanted = spark.createDataFrame([(c, 1, ["Facebook", "Email"]) for c in range(10, 16)], "campaign_id long, product_id long, platforms array<string>")
    first = mutations.generate_links(seed, wanted, "s").links
    again = mutations.generate_links(seed.replace(tracking_link=seed["tracking_link"].unionByName(first)), wanted, "s").links
    codes = [r.short_code for r in first.unionByName(again).collect()]
    assert len(set(codes)) == 24 and sum(c.endswith("-2") for c in codes) == 12
    assert sorted(r.link_id for r in first.collect()) == list(range(8, 20))


def test_unknown_platforms_are_told(spark, seed):
    wanted = spark.createDataFrame([(1, 1, ["Facebook", "TikTok", None]), (2, 1, None)], "campaign_id long, product_id long, platforms array<string>")
    made = mutations.generate_links(seed, wanted, "s")
    assert rows(made.links, "campaign_id", "platform") == [(1, "Facebook")]
    assert rows(made.rejected) == [(1, "unknown platform: TikTok"), (1, "unknown platform: none"), (2, "unknown platform: none")]


def test_requests_without_a_time_are_told(spark, seed):
    schema = "request_id long, customer_id long, link_id long, product_id long, quantity int, requested_at timestamp_ntz"
    made = mutations.place_orders(seed, spark.createDataFrame([(1, 1, None, 1, 1, None), (2, 1, None, 1, 1, AS_OF)], schema))
    assert made.orders.count() == 1 and rows(made.rejected) == [(1, "no time")]


def test_unknown_and_empty_purchases_are_told(spark, seed):
    bare = seed.replace(purchase_item=seed["purchase_item"].where("purchase_id <> 2"))
    undone = mutations.reverse_purchases(bare, spark.createDataFrame([(1,), (2,), (999,), (1,)], "purchase_id long"))
    assert rows(undone.rejected) == [(2, "purchase without lines"), (999, "unknown purchase")]
    assert rows(undone.reversed_ids) == [(1,)]
    assert undone.items.where("purchase_id = 1").isEmpty() and undone.purchases.count() == seed["purchase"].count() - 1


def test_two_edits_of_a_customer_leave_one_row(spark, seed):
    edits = spark.createDataFrame([(1, "Old", "1", 1), (1, "New", "2", 2)], "customer_id long, name string, contact string, edited_at int")
    none = spark.createDataFrame([], "customer_id long")
    changed = mutations.edit_customers(seed, edits, none).customers
    assert rows(changed.where("customer_id = 1"), "name", "contact") == [("New", "2")]
    assert changed.count() == seed["customer"].count()


def test_a_refused_transfer_leaves_the_stock_to_later_ones(spark):
    d = seed_domain(spark, **lots([(1, 1, 10, ago(50))], [(1, 1, 1, 10)]))
    schema = "request_id long, product_id long, from_warehouse_id long, to_warehouse_id long, quantity int"
    moved = mutations.transfer_stock(d, spark.createDataFrame([(1, 1, 1, 2, 6), (2, 1, 1, 2, 6), (3, 1, 1, 2, 4)], schema), AS_OF)
    assert rows(moved.rejected) == [(2, "not enough stock")]
    assert rows(moved.inventory, "warehouse_id", "quantity") == [(1, 0), (2, 10)]


def replay(stock, room, requests):
    """Transfers one after another, as single calls would go."""
    stock, room, refused = dict(stock), dict(room), []
    for i, product, a, b, n in sorted(requests):
        if stock.get((a, product), 0) < n:
            refused.append((i, "not enough stock"))
        elif room[b] < n:
            refused.append((i, "destination full"))
        else:
            stock[a, product] -= n
            stock[b, product] = stock.get((b, product), 0) + n
            room[a], room[b] = room[a] + n, room[b] - n
    return stock, refused


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_transfers_equal_single_calls(spark, seed):
    draw = random.Random(seed)
    stock = {(h, p): draw.randint(0, 30) for h in (1, 2, 3) for p in (1, 2, 3)}
    used = {h: sum(n for (hub, _), n in stock.items() if hub == h) for h in (1, 2, 3)}
    room = {h: draw.randint(0, 25) for h in (1, 2, 3)}
    asked = []
    for i in range(1, 61):
        a, b = draw.sample([1, 2, 3], 2)
        asked.append((i, draw.randint(1, 3), a, b, draw.randint(1, 14)))
    d = seed_domain(spark, **lots([], [(i, h, p, n) for i, ((h, p), n) in enumerate(stock.items(), 1)]))
    d = d.replace(warehouse=spark.createDataFrame([(h, f"h{h}", "", used[h] + room[h]) for h in (1, 2, 3)], d["warehouse"].schema))
    schema = "request_id long, product_id long, from_warehouse_id long, to_warehouse_id long, quantity int"
    moved = mutations.transfer_stock(d, spark.createDataFrame(asked, schema), AS_OF)
    after, refused = replay(stock, room, asked)
    assert rows(moved.rejected, "key") == sorted(((i,) for i, _ in refused), key=repr)
    assert rows(moved.inventory, "warehouse_id", "product_id", "quantity") == sorted(((*k, n) for k, n in after.items()), key=repr)
    assert moved.transfers.count() + len(refused) == len(asked)


@pytest.mark.parametrize("seed", [4, 5])
def test_reversals_and_guarded_purchases_equal_single_calls(spark, seed):
    draw = random.Random(seed)
    stock = {(h, p): draw.randint(0, 40) for h in (1, 2) for p in (1, 2)}
    bought = [(i, 1, draw.choice([1, 2]), ago(9)) for i in range(1, 26)]
    items = [(k, i, p, draw.randint(1, 12), D(1)) for k, (i, p) in enumerate(((i, p) for i, *_ in bought for p in (1, 2) if draw.random() < 0.7), 1)]
    d = seed_domain(spark, purchase=bought, purchase_item=items, inventory=[(i, h, p, n) for i, ((h, p), n) in enumerate(stock.items(), 1)])
    left, refused = dict(stock), []
    for i, _, hub, _ in bought:
        own = [(p, n) for _, j, p, n, _ in items if j == i]
        if any(left[hub, p] < n for p, n in own):
            refused.append((i,))
        else:
            for p, n in own:
                left[hub, p] -= n
    undone = mutations.reverse_purchases(d, d["purchase"].select("purchase_id"))
    bare = [(i,) for i, *_ in bought if not any(j == i for _, j, *_ in items)]
    assert rows(undone.rejected, "key") == sorted(refused + bare, key=repr)
    assert rows(undone.inventory, "warehouse_id", "product_id", "quantity") == sorted(((*k, n) for k, n in left.items()), key=repr)

    used = {h: sum(n for (hub, _), n in stock.items() if hub == h) for h in (1, 2)}
    room = {1: 30, 2: 17}
    d = d.replace(
        warehouse=spark.createDataFrame([(h, f"h{h}", "", used[h] + room[h]) for h in (1, 2)], d["warehouse"].schema),
        product=spark.createDataFrame([(1, 1, "p", "c", D(1))], d["product"].schema),
    )
    schema = "request_id long, supplier_id long, warehouse_id long, product_id long, quantity int, unit_cost decimal(10,2), requested_at timestamp_ntz"
    asked = [(i, 1, draw.choice([1, 2]), 1, draw.randint(1, 9), D(1), ago(draw.randint(0, 5))) for i in range(1, 21)]
    made = mutations.place_purchases(d, spark.createDataFrame(asked, schema))
    refused = []
    for i, _, hub, _, n, _, _ in sorted(asked, key=lambda r: (r[6], r[0])):
        if n > room[hub]:
            refused.append((i, "hub full"))
        else:
            room[hub] -= n
    assert rows(made.rejected) == sorted(refused, key=repr) and made.purchases.count() + len(refused) == 20


def test_pieces_are_linear_in_lots_and_requests(spark):
    lot = spark.range(3000).selectExpr("1 as k", "id as pos", "1L as units", "struct(id as lot) as data")
    ask = spark.range(3000).selectExpr("1 as k", "id as pos", "1L as units", "struct(id as request) as data")
    made = mutations.overlaps(ask, lot, ["k"])
    assert made.count() == 3000 and made.where("wanted.request <> held.lot").isEmpty()


def test_stamps_mark_several_hubs(spark, seed):
    allocated = spark.createDataFrame([(1, 1), (1, 1), (2, 1), (2, 2), (3, None)], "order_id long, warehouse_id long")
    stamps = mutations.stamp_hub(allocated, seed["warehouse"])
    assert rows(stamps) == [(1, "Hub One"), (2, "Multiple hubs")]
    stamped = mutations.stamp_statuses(seed, stamps).where("status = 'Packed'")
    assert rows(stamped, "shipment_id", "location")[:3] == [(1, "Multiple hubs"), (2, "Multiple hubs"), (3, "Hub One")]


def test_audit_and_backdate(spark, seed):
    before = seed["product"]
    after = before.where("product_id <> 1").withColumn("price", F.when(F.col("product_id") == 2, 1).otherwise(F.col("price")).cast("decimal(10,2)"))
    extra = before.where("product_id = 1").withColumn("product_id", F.lit(9).cast("long"))
    diff = mutations.audit_diff(before, after.unionByName(extra), "product_id", "product", AS_OF)
    assert rows(diff, "operation", "record_id") == [("DELETE", 1), ("INSERT", 9), ("UPDATE", 2)]
    ages = spark.createDataFrame([(3, 10)], "purchase_id long, days int")
    moved = mutations.backdate(seed["purchase"], "purchase_id", "purchase_date", ages, AS_OF)
    assert rows(moved.where("purchase_id = 3"), "purchase_date") == [(AS_OF - dt.timedelta(days=10),)]


def test_customer_delete_is_guarded(spark, seed):
    edits = spark.createDataFrame([(2, " New ", " ")], "customer_id long, name string, contact string")
    deletes = spark.createDataFrame([(1,), (9,)], "customer_id long")
    result = mutations.edit_customers(seed, edits, deletes)
    assert rows(result.blocked) == [(1, "still referenced")]
    assert (2, "New", None) in rows(result.customers)


def test_restock_links(spark, seed):
    links = spark.createDataFrame([(1, 1), (1, 3), (1, None), (99, 1)], "product_id long, supplier_id long")
    assert rows(purchasing.resolve_restock(seed, links)) == [
        (1, 1, 1, "ok"), (1, 3, 1, "supplier corrected"), (1, None, 1, "ok"), (99, 1, None, "unknown product"),
    ]
