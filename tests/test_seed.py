"""Results derived by hand from the seed data."""

from decimal import Decimal as D

import pytest
from fixture import AS_OF, OPENING, ORDERS, ago, rows, seed_domain, stock_rows

from depotwise.operators import allocation, campaigns, mutations, orders, purchasing, quality, routing, shipping, stock


def test_stock_age(seed):
    found = {
        (r.warehouse_id, r.product_id): (r.units, r.days_stored, r.age_band, r.rent_multiplier, r.daily_rent)
        for r in stock.warehouse_stock_age(seed, AS_OF).collect()
    }
    fresh = lambda units, rent: (units, 0, "Fresh", D("1.0"), D(rent))
    assert found == {
        (2, 1): (17, 105, "Dead stock", D("3.0"), D("153.00")),
        (1, 4): (30, 95, "Dead stock", D("3.0"), D("225.00")),
        (1, 5): (5, 72, "Stale", D("2.0"), D("25.00")),
        (1, 6): (15, 45, "Aging", D("1.5"), D("56.25")),
        (2, 4): (12, 38, "Aging", D("1.5"), D("54.00")),
        (1, 1): fresh(40, "100.00"), (1, 2): fresh(25, "62.50"), (1, 3): fresh(96, "240.00"),
        (2, 2): fresh(10, "30.00"), (2, 3): fresh(60, "180.00"), (2, 5): fresh(5, "15.00"), (2, 6): fresh(20, "60.00"),
    }


def test_capacity_and_rent(seed):
    overview = rows(
        stock.warehouse_overview(seed, AS_OF), "warehouse_id", "used_units", "free_units", "utilisation_pct",
        "capacity_status", "rent_per_unit_day", "overdue_units", "oldest_days", "base_daily_rent",
        "surcharge_daily_rent", "total_daily_rent", "total_monthly_rent",
    )
    assert overview == [
        (1, 211, 189, D("52.8"), "OK", D("2.50"), 50, 95, D("527.50"), D("181.25"), D("708.75"), D("21262.50")),
        (2, 124, 26, D("82.7"), "HIGH", D("3.00"), 29, 105, D("372.00"), D("120.00"), D("492.00"), D("14760.00")),
    ]


def test_routing(spark, seed):
    requests = spark.createDataFrame([(1, 3), (1, 50), (3, 200), (99, 1)], "product_id long, quantity int")
    preview = routing.hub_routing_preview(seed, requests.where("product_id = 1 and quantity = 3"), AS_OF)
    assert rows(preview, "warehouse_id", "on_hand", "oldest_days", "surcharge_units", "can_fulfil", "is_chosen") == [
        (1, 40, 0, D("0.0"), True, False),
        (2, 17, 105, D("34.0"), True, True),
    ]
    picked = routing.pick_source_warehouse(seed, requests, AS_OF)
    assert rows(picked, "product_id", "quantity", "warehouse_id") == [(1, 3, 2), (1, 50, None), (3, 200, None), (99, 1, None)]
    reasons = routing.rejection_reasons(seed, picked.where("warehouse_id is null"))
    assert rows(reasons, "product_id", "reason") == [(1, "split across hubs"), (3, "insufficient stock"), (99, "no stock")]


def test_allocation_reaches_the_final_stock(spark, seed):
    before = seed.replace(inventory=lambda: seed_domain(spark, inventory=stock_rows(OPENING))["inventory"])
    lines = seed["order_item"].join(seed["order"].select("order_id", "order_date"), "order_id")
    result = allocation.allocate_orders(before, lines, AS_OF)
    assert rows(result.lines, "order_id", "warehouse_id") == [(1, 2), (2, 2), (3, 1), (4, 1), (5, 1), (6, 1)]
    key = ["warehouse_id", "product_id", "quantity"]
    assert rows(result.inventory, *key) == rows(seed["inventory"], *key)
    assert result.rejected.count() == 0
    stamps = mutations.stamp_hub(result.lines, seed["warehouse"])
    assert rows(stamps)[0] == (1, "Hub Two") and len(ORDERS) == stamps.count()


def test_campaigns(seed):
    assert rows(campaigns.campaign_revenue(seed)) == [(1, D("5697.00")), (2, D("1996.00")), (3, D("3897.00"))]
    assert rows(campaigns.campaign_revenue(seed, 2)) == [(2, D("1996.00"))]
    performance = rows(campaigns.campaign_performance(seed).drop("campaign_name"))
    assert performance == [
        (1, "Email", 2, 1, D("7596.00")), (1, "Facebook", 3, 1, D("5697.00")), (1, "Instagram", 2, 0, D("0.00")),
        (2, "Facebook", 3, 1, D("4491.00")), (2, "WhatsApp", 1, 1, D("499.00")),
        (3, "Email", 2, 1, D("5196.00")), (3, "Instagram", 1, 1, D("1299.00")),
    ]
    assert rows(campaigns.platform_performance(seed)) == [
        ("Email", 4, 2, D("12792.00"), D("50.0")), ("Facebook", 6, 2, D("10188.00"), D("33.3")),
        ("Instagram", 3, 1, D("1299.00"), D("33.3")), ("WhatsApp", 1, 1, D("499.00"), D("100.0")),
    ]
    exact = campaigns.platform_performance(seed, "exact")
    assert [r[1] for r in rows(exact, "platform", "total_revenue")] == [D("6396.00"), D("3396.00"), D("1299.00"), D("499.00")]
    ordered = campaigns.platforms_in_order(campaigns.platform_performance(seed))
    assert [r.platform for r in ordered.collect()] == ["Facebook", "Instagram", "WhatsApp", "Email"]


def test_dashboard(seed):
    assert rows(campaigns.dashboard_kpis(seed, AS_OF)) == [(D("11590.00"), 6, 3, 14, 5)]
    assert rows(purchasing.purchase_stats(seed)) == [(12, 345, D("242850.00"), 6)]
    assert [tuple(r) for r in orders.top_products(seed).collect()] == [
        ("Product 1", 3, D("5697.00")), ("Product 5", 3, D("3897.00")), ("Product 3", 4, D("1996.00")),
    ]
    assert [r.product_count for r in purchasing.supplier_product_count(seed).collect()] == [2, 2, 2]
    assert rows(campaigns.clicks_by_country(seed)) == [("Bangladesh", 12), ("India", 1), ("UAE", 1)]
    assert rows(campaigns.clicks_by_device(seed)) == [("Android", 6), ("Desktop", 8)]


def test_low_stock(seed):
    assert rows(stock.low_stock_by_hub(seed)) == [(5, "Product 5", 5), (5, "Product 5", 5)]
    assert stock.low_stock_by_product(seed).count() == 0
    assert rows(stock.inventory_kpis(seed)) == [(6, 335, 2, 0)]


def test_shipments(seed):
    assert rows(shipping.pending_shipments(seed, AS_OF)) == [
        (2, "TRK2", 3), (3, "TRK3", 2), (4, "TRK4", 1), (5, "TRK5", 0), (6, "TRK6", 0),
    ]
    assert rows(shipping.shipments_by_status(seed), "position", "shipments") == [(1, 4), (2, 1), (3, 0), (4, 1)]
    fulfilment = orders.order_fulfilment(seed)
    assert rows(fulfilment, "order_id", "source_warehouse_id", "units", "shipment_status") == [
        (1, 2, 2, "Delivered"), (2, 2, 1, "In Transit"), (3, 1, 3, "Packed"),
        (4, 1, 1, "Packed"), (5, 1, 2, "Packed"), (6, 1, 1, "Packed"),
    ]
    timeline = shipping.shipment_timeline(seed).where("tracking_code = 'TRK2'")
    assert [r[1] for r in rows(timeline, "position", "state")] == ["done", "current", "", ""]
    board = rows(shipping.shipment_board(seed), "shipment_id", "bucket", "next_status")
    assert board[:3] == [(1, "delivered", None), (2, "transit", "Out For Delivery"), (3, "pending", "In Transit")]


def test_transfer_keeps_the_age(spark, seed):
    request = spark.createDataFrame(
        [(1, 1, 2, 1, 5)], "request_id long, product_id long, from_warehouse_id long, to_warehouse_id long, quantity int"
    )
    moved = mutations.transfer_stock(seed, request, AS_OF)
    assert rows(moved.transfers, "from_warehouse_id", "to_warehouse_id", "quantity", "origin_date") == [(2, 1, 5, ago(105))]
    after = seed.replace(inventory=moved.inventory, stock_transfer=moved.transfers)
    aged = stock.warehouse_stock_age(after, AS_OF).where("product_id = 1")
    assert rows(aged, "warehouse_id", "units", "days_stored") == [(1, 40, 0), (1, 5, 105), (2, 12, 105)]


@pytest.mark.parametrize("table", ["order_item", "click", "shipment_status", "purchase_item", "inventory"])
def test_seed_is_clean(seed, table):
    quality.assert_clean(quality.table_violations(seed, table))


def test_ledger_agrees_with_the_snapshot(seed):
    assert stock.ledger_reconciliation(seed).count() == 0
    assert quality.supplier_mismatches(seed).count() == 0
    assert stock.movement_balance(seed).where("balance < 0").count() == 0
