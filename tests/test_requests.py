"""Batches of requests: codes after deletions, purchases of several lines, arrivals with limited room, pages in any order."""

import datetime as dt
import random

import pytest
from fixture import AS_OF, rows, seed_domain

from depotwise.operators import mutations, orders, tables
from depotwise.session import materialise, release, work_path

PLATFORMS = "campaign_id long, product_id long, platforms array<string>"


def test_codes_stay_unique_after_a_deletion(spark, seed):
    wanted = spark.createDataFrame([(10, 1, ["Facebook"])], PLATFORMS)
    known = seed["tracking_link"]
    for _ in range(3):
        known = materialise(known.unionByName(mutations.generate_links(seed.replace(tracking_link=known), wanted, "s").links), "links")
    code = known.where("campaign_id = 10 AND short_code NOT LIKE '%-%-%'").first().short_code
    left = known.where(f"short_code <> '{code}'")  # -2 and -3 stay
    made = mutations.generate_links(seed.replace(tracking_link=left), wanted, "s").links.collect()
    assert [r.short_code for r in made] == [f"{code}-4"]


def at(minute):
    return AS_OF + dt.timedelta(minutes=minute)


def test_purchases_of_several_lines_are_placed_as_a_whole(spark, seed):
    requests = spark.createDataFrame(
        [(1, 1, 2, at(2)), (2, 1, 2, at(1)), (3, 1, 9, at(3)), (4, 1, 2, None), (5, 1, 2, at(5)), (6, 2, 2, at(6)), (7, 1, 2, at(7)), (8, 1, 2, at(8)), (8, 1, 2, at(8))],
        "request_id long, supplier_id long, warehouse_id long, requested_at timestamp_ntz",
    )
    lines = spark.createDataFrame(
        [(1, 1, 1, 20, 5), (1, 2, 2, 3, 5), (2, 1, 1, 4, 5), (2, 2, 1, 2, 6), (3, 1, 1, 1, 1), (4, 1, 1, 1, 1), (6, 1, 1, 1, 1), (6, 2, 3, 0, 1),
         (7, 2, 2, 1, -1), (7, 1, 99, 1, 1), (8, 1, 1, 1, 1)],
        "request_id long, line_no long, product_id long, quantity int, unit_cost int",
    )
    made = mutations.place_purchase_orders(seed, requests, lines)
    # 26 units are free: request 2 takes 6 of them first, so 23 do not fit
    assert sorted((r.key, r.reason) for r in made.rejected.collect()) == [
        (1, "hub full"), (3, "unknown hub"), (4, "no time"), (5, "no lines"), (6, "product of another supplier"), (7, "unknown product"),
        (8, "request id not unique"), (8, "request id not unique"),
    ]
    assert rows(made.purchases, "purchase_id", "supplier_id", "warehouse_id") == [(13, 1, 2)]
    assert rows(made.items) == [(13, 13, 1, 4, 5), (14, 13, 1, 2, 6)]


def test_arrivals_stop_where_the_hub_is_full(spark, seed):
    rng = random.Random(0)
    purchases = [(100 + i, 1, 2, at(i // 2)) for i in range(30)]
    items = [(1000 + i, 100 + i, 1, rng.randrange(1, 9), 1) for i in range(29)]
    d = seed_domain(spark)
    d = d.replace(
        purchase=spark.createDataFrame(purchases, seed["purchase"].schema),
        purchase_item=spark.createDataFrame([(a, b, c, q, None) for a, b, c, q, _ in items], "purchase_item_id long, purchase_id long, product_id long, quantity int, unit_cost decimal(10,2)"),
    )
    free, refused = 26, []
    for (purchase, *_), item in zip(purchases, items):
        if item[3] <= free:
            free -= item[3]
        else:
            refused.append((purchase, "hub full"))
    got = mutations.receive_purchases(d, d["purchase"])
    assert sorted((r.key, r.reason) for r in got.rejected.collect()) == sorted([*refused, (129, "purchase without lines")])
    stored = sum(r.quantity for r in got.inventory.where("warehouse_id = 2").collect())
    assert stored == 150 - free and got.received.count() == 29 - len(refused)


@pytest.mark.parametrize("sort", [[("name", False), ("size", True)], [("day", True)], [("size", True), ("name", True)], [("day", False), ("name", False)]])
def test_pages_in_any_order_give_every_row_once(spark, sort):
    rng = random.Random(2)
    data = [
        (i, rng.choice(["b", "B", "a", "Ä", "", None]), rng.choice([1, 2, 3, None]), rng.choice([dt.date(2026, 1, d) for d in (1, 2, 3)] + [None]))
        for i in range(60)
    ]
    df = spark.createDataFrame(data, "id long, name string, size int, day date")
    sort = [*sort, ("id", False)]
    expected = [r.id for r in df.orderBy(*[tables.sort_key(df, *key) for key in sort]).collect()]
    seen, after = [], None
    while True:
        page = tables.page_by(df, sort, 13, after).collect()
        seen += [r.id for r in page]
        if len(page) < 13:
            break
        after = [page[-1][name] for name, _ in sort]
    assert seen == expected


def test_the_bound_of_a_page_reaches_the_scan(spark, tmp_path):
    spark.range(1000).selectExpr("id", "cast(id % 50 as int) AS size", "cast(id as string) AS name").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    page = tables.page_by(df, [("size", True), ("name", False), ("id", False)], 10, (7, "2", 3))
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(size,7)" in plan


def test_nested_orders_come_back_as_stored(spark, seed):
    path = work_path(spark, "nested")
    d = seed.replace(order=seed["order"].unionByName(seed["order"].limit(1).selectExpr("order_id + 100 AS order_id", "customer_id", "order_date", "status")))
    orders.store_orders_with_items(d, path)
    nested = orders.read_orders_with_items(spark, path)
    assert nested.count() == 7 and nested.where("size(items) = 0").count() == 1
    got = rows(orders.items_of(nested), "order_id", "place", "product_id", "quantity", "unit_price")
    assert got == rows(seed["order_item"].selectExpr("order_id", "0 AS place", "product_id", "quantity", "unit_price"))
    plan = nested.selectExpr("explode(items.quantity)")._jdf.queryExecution().executedPlan().toString()
    assert "struct<quantity:int>" in plan and "customer" not in plan


def test_intermediates_can_be_released(spark):
    df = materialise(spark.range(5), "short-lived")
    assert df.count() == 5 and release(spark) >= 1
    with pytest.raises(Exception, match="(?i)exist|found"):
        spark.read.schema("id long").parquet(df.inputFiles()[0]).count()
