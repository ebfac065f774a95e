"""Invariants on random data."""

from decimal import Decimal as D

from fixture import AS_OF, ago, rows, seed_domain
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from depotwise.operators import campaigns, mutations, stock
from depotwise.sources.domain import Domain

few = settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
lots = st.lists(st.tuples(st.integers(1, 2), st.integers(1, 2), st.integers(1, 30), st.integers(0, 120)), max_size=25)
on_hand = st.lists(st.integers(0, 80), min_size=4, max_size=4)
KEYS = [(1, 1), (1, 2), (2, 1), (2, 2)]


def build(spark, bought, left) -> Domain:
    return seed_domain(
        spark,
        purchase=[(i, 1, hub, ago(days)) for i, (hub, _, _, days) in enumerate(bought, 1)],
        purchase_item=[(i, i, product, units, D(1)) for i, (_, product, units, _) in enumerate(bought, 1)],
        inventory=[(i, *key, units) for i, (key, units) in enumerate(zip(KEYS, left, strict=True), 1)],
    )


@few
@given(bought=lots, left=on_hand)
def test_lots_never_exceed_stock_and_bills_add_up(spark, bought, left):
    d = build(spark, bought, left)
    units = {(r.warehouse_id, r.product_id): r.u for r in stock.remaining_lots(d).groupBy("warehouse_id", "product_id").agg(F.sum("units").alias("u")).collect()}
    for key, held in zip(KEYS, left, strict=True):
        assert units.get(key, 0) == min(held, sum(q for hub, product, q, _ in bought if (hub, product) == key))
    for r in stock.warehouse_rent(d, AS_OF).collect():
        assert r.total_daily_rent == r.base_daily_rent + r.surcharge_daily_rent
        assert r.surcharge_daily_rent >= 0


@few
@given(bought=lots, left=on_hand, share=st.integers(1, 40))
def test_transfers_conserve_units_and_ages(spark, bought, left, share):
    d = build(spark, bought, left)
    asked = [(i, product, hub, 3 - hub, share) for i, (hub, product) in enumerate(KEYS * 2)]
    requests = spark.createDataFrame(asked, "request_id long, product_id long, from_warehouse_id long, to_warehouse_id long, quantity int")
    moved = mutations.transfer_stock(d, requests, AS_OF)
    assert moved.inventory.agg(F.sum("quantity")).first()[0] == sum(left)
    assert moved.inventory.where("quantity < 0").count() == 0
    refused = moved.rejected.count()
    sent = moved.transfers.agg(F.coalesce(F.sum("quantity"), F.lit(0))).first()[0]
    assert sent == share * (len(asked) - refused)
    dated = {r.origin_date for r in moved.transfers.collect()}
    assert dated <= {ago(days) for *_, days in bought} | {AS_OF}


@few
@given(
    clicks=st.lists(st.integers(1, 7), max_size=20),
    sales=st.lists(st.tuples(st.integers(1, 7), st.integers(1, 5), st.integers(1, 99)), max_size=12),
)
def test_revenue_modes_match_the_plain_joins(spark, clicks, sales):
    d = seed_domain(
        spark,
        click=[(i, link, AS_OF, None, None, None) for i, link in enumerate(clicks, 1)],
        order_attribution=[(i, i, link, AS_OF) for i, (link, _, _) in enumerate(sales, 1)],
        order_item=[(i * 2 + part, i, 1, q, D(price)) for i, (_, q, price) in enumerate(sales, 1) for part in (0, 1)],
    )
    fanned = (
        d["tracking_link"].join(d["click"].select("link_id", "click_id"), "link_id", "left")
        .join(d["order_attribution"].select("link_id", "order_id"), "link_id", "left")
        .join(d["order_item"].select("order_id", "quantity", "unit_price"), "order_id", "left")
        .groupBy("platform")
        .agg(F.count_distinct("click_id"), F.count_distinct("order_id"),
             F.coalesce(F.sum(F.col("quantity") * F.col("unit_price")), F.lit(0)).cast("decimal(31,2)"))
    )
    assert rows(campaigns.platform_performance(d).drop("conversion_pct")) == rows(fanned)
    exact = campaigns.campaign_performance(d, "exact").agg(F.sum("total_revenue")).first()[0]
    assert exact == sum(2 * q * price for _, q, price in sales)
