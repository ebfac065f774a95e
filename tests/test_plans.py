"""Physical plans keep the shape they were designed for."""

import re

import pytest

from depotwise.operators import campaigns, shipping, stock, tables
from depotwise.plans.catalog import reports
from depotwise.session import work_path
from depotwise.sources import domain
from depotwise.sources.star import star_domain

ROOT = "/root/testdata/sf0.001"
STATEFUL = {name for name in reports() if name.startswith(("stream_", "allocate_"))}
WRITING = {name for name in reports() if name.startswith(("place_", "reverse_", "transfer_stock", "generate_", "upsert_", "create_"))}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark):
    """Domain tables on storage, as a user has them."""
    root = work_path(spark, "stored")
    d = star_domain(spark, ROOT)
    for name in ("shipment", "shipment_status", "inventory", "click", "tracking_link", "order_attribution", "order_item"):
        domain.append(d[name], root, name)
    return domain.load(spark, root)


@pytest.mark.parametrize("name", sorted(set(reports()) - STATEFUL - WRITING))
def test_no_cartesian_products_and_no_python(spark, name):
    text = plan(reports()[name].run(spark, ROOT))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "InPandas" not in text and "BatchEvalPython" not in text and "ArrowEvalPython" not in text


def test_pending_is_an_anti_join_on_two_pruned_scans(stored):
    text = plan(shipping.pending_shipments(stored, "2001-12-01 00:00:00"))
    assert "LeftAnti" in text and "EqualTo(status,Delivered)" in text
    assert re.search(r"ReadSchema: struct<shipment_id:bigint,status:string>", text)


def test_low_stock_filter_reaches_the_scan(stored, spark):
    d = stored.replace(product=star_domain(spark, ROOT)["product"])
    assert "LessThan(quantity,10)" in plan(stock.low_stock_by_hub(d))


def test_performance_never_joins_clicks_to_order_lines(stored):
    text = plan(campaigns.platform_performance(stored))
    clicks = text.index("ReadSchema: struct<link_id:bigint>")
    assert "partial_count(1)" in text[:clicks]


def test_lots_are_windowed_by_block(spark):
    d = star_domain(spark, ROOT)
    text = plan(stock.remaining_lots(d))
    assert text.count("lot_id#") > 0
    windows = re.findall(r"Window \[sum\(quantity[^\n]*", text)
    assert windows and all("_block" in w for w in windows)


def test_a_page_bound_reaches_the_scan(stored):
    page = tables.page_after(stored["shipment"], ["shipment_date", "shipment_id"], 5, after=("2001-07-30 00:00:00", 0))
    assert re.search(r"PushedFilters: \[[^\]]*LessThanOrEqual\(shipment_date", plan(page))
