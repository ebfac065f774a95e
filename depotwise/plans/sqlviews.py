"""The report surface for ``spark.sql`` users: views by name, and functions with parameters.

Views are the operators themselves, so a filter in the query text reaches their plans; functions are
SQL functions over those views and inline into the calling query."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from depotwise.functions.sqlfuncs import register_age_functions
from depotwise.operators import campaigns, orders, purchasing, routing, shipping, stock
from depotwise.operators.stock import Moment
from depotwise.policy import LOW_STOCK_THRESHOLD, AgePolicy, RentPolicy
from depotwise.sources.domain import Domain


def register(
    spark: SparkSession,
    d: Domain,
    as_of: Moment,
    age_policy: AgePolicy = AgePolicy(),
    rent_policy: RentPolicy = RentPolicy(),
) -> None:
    """Create all report views and functions in the session, as of one moment."""
    hubs = stock.warehouse_capacity(d).select("warehouse_id", F.col("name").alias("warehouse_name"), "utilisation_pct")
    views = {
        "warehouse_stock_age": stock.warehouse_stock_age(d, as_of, age_policy, rent_policy),
        "warehouse_capacity": stock.warehouse_capacity(d),
        "warehouse_rent": stock.warehouse_rent(d, as_of, age_policy, rent_policy),
        "warehouse_overview": stock.warehouse_overview(d, as_of, age_policy, rent_policy),
        "campaign_performance": campaigns.campaign_performance(d),
        "platform_performance": campaigns.platform_performance(d),
        "supplier_product_count": purchasing.supplier_product_count(d),
        "purchase_history": purchasing.purchase_history(d),
        "order_fulfilment": orders.order_fulfilment(d),
        "pending_shipments": shipping.pending_shipments(d, as_of),
        "campaign_revenues": campaigns.campaign_revenue(d),
        "hub_stock": stock.stock_levels(d).select("product_id", "product_name", "warehouse_id", "quantity"),
        "hub_ranking": routing.routing_candidates(d, as_of, age_policy).join(hubs, "warehouse_id"),
    }
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    register_age_functions(spark, age_policy)

    wins = "need > covered AND need <= on_hand"
    functions = {
        f"low_stock_products(threshold INT DEFAULT {LOW_STOCK_THRESHOLD}) "
        "RETURNS TABLE(product_id BIGINT, product_name STRING, quantity INT)": (
            "SELECT product_id, product_name, quantity FROM hub_stock WHERE quantity < threshold"
        ),
        "pending_shipment_report() RETURNS TABLE(shipment_id BIGINT, tracking_code STRING, days_pending INT)": (
            "SELECT * FROM pending_shipments"
        ),
        "campaign_revenue(campaign BIGINT) RETURNS DECIMAL(31,2)": (
            "coalesce((SELECT max(revenue) FROM campaign_revenues WHERE campaign_id = campaign), 0)"
        ),
        "pick_source_warehouse(product BIGINT, need INT) RETURNS BIGINT": (
            f"(SELECT max(warehouse_id) FROM hub_ranking WHERE product_id = product AND {wins})"
        ),
        "hub_routing_preview(product BIGINT, need INT DEFAULT 1) "
        "RETURNS TABLE(warehouse_id BIGINT, warehouse_name STRING, on_hand INT, oldest_days INT, "
        "surcharge_units DECIMAL(20,1), utilisation_pct DECIMAL(12,1), can_fulfil BOOLEAN, is_chosen BOOLEAN)": (
            "SELECT warehouse_id, warehouse_name, on_hand, oldest_days, surcharge_units, utilisation_pct, "
            f"on_hand >= need, {wins} FROM hub_ranking WHERE product_id = product"
        ),
    }
    for signature, body in functions.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
