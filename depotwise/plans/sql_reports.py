"""Reports asked for in SQL text, over the registered views and functions."""

from __future__ import annotations

from depotwise.plans import sqlviews
from depotwise.plans.reports import Inputs, Report
from depotwise.sources.star import AGE_POLICY, AS_OF, RENT_POLICY


def _asked(text: str):
    def build(x: Inputs):
        sqlviews.register(x.spark, x.domain, AS_OF, AGE_POLICY, RENT_POLICY)
        return x.spark.sql(text)

    return build


REPORTS = {
    "sql_low_stock_products": Report(
        _asked("SELECT * FROM low_stock_products(25)"),
        """SELECT i.product_id, p.name AS product_name, i.quantity::BIGINT AS quantity
           FROM d_inventory AS i JOIN d_product AS p USING (product_id) WHERE i.quantity < 25""",
    ),
    "sql_pending_shipment_report": Report(
        _asked("SELECT * FROM pending_shipment_report() WHERE days_pending > 30"),
        """SELECT shipment_id, tracking_code, datesub('day', shipment_date, {as_of}) AS days_pending
           FROM d_shipment AS s WHERE datesub('day', shipment_date, {as_of}) > 30 AND NOT EXISTS (
             SELECT 1 FROM d_shipment_status AS t WHERE t.shipment_id = s.shipment_id AND t.status = 'Delivered')""",
    ),
    "sql_storage_age": Report(
        _asked(
            """SELECT warehouse_id, storage_age_band(days_stored) AS band, max(storage_age_multiplier(days_stored)) AS multiplier,
                 sum(units) AS units FROM warehouse_stock_age GROUP BY 1, 2"""
        ),
        """SELECT warehouse_id::BIGINT AS warehouse_id, CASE factor WHEN 3.0 THEN 'Dead stock' WHEN 2.0 THEN 'Stale'
             WHEN 1.5 THEN 'Aging' ELSE 'Fresh' END AS band, max(factor)::DOUBLE AS multiplier, sum(units)::BIGINT AS units
           FROM s_aged GROUP BY 1, 2""",
    ),
    "sql_hub_routing_preview": Report(
        _asked("SELECT warehouse_id, warehouse_name, on_hand, can_fulfil FROM hub_routing_preview(7, 20)"),
        """SELECT c.warehouse_id, f.name AS warehouse_name, c.on_hand::BIGINT AS on_hand, c.on_hand >= 20 AS can_fulfil
           FROM s_candidates AS c JOIN s_fill AS f USING (warehouse_id) WHERE c.product_id = 7""",
    ),
    "sql_campaign_revenue": Report(
        _asked("SELECT campaign_id, campaign_revenue(campaign_id) AS revenue FROM campaign_revenues UNION ALL SELECT -1, campaign_revenue(-1)"),
        """SELECT campaign_id, coalesce(sum(revenue), 0)::DOUBLE AS revenue FROM d_campaign LEFT JOIN s_link USING (campaign_id) GROUP BY 1
           UNION ALL SELECT -1, 0""",
    ),
    "sql_pick_source_warehouse": Report(
        _asked(
            """SELECT product_id, need, pick_source_warehouse(product_id, need) AS warehouse_id
               FROM (SELECT product_id, CAST(product_id % 60 + 1 AS INT) AS need FROM hub_stock GROUP BY product_id)"""
        ),
        """SELECT product_id, product_id % 60 + 1 AS need, arg_max(warehouse_id, (surcharge, oldest, on_hand, -warehouse_id))
             FILTER (on_hand >= product_id % 60 + 1)::DOUBLE AS warehouse_id
           FROM s_candidates GROUP BY product_id""",
        optional_ids=("warehouse_id",),
    ),
}
