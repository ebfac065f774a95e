"""Reports on campaigns, tracking links and clicks."""

from __future__ import annotations

from pyspark.sql import functions as F

from depotwise.functions import columns as C
from depotwise.operators import campaigns, tables
from depotwise.plans.reports import Inputs, Report
from depotwise.sources.star import AS_OF, StarTables


def _arrivals(x: Inputs):
    """Page visits carrying a tracking code: some right, some unknown, some without one."""
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    code = (
        F.when(k % 10 == 9, F.lit(None))
        .when(k % 10 == 8, F.concat(F.lit("XX-"), k.cast("string")))
        .otherwise(F.concat(F.lit("FB-"), (F.col("user_id") % 10 + 1).cast("string")))
    )
    return StarTables(x.spark, x.root)("events").where(F.col("event_type") == "view").select("event_id", code.alias("code"))


# The plain fan-out: clicks and order lines joined to the link before summing.
FANNED = """SELECT l.link_id, l.campaign_id, l.platform, k.click_id, a.order_id, i.quantity * i.unit_price AS amount
    FROM d_tracking_link AS l LEFT JOIN d_click AS k USING (link_id) LEFT JOIN d_order_attribution AS a USING (link_id)
    LEFT JOIN d_order_item AS i USING (order_id)"""
FAN_TOTALS = """count(DISTINCT click_id) AS total_clicks, count(DISTINCT f.order_id) AS total_orders,
    coalesce(sum(amount), 0)::DOUBLE AS total_revenue"""
WEIGHTED = "SELECT *, revenue * greatest(clicks, 1) AS weighted FROM s_link"

def _by_recency(x: Inputs):
    """Page of campaigns, newest first, that reaches those without a date."""
    rows = tables.page_by(x.domain["campaign"], [("start_date", True), ("campaign_id", False)], 40, ("2001-02-01", 0))
    return rows.select("campaign_id", "start_date")


REPORTS = {
    "campaign_revenue": Report(
        lambda x: campaigns.campaign_revenue(x.domain),
        """SELECT campaign_id, coalesce(sum(revenue), 0)::DOUBLE AS revenue
           FROM d_campaign LEFT JOIN s_link USING (campaign_id) GROUP BY campaign_id""",
    ),
    "link_performance": Report(
        lambda x: campaigns.link_performance(x.domain, "exact"),
        """SELECT link_id, campaign_id, platform, short_code, clicks, orders, revenue::DOUBLE AS revenue FROM s_link""",
    ),
    "campaign_performance": Report(
        lambda x: campaigns.campaign_performance(x.domain),
        f"""SELECT c.campaign_id, c.campaign_name, f.platform, {FAN_TOTALS}
            FROM d_campaign AS c LEFT JOIN t_fanned AS f USING (campaign_id) GROUP BY 1, 2, 3""",
        tables={"t_fanned": FANNED},
    ),
    "campaign_performance_exact": Report(
        lambda x: campaigns.campaign_performance(x.domain, "exact"),
        """SELECT c.campaign_id, c.campaign_name, l.platform, coalesce(sum(clicks), 0)::BIGINT AS total_clicks,
             coalesce(sum(orders), 0)::BIGINT AS total_orders, coalesce(sum(revenue), 0)::DOUBLE AS total_revenue
           FROM d_campaign AS c LEFT JOIN s_link AS l USING (campaign_id) GROUP BY 1, 2, 3""",
    ),
    "platform_performance": Report(
        lambda x: campaigns.platform_performance(x.domain),
        f"""SELECT *, CASE WHEN total_clicks = 0 THEN 0 ELSE
              round(CAST(total_orders AS DECIMAL(18,6)) * 100 / total_clicks, 1) END::DOUBLE AS conversion_pct
            FROM (SELECT f.platform, {FAN_TOTALS} FROM t_fanned AS f GROUP BY 1) AS q""",
        tables={"t_fanned": FANNED},
    ),
    "platform_performance_exact": Report(
        lambda x: campaigns.platform_performance(x.domain, "exact"),
        """SELECT platform, sum(clicks)::BIGINT AS total_clicks, sum(orders)::BIGINT AS total_orders,
             sum(revenue)::DOUBLE AS total_revenue, CASE WHEN sum(clicks) = 0 THEN 0 ELSE
               round(CAST(sum(orders) AS DECIMAL(18,6)) * 100 / sum(clicks), 1) END::DOUBLE AS conversion_pct
           FROM s_link GROUP BY platform""",
    ),
    "campaign_rollup": Report(
        lambda x: campaigns.campaign_rollup(x.domain),
        """SELECT c.campaign_id, c.campaign_name, p.name AS product_name, c.start_date::VARCHAR AS start_date,
             c.end_date::VARCHAR AS end_date,
             coalesce(sum(w.clicks), 0)::BIGINT AS clicks, coalesce(sum(w.orders), 0)::BIGINT AS orders,
             coalesce(sum(w.weighted), 0)::DOUBLE AS revenue
           FROM d_campaign AS c JOIN d_product AS p USING (product_id) LEFT JOIN t_weighted AS w USING (campaign_id)
           GROUP BY 1, 2, 3, 4, 5""",
        tables={"t_weighted": WEIGHTED},
    ),
    "top_campaigns": Report(
        lambda x: campaigns.top_campaigns(x.domain),
        """SELECT c.campaign_name AS name, coalesce(sum(w.orders), 0)::BIGINT AS orders,
             coalesce(sum(w.weighted), 0)::DOUBLE AS revenue
           FROM d_campaign AS c LEFT JOIN t_weighted AS w USING (campaign_id) GROUP BY 1
           ORDER BY coalesce(sum(w.weighted), 0) DESC, 1 LIMIT 6""",
        tables={"t_weighted": WEIGHTED},
    ),
    "platforms_in_order": Report(
        lambda x: campaigns.platforms_in_order(campaigns.platform_performance(x.domain)).select(
            "position", "platform", "total_clicks", "total_revenue"
        ),
        """SELECT o.position::BIGINT AS position, o.platform, sum(clicks)::BIGINT AS total_clicks,
             sum(weighted)::DOUBLE AS total_revenue
           FROM (VALUES (1, 'Facebook'), (2, 'Instagram'), (3, 'WhatsApp'), (4, 'Email')) AS o(position, platform)
           JOIN t_weighted AS w USING (platform) GROUP BY 1, 2""",
        tables={"t_weighted": WEIGHTED},
    ),
    "clicks_by_country": Report(
        lambda x: campaigns.clicks_by_country(x.domain),
        """SELECT coalesce(nullif(country, ''), 'Unknown') AS country, count(*) AS clicks FROM d_click GROUP BY 1
           ORDER BY clicks DESC, 1 LIMIT 8""",
    ),
    "clicks_by_device": Report(
        lambda x: campaigns.clicks_by_device(x.domain),
        """SELECT CASE WHEN device ILIKE '%android%' OR device ILIKE '%mobile%' THEN 'Android'
             WHEN device ILIKE '%iphone%' THEN 'iOS' WHEN device ILIKE '%ipad%' OR device ILIKE '%tablet%' THEN 'Tablet'
             ELSE 'Desktop' END AS device, count(*) AS clicks FROM d_click GROUP BY 1""",
    ),
    "link_clicks": Report(
        lambda x: campaigns.link_clicks(x.domain),
        """SELECT link_id, campaign_id, platform, short_code, count(click_id) AS clicks
           FROM d_tracking_link LEFT JOIN d_click USING (link_id) GROUP BY ALL""",
    ),
    "recent_clicks": Report(
        lambda x: campaigns.recent_clicks(x.domain, last_seen_id=900),
        """SELECT k.click_id, k.click_time, l.short_code, l.platform, coalesce(nullif(k.country, ''), '-') AS country,
             k.click_id > 900 AS is_new
           FROM d_click AS k LEFT JOIN d_tracking_link AS l USING (link_id)
           ORDER BY k.click_time DESC, k.click_id DESC LIMIT 20""",
    ),
    "tracking_links": Report(
        lambda x: campaigns.tracking_links(x.domain),
        """SELECT l.link_id, l.short_code, l.platform, c.campaign_name, l.destination_url
           FROM d_tracking_link AS l JOIN d_campaign AS c USING (campaign_id)""",
    ),
    "resolve_codes": Report(
        lambda x: campaigns.resolve_codes(x.domain, _arrivals(x)),
        """SELECT v.event_id, v.code, l.link_id::DOUBLE AS link_id, l.platform, c.campaign_name,
             CASE WHEN v.code IS NULL THEN 'no code' WHEN l.link_id IS NULL THEN 'unknown code' ELSE 'matched' END AS outcome,
             l.destination_url || CASE WHEN contains(l.destination_url, '?') THEN '&' ELSE '?' END || 'code=' || v.code
               AS continue_to
           FROM (SELECT event_id, CASE k % 10 WHEN 9 THEN NULL WHEN 8 THEN 'XX-' || k
                   ELSE 'FB-' || (user_id % 10 + 1) END AS code
                 FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events) AS e
                 WHERE event_type = 'view') AS v
           LEFT JOIN d_tracking_link AS l ON l.short_code = v.code
           LEFT JOIN d_campaign AS c ON c.campaign_id = l.campaign_id""",
        optional_ids=("link_id",),
    ),
    "dashboard_kpis": Report(
        lambda x: campaigns.dashboard_kpis(x.domain, AS_OF),
        """SELECT (SELECT sum(quantity * unit_price) FROM d_order_item)::DOUBLE AS revenue,
             (SELECT count(*) FROM d_order) AS orders, (SELECT count(*) FROM d_campaign) AS campaigns,
             (SELECT count(*) FROM d_click) AS clicks, (SELECT count(*) FROM d_shipment WHERE shipment_id NOT IN
               (SELECT shipment_id FROM d_shipment_status WHERE status = 'Delivered')) AS pending""",
    ),
    "campaigns_by_recency": Report(
        _by_recency,
        """SELECT campaign_id, CAST(start_date AS VARCHAR) AS start_date FROM d_campaign
           WHERE start_date <= DATE '2001-02-01' OR start_date IS NULL ORDER BY start_date DESC NULLS LAST, campaign_id LIMIT 40""",
    ),
    "campaign_file_names": Report(
        lambda x: x.domain["campaign"].join(x.domain["product"].select("product_id", "name"), "product_id").select(
            "campaign_id", C.slug(F.concat_ws(" / ", "campaign_name", "name")).alias("file_name")
        ),
        """SELECT campaign_id, trim(regexp_replace(lower(campaign_name || ' / ' || name), '[^a-z0-9]+', '-', 'g'), '-') AS file_name
           FROM d_campaign JOIN d_product USING (product_id)""",
    ),
}
