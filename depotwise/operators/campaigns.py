"""Campaign analytics: clicks, attributed orders and revenue per link, campaign and platform."""

from __future__ import annotations

from typing import Literal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depotwise.functions import columns as C
from depotwise.operators import tables
from depotwise.operators.shipping import pending_shipments
from depotwise.operators.stock import Moment
from depotwise.policy import PLATFORMS, RECENT_CLICKS_LIMIT, UNKNOWN
from depotwise.sources.domain import Domain

RevenueMode = Literal["reference", "exact"]


def _clicks_per_link(d: Domain) -> DataFrame:
    return d["click"].groupBy("link_id").agg(F.count(F.lit(1)).alias("clicks"))


def _sales_per_link(d: Domain) -> DataFrame:
    """Attributed orders and their revenue per link. Lines are summed per order where the join left
    them, then only order sums travel on to the link."""
    amount = C.line_amount("quantity", "unit_price")
    per_order = (
        d["order_attribution"]
        .select("order_id", "link_id")
        .join(d["order_item"].select("order_id", "quantity", "unit_price"), "order_id", "left")
        .groupBy("order_id", "link_id")
        .agg(F.sum(amount).alias("amount"))
    )
    return per_order.groupBy("link_id").agg(
        F.count(F.lit(1)).alias("orders"), F.sum("amount").alias("revenue")
    )


def link_performance(d: Domain, revenue_mode: RevenueMode = "reference") -> DataFrame:
    """Clicks, orders and revenue per tracking link, links without any included.

    A click and an attributed order belong to exactly one link, so plain sums over links replace
    distinct counts. In ``reference`` mode a link's revenue counts once per click on it (at least
    once), which is what joining clicks and order lines before summing amounts to; ``exact`` counts
    every sale once. Neither mode ever joins clicks to order lines."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    weight = F.greatest(zero("clicks"), F.lit(1)) if revenue_mode == "reference" else F.lit(1)
    return (
        d["tracking_link"]
        .join(_clicks_per_link(d), "link_id", "left")
        .join(_sales_per_link(d), "link_id", "left")
        .select(
            "link_id", "campaign_id", "platform", "short_code",
            zero("clicks").cast("bigint").alias("clicks"),
            zero("orders").cast("bigint").alias("orders"),
            (zero("revenue") * weight).cast("decimal(31,2)").alias("revenue"),
        )
    )


def _totals():
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return [
        zero("clicks").alias("total_clicks"),
        zero("orders").alias("total_orders"),
        zero("revenue").cast("decimal(31,2)").alias("total_revenue"),
    ]


def campaign_performance(d: Domain, revenue_mode: RevenueMode = "reference") -> DataFrame:
    """Per campaign and platform; a campaign without links has one row with a null platform."""
    links = link_performance(d, revenue_mode)
    return (
        d["campaign"]
        .select("campaign_id", "campaign_name")
        .join(links, "campaign_id", "left")
        .groupBy("campaign_id", "campaign_name", "platform")
        .agg(*_totals())
    )


def platform_performance(d: Domain, revenue_mode: RevenueMode = "reference") -> DataFrame:
    """Per platform, with the share of clicks that became orders."""
    return (
        link_performance(d, revenue_mode)
        .groupBy("platform")
        .agg(*_totals())
        .withColumn("conversion_pct", C.conversion_pct("total_orders", "total_clicks"))
    )


def campaign_revenue(d: Domain, campaign_id: int | None = None) -> DataFrame:
    """Attributed revenue of one campaign or of all, zero where nothing was sold."""
    campaigns, links = d["campaign"].select("campaign_id"), d["tracking_link"].select("link_id", "campaign_id")
    if campaign_id is not None:
        campaigns = campaigns.where(F.col("campaign_id") == campaign_id)
        links = links.where(F.col("campaign_id") == campaign_id)
    earned = links.join(_sales_per_link(d), "link_id").groupBy("campaign_id").agg(F.sum("revenue").alias("r"))
    revenue = F.coalesce("r", F.lit(0)).cast("decimal(31,2)").alias("revenue")
    return campaigns.join(earned, "campaign_id", "left").select("campaign_id", revenue)


def campaign_rollup(d: Domain, revenue_mode: RevenueMode = "reference") -> DataFrame:
    """The campaign page: totals per campaign id with dates and product name."""
    totals = link_performance(d, revenue_mode).groupBy("campaign_id").agg(*_totals())
    products = d["product"].select("product_id", F.col("name").alias("product_name"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return (
        d["campaign"]
        .join(totals, "campaign_id", "left")
        .join(products, "product_id", "left")
        .select(
            "campaign_id", "campaign_name", F.coalesce("product_name", F.lit("-")).alias("product_name"),
            "start_date", "end_date",
            zero("total_clicks").cast("bigint").alias("clicks"),
            zero("total_orders").cast("bigint").alias("orders"),
            zero("total_revenue").cast("decimal(31,2)").alias("revenue"),
        )
    )


def top_campaigns(d: Domain, limit: int = 6, revenue_mode: RevenueMode = "reference") -> DataFrame:
    """Campaign names with most revenue; campaigns sharing a name count together."""
    by_name = (
        campaign_performance(d, revenue_mode)
        .groupBy(F.col("campaign_name").alias("name"))
        .agg(
            F.sum("total_orders").alias("orders"),
            F.sum("total_revenue").cast("decimal(31,2)").alias("revenue"),
        )
    )
    return tables.top(by_name, limit, F.col("revenue").desc(), F.col("name").asc())


def platforms_in_order(performance: DataFrame) -> DataFrame:
    """Platform rows in the fixed presentation order; others, and rows without a platform, come last."""
    rank = F.coalesce(C.platform_rank("platform"), F.lit(0))
    placed = performance.withColumn("position", F.when(rank > 0, rank).otherwise(len(PLATFORMS) + 1))
    return placed.orderBy("position", F.col("platform").asc_nulls_last())


def clicks_by_country(d: Domain, limit: int = 8) -> DataFrame:
    counts = d["click"].groupBy(C.known("country", UNKNOWN).alias("country")).agg(F.count(F.lit(1)).alias("clicks"))
    return tables.top(counts, limit, F.col("clicks").desc(), F.col("country").asc())


def clicks_by_device(d: Domain) -> DataFrame:
    return d["click"].groupBy(C.device_bucket("device").alias("device")).agg(F.count(F.lit(1)).alias("clicks"))


def link_clicks(d: Domain, campaign_id: int | None = None) -> DataFrame:
    """Links (of one campaign) with their number of clicks."""
    links = d["tracking_link"]
    if campaign_id is not None:
        links = links.where(F.col("campaign_id") == campaign_id)
    return links.join(_clicks_per_link(d), "link_id", "left").select(
        "link_id", "campaign_id", "platform", "short_code", F.coalesce("clicks", F.lit(0)).cast("bigint").alias("clicks")
    )


def recent_clicks(d: Domain, limit: int = RECENT_CLICKS_LIMIT, last_seen_id: int | None = None) -> DataFrame:
    """Newest clicks; ``is_new`` marks those after the last one a viewer has seen."""
    newest = tables.top(d["click"], limit, F.col("click_time").desc(), F.col("click_id").desc())
    is_new = F.lit(False) if last_seen_id is None else F.col("click_id") > last_seen_id
    links = d["tracking_link"].select("link_id", "short_code", "platform")
    return newest.join(links, "link_id", "left").select(
        "click_id", "click_time", "short_code", "platform", C.known("country", "-").alias("country"), is_new.alias("is_new")
    )


def tracking_links(d: Domain) -> DataFrame:
    campaigns = d["campaign"].select("campaign_id", "campaign_name")
    return d["tracking_link"].join(campaigns, "campaign_id", "left").select(
        "link_id", "short_code", "platform", F.coalesce("campaign_name", F.lit("-")).alias("campaign_name"), "destination_url"
    )


def resolve_codes(d: Domain, arrivals: DataFrame) -> DataFrame:
    """Arrivals (…, code) matched to their link: attribution plus the address to continue to.
    Arrivals without a code or with an unknown one stay, with their outcome."""
    links = (
        d["tracking_link"]
        .join(d["campaign"].select("campaign_id", "campaign_name"), "campaign_id", "left")
        .select(F.col("short_code").alias("code"), "link_id", "platform", "campaign_name", "destination_url")
    )
    outcome = (
        F.when(F.coalesce("code", F.lit("")) == "", "no code")
        .when(F.col("link_id").isNull(), "unknown code")
        .otherwise("matched")
    )
    return (
        arrivals.join(links, "code", "left")
        .withColumn("outcome", outcome)
        .withColumn("continue_to", C.with_code("destination_url", "code"))
        .drop("destination_url")
    )


def dashboard_kpis(d: Domain, as_of: Moment) -> DataFrame:
    """One row: revenue, orders, campaigns, clicks and pending shipments."""
    count = lambda df: df.agg(F.count(F.lit(1))).scalar()
    revenue = F.coalesce(F.sum(C.line_amount("quantity", "unit_price")), F.lit(0)).cast("decimal(31,2)")
    return d["order_item"].agg(revenue.alias("revenue")).select(
        "revenue",
        count(d["order"]).alias("orders"),
        count(d["campaign"]).alias("campaigns"),
        count(d["click"]).alias("clicks"),
        count(pending_shipments(d, as_of)).alias("pending"),
    )
