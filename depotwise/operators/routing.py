"""Which hub should ship an order line, for any number of lines at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from depotwise.operators.stock import STOCK_KEY, Moment, aged_lots, warehouse_capacity
from depotwise.policy import AgePolicy
from depotwise.sources.domain import Domain


def routing_candidates(d: Domain, as_of: Moment, policy: AgePolicy = AgePolicy()) -> DataFrame:
    """Stock rows ranked within their product: most surcharge first, then the oldest lot, then most
    stock, then the lowest hub id.

    The hub chosen for a need is the first one in this ranking that holds enough. Walking down the
    ranking, a hub can only win needs above everything the hubs before it could cover, so each hub
    owns the half-open range ``(covered, on_hand]`` of needs and the ranges of a product are
    disjoint. A line then matches at most one hub: no line is ever paired with all hubs."""
    pressure = (
        aged_lots(d, as_of, policy)
        .groupBy(*STOCK_KEY)
        .agg(
            F.sum(F.col("units") * (F.col("rent_multiplier") - 1)).alias("surcharge"),
            F.max("days_stored").alias("oldest"),
        )
    )
    ranked = (
        Window.partitionBy("product_id")
        .orderBy(
            F.col("surcharge_units").desc(), F.col("oldest_days").desc(),
            F.col("on_hand").desc(), F.col("warehouse_id").asc(),
        )
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        d["inventory"]
        .join(pressure, STOCK_KEY, "left")
        .select(
            *STOCK_KEY,
            F.col("quantity").alias("on_hand"),
            F.coalesce("surcharge", F.lit(0)).cast("decimal(20,1)").alias("surcharge_units"),
            F.coalesce("oldest", F.lit(0)).alias("oldest_days"),
        )
        .withColumn("covered", F.coalesce(F.max("on_hand").over(ranked), F.lit(-1)))
    )


def _wins(need: str):
    return (F.col(need) > F.col("covered")) & (F.col(need) <= F.col("on_hand"))


def pick_source_warehouse(
    d: Domain, lines: DataFrame, as_of: Moment, policy: AgePolicy = AgePolicy()
) -> DataFrame:
    """``lines`` (product_id, quantity, ...) plus the hub that would ship each one, null if no
    single hub covers it. All lines see the same stock."""
    steps = (
        routing_candidates(d, as_of, policy)
        .where(F.col("on_hand") > F.col("covered"))
        .select(F.col("product_id").alias("_product"), "warehouse_id", "covered", "on_hand")
    )
    match = (F.col("product_id") == F.col("_product")) & _wins("quantity")
    return lines.join(steps, match, "left").drop("_product", "covered", "on_hand")


def hub_routing_preview(
    d: Domain, requests: DataFrame, as_of: Moment, policy: AgePolicy = AgePolicy()
) -> DataFrame:
    """Every hub holding a requested product, with its ranking values and whether it wins the
    request. ``requests`` is (product_id, quantity), one row per question."""
    hubs = warehouse_capacity(d).select("warehouse_id", F.col("name").alias("warehouse_name"), "utilisation_pct")
    return (
        requests.select("product_id", "quantity")
        .join(routing_candidates(d, as_of, policy), "product_id")
        .join(hubs, "warehouse_id")
        .select(
            "product_id", "quantity", "warehouse_id", "warehouse_name", "on_hand", "oldest_days",
            "surcharge_units", "utilisation_pct",
            (F.col("on_hand") >= F.col("quantity")).alias("can_fulfil"),
            _wins("quantity").alias("is_chosen"),
        )
    )


def rejection_reasons(d: Domain, unrouted: DataFrame) -> DataFrame:
    """Why lines without a hub cannot ship: nothing anywhere, too little in total, or enough in
    total but split across hubs."""
    totals = d["inventory"].groupBy("product_id").agg(F.sum("quantity").alias("total_units"))
    total = F.coalesce(F.col("total_units"), F.lit(0))
    reason = (
        F.when(total == 0, "no stock")
        .when(total < F.col("quantity"), "insufficient stock")
        .otherwise("split across hubs")
    )
    return unrouted.join(totals, "product_id", "left").withColumn("reason", reason).drop("total_units")
