"""Domain tables derived from the star-schema test tables (orders, lineitem, part, events, ...).

Every domain table is an expression over a given table, so the work of a query grows with its input.
Line items play three parts, chosen by their flags: returned-and-filled ones are stock transfers,
other A / R ones purchases, N ones customer orders. ``hub`` picks what acts as a warehouse: the five
regions (deep lot histories) or every supplier (many hubs).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from depotwise.policy import MULTIPLE_HUBS, PLATFORM_PREFIX, PLATFORMS, SHIPMENT_LIFECYCLE
from depotwise.policy import AgePolicy, RentPolicy
from depotwise.sources.domain import Domain, conform

# Parameters that suit the age and size of the test data.
AS_OF = "2001-12-01 00:00:00"
AGE_POLICY = AgePolicy().with_days(600, 1200, 1800)
RENT_POLICY = RentPolicy().with_sizes(9500, 12000, 14000)

USER_AGENTS = (
    "Mozilla/5.0 (Linux; Android 14; Pixel 8) Mobile",
    "Mozilla/5.0 (iPhone; CPU OS 17)",
    "Mozilla/5.0 (iPad; CPU OS 17)",
    "Mozilla/5.0 (Windows NT 10.0)",
    "iOS",
    "Mozilla/5.0 (Linux; Android 13; tablet)",
    "Mozilla/5.0 (Tablet; rv:109)",
)


# Declared, so that opening a table starts no job to look into its files.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


class StarTables:
    """Column-pruned readers over one directory of the test tables."""

    def __init__(self, spark: SparkSession, root: str, streamed: tuple[str, ...] = ()):
        self.spark, self.root, self.streamed = spark, root, streamed
        self._frames: dict[str, DataFrame] = {}
        self._counts: dict[str, int] = {}

    def path(self, name: str) -> str:
        return f"{self.root}/{name}.parquet"

    def __call__(self, name: str) -> DataFrame:
        if name not in self._frames:
            if name in self.streamed:
                files = self.spark.readStream.schema(SCHEMAS[name]).option("pathGlobFilter", f"{name}.parquet")
                self._frames[name] = files.parquet(self.root)
            else:
                self._frames[name] = self.spark.read.schema(SCHEMAS[name]).parquet(self.path(name))
        return self._frames[name]

    def count(self, name: str) -> int:
        """Rows of a (read-only) dimension table, answered from file footers. As a
        literal it folds into every expression that spreads keys over hubs or suppliers."""
        path = self.path(name)
        if path not in self._counts:
            self._counts[path] = self.spark.read.schema(SCHEMAS[name]).parquet(path).count()
        return self._counts[path]


def _packed_line_id() -> Column:
    """Line id; equal only for lines of one order with the same number and quantity."""
    line = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    return line * 64 + F.col("l_quantity").cast("bigint")


def _days(n: Column) -> Column:
    return F.make_dt_interval(days=n.cast("int"))


def clicks_of(events: DataFrame, suppliers: Column | int) -> DataFrame:
    """Click rows of an event table (batch or stream)."""
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    channel = F.col("event_id") % len(PLATFORMS)
    agents = F.array(*[F.lit(a) for a in USER_AGENTS])
    rows = events.where(F.col("event_type") == "click").select(
        F.col("event_id").alias("click_id"),
        (((F.col("user_id") * 100 + k) % suppliers) * len(PLATFORMS) + channel + 1).alias("link_id"),
        F.col("ts").alias("click_time"),
        F.when(k % 10 == 0, F.lit(None))
        .when(k % 10 == 1, F.lit(""))
        .otherwise(F.concat(F.lit("NATION_"), (k % 25).cast("string")))
        .alias("country"),
        F.element_at(agents, k % len(USER_AGENTS) + 1).alias("device"),
        F.when(channel == 3, F.col("user_id") + 1).alias("customer_id"),
    )
    return conform(rows, "click")


def star_domain(spark: SparkSession, root: str, hub: str = "region", streamed: tuple[str, ...] = ()) -> Domain:
    """All domain tables. Those derived from a ``streamed`` test table are streaming DataFrames."""
    t = StarTables(spark, root, streamed)
    suppliers = t.count("supplier")
    hubs = t.count("region" if hub == "region" else "supplier")
    order_key = F.col("o_orderkey")

    def supplier():
        return conform(
            t("supplier").select(
                (F.col("s_suppkey") + 1).alias("supplier_id"),
                F.col("s_name").alias("name"),
                F.concat(F.lit("017"), F.lpad(F.col("s_suppkey").cast("string"), 8, "0")).alias("phone"),
                F.concat(F.lit("Nation "), F.col("s_nationkey").cast("string")).alias("address"),
            ),
            "supplier",
        )

    def product():
        return conform(
            t("part").select(
                (F.col("p_partkey") + 1).alias("product_id"),
                (F.col("p_partkey") % suppliers + 1).alias("supplier_id"),
                F.col("p_name").alias("name"),
                F.col("p_type").alias("category"),
                F.col("p_retailprice").alias("price"),
            ),
            "product",
        )

    def warehouse():
        if hub == "region":
            rows = t("region").select(
                (F.col("r_regionkey") + 1).alias("warehouse_id"),
                F.concat(F.lit("Hub "), F.col("r_name")).alias("name"),
                F.col("r_name").alias("location"),
                (F.lit(suppliers) * (1200 + 500 * F.col("r_regionkey"))).alias("capacity_units"),
            )
        else:
            rows = t("supplier").select(
                (F.col("s_suppkey") + 1).alias("warehouse_id"),
                F.concat(F.lit("Hub "), F.col("s_name")).alias("name"),
                F.concat(F.lit("Nation "), F.col("s_nationkey").cast("string")).alias("location"),
                (8000 + (F.col("s_suppkey") * 1237) % 8000).alias("capacity_units"),
            )
        return conform(rows, "warehouse")

    def lines(condition: Column) -> DataFrame:
        return t("lineitem").where(condition)

    def transfer_line() -> Column:
        return (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F")

    def purchase_line() -> Column:
        returned_open = (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O")
        return (F.col("l_returnflag") == "A") | returned_open

    def purchase_hub(key: Column) -> Column:
        return (key * 3 + 1) % hubs + 1

    def order_hub(key: Column) -> Column:
        return key % hubs + 1

    def purchase():
        return conform(
            t("orders").select(
                (order_key + 1).alias("purchase_id"),
                (F.col("o_custkey") % suppliers + 1).alias("supplier_id"),
                purchase_hub(order_key).alias("warehouse_id"),
                F.col("o_orderdate").alias("purchase_date"),
            ),
            "purchase",
        )

    def purchase_item():
        return conform(
            lines(purchase_line()).select(
                _packed_line_id().alias("purchase_item_id"),
                (F.col("l_orderkey") + 1).alias("purchase_id"),
                (F.col("l_partkey") + 1).alias("product_id"),
                F.col("l_quantity").alias("quantity"),
                F.floor(F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_cost"),
            ),
            "purchase_item",
        )

    def stock_transfer():
        source = F.col("l_suppkey") % hubs
        return conform(
            lines(transfer_line()).select(
                _packed_line_id().alias("transfer_id"),
                (source + 1).alias("from_warehouse_id"),
                ((source + 1 + F.col("l_orderkey") % (hubs - 1)) % hubs + 1).alias("to_warehouse_id"),
                (F.col("l_partkey") + 1).alias("product_id"),
                F.col("l_quantity").alias("quantity"),
                F.col("l_shipdate").alias("transfer_date"),
                (F.col("l_shipdate") - _days(F.col("l_linenumber") * 30)).alias("origin_date"),
            ),
            "stock_transfer",
        )

    def inventory():
        """Stock left by all movements; a negative balance (no stock to sell) counts as zero."""
        quantity = F.col("l_quantity").cast("bigint")
        source = F.col("l_suppkey") % hubs
        target = (source + 1 + F.col("l_orderkey") % (hubs - 1)) % hubs + 1
        move = lambda hub_id, units: F.struct(hub_id.alias("hub"), units.alias("units"))
        moves = (
            F.when(purchase_line(), F.array(move(purchase_hub(F.col("l_orderkey")), quantity)))
            .when(transfer_line(), F.array(move(source + 1, -quantity), move(target, quantity)))
            .otherwise(F.array(move(order_hub(F.col("l_orderkey")), -quantity)))
        )
        balance = (
            t("lineitem")
            .select((F.col("l_partkey") + 1).alias("product_id"), F.inline(moves))
            .groupBy(F.col("hub").alias("warehouse_id"), "product_id")
            .agg(F.sum("units").alias("units"))
        )
        return conform(
            balance.select(
                (F.col("warehouse_id") * 10_000_000_000 + F.col("product_id")).alias("inventory_id"),
                "warehouse_id",
                "product_id",
                F.greatest(F.col("units"), F.lit(0)).alias("quantity"),
            ),
            "inventory",
        )

    def customer():
        contact = F.concat(F.lit("01"), F.lpad(F.expr("c_custkey div 2").cast("string"), 9, "0"))
        return conform(
            t("customer").select(
                (F.col("c_custkey") + 1).alias("customer_id"),
                F.col("c_name").alias("name"),
                F.when(F.col("c_acctbal") >= 0, contact).alias("contact"),
            ),
            "customer",
        )

    def order():
        return conform(
            t("orders").select(
                (order_key + 1).alias("order_id"),
                (F.col("o_custkey") + 1).alias("customer_id"),
                F.col("o_orderdate").alias("order_date"),
                F.lit("PLACED").alias("status"),
            ),
            "order",
        )

    def order_item():
        cents = F.floor(F.col("l_extendedprice") * 100 / F.col("l_quantity"))
        return conform(
            lines(F.col("l_returnflag") == "N").select(
                _packed_line_id().alias("order_item_id"),
                (F.col("l_orderkey") + 1).alias("order_id"),
                (F.col("l_partkey") + 1).alias("product_id"),
                F.col("l_quantity").alias("quantity"),
                (cents.cast("decimal(12,0)") * F.lit("0.01").cast("decimal(3,2)")).alias("unit_price"),
            ),
            "order_item",
        )

    def campaign():
        start = F.date_add(F.lit("2001-01-01").cast("date"), (F.col("s_suppkey") % 300).cast("int"))
        linked = t("supplier").select(
            (F.col("s_suppkey") + 1).alias("campaign_id"),
            (F.col("s_suppkey") + 1).alias("product_id"),
            F.concat(F.lit("Push NATION_"), F.col("s_nationkey").cast("string")).alias("campaign_name"),
            start.alias("start_date"),
            F.date_add(start, 30).alias("end_date"),
        )
        unlinked = t("region").select(
            (F.col("r_regionkey") + F.lit(suppliers).cast("bigint") + 1).alias("campaign_id"),
            (F.col("r_regionkey") + 1).cast("bigint").alias("product_id"),
            F.concat(F.lit("Teaser "), F.col("r_name")).alias("campaign_name"),
            F.lit(None).cast("date").alias("start_date"),
            F.lit(None).cast("date").alias("end_date"),
        )
        return conform(linked.unionByName(unlinked), "campaign")

    def tracking_link():
        channels = F.array(
            *[
                F.struct(
                    F.lit(i).alias("position"), F.lit(p).alias("platform"), F.lit(PLATFORM_PREFIX[p]).alias("prefix")
                )
                for i, p in enumerate(PLATFORMS)
            ]
        )
        product_key = (F.col("s_suppkey") + 1).cast("string")
        url = F.when(
            F.col("s_suppkey") % 2 == 0, F.concat(F.lit("/storefront/product.html?product="), product_key)
        ).otherwise(F.concat(F.lit("/shop/"), product_key))
        return conform(
            t("supplier")
            .select("s_suppkey", url.alias("destination_url"), F.inline(channels))
            .select(
                (F.col("s_suppkey") * len(PLATFORMS) + F.col("position") + 1).alias("link_id"),
                (F.col("s_suppkey") + 1).alias("campaign_id"),
                "platform",
                F.concat("prefix", F.lit("-"), (F.col("s_suppkey") + 1).cast("string")).alias("short_code"),
                "destination_url",
            ),
            "tracking_link",
        )

    def click():
        return clicks_of(t("events"), suppliers)

    def order_attribution():
        link = (F.col("o_custkey") % suppliers) * len(PLATFORMS) + order_key % len(PLATFORMS) + 1
        return conform(
            t("orders")
            .where(F.col("o_orderpriority") == "1-URGENT")
            .select(
                (order_key + 1).alias("attribution_id"),
                (order_key + 1).alias("order_id"),
                link.alias("link_id"),
                F.col("o_orderdate").alias("attributed_time"),
            ),
            "order_attribution",
        )

    def shipment():
        return conform(
            t("orders").select(
                (order_key + 1).alias("shipment_id"),
                (order_key + 1).alias("order_id"),
                F.concat(F.lit("TRK"), (order_key + 1).cast("string")).alias("tracking_code"),
                (F.col("o_orderdate") + _days(order_key % 3)).alias("shipment_date"),
            ),
            "shipment",
        )

    def shipment_status():
        steps = (
            F.when(F.col("o_orderstatus") == "F", 4)
            .when(F.col("o_orderstatus") == "O", 2)
            .when(F.col("o_orderpriority") == "5-LOW", 0)
            .otherwise(1)
        )
        lifecycle = F.array(
            *[F.struct(F.lit(i).alias("step"), F.lit(s).alias("status")) for i, s in enumerate(SHIPMENT_LIFECYCLE)]
        )
        stamp = (
            F.when(order_key % 89 == 0, F.lit(None))
            .when(order_key % 97 == 0, F.lit(MULTIPLE_HUBS))
            .otherwise(F.col("name"))
        )
        events = t("orders").select(
            "o_orderkey",
            "o_orderdate",
            order_hub(order_key).alias("warehouse_id"),
            F.inline(F.slice(lifecycle, 1, steps)),
        )
        named = events.join(warehouse().select("warehouse_id", "name"), "warehouse_id")
        two_days_per_pair = order_key % 3 + F.floor(F.col("step") / 2) * 2
        return conform(
            named.select(
                (order_key * 4 + F.col("step") + 4).alias("status_id"),
                (order_key + 1).alias("shipment_id"),
                F.when(F.col("step") < 2, stamp).otherwise(F.lit("Customer Area")).alias("location"),
                "status",
                (F.col("o_orderdate") + _days(two_days_per_pair)).alias("updated_time"),
            ),
            "shipment_status",
        )

    def audit_log():
        tables = F.array(F.lit("order"), F.lit("inventory"), F.lit("purchase"))
        return conform(
            t("events")
            .where(F.col("event_type") != "click")
            .select(
                F.col("event_id").alias("log_id"),
                F.element_at(tables, (F.col("user_id") % 3 + 1).cast("int")).alias("table_name"),
                F.when(F.col("event_type") == "view", "UPDATE")
                .when(F.col("event_type") == "error", "DELETE")
                .otherwise("INSERT")
                .alias("operation"),
                F.col("user_id").alias("record_id"),
                F.col("ts").alias("log_time"),
            ),
            "audit_log",
        )

    builders = (
        supplier, product, warehouse, purchase, purchase_item, stock_transfer, inventory, customer,
        order, order_item, campaign, tracking_link, click, order_attribution, shipment,
        shipment_status, audit_log,
    )
    return Domain({b.__name__: b for b in builders})
