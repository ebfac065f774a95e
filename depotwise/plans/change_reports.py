"""Reports of the change feed: what batches change, row by row, with stock before and after."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depotwise.operators import changes, checkout, mutations
from depotwise.plans import mutation_reports, order_path_reports
from depotwise.plans.reports import Inputs, Report
from depotwise.session import work_path
from depotwise.sources.star import AGE_POLICY, AS_OF
from depotwise.streaming import live, sinks

TABLES = mutation_reports.MUTATION_TABLES | order_path_reports.TABLES | {
    "f_items": """SELECT ts, order_id, (SELECT max(order_item_id) FROM d_order_item) + row_number() OVER (ORDER BY order_id, line_no) AS step,
          hub AS warehouse_id, product_id, -quantity AS units
        FROM c_placed JOIN c_outcome USING (request_id)""",
    "f_sold": """SELECT ts, order_id, 0 AS step, 'order' AS table_name, 'INSERT' AS operation, order_id AS record_id,
          CAST(NULL AS BIGINT) AS units_before, CAST(NULL AS BIGINT) AS units_after FROM c_placed
        UNION ALL SELECT ts, order_id, step, 'inventory', 'UPDATE', inventory_id, upto - units, upto
        FROM (SELECT f.*, inventory_id, quantity + sum(units) OVER (PARTITION BY warehouse_id, product_id ORDER BY ts, order_id, step) AS upto
              FROM f_items AS f JOIN d_inventory USING (warehouse_id, product_id)) AS q""",
    "f_undone": """SELECT purchase_id, product_id AS step, 'inventory' AS table_name, 'UPDATE' AS operation, inventory_id AS record_id,
          upto + units AS units_before, upto AS units_after
        FROM (SELECT b.*, inventory_id, quantity - sum(units) OVER (PARTITION BY warehouse_id, product_id ORDER BY purchase_id) AS upto
              FROM v_bought AS b JOIN v_undone USING (purchase_id) JOIN d_inventory USING (warehouse_id, product_id) WHERE granted) AS q
        UNION ALL SELECT purchase_id, 4611686018427387904, 'purchase', 'DELETE', purchase_id, NULL, NULL FROM v_undone WHERE granted""",
    "f_sides": """SELECT request_id, 0 AS place, source AS warehouse_id, product_id, -units AS units FROM v_granted
        UNION ALL SELECT request_id, 1, target, product_id, units FROM v_granted""",
    "f_ids": """SELECT warehouse_id, product_id, inventory_id, quantity, false AS fresh FROM d_inventory
        UNION ALL SELECT warehouse_id, product_id, (SELECT max(inventory_id) FROM d_inventory) + row_number() OVER (ORDER BY warehouse_id, product_id), 0, true
        FROM (SELECT DISTINCT warehouse_id, product_id FROM f_sides ANTI JOIN d_inventory USING (warehouse_id, product_id)) AS q""",
    "f_moved": """SELECT request_id, place, inventory_id, quantity + sum(units) OVER same AS upto, units, fresh AND row_number() OVER same = 1 AS makes
        FROM f_sides JOIN f_ids USING (warehouse_id, product_id) WINDOW same AS (PARTITION BY warehouse_id, product_id ORDER BY request_id, place)""",
}


def _shown(fed: DataFrame) -> DataFrame:
    units = lambda image: F.get_json_object(image, "$.quantity").cast("bigint")
    return fed.select(
        "change_id", "table_name", "operation", "record_id", units("before").alias("units_before"), units("after").alias("units_after"), "changed_at"
    )


def _sold(x: Inputs) -> DataFrame:
    x = x.stored("inventory")
    made = checkout.checkout(x.domain, *order_path_reports.carts(x), AS_OF, AGE_POLICY)
    return changes.feed(*changes.of_checkout(x.domain, made))


def _reversed(x: Inputs) -> DataFrame:
    x = x.stored("inventory")
    made = mutations.reverse_purchases(x.domain, x.domain["purchase"])
    return changes.feed(*changes.of_reversals(x.domain, made, AS_OF))


def _moved(x: Inputs) -> DataFrame:
    x = x.stored("inventory")
    requests = mutation_reports.transfer_requests(x)
    made = mutations.transfer_stock(x.domain, requests, AS_OF)
    return changes.feed(*changes.of_transfers(x.domain, requests, made.rejected, made.inventory, AS_OF))


def _streamed_audit(x: Inputs) -> DataFrame:
    """The audit trail of the checkout, from its feed as a stream."""
    path = work_path(x.spark, "feed")
    fed = _sold(x)
    fed.write.parquet(path)
    stream = live.audit_trail(x.spark.readStream.schema(fed.schema).parquet(path))
    return sinks.read_batches(x.spark, sinks.run_available(stream, "audit", "append"), stream.schema).drop(sinks.BATCH)


OPTIONAL = ("units_before", "units_after")
UNITS = "units_before::DOUBLE AS units_before, units_after::DOUBLE AS units_after"
SOLD = "(row_number() OVER (ORDER BY ts, order_id, step, table_name, record_id))"

REPORTS = {
    "checkout_changes": Report(
        lambda x: _shown(_sold(x)),
        f"SELECT {SOLD} AS change_id, table_name, operation, record_id, {UNITS}, ts AS changed_at FROM f_sold",
        tables=TABLES, optional_ids=OPTIONAL,
    ),
    "reversal_changes": Report(
        lambda x: _shown(_reversed(x)),
        f"""SELECT row_number() OVER (ORDER BY purchase_id, step, table_name, record_id) AS change_id, table_name, operation, record_id, {UNITS},
              {{as_of}} AS changed_at FROM f_undone""",
        tables=TABLES, optional_ids=OPTIONAL,
    ),
    "transfer_changes": Report(
        lambda x: _shown(_moved(x)),
        """SELECT row_number() OVER (ORDER BY request_id, place, inventory_id) AS change_id, 'inventory' AS table_name,
             CASE WHEN makes THEN 'INSERT' ELSE 'UPDATE' END AS operation, inventory_id AS record_id,
             CASE WHEN NOT makes THEN upto - units END::DOUBLE AS units_before, upto::DOUBLE AS units_after, {as_of} AS changed_at FROM f_moved""",
        tables=TABLES, optional_ids=OPTIONAL,
    ),
    "stream_change_audit": Report(
        _streamed_audit,
        f"SELECT {SOLD} AS log_id, table_name, operation, record_id, ts AS log_time FROM f_sold", tables=TABLES,
    ),
}
