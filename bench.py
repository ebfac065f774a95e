"""Time the headline reports: prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from depotwise.plans.catalog import reports
from depotwise.session import local_session, release

HEADLINE = (
    "warehouse_stock_age", "warehouse_overview", "pick_source_warehouse", "stock_levels", "movement_balance",
    "purchase_history", "order_fulfilment", "order_list", "shipment_timeline", "campaign_performance",
    "platform_performance", "dashboard_kpis", "supplier_mismatches", "apply_purchases", "stream_shipment_status",
    "allocate_orders",
)
REPEATS = 2


def timed(spark, root: str, name: str) -> float:
    """Build, plan and run a report to the end without keeping its rows."""
    start = time.perf_counter()
    reports()[name].run(spark, root).write.format("noop").mode("overwrite").save()
    seconds = time.perf_counter() - start
    release(spark)
    return seconds


def main() -> None:
    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, shuffle_partitions=int(cores) if cores.isdigit() else 8, memory="16g")
    timed(spark, root, "stock_age_summary")  # start the engine and warm up its compiler
    times = {name: round(min(timed(spark, root, name) for _ in range(REPEATS)), 3) for name in HEADLINE}
    line = {
        "metric": "headline reports, best of 2, total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": Path(root).name.removeprefix("sf"),
    }
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
