"""Stock age from stored arrivals: the same rows, and arrivals that stay where they are."""

import datetime as dt
from decimal import Decimal

from fixture import AS_OF, rows, seed_domain

from depotwise.functions.running import BLOCK
from depotwise.operators import stock
from depotwise.sources import layout


def test_stock_age_from_the_layout(spark, seed, tmp_path):
    layout.store_lots(seed, "seed_lots", 4, str(tmp_path))
    got = stock.warehouse_stock_age(seed, AS_OF, lots=layout.stored_lots(spark, "seed_lots"))
    assert rows(got) == rows(stock.warehouse_stock_age(seed, AS_OF))


def hot_domain(spark):
    items = [(i, i, 1, 3, Decimal(1)) for i in range(4000)] + [(9000 + i, 9000 + i, 2 + i % 5, 2, Decimal(1)) for i in range(100)]
    purchases = [(i, 1, 1, AS_OF - dt.timedelta(hours=i % 3000)) for i, *_ in items]
    held = [(1, 1, 1, 5000)] + [(1 + p, 1, p, 30) for p in range(2, 7)]
    return seed_domain(spark, purchase=purchases, purchase_item=items, inventory=held, stock_transfer=[])


def test_arrivals_do_not_move_and_a_hot_product_is_spread(spark, tmp_path):
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        d = hot_domain(spark)
        layout.store_lots(d, "hot_lots", 8, str(tmp_path))
        lots = layout.stored_lots(spark, "hot_lots")
        per_block = lots.rows.where("product_id = 1").groupBy(BLOCK).count().collect()
        assert len(per_block) >= 4 and max(r["count"] for r in per_block) < 2500
        left = stock.remaining_lots(d, lots)
        plan = left._jdf.queryExecution().executedPlan().toString().splitlines()
        scan = next(i for i, line in enumerate(plan) if "hot_lots[" in line or "hot_lots " in line or "hot_lots" in line and "blocks" not in line)
        depth = len(plan[scan]) - len(plan[scan].lstrip(" :+-*"))
        above = []
        for line in reversed(plan[:scan]):
            here = len(line) - len(line.lstrip(" :+-*"))
            if here < depth:
                above.append(line)
                depth = here
        assert any("SortMergeJoin" in line for line in above) and any("Window" in line for line in above)
        assert not any("Exchange" in line for line in above)
        assert rows(left) == rows(stock.remaining_lots(d))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
