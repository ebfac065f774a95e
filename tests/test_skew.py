"""Hot keys: results must not change when one key holds most rows and is cut into blocks."""

import datetime as dt
import random
from decimal import Decimal as D

import pytest
from fixture import AS_OF, OPENING, ago, rows, seed_domain, stock_rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from depotwise.functions.numbering import number_rows
from depotwise.functions.running import blocked, running, running_total
from depotwise.operators import allocation, routing, stock
from depotwise.policy import AgePolicy


@pytest.mark.parametrize("descending", [False, True])
def test_running_total_equals_a_plain_window(spark, descending):
    draw = random.Random(descending)
    data = [
        (draw.choice(["a", "a", "a", "b", None]), dt.datetime(2026, 1, draw.randint(1, 4), draw.choice([0, 0, 0, 7])), i, draw.randint(1, 9))
        for i in range(400)
    ]
    df = spark.createDataFrame(data, "k string, at timestamp_ntz, id long, q int")
    got = running_total(df, ["k"], ["at", "id"], "q", descending)
    way = (lambda c: F.desc(c)) if descending else (lambda c: F.asc(c))
    w = Window.partitionBy("k").orderBy(way("at"), way("id")).rowsBetween(Window.unboundedPreceding, 0)
    assert rows(got, "id", "running_total") == rows(df.select("id", F.sum("q").over(w)))


def test_a_key_has_at_most_one_block_per_partition_whatever_its_times(spark):
    df = spark.range(20_000).selectExpr("1 as k", "timestamp_seconds(id * 7919 % 1000003) as at", "id", "1 as q")
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"  # else so few rows become one partition
    spark.conf.set(coalesce, "false")
    try:
        cut = blocked(df, ["k"], ["at", "id"], {"n": ("sum", "q")})
        sizes = [r["count"] for r in cut.rows.groupBy("_block").count().collect()]
        w = Window.partitionBy("k").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, 0)
        assert rows(running_total(df, ["k"], ["at", "id"], "q"), "id", "running_total") == rows(df.select("id", F.sum("q").over(w)))
    finally:
        spark.conf.set(coalesce, "true")
    assert cut.blocks.count() == len(sizes) <= int(spark.conf.get("spark.sql.shuffle.partitions")) and len(sizes) > 1
    assert max(sizes) < 15_000


def test_running_maximum(spark):
    df = spark.range(300).selectExpr("id % 3 as k", "id", "id * 37 % 101 as v")
    w = Window.partitionBy("k").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    got = running(df, ["k"], ["id"], {"top": ("max", "v")})
    assert rows(got, "id", "top") == rows(df.select("id", F.max("v").over(w)))


def test_numbers_are_dense_and_ordered(spark):
    df = spark.range(1000).withColumn("id", F.col("id") * 3)
    found = number_rows(df, ["id"], 50, "n").orderBy("id").collect()
    assert [r.n for r in found] == list(range(51, 1051))


def random_history(seed: int, days: int = 6):
    """One dominant stock row with many lots on few instants, and some small ones."""
    draw = random.Random(seed)
    lots = [
        (draw.choice([(1, 1)] * 6 + [(1, 2), (2, 1), (2, 2)]), draw.randint(1, 9), ago(draw.randint(0, days) * 25))
        for _ in range(150)
    ]
    bought: dict = {}
    for key, units, _ in lots:
        bought[key] = bought.get(key, 0) + units
    stock_left = {key: draw.randint(0, units + 5) for key, units in bought.items()}
    return lots, stock_left


def history_domain(spark, lots, stock_left):
    return seed_domain(
        spark,
        purchase=[(i, 1, hub, at) for i, ((hub, _), _, at) in enumerate(lots, 1)],
        purchase_item=[(i, i, product, units, D(1)) for i, ((_, product), units, _) in enumerate(lots, 1)],
        inventory=stock_rows(stock_left),
    )


def newest_units(lots, key, on_hand):
    """(age in days, units) of the newest ``on_hand`` units of a stock row, walked lot by lot."""
    mine = sorted(((at, i, units) for i, (k, units, at) in enumerate(lots) if k == key), reverse=True)
    kept = []
    for at, _, units in mine:
        take = min(units, on_hand)
        on_hand -= take
        if take:
            kept.append(((AS_OF - at).days, take))
    return kept


def test_remaining_lots_match_a_walk_over_lots(spark):
    lots, left = random_history(1)
    d = history_domain(spark, lots, left)
    got = stock.remaining_lots(d)
    want = [(*key, ago(age), units) for key in left for age, units in newest_units(lots, key, left[key])]
    assert rows(got, "warehouse_id", "product_id", "received_date", "units") == sorted(want, key=repr)


def route(lots, left, product, need):
    """One line routed by looking at every hub, straight from the ranking rule."""
    policy = AgePolicy()

    def multiplier(age):
        return next((factor for above, factor, _ in policy.tiers if age > above), policy.fresh[0])

    ranked = []
    for (hub, p), units in left.items():
        if p == product and units >= need:
            kept = newest_units(lots, (hub, p), units)
            surcharge = sum(u * (multiplier(age) - 1) for age, u in kept)
            ranked.append((-surcharge, -max([age for age, _ in kept], default=0), -units, hub))
    return min(ranked)[3] if ranked else None


@pytest.mark.parametrize("seed", [2, 3])
def test_allocation_matches_serving_lines_one_by_one(spark, seed):
    lots, left = random_history(seed)
    draw = random.Random(seed)
    lines = [(i, i, draw.choice([1, 1, 1, 2, 3]), draw.randint(1, 12), ago(draw.randint(0, 9))) for i in range(1, 161)]
    frame = spark.createDataFrame(lines, "order_item_id long, order_id long, product_id long, quantity int, order_date timestamp_ntz")
    d = history_domain(spark, lots, left)
    bulk = routing.pick_source_warehouse(d, frame, AS_OF)
    assert rows(bulk, "order_id", "warehouse_id") == sorted(
        ((o, route(lots, left, p, q)) for o, _, p, q, _ in lines), key=repr
    )
    result = allocation.allocate_orders(d, frame, AS_OF)
    want, now = [], dict(left)
    for item, order, product, need, _ in sorted(lines, key=lambda r: (r[4], r[1], r[0])):
        hub, total = route(lots, now, product, need), sum(u for (_, p), u in now.items() if p == product)
        reason = None
        if hub is None:
            reason = "no stock" if total == 0 else "insufficient stock" if total < need else "split across hubs"
        else:
            now[hub, product] -= need
        want.append((order, hub, reason))
    assert rows(result.lines, "order_id", "warehouse_id", "reason") == sorted(want, key=repr)
    assert rows(result.inventory, "warehouse_id", "product_id", "quantity") == sorted(
        ((*key, units) for key, units in now.items()), key=repr
    )


def test_opening_stock_is_complete():
    assert sum(OPENING.values()) == 345


def test_only_keys_of_many_rows_are_cut_into_blocks(spark, monkeypatch):
    """Short keys take one window, long and missing ones the same totals through blocks."""
    from depotwise.functions import running as module

    written = []
    write = module.materialise
    monkeypatch.setattr(module, "materialise", lambda df, name: written.append(name) or write(df, name))
    key = F.when(F.col("id") < 400, F.lit(1)).when(F.col("id") % 50 == 0, None).otherwise(F.col("id") % 97 + 2)
    df = spark.range(1000).select(key.alias("k"), F.col("id").alias("at"), (F.col("id") % 7 - 3).alias("v"))
    totals = {"s": ("sum", "v"), "m": ("max", "v")}
    expected, state = set(), {}
    for r in sorted(df.collect(), key=lambda r: r["at"]):
        s, m = state.get(r["k"], (0, -99))
        state[r["k"]] = s + r["v"], max(m, r["v"])
        expected.add((r["k"], r["at"], *state[r["k"]]))
    for few, blocks in ((10**6, False), (20, True), (0, True)):
        monkeypatch.setattr(module, "FEW", few)
        written.clear()
        got = module.running(df, ["k"], ["at"], totals).select("k", "at", "s", "m").collect()
        assert {tuple(r) for r in got} == expected and len(got) == 1000
        assert ("blocks" in written) == blocks


def test_values_to_compare_are_dealt_by_the_number_of_rows(spark, monkeypatch):
    from depotwise.operators import quality
    from depotwise.sources.domain import from_rows

    monkeypatch.setattr(quality, "GROUPS", 10)
    at = dt.datetime(2026, 1, 1)
    d = from_rows(spark, {"shipment": [(i % 95, i, f"TRK{i % 90}", at) for i in range(100)]})
    found = quality.unique_violations(d, "shipment")
    assert found.rdd.getNumPartitions() == 22  # 11 for each of two rules
    assert {(r.key, r.detail) for r in found.collect()} == {(str(i), "shipment_id occurs 2") for i in range(5)} | {
        (f"TRK{i}", "tracking_code occurs 2") for i in range(10)
    }
