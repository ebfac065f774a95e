"""Orders served as a whole, against serving them one by one in plain Python."""

import datetime as dt
import random
import time
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pytest
from fixture import AS_OF, LINKS, OPENING, ORDERS, rows, seed_domain, stock_rows

from depotwise.operators import allocation, checkout
from depotwise.policy import MULTIPLE_HUBS
from depotwise.sources.domain import from_rows

REQUEST = "request_id long, customer_id long, link_id long, requested_at timestamp_ntz"
LINE = "request_id long, line_no long, product_id long, quantity int"
TIERS = ((90, 20), (60, 10), (30, 5), (0, 0))  # days and tenths of a unit's rent, oldest first


class Shop:
    """Stock of hubs as lists of single lots, oldest first."""

    def __init__(self, lots, loose):
        self.stock = {}
        for (hub, product), units in loose.items():
            self.stock.setdefault((hub, product), []).extend([[None, units]] if units else [])
        for hub, product, days, units in sorted(lots, key=lambda lot: -lot[2]):
            self.stock.setdefault((hub, product), []).append([days, units])

    def route(self, product, need):
        ranked = []
        for (hub, p), lots in self.stock.items():
            held = sum(units for _, units in lots)
            if p == product and held >= need:
                aged = [(days, units) for days, units in lots if days is not None]
                extra = sum(units * next(e for least, e in TIERS if days >= least) for days, units in aged)
                ranked.append((-extra, -max((days for days, _ in aged), default=0), -held, hub))
        return min(ranked)[3] if ranked else None

    def take(self, hub, product, need):
        lots = self.stock[hub, product]
        while need:
            used = min(need, lots[0][1])
            lots[0][1] -= used
            need -= used
            if not lots[0][1]:
                lots.pop(0)

    def reason(self, product, need):
        total = sum(units for (_, p), lots in self.stock.items() if p == product for _, units in lots)
        return "no stock" if not total else "insufficient stock" if total < need else "split across hubs"


def one_by_one(shop, orders):
    """order -> (hubs by line) or reason."""
    out = {}
    for order, lines in orders:
        before = {key: [lot[:] for lot in lots] for key, lots in shop.stock.items()}
        hubs = []
        for product, need in lines:
            hub = shop.route(product, need)
            if hub is None:
                out[order] = shop.reason(product, need)
                shop.stock = before
                break
            shop.take(hub, product, need)
            hubs.append(hub)
        else:
            out[order] = tuple(hubs)
    return out


def by_repr(rows_):
    return sorted(rows_, key=repr)


def ago(days):
    return AS_OF - dt.timedelta(days=days)


def made_domain(spark, lots, loose, products, hubs, customers=5):
    held = dict(loose)
    for hub, product, _, units in lots:
        held[hub, product] = held.get((hub, product), 0) + units
    return from_rows(
        spark,
        {
            "supplier": [(1, "S", None, None)],
            "product": [(p, 1, f"P{p}", None, Decimal(p)) for p in range(products)],
            "warehouse": [(h, f"Hub {h}", None, 10**6) for h in range(hubs)],
            "customer": [(c, f"C{c}", None) for c in range(customers)],
            "purchase": [(i, 1, hub, ago(days)) for i, (hub, _, days, _) in enumerate(lots)],
            "purchase_item": [(i, i, product, units, Decimal(1)) for i, (_, product, _, units) in enumerate(lots)],
            "inventory": [(i, hub, product, units) for i, ((hub, product), units) in enumerate(held.items())],
        },
    )


@pytest.mark.parametrize("seed", range(3))
def test_checkout_equals_serving_one_by_one(spark, seed):
    rng = random.Random(seed)
    products, hubs = 8, 3
    lots = list({(h, p, days): (h, p, days, rng.randrange(1, 30)) for h in range(hubs) for p in range(products)
                 for days in rng.sample([0, 10, 31, 45, 61, 95, 120], rng.randrange(0, 4))}.values())
    loose = {(h, p): rng.randrange(0, 9) for h in range(hubs) for p in range(products) if rng.random() < 0.5}
    orders = [(i, [(rng.randrange(products), rng.choice([1, 2, 3, 9, 20, 60])) for _ in range(rng.choice([1, 1, 2, 3, 5]))]) for i in range(150)]
    d = made_domain(spark, lots, loose, products, hubs)
    at = {i: AS_OF + dt.timedelta(seconds=i // 3) for i, _ in orders}
    requests = spark.createDataFrame([(i, i % 5, None, at[i]) for i, _ in orders], REQUEST)
    lines = spark.createDataFrame([(i, n * 2, p, q) for i, many in orders for n, (p, q) in enumerate(many)], LINE)
    shop = Shop(lots, loose)
    expected = one_by_one(shop, orders)
    placed = [i for i, _ in orders if isinstance(expected[i], tuple)]
    assert 20 < len(placed) < 130

    got = checkout.checkout(d, requests, lines, AS_OF)
    assert {r.key: r.reason for r in got.rejected.collect()} == {i: r for i, r in expected.items() if not isinstance(r, tuple)}
    assert rows(got.orders, "order_id", "customer_id", "order_date") == by_repr((n, i % 5, at[i]) for n, i in enumerate(placed, 1))
    wanted = dict(orders)
    assert rows(got.items, "order_id", "product_id", "quantity", "unit_price") == by_repr(
        (n, p, q, Decimal(p)) for n, i in enumerate(placed, 1) for p, q in wanted[i]
    )
    names = {h: f"Hub {h}" for h in range(hubs)}
    stamp = lambda chosen: names[chosen[0]] if len(set(chosen)) == 1 else MULTIPLE_HUBS
    assert rows(got.statuses, "shipment_id", "location", "status") == by_repr((n, stamp(expected[i]), "Packed") for n, i in enumerate(placed, 1))
    assert rows(got.shipments, "shipment_id", "order_id", "tracking_code") == by_repr((n, n, f"TRK{n}") for n in range(1, len(placed) + 1))
    left = {(r.warehouse_id, r.product_id): r.quantity for r in got.inventory.collect()}
    assert left == {key: sum(units for _, units in shop.stock.get(key, [])) for key in left}


def test_the_seed_orders(spark, seed):
    """The six demo orders from the opening stock give the demo tables."""
    before = seed.replace(
        inventory=lambda: seed_domain(spark, inventory=stock_rows(OPENING))["inventory"],
        **{t: seed[t].limit(0) for t in ("order", "order_item", "order_attribution", "shipment", "shipment_status")},
    )
    at = {r.order_id: r.order_date for r in seed["order"].collect()}
    requests = spark.createDataFrame([(o, customer, link, at[o]) for o, (customer, link, _, _) in ORDERS.items()], REQUEST)
    lines = spark.createDataFrame([(o, 1, product, quantity) for o, (_, _, product, quantity) in ORDERS.items()], LINE)
    got = checkout.checkout(before, requests, lines, AS_OF)
    assert got.rejected.count() == 0 and max(LINKS) == 7
    assert rows(got.orders) == rows(seed["order"])
    for name, table in (("items", "order_item"), ("attributions", "order_attribution")):
        assert rows(getattr(got, name).drop("attributed_time")) == rows(seed[table].drop("attributed_time")), table
    hubs = {r.order_id: r.location for r in got.statuses.join(got.shipments, "shipment_id").collect()}
    assert hubs == {1: "Hub Two", 2: "Hub Two", 3: "Hub One", 4: "Hub One", 5: "Hub One", 6: "Hub One"}
    key = ["warehouse_id", "product_id", "quantity"]
    assert rows(got.inventory, *key) == rows(seed["inventory"], *key)


def test_requests_that_cannot_be_served(spark):
    d = made_domain(spark, [(0, 1, 5, 10)], {}, 3, 1)
    requests = spark.createDataFrame(
        [(1, 0, None, AS_OF), (2, 99, None, AS_OF), (3, 0, 77, AS_OF), (4, 0, None, None), (5, 0, None, AS_OF), (6, 0, None, AS_OF),
         (7, 0, None, AS_OF), (8, 0, None, AS_OF), (8, 1, None, AS_OF), (9, 0, None, AS_OF), (10, 0, None, AS_OF), (None, 0, None, AS_OF)], REQUEST
    )
    lines = spark.createDataFrame(
        [(1, 1, 1, 4), (1, 2, 1, 7), (2, 1, 1, 1), (3, 1, 1, 1), (4, 1, 1, 1), (5, 1, 88, 1), (5, 2, 1, 0), (6, 1, 1, None), (8, 1, 1, 1),
         (9, 1, 1, 1), (9, 1, 1, 1), (10, 1, 1, 6), (10, 2, 1, 4), (11, 1, 1, 1)], LINE
    )
    got = checkout.checkout(d, requests, lines, AS_OF)
    assert sorted((r.key or 0, r.reason) for r in got.rejected.collect()) == [
        (0, "no request id"), (1, "insufficient stock"), (2, "unknown customer"), (3, "unknown link"), (4, "no time"), (5, "unknown product"),
        (6, "quantity not positive"), (7, "no lines"), (8, "request id not unique"), (8, "request id not unique"), (9, "line number not unique"),
    ]
    assert rows(got.items, "order_id", "quantity") == [(1, 4), (1, 6)]
    assert rows(got.inventory, "quantity") == [(0,)]


def test_nothing_to_do(spark):
    d = made_domain(spark, [(0, 1, 5, 10)], {}, 3, 1)
    got = checkout.checkout(d, spark.createDataFrame([], REQUEST), spark.createDataFrame([], LINE), AS_OF)
    assert [df.count() for df in (got.orders, got.items, got.attributions, got.shipments, got.statuses, got.rejected, got.inventory)] == [0] * 6 + [1]


def test_only_asked_products_are_folded_and_each_decision_is_made_once(spark, monkeypatch):
    """No order fails in a product that another one shares, so nothing is folded twice; products without a line have no rows."""
    folded = []

    def spy(stock, lines, fold=allocation._fold):
        folded.append((sorted(r.product_id for r in stock.select("product_id").distinct().collect()), lines.count()))
        return fold(stock, lines)

    monkeypatch.setattr(allocation, "_fold", spy)
    d = made_domain(spark, [(h, p, 10 * p, 50) for h in range(2) for p in range(6)], {}, 6, 2)
    requests = spark.createDataFrame([(i, 0, None, AS_OF) for i in range(4)], REQUEST)
    lines = spark.createDataFrame([(0, 0, 1, 5), (0, 1, 4, 5), (1, 0, 4, 7), (2, 0, 1, 99), (3, 0, 1, 9)], LINE)
    got = checkout.checkout(d, requests, lines, AS_OF)
    assert rows(got.items, "order_id", "product_id", "quantity") == [(1, 1, 5), (1, 4, 5), (2, 4, 7), (3, 1, 9)]
    assert rows(got.rejected) == [(2, "insufficient stock")]
    assert folded == [([1, 4], 5)]


def feed(hubs, lots, needs, product=1):
    rows_ = [(product, allocation.HUB, h, 0, 0, u, 0, 0, 0, 0) for h, u in hubs]
    rows_ += [(product, allocation.LOT, h, days, extra, u, 0, 0, 0, 0) for h, days, extra, u in sorted(lots, key=lambda lot: -lot[1])]
    rows_ += [(product, allocation.LINE, 0, 0, 0, q, i, i, 0, 0) for i, q in enumerate(needs)]
    columns = [np.array(c, dtype=np.int64) for c in zip(*rows_)]
    table = pa.table(dict(zip(allocation.FED, columns)))
    return table.to_batches(max_chunksize=10_000)


def served(batches):
    return [(h, r) for b in allocation._serve(iter(batches)) for h, r in zip(b.column(4).to_pylist(), b.column(5).to_pylist())]


@pytest.mark.parametrize("seed", range(6))
def test_runs_equal_lines_one_at_a_time(seed, monkeypatch):
    rng = random.Random(seed)
    lots = [(h, days, rng.choice([0, 5, 20]), rng.randrange(1, 900)) for h in range(4) for days in rng.sample(range(200), 12)]
    held = {h: sum(u for hub, _, _, u in lots if hub == h) + rng.choice([0, 50]) for h in range(4)}
    needs = [rng.choice([1, 1, 2, 5, 700]) for _ in range(9000)]
    runs = served(feed(held.items(), lots, needs))
    monkeypatch.setattr(allocation, "WORTH", 10**12)
    assert served(feed(held.items(), lots, needs)) == runs


def test_a_dominant_product_costs_no_more_per_line():
    """One product with very many lines and lots against many products of few, in seconds for equal lines."""
    rng = random.Random(1)
    n = 200_000
    lots = [(h, days, 5 * (days > 300), rng.randrange(50, 200)) for h in range(5) for days in rng.sample(range(3000), 1000)]
    held = {h: sum(u for hub, _, _, u in lots if hub == h) for h in range(5)}
    one = feed(held.items(), lots, [rng.randrange(1, 6) for _ in range(n)])
    many = []
    for p in range(n // 200):
        some = [(h, days, 5 * (days > 300), 200) for h in range(5) for days in rng.sample(range(3000), 1)]
        many += feed([(h, 200) for h in range(5)], some, [rng.randrange(1, 6) for _ in range(200)], product=p)
    def seconds(batches):
        start = time.perf_counter()
        assert len(served(batches)) == n
        return time.perf_counter() - start
    assert seconds(one) < 1.5 * seconds(many)
