"""A small hand-checkable data set: 2 hubs, 6 products, 12 purchases, 6 orders, 14 clicks."""

import datetime as dt
from decimal import Decimal

from depotwise.sources.domain import from_rows

AS_OF = dt.datetime(2026, 7, 20, 12, 0)

PRICES = {1: 1899, 2: 3499, 3: 499, 4: 1899, 5: 1299, 6: 899}
OWNER = {1: 1, 2: 1, 3: 2, 4: 2, 5: 3, 6: 3}
# purchase: hub, product, quantity, unit cost, age in days
PURCHASES = {
    1: (1, 1, 40, 1100, 0), 2: (1, 2, 25, 2000, 0), 3: (1, 3, 100, 250, 0), 4: (1, 4, 30, 1000, 95),
    5: (1, 5, 8, 700, 72), 6: (1, 6, 15, 450, 45), 7: (2, 1, 20, 1100, 105), 8: (2, 2, 10, 2000, 0),
    9: (2, 3, 60, 250, 0), 10: (2, 4, 12, 1000, 38), 11: (2, 5, 5, 700, 0), 12: (2, 6, 20, 450, 0),
}
# order: customer, link, product, quantity
ORDERS = {1: (1, 3, 1, 2), 2: (2, 1, 1, 1), 3: (3, 4, 3, 3), 4: (4, 5, 3, 1), 5: (5, 7, 5, 2), 6: (1, 6, 5, 1)}
LINKS = {
    1: (1, "Facebook", "FB1"), 2: (1, "Instagram", "IG1"), 3: (1, "Email", "EM1"), 4: (2, "Facebook", "FB2"),
    5: (2, "WhatsApp", "WA2"), 6: (3, "Instagram", "IG3"), 7: (3, "Email", "EM3"),
}
# link: (days ago, country, device, customer) per click
CLICKS = {
    1: [(5, "Bangladesh", "Android", None), (4, "Bangladesh", "iOS", None), (3, "India", "Android", None)],
    2: [(5, "Bangladesh", "iOS", None), (2, "Bangladesh", "Android", None)],
    3: [(6, "Bangladesh", "Desktop", 1), (1, "Bangladesh", "Desktop", 2)],
    4: [(4, "Bangladesh", "Android", None), (3, "Bangladesh", "Android", None), (2, "UAE", "iOS", None)],
    5: [(3, "Bangladesh", "Android", None)],
    6: [(2, "Bangladesh", "iOS", None)],
    7: [(2, "Bangladesh", "Desktop", 3), (1, "Bangladesh", "Desktop", 4)],
}
HUB_OF_ORDER = {1: 2, 2: 2, 3: 1, 4: 1, 5: 1, 6: 1}
SHIPPED_DAYS_AGO = {1: 4, 2: 3, 3: 2, 4: 1, 5: 0, 6: 0}
OPENING = {(hub, product): quantity for hub, product, quantity, _, _ in PURCHASES.values()}


def ago(days: float) -> dt.datetime:
    return AS_OF - dt.timedelta(days=days)


def stock_rows(stock: dict) -> list[tuple]:
    return [(i, hub, product, units) for i, ((hub, product), units) in enumerate(sorted(stock.items()), 1)]


def seed_rows() -> dict[str, list[tuple]]:
    money = Decimal
    final = dict(OPENING)
    for order, (_, _, product, quantity) in ORDERS.items():
        final[HUB_OF_ORDER[order], product] -= quantity
    name = {1: "Hub One", 2: "Hub Two"}
    statuses = [(o, o, name[HUB_OF_ORDER[o]], "Packed", ago(SHIPPED_DAYS_AGO[o])) for o in ORDERS]
    statuses += [
        (7, 1, name[2], "In Transit", ago(3)), (8, 1, "Customer Area", "Out For Delivery", ago(2)),
        (9, 1, "Customer Area", "Delivered", ago(1)), (10, 2, name[2], "In Transit", ago(2)),
    ]
    clicks = [(link, *click) for link, many in CLICKS.items() for click in many]
    return {
        "supplier": [(i, f"Supplier {i}", None, None) for i in (1, 2, 3)],
        "product": [(p, OWNER[p], f"Product {p}", "Goods", money(price)) for p, price in PRICES.items()],
        "warehouse": [(1, name[1], "North", 400), (2, name[2], "South", 150)],
        "inventory": stock_rows(final),
        "customer": [(c, f"Customer {c}", f"0190000000{c}") for c in range(1, 6)],
        "order": [(o, customer, AS_OF, "PLACED") for o, (customer, *_) in ORDERS.items()],
        "order_item": [(o, o, p, q, money(PRICES[p])) for o, (_, _, p, q) in ORDERS.items()],
        "campaign": [(c, p, f"Campaign {c}", None, None) for c, p in ((1, 1), (2, 3), (3, 5))],
        "tracking_link": [(link, c, platform, code, f"/product/{c}") for link, (c, platform, code) in LINKS.items()],
        "order_attribution": [(o, o, link, AS_OF) for o, (_, link, *_) in ORDERS.items()],
        "click": [(i, link, ago(days), country, device, who) for i, (link, days, country, device, who) in enumerate(clicks, 1)],
        "shipment": [(o, o, f"TRK{o}", ago(days)) for o, days in SHIPPED_DAYS_AGO.items()],
        "shipment_status": statuses,
        "purchase": [(i, OWNER[p], hub, ago(age)) for i, (hub, p, _, _, age) in PURCHASES.items()],
        "purchase_item": [(i, i, p, q, money(cost)) for i, (_, p, q, cost, _) in PURCHASES.items()],
    }


def seed_domain(spark, **changes):
    return from_rows(spark, {**seed_rows(), **changes})


def rows(df, *columns) -> list[tuple]:
    """Sorted tuples of some columns."""
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=repr)
