"""Business rules as Column expressions: all of them stay inside JVM code generation."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from depotwise.policy import (
    CAPACITY_STATUS,
    PLATFORM_PREFIX,
    PLATFORMS,
    SHIPMENT_BUCKETS,
    SHIPMENT_LIFECYCLE,
    SLUG_BREAK,
    SLUG_EDGES,
    TRACKING_CODE_PREFIX,
    AgePolicy,
    CapacityPolicy,
    RentPolicy,
)

ColumnOrName = Column | str


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def moment(value: dt.datetime | str | Column) -> Column:
    """A timestamp without zone, whatever the session zone is."""
    if isinstance(value, Column):
        return value
    text = value if isinstance(value, str) else value.isoformat(sep=" ")
    return F.lit(text).cast("timestamp_ntz")


# ---- warehouse economics -------------------------------------------------------------


def rent_rate(capacity: ColumnOrName, policy: RentPolicy = RentPolicy()) -> Column:
    """Rate per unit and day, a function of hub size only."""
    rate = F.lit(policy.bulk_rate)
    for limit, price in reversed(policy.tiers):
        rate = F.when(col(capacity) <= limit, F.lit(price)).otherwise(rate)
    return rate.cast("decimal(10,2)")


def age_multiplier(days: ColumnOrName, policy: AgePolicy = AgePolicy()) -> Column:
    rule = F.lit(policy.fresh[0])
    for above, factor, _ in reversed(policy.tiers):
        rule = F.when(col(days) > above, F.lit(factor)).otherwise(rule)
    return rule.cast("decimal(2,1)")


def age_band(days: ColumnOrName, policy: AgePolicy = AgePolicy()) -> Column:
    rule = F.lit(policy.fresh[1])
    for above, _, label in reversed(policy.tiers):
        rule = F.when(col(days) > above, F.lit(label)).otherwise(rule)
    return rule


def whole_days(start: ColumnOrName, end: ColumnOrName) -> Column:
    """Day field of ``end - start``: elapsed whole days, truncated toward zero."""
    return F.extract(F.lit("DAY"), col(end) - col(start)).cast("int")


def percent(part: ColumnOrName, whole: ColumnOrName) -> Column:
    """``part / whole`` in percent with one decimal, half up."""
    ratio = col(part).cast("decimal(20,0)") * F.lit(100) / col(whole).cast("decimal(12,0)")
    return F.round(ratio, 1).cast("decimal(12,1)")


def capacity_status(
    used: ColumnOrName, capacity: ColumnOrName, policy: CapacityPolicy = CapacityPolicy()
) -> Column:
    used, capacity = col(used), col(capacity)
    over, critical, high, fine = CAPACITY_STATUS
    return (
        F.when(used > capacity, over)
        .when(used >= capacity * F.lit(policy.critical), critical)
        .when(used >= capacity * F.lit(policy.high), high)
        .otherwise(fine)
    )


# ---- orders and shipments ------------------------------------------------------------


def line_amount(quantity: ColumnOrName, price: ColumnOrName) -> Column:
    return (col(quantity) * col(price)).cast("decimal(21,2)")


def shipment_bucket(status: ColumnOrName) -> Column:
    """Board column of a shipment; one without any status counts as in transit."""
    pending, transit, delivered = SHIPMENT_BUCKETS
    return (
        F.when(col(status) == SHIPMENT_LIFECYCLE[0], pending)
        .when(col(status) == SHIPMENT_LIFECYCLE[-1], delivered)
        .otherwise(transit)
    )


def next_status(status: ColumnOrName) -> Column:
    """Following lifecycle step; null after the last one and for unknown values."""
    pairs = zip(SHIPMENT_LIFECYCLE, SHIPMENT_LIFECYCLE[1:], strict=False)
    steps = F.create_map(*[F.lit(v) for pair in pairs for v in pair])
    return F.try_element_at(steps, col(status))


def tracking_code(shipment_id: ColumnOrName) -> Column:
    return F.concat(F.lit(TRACKING_CODE_PREFIX), col(shipment_id).cast("string"))


# ---- campaigns -----------------------------------------------------------------------


def rank_in(value: ColumnOrName, domain: Iterable[str]) -> Column:
    """Position of a value in a fixed ordered vocabulary, for presentation order."""
    return F.array_position(F.array(*[F.lit(v) for v in domain]), col(value))


def platform_rank(platform: ColumnOrName) -> Column:
    return rank_in(platform, PLATFORMS)


def platform_prefix(platform: ColumnOrName) -> Column:
    mapping = F.create_map(*[F.lit(v) for pair in PLATFORM_PREFIX.items() for v in pair])
    return F.try_element_at(mapping, col(platform))


def short_code(platform: ColumnOrName, seed: ColumnOrName) -> Column:
    """Prefix and five upper-case hex digits of a seeded digest: reproducible per seed."""
    digest = F.upper(F.substring(F.md5(col(seed).cast("string")), 1, 5))
    return F.concat(platform_prefix(platform), F.lit("-"), digest)


def device_bucket(user_agent: ColumnOrName) -> Column:
    """Device family of a user agent; the first matching family wins, anything else is a desktop."""
    # fixed values: family and the words that reveal it, in order of precedence
    families = (
        ("Android", ("android", "mobile")),
        ("iOS", ("iphone",)),
        ("Tablet", ("ipad", "tablet")),
    )
    text = F.lower(F.coalesce(col(user_agent), F.lit("")))
    rule = F.lit("Desktop")
    for family, words in reversed(families):
        rule = F.when(any_of(text.contains(w) for w in words), F.lit(family)).otherwise(rule)
    return rule


def known(value: ColumnOrName, default: str) -> Column:
    """Default for null and for the empty string."""
    return F.coalesce(F.nullif(col(value), F.lit("")), F.lit(default))


def conversion_pct(orders: ColumnOrName, clicks: ColumnOrName) -> Column:
    rate = F.when(col(clicks) > 0, percent(orders, clicks))
    return F.coalesce(rate, F.lit(0)).cast("decimal(12,1)")


def with_code(url: ColumnOrName, code: ColumnOrName) -> Column:
    """Destination with the tracking code as its ``code`` parameter: an existing one is replaced,
    and a fragment stays last."""
    url, code = col(url), col(code)
    fragment = F.regexp_extract(url, r"(#.*)$", 1)
    base = F.regexp_replace(url, r"#.*$", "")
    base = F.regexp_replace(base, r"([?&])code=[^&]*&?", "$1")
    base = F.regexp_replace(base, r"[?&]$", "")
    glue = F.when(base.contains("?"), "&").otherwise("?")
    return F.concat(base, glue, F.lit("code="), F.url_encode(code), fragment)


def product_url(product_id: ColumnOrName) -> Column:
    return F.concat(F.lit("/storefront/product.html?product="), col(product_id).cast("string"))


# ---- text ----------------------------------------------------------------------------


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def normalised_name(name: ColumnOrName) -> Column:
    """Trimmed, lower case, inner white space collapsed; null becomes empty."""
    text = F.lower(F.coalesce(col(name), F.lit("")))
    return F.regexp_replace(F.regexp_replace(text, r"\s+", " "), r"^ | $", "")


def slug(text: ColumnOrName, fallback: str = "export") -> Column:
    """Lower-case words joined by dashes, usable as a file name."""
    cleaned = F.regexp_replace(F.lower(known(text, fallback)), SLUG_BREAK, "-")
    return known(F.regexp_replace(cleaned, SLUG_EDGES, ""), fallback)


def matches_text(text: str, *fields: ColumnOrName) -> Column:
    """Case-insensitive literal substring in any of the fields; numbers match as text."""
    needle = text.strip().lower()
    if not needle:
        return F.lit(True)
    return any_of(F.lower(F.coalesce(col(f).cast("string"), F.lit(""))).contains(needle) for f in fields)


def within_days(when: ColumnOrName, as_of: dt.datetime | str | Column, days: int | None) -> Column:
    """At or after ``as_of`` minus ``days`` (inclusive); no bound when ``days`` is None."""
    if days is None:
        return F.lit(True)
    return col(when) >= moment(as_of) - F.expr(f"INTERVAL {int(days)} DAYS")


def month_start(when: ColumnOrName) -> Column:
    return F.trunc(col(when), "month")


def month_label(when: ColumnOrName) -> Column:
    return F.date_format(col(when), "MMM yyyy")


def money_label(amount: ColumnOrName) -> Column:
    return F.concat(F.lit("৳"), F.format_number(F.coalesce(col(amount), F.lit(0)), 2))


def date_label(when: ColumnOrName) -> Column:
    return F.coalesce(F.date_format(col(when), "MMM d, yyyy"), F.lit("-"))
