"""Business rules that are data, not code: tiers, labels, lifecycles, vocabularies."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

# ---- fixed values: they decide results, so they are stated as plain text -------------
PLATFORMS = ("Facebook", "Instagram", "WhatsApp", "Email")
PLATFORM_PREFIX = {"Facebook": "FB", "Instagram": "IG", "WhatsApp": "WA", "Email": "EM"}
SHIPMENT_LIFECYCLE = ("Packed", "In Transit", "Out For Delivery", "Delivered")
AUDIT_OPERATIONS = ("INSERT", "UPDATE", "DELETE")
MULTIPLE_HUBS = "Multiple hubs"
DIRECT_SOURCE = "Direct"
UNKNOWN = "Unknown"
DEFAULT_CAPACITY = 500
LOW_STOCK_THRESHOLD = 10
TRACKING_CODE_PREFIX = "TRK"
PURCHASE_PAGE_SIZE = 100
RECENT_CLICKS_LIMIT = 20
LIVE_REFRESH = "6 seconds"
CAPACITY_STATUS = ("OVER", "CRITICAL", "HIGH", "OK")
SHIPMENT_BUCKETS = ("pending", "transit", "delivered")
# what a file name's words are joined by, and what is cut from its ends
SLUG_BREAK = "[^a-z0-9]+"
SLUG_EDGES = "^-|-$"
# --------------------------------------------------------------------------------------


@dataclass(frozen=True)
class AgePolicy:
    """Storage-age tiers. A tier starts strictly above its day threshold."""

    # fixed values: (days above which the tier applies, rent multiplier, label)
    fresh: tuple[Decimal, str] = (Decimal("1.0"), "Fresh")
    aging: tuple[int, Decimal, str] = (30, Decimal("1.5"), "Aging")
    stale: tuple[int, Decimal, str] = (60, Decimal("2.0"), "Stale")
    dead: tuple[int, Decimal, str] = (90, Decimal("3.0"), "Dead stock")

    @property
    def tiers(self) -> tuple[tuple[int, Decimal, str], ...]:
        """Oldest tier first."""
        return self.dead, self.stale, self.aging

    @property
    def overdue_after(self) -> int:
        return self.aging[0]

    def with_days(self, aging: int, stale: int, dead: int) -> AgePolicy:
        """The same multipliers and labels on other day thresholds."""
        return AgePolicy(
            self.fresh, (aging, *self.aging[1:]), (stale, *self.stale[1:]), (dead, *self.dead[1:])
        )


@dataclass(frozen=True)
class RentPolicy:
    """Daily rate per unit by hub size: (largest capacity of the tier, rate)."""

    # fixed values
    tiers: tuple[tuple[int, Decimal], ...] = (
        (200, Decimal("3.00")),
        (500, Decimal("2.50")),
        (1000, Decimal("2.00")),
    )
    bulk_rate: Decimal = Decimal("1.50")
    days_per_month: int = 30

    def with_sizes(self, *sizes: int) -> RentPolicy:
        """The same rates on other capacity limits."""
        rates = (rate for _, rate in self.tiers)
        return RentPolicy(tuple(zip(sizes, rates, strict=True)), self.bulk_rate, self.days_per_month)


@dataclass(frozen=True)
class CapacityPolicy:
    """Fill levels, as a share of capacity, at which a hub's status escalates."""

    # fixed values
    critical: Decimal = Decimal("0.90")
    high: Decimal = Decimal("0.75")
