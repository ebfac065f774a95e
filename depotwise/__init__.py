"""Supply-chain and campaign analytics as Spark DataFrame jobs."""

from depotwise.policy import AgePolicy, CapacityPolicy, RentPolicy
from depotwise.sources.domain import Domain

__all__ = ["AgePolicy", "CapacityPolicy", "Domain", "RentPolicy"]
