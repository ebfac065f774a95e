"""All registered reports."""

from __future__ import annotations

from depotwise.plans import (
    campaign_reports,
    change_reports,
    live_reports,
    mutation_reports,
    order_path_reports,
    quality_reports,
    source_reports,
    sql_reports,
    stock_reports,
    trade_reports,
)
from depotwise.plans.reports import Report

FAMILIES = (
    stock_reports,
    trade_reports,
    campaign_reports,
    quality_reports,
    mutation_reports,
    live_reports,
    order_path_reports,
    change_reports,
    source_reports,
    sql_reports,
)


def reports() -> dict[str, Report]:
    merged: dict[str, Report] = {}
    for family in FAMILIES:
        clash = merged.keys() & family.REPORTS.keys()
        if clash:
            raise ValueError(f"reports defined twice: {sorted(clash)}")
        merged.update(family.REPORTS)
    return merged
