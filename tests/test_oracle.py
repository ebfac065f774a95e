"""Every report with SQL gives the same rows as that SQL in another engine."""

import pytest
from compare import connect, difference

from depotwise.plans.catalog import reports

ROOT = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(ROOT)


@pytest.mark.parametrize("name", sorted(name for name, r in reports().items() if r.sql is not None))
def test_report_matches_sql(spark, con, name):
    report = reports()[name]
    assert difference(report.run(spark, ROOT), con, report.oracle()) is None
