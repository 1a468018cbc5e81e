"""Physical-plan properties the design relies on."""
import re

import pytest

import __spark_entry__ as entry
from tests.conftest import SF_SMALL
from tillroll.catalog import QUERIES
from tillroll.workspace import Workspace


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_report_scan_pushes_date_and_prunes_columns(spark):
    plan = _plan(entry.queries()["breakdown"](spark, SF_SMALL))
    assert re.search(r"PushedFilters: \[[^\n]*GreaterThanOrEqual\(date", plan)
    read = re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1)
    assert set(re.findall(r"(?:^|,)(\w+):", read)) == {
        "date", "geo_market", "orders", "revenue", "gross_profit"}


@pytest.mark.parametrize("name", ["breakdown", "top_products", "product_kpis", "seo_kpis", "email_performance"])
def test_reports_read_only_their_months(spark, name):
    plan = _plan(entry.queries()[name](spark, SF_SMALL))
    assert re.search(r"PartitionFilters: \[[^\n]*stored_month", plan)


def test_no_cartesian_and_bounded_broadcasts(spark):
    Workspace(spark, SF_SMALL).build_all()
    for name, fn in entry.queries().items():
        if name in ("sink_roundtrip", "orders_from_json", "targets_ingest", "export_csv") or name not in QUERIES:
            continue        # these write scratch output while planning; covered elsewhere
        plan = _plan(fn(spark, SF_SMALL))
        assert "CartesianProduct" not in plan, name
        assert "BroadcastNestedLoopJoin" not in plan, name
