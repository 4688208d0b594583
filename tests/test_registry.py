"""Registered queries against their SQL on a small data set.

All of them with CHECK_ALL=1; otherwise one or two of each kind.
"""

import os

import pytest

import __spark_entry__ as entry_points
from analogue import check, oracle, registry
from analogue import star as source
from caregauge import constants as K
from caregauge.plans import outcomes

SF_DIR = "/root/testdata/sf0.01"
FEW = [
    "readmit_percentiles", "satisfaction_state_domain_range", "volume_yoy_growth", "utilization_intensity_range",
    "mortality_by_hospital_category_year", "quality_trend", "state_peer_benchmark", "vw_hospital_scorecard",
    "referential_integrity", "report_against_national", "upsert_hospitals", "load_readmissions", "load_date_dimension",
    "load_two_deliveries", "parse_delivered_lines", "load_readmissions_mixed_case", "mortality_by_hospital_counted",
    "report_volume_tiers", "report_sliced_comparison",
]
NAMES = list(registry.queries()) if os.environ.get("CHECK_ALL") else FEW


def test_every_query_has_sql():
    assert set(registry.queries()) == set(oracle.oracle_sql())
    assert registry.queries().keys() <= entry_points.queries().keys()
    assert entry_points.oracle_sql().keys() <= entry_points.queries().keys()


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0


@pytest.fixture(scope="module")
def con():
    return check.connect(SF_DIR)


@pytest.mark.parametrize("name", NAMES)
def test_equals_sql(spark, con, name):
    assert check.compare(spark, con, name, SF_DIR) is None


def test_plans_of_chosen_hospitals_filter_every_fact(spark):
    """The facts meet the one hospital before they are aggregated."""
    plan = registry.queries()["report_hospital_detail"](spark, SF_DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftSemi") == 3


def test_all_volume_tiers_occur(spark):
    assert registry.queries()["report_volume_tiers"](spark, SF_DIR).count() == 4


def test_scope_of_the_latest_year_matters(spark):
    """On data whose infections end a year before the rest of the fact."""
    star = source.star(spark, SF_DIR, early=K.SAFETY)
    assert outcomes.infections_by_hospital(star, "fact").count() == 0
    assert outcomes.infections_by_hospital(star, "category").count() > 0


def _scans(df, table):
    return df._jdf.queryExecution().optimizedPlan().toString().count(table)


def test_a_second_delivery_is_formed_once(spark):
    """Its keys and its rows are read from where it was saved."""
    assert _scans(registry.queries()["load_two_deliveries"](spark, SF_DIR), "l_shipdate#") > 0
    plan = registry.queries()["load_two_deliveries"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lineitem.parquet") == 1


def test_text_of_large_tables_stays_where_it_is_formed(spark, monkeypatch):
    rebalanced = lambda: _scans(registry.queries()["load_readmissions"](spark, SF_DIR), "Rebalance")
    assert rebalanced() > 0
    monkeypatch.setattr(registry, "BROADCAST_LIMIT", 0)
    assert rebalanced() == 0
