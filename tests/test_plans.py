"""Plan shape: what Catalyst chose must still hold at scale."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from conftest import SF_SMALL
from tenure.catalog import REPORTS
from tenure.operators import reports_pay, reports_rep
from tenure.plans.inspect import plan_text, problems, pushed_filters
from tenure.session import scratch_path
from tenure.sources.sinks import materialize_tables

# These use a global window over one row per partition (row-index offsets):
# bounded by the partition count, not by the data.
BOUNDED_GLOBAL_WINDOW = {"admin_data_export", "tel_request_metrics", "tel_slo_check"}


@pytest.mark.parametrize("name", sorted(REPORTS))
def test_no_cartesian_or_single_partition_window(spark, name):
    df = entry.queries()[name](spark, SF_SMALL)
    found = problems(df)
    if name in BOUNDED_GLOBAL_WINDOW:
        found = [p for p in found if p != "window over a single partition"]
    assert not found, found


@pytest.fixture(scope="module")
def stored(spark, tables):
    return materialize_tables(tables, scratch_path(spark, "stored"))


def test_year_filter_reaches_the_scan(stored):
    pushed = " ".join(pushed_filters(reports_pay.pay_salary_by_year(stored)))
    assert "GreaterThanOrEqual(from_date,1995-01-01)" in pushed and "LessThan(from_date,1996-01-01)" in pushed


def test_current_filter_reaches_the_scan(stored):
    pushed = " ".join(pushed_filters(reports_pay.pay_list_by_salary(stored)))
    assert "EqualTo(to_date,9999-01-01)" in pushed


def test_projection_is_pruned_at_the_scan(stored):
    text = plan_text(reports_pay.pay_department_avg(stored))
    assert "ReadSchema: struct<emp_no:int,salary:int,to_date:date>" in text


def test_top_k_per_department_uses_window_group_limit(stored):
    text = plan_text(reports_rep.rep_top_salaries_by_dept(stored))
    assert "WindowGroupLimit" in text


def test_departments_are_broadcast(stored):
    text = plan_text(reports_pay.pay_department_avg(stored))
    assert "BroadcastHashJoin" in text and "CartesianProduct" not in text


def test_emp_no_joins_reuse_one_partitioning(spark, stored):
    """Tables joined on emp_no: one exchange per input, none between the joins (sizes as at scale)."""
    from tenure.operators.current import snapshot

    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan_text(snapshot(stored, dept=False), "simple")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert text.count("Exchange hashpartitioning(emp_no") == 3


def test_department_figures_combine_map_side(stored):
    """Few, possibly hot, departments: partial aggregation runs before the department shuffle."""
    text = plan_text(reports_pay.pay_department_avg(stored))
    assert "partial_sum" in text and "partial_max" in text


def test_slow_request_samples_limit_before_the_shuffle(spark, stored):
    from tenure.operators.telemetry import slow_requests

    text = plan_text(slow_requests(stored, threshold_ms=0.0), "simple")
    assert "WindowGroupLimit" in text


def test_bucketed_tables_join_without_exchange(spark, tables):
    from tenure.operators.current import snapshot
    from tenure.sources.sinks import store_bucketed

    b = store_bucketed(tables, scratch_path(spark, "bucketed"), 8, "tb",
                       ["employees", "titles", "salaries", "dept_emp", "departments"])
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan_text(snapshot(b, dept=False), "simple")
        rows = snapshot(b).count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "Exchange hashpartitioning(emp_no" not in text and "SortMergeJoin" in text
    assert rows == snapshot(tables).count()
