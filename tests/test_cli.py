from __future__ import annotations

from conftest import SF_SMALL
from tenure.cli import main
from tenure.session import scratch_path
from tenure.sources.sinks import materialize_tables
from tenure.sources.tables import stored_tables


def test_cli_runs_reports_from_stored_tables(spark, tables):
    store = scratch_path(spark, "cli-store")
    materialize_tables(tables, store)
    out = scratch_path(spark, "cli-out")
    assert main(["--tables", store, "--out", out, "pay_department_avg", "ms_hierarchy_salary"]) == 0
    got = spark.read.parquet(f"{out}/pay_department_avg")
    assert got.columns == ["dept_name", "emp_count", "avg_salary", "max_salary", "min_salary"] and got.count() > 0
    t = stored_tables(spark, store)
    assert "salaries_multi" in t and set(t) >= {"employees", "dept_emp", "salaries", "titles"}


def test_cli_from_fixture_with_as_of(spark):
    out = scratch_path(spark, "cli-fx")
    assert main(["--fixture", SF_SMALL, "--out", out, "--as-of", "2000-01-01", "rep_headcount_by_dept"]) == 0
    assert spark.read.parquet(f"{out}/rep_headcount_by_dept").count() > 0
