"""Registry of every report / operator with its default parameters.

``REPORTS[name](tables)`` returns a DataFrame; ``ORACLE[name]`` is the
matching DuckDB statement over the driver tables (absent for operators whose
result has no plain-SQL form).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tenure.operators import reports_admin as adm
from tenure.operators import reports_hr as hr
from tenure.operators import reports_ms as ms
from tenure.operators import reports_pay as pay
from tenure.operators import reports_perf as perf
from tenure.operators import reports_rep as rep
from tenure.operators import changes as chg
from tenure.operators import quality as dq
from tenure.operators import stored
from tenure.operators import telemetry as tel
from tenure.operators import views
from tenure.sources.fixture import hr_tables
from tenure.sources.tables import Tables

Report = Callable[[Tables], DataFrame]

REPORTS: dict[str, Report] = {
    # HR portal
    "hr_search_by_hire_date": hr.hr_search_by_hire_date,
    "hr_search_by_name_or_dept": hr.hr_search_by_name_or_dept,
    "hr_employee_list": hr.hr_employee_list,
    "hr_employees_by_department": hr.hr_employees_by_department,
    "hr_employees_sorted": hr.hr_employees_sorted,
    "hr_salary_distribution": hr.hr_salary_distribution,
    "hr_salary_above_average": hr.hr_salary_above_average,
    "hr_employee_performance": hr.hr_employee_performance,
    # payroll
    "pay_salary_by_employee": pay.pay_salary_by_employee,
    "pay_salary_by_range": pay.pay_salary_by_range,
    "pay_list_by_salary": pay.pay_list_by_salary,
    "pay_highest_earners": pay.pay_highest_earners,
    "pay_salary_by_year": pay.pay_salary_by_year,
    "pay_department_avg": pay.pay_department_avg,
    "pay_search_by_salary": pay.pay_search_by_salary,
    "pay_lookup_many": pay.pay_lookup_many,
    # reporting dashboard
    "rep_list_all": rep.rep_list_all,
    "rep_department_salary": rep.rep_department_salary,
    "rep_hires_by_month": rep.rep_hires_by_month,
    "rep_headcount_by_dept": rep.rep_headcount_by_dept,
    "rep_salary_by_title": rep.rep_salary_by_title,
    "rep_long_tenure": rep.rep_long_tenure,
    "rep_top_salaries_by_dept": rep.rep_top_salaries_by_dept,
    "rep_hired_range_detail": rep.rep_hired_range_detail,
    "rep_search_by_salary_range": rep.rep_search_by_salary_range,
    "rep_search_by_name": rep.rep_search_by_name,
    # performance review
    "perf_employee_list": perf.perf_employee_list,
    "perf_career_progression": perf.perf_career_progression,
    "perf_department_score": perf.perf_department_score,
    "perf_reviews": perf.perf_reviews,
    "perf_department_comparison": perf.perf_department_comparison,
    "perf_top_performers": perf.perf_top_performers,
    "perf_annual_summary": perf.perf_annual_summary,
    "perf_search_name_year": perf.perf_search_name_year,
    "perf_search_by_year": perf.perf_search_by_year,
    # admin console
    "admin_search": adm.admin_search,
    "admin_department_details": adm.admin_department_details,
    "admin_employee_details": lambda t: adm.admin_employee_details(t, emp_no=None),
    "admin_salary_audit": adm.admin_salary_audit,
    "admin_transfer_audit": adm.admin_transfer_audit,
    "admin_data_export": adm.admin_data_export,
    # SQL Server workload
    "ms_hierarchy_salary": ms.ms_hierarchy_salary,
    "ms_employee_scan": ms.ms_employee_scan,
    "ms_history_strings": ms.ms_history_strings,
    "ms_history_chunks": ms.ms_history_chunks,
    "ms_hierarchy_salary_tsql": lambda t: ms.ms_hierarchy_salary(t, int_avg=True),
    # views
    "employee_stats": views.employee_stats,
    "salary_metrics": views.salary_metrics,
    "dept_stats": views.dept_stats,
    "salary_metrics_tsql": lambda t: views.salary_metrics(t, int_avg=True),
    "high_salaries": views.high_salaries,
    "high_salaries_100k": lambda t: views.high_salaries(t, threshold=100000),
    "current_assignments": views.current_assignments,
    # table changes: each returns the whole new version of one table
    "chg_bulk_title_update": chg.bulk_title_update,
    "chg_salary_adjust": chg.salary_adjust,
    "chg_transfer": chg.transfer,
    "chg_transfer_conflicts": chg.transfer_conflicts,
    "chg_update_salary": chg.update_salary,
    "chg_append_suffix": chg.append_suffix,
    "chg_dept_budget_raise": chg.dept_budget_raise,
    "chg_bracket_raise": chg.bracket_raise,
    "chg_touch_last_modified": chg.touch_last_modified,
    "chg_update_salary_random": lambda t: chg.update_salary(t, emp_no=None, salary=None),
    "chg_log_maintenance": chg.maintenance_log_after,
    # the rows that each change touches: kind, old and new values
    **{f"chg_{name}_changes": change.changes for name, (change, _) in chg.CHANGES.items()},
    # stored tables with versions
    "snk_apply_salary_adjust": stored.apply_salary_adjust,
    "snk_insert_if_absent": stored.insert_salaries_if_absent,
    "snk_range_partitioned": stored.salary_eras,
    "snk_verified_load": stored.verified_load,
    "snk_dept_stats_refreshed": stored.refreshed_dept_stats,
    # data quality
    "dq_duplicate_keys": dq.dq_duplicate_keys,
    "dq_foreign_key_orphans": dq.dq_foreign_key_orphans,
    "dq_not_null": dq.dq_not_null,
    "dq_domain_violations": dq.dq_domain_violations,
    "dq_table_counts": dq.dq_table_counts,
    "dq_employees_with_defaults": dq.employees_with_defaults,
    # the same checks over tables with planted violations
    "dq_duplicate_keys_planted": lambda t: dq.dq_duplicate_keys(dq.with_planted_violations(t)),
    "dq_foreign_key_orphans_planted": lambda t: dq.dq_foreign_key_orphans(dq.with_planted_violations(t)),
    "dq_domain_violations_planted": lambda t: dq.dq_domain_violations(dq.with_planted_violations(t)),
    "dq_interval_overlaps": lambda t: dq.dq_interval_overlaps(t, "salaries_multi"),
    # request telemetry
    "tel_request_metrics": tel.request_metrics,
    "tel_request_metrics_narrowed": lambda t: tel.request_metrics(t, narrow=True),
    "tel_request_metrics_windowed": tel.request_metrics_windowed,
    "tel_slo_check": tel.slo_check,
    "tel_gauge_records": tel.gauge_records,
    "tel_top_statements": tel.top_statements,
    "tel_active_sessions": tel.active_sessions,
    "tel_counter_rate": tel.request_counter_rate,
    "tel_slow_requests": tel.slow_requests,
    "tel_slow_requests_100ms": lambda t: tel.slow_requests(t, threshold_ms=100.0),
    "tel_slow_requests_windowed": lambda t: tel.slow_requests_windowed(t, threshold_ms=50.0, window="1 hour", max_samples=3),
    "tel_request_metrics_15s": tel.request_metrics_windowed_p95,
    "tel_slo_run": tel.slo_run,
    "tel_slo_run_mysql": lambda t: tel.slo_run(t, p95_max_ms=tel.P95_MAX_MS_MYSQL),
    "tel_statement_rates": tel.statement_rates,
    "tel_request_log": tel.request_log,
    "tel_endpoint_mix": tel.endpoint_mix,
    "tel_endpoint_mix_declared": lambda t: tel.endpoint_mix(t, tel.ENDPOINT_WEIGHTS, tel.ENDPOINT_OF_TYPE),
    "tel_endpoint_mix_script": lambda t: tel.endpoint_mix(t, tel.SCRIPT_WEIGHTS, tel.SCRIPT_ENDPOINT_OF_TYPE),
}

# Tables of the session last seen; another session starts a new memo.
_MEMO: list = [None, {}]


def tables_for(spark: SparkSession, sf_dir: str) -> Tables:
    """HR tables derived from ``sf_dir`` (lazy DataFrames, memoised per session)."""
    if _MEMO[0] is not spark:
        _MEMO[:] = [spark, {}]
    if sf_dir not in _MEMO[1]:
        _MEMO[1][sf_dir] = hr_tables(spark, sf_dir)
    return _MEMO[1][sf_dir]


def oracle() -> dict[str, str]:
    from tenure.oracle_sql import REPORT_SQL, report_sql

    return {name: report_sql(name) for name in REPORT_SQL if name in REPORTS}
