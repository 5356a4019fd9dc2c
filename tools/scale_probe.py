"""Scale probe: generate an HR dataset of N employees on the executors, load it, time reports.

Usage: python tools/scale_probe.py N [cpus] [report ...]

Uses the loader-shaped generator (employees, 5 departments, one assignment and
1-4 open salaries per employee), loads employees with insert-if-absent (the
generator repeats emp_no like the source loader), stores the tables and runs
the reports that need only these tables. Prints one JSON line.
"""

from __future__ import annotations

import json
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tenure.operators import changes, reports_admin, reports_hr, reports_ms, reports_pay, reports_rep, views  # noqa: E402
from tenure.session import local_session, scratch_path  # noqa: E402
from tenure.sources.generate import generate_hr  # noqa: E402
from tenure.sources.sinks import insert_if_absent, materialize_tables  # noqa: E402
from tenure.sources.tables import Tables  # noqa: E402

REPORTS = {
    "pay_department_avg": reports_pay.pay_department_avg,
    "hr_employees_by_department": reports_hr.hr_employees_by_department,
    "hr_salary_distribution": reports_hr.hr_salary_distribution,
    "rep_headcount_by_dept": reports_rep.rep_headcount_by_dept,
    "rep_hires_by_month": reports_rep.rep_hires_by_month,
    "pay_salary_by_year": reports_pay.pay_salary_by_year,
    "admin_transfer_audit": reports_admin.admin_transfer_audit,
    "ms_hierarchy_salary": reports_ms.ms_hierarchy_salary,
    "employee_stats": views.employee_stats,
    "salary_metrics": views.salary_metrics,
    "dept_stats": views.dept_stats,
    "chg_salary_adjust": changes.salary_adjust,
    "chg_transfer": changes.transfer,
    "ms_history_strings": reports_ms.ms_history_strings,
}


def main() -> None:
    n = int(sys.argv[1]) if len(sys.argv) > 1 else 1_000_000
    cpus = int(sys.argv[2]) if len(sys.argv) > 2 else 8
    spark = local_session(cores=cpus, shuffle_partitions=4 * cpus, app="tenure-scale")
    t0 = time.perf_counter()
    g = generate_hr(spark, n)
    empty = spark.createDataFrame([], g["employees"].schema)
    loaded = Tables({**g, "employees": insert_if_absent(empty, g["employees"], ["emp_no"])})
    stored = materialize_tables(loaded, scratch_path(spark, "scale"))
    stored["salaries_multi"] = stored["salaries"]  # loader rows are all open: 1-4 current salaries
    load = time.perf_counter() - t0
    rows = {k: stored[k].count() for k in ("employees", "dept_emp", "salaries")}
    times = {}
    only = set(sys.argv[3:])
    for name, fn in REPORTS.items():
        if only and name not in only:
            continue
        t = time.perf_counter()
        fn(stored).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t, 3)
    print(json.dumps({"employees_generated": n, "rows": rows, "load_sec": round(load, 3),
                      "total_sec": round(sum(times.values()), 3), "queries": times, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
