"""Reports run on loader-shaped generated data (1-4 open salaries per employee, repeated emp_no)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tenure.operators import changes, quality, reports_admin, reports_hr, reports_ms, reports_pay, views
from tenure.sources.generate import generate_hr
from tenure.sources.sinks import insert_if_absent
from tenure.sources.tables import Tables


def test_reports_on_generated_tables(spark):
    g = generate_hr(spark, 3000, seed=11)
    empty = spark.createDataFrame([], g["employees"].schema)
    t = Tables({**g, "employees": insert_if_absent(empty, g["employees"], ["emp_no"])})
    t["salaries_multi"] = t["salaries"]
    assert quality.duplicate_keys(t["employees"], ["emp_no"]).count() == 0
    dept = reports_pay.pay_department_avg(t).collect()
    assert {r.dept_name for r in dept} <= {"Marketing", "Finance", "HR", "Engineering", "Sales"}
    # every employee row is counted once per department, whatever its number of open salaries
    members = t["dept_emp"].join(t["employees"].select("emp_no"), "emp_no", "left_semi")
    members = members.join(t["salaries"].select("emp_no").distinct(), "emp_no", "left_semi")
    want = {r.dept_no: r.n for r in members.groupBy("dept_no").agg(F.count_distinct("emp_no").alias("n")).collect()}
    got = {r.dept_no: r.employee_count for r in reports_hr.hr_employees_by_department(t).collect()}
    assert got == want
    assert reports_ms.ms_hierarchy_salary(t).count() >= 1
    assert views.dept_stats(t).count() == 5
    assert reports_admin.admin_transfer_audit(t).count() == 0  # one assignment each: no transfers
    new = changes.salary_adjust(t)
    opened = new.filter(F.col("from_date") == F.lit("2001-08-01").cast("date"))
    assert opened.count() >= t["dept_emp"].filter(F.col("dept_no") == "d005").count()
