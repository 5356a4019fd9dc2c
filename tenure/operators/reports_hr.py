"""HR-portal reports: detail listings and department / salary summaries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenure.functions.dialect import avg_round, days_since, is_open, like_contains, ratio_small
from tenure.operators.current import EMP_COLS, current, snapshot, with_dept_name
from tenure.plans.sizing import one_row
from tenure.schema import AS_OF
from tenure.sources.tables import Tables


def hr_search_by_hire_date(t: Tables, as_of: dt.date = AS_OF, hire_date: dt.date = dt.date(1990, 1, 15)) -> DataFrame:
    """Employees hired on one day with their current title, salary and department.

    Left joins keep former employees (NULL title / salary / department).
    """
    e = t["employees"].filter(F.col("hire_date") == F.lit(hire_date))
    de = current(t, "dept_emp", ["emp_no", "dept_no"])
    out = (
        e.join(current(t, "titles", ["emp_no", "title"]), "emp_no", "left")
        .join(current(t, "salaries", ["emp_no", "salary"]), "emp_no", "left")
        .join(de, "emp_no", "left")
    )
    out = with_dept_name(t, out, "left")
    return out.select(*EMP_COLS, "title", "salary", "dept_name")


def hr_search_by_name_or_dept(
    t: Tables, as_of: dt.date = AS_OF, first_like: str = "Geo", last_like: str = "son", dept_no: str = "d005",
    case_sensitive: bool = False,
) -> DataFrame:
    """Distinct employee x department name: a name match (any assignment) or a current member of one department.

    The source's OR spans both tables, which forces a join of everything
    before filtering. Split into two selective branches (name matches; open
    rows of one department), each filtered at its scan, then DISTINCT over
    their union gives the same rows.
    """
    name_hit = like_contains("first_name", first_like, case_sensitive) | like_contains("last_name", last_like, case_sensitive)
    de = t["dept_emp"].select("emp_no", "dept_no", "to_date")
    by_name = t["employees"].filter(name_hit).join(de.select("emp_no", "dept_no"), "emp_no")
    by_dept = t["employees"].join(
        de.filter((F.col("dept_no") == dept_no) & is_open()).select("emp_no", "dept_no"), "emp_no")
    both = by_name.select(*EMP_COLS, "dept_no").unionByName(by_dept.select(*EMP_COLS, "dept_no"))
    return with_dept_name(t, both).select(*EMP_COLS, "dept_name").distinct()


def hr_employee_list(t: Tables, as_of: dt.date = AS_OF) -> DataFrame:
    """Current detail (title, salary, department) for all employees."""
    return snapshot(t).select(*EMP_COLS, "dept_name", "title", "salary")


def hr_employees_by_department(t: Tables, as_of: dt.date = AS_OF) -> DataFrame:
    """Per department: distinct current members and average current salary.

    Aggregated by ``dept_no`` first (partial aggregation absorbs hot
    departments), the name is attached to the small result.
    """
    members = current(t, "dept_emp", ["emp_no", "dept_no"]).join(t["employees"].select("emp_no"), "emp_no", "left_semi")
    rows = members.join(current(t, "salaries", ["emp_no", "salary"]), "emp_no")
    agg = rows.groupBy("dept_no").agg(
        F.count_distinct("emp_no").alias("employee_count"), avg_round("salary", 4).alias("avg_salary"),
    )
    return with_dept_name(t, agg).select("dept_no", "dept_name", "employee_count", "avg_salary")


def hr_employees_sorted(t: Tables, as_of: dt.date = AS_OF) -> DataFrame:
    """Current detail with days employed, longest tenure first."""
    s = snapshot(t, ["emp_no", "first_name", "last_name", "hire_date"])
    return s.select(
        "emp_no", "first_name", "last_name", "hire_date", "title", "salary", "dept_name",
        days_since("hire_date", as_of).alias("days_employed"),
    ).orderBy(F.col("days_employed").desc(), F.col("salary").desc(), "emp_no")


def hr_salary_distribution(t: Tables, as_of: dt.date = AS_OF, width: int = 10000) -> DataFrame:
    """Histogram of current salaries in buckets of ``width``."""
    s = current(t, "salaries", ["salary"])
    return (
        s.groupBy((F.floor(F.col("salary") / width) * width).cast("long").alias("salary_range"))
        .agg(F.count(F.lit(1)).alias("employee_count"))
        .orderBy("salary_range")
    )


def hr_salary_above_average(t: Tables, as_of: dt.date = AS_OF) -> DataFrame:
    """Current employees paid above the average of all current salary rows.

    The average is a one-row aggregate, broadcast (never a global window).
    """
    avg = one_row(current(t, "salaries", ["salary"]).agg(avg_round("salary", 4).alias("avg_sal")))
    s = snapshot(t, ["emp_no", "first_name", "last_name"]).crossJoin(avg)
    return (
        s.filter(F.col("salary") > F.col("avg_sal"))
        .select(
            "emp_no", "first_name", "last_name", "salary", "title", "dept_name",
            (F.col("salary") - F.col("avg_sal")).alias("difference_from_avg"),
        )
        .orderBy(F.col("difference_from_avg").desc(), "emp_no")
    )


def hr_employee_performance(t: Tables, as_of: dt.date = AS_OF) -> DataFrame:
    """Current title and salary with years employed (days / 365, four digits)."""
    s = snapshot(t, ["emp_no", "first_name", "last_name", "hire_date"], dept=False)
    return s.select(
        "emp_no", "first_name", "last_name", "title", "salary",
        ratio_small(days_since("hire_date", as_of), F.lit(365), 4).alias("years_employed"),
    )
