"""Reporting-dashboard reports: listings, department and title statistics, rankings."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tenure.functions.dialect import avg_round, days_since, in_years, is_open, like_contains
from tenure.operators.current import EMP_COLS, current, snapshot, with_dept_name
from tenure.schema import AS_OF
from tenure.sources.tables import Tables


def rep_list_all(t: Tables, as_of: dt.date = AS_OF, n: int = 1000) -> DataFrame:
    """First ``n`` current employees by emp_no with days employed (a top-n report)."""
    s = snapshot(t)
    return (
        s.select(*EMP_COLS, "dept_name", "title", "salary", days_since("hire_date", as_of).alias("days_employed"))
        .orderBy("emp_no", "title", "salary", "dept_name")
        .limit(n)
    )


def rep_department_salary(t: Tables, as_of: dt.date = AS_OF) -> DataFrame:
    """Per department: members, rounded average, min, max salary and distinct current titles."""
    rows = (
        current(t, "dept_emp", ["emp_no", "dept_no"])
        .join(t["employees"].select("emp_no"), "emp_no", "left_semi")
        .join(current(t, "salaries", ["emp_no", "salary"]), "emp_no")
        .join(current(t, "titles", ["emp_no", "title"]), "emp_no")
    )
    agg = rows.groupBy("dept_no").agg(
        F.count_distinct("emp_no").alias("employee_count"),
        avg_round("salary", 2).alias("avg_salary"),
        F.min("salary").alias("min_salary"),
        F.max("salary").alias("max_salary"),
        F.count_distinct("title").alias("title_count"),
    )
    return (
        with_dept_name(t, agg)
        .select("dept_name", "employee_count", "avg_salary", "min_salary", "max_salary", "title_count")
        .orderBy(F.col("avg_salary").desc())
    )


def rep_hires_by_month(t: Tables, as_of: dt.date = AS_OF, first_year: int = 1985, last_year: int = 1995) -> DataFrame:
    """Hires per (year, month) counted over employee x assignment rows, with distinct departments."""
    e = t["employees"].filter(in_years("hire_date", first_year, last_year)).select("emp_no", "hire_date")
    rows = e.join(t["dept_emp"].select("emp_no", "dept_no"), "emp_no")
    return (
        rows.groupBy(F.year("hire_date").alias("hire_year"), F.month("hire_date").alias("hire_month"))
        .agg(F.count(F.lit(1)).alias("hire_count"), F.count_distinct("dept_no").alias("dept_count"))
        .orderBy("hire_year", "hire_month")
    )


def rep_headcount_by_dept(t: Tables, as_of: dt.date = AS_OF) -> DataFrame:
    """Per department: current members, assignments started and ended in the ``as_of`` year.

    One pass over ``dept_emp`` with conditional counts replaces the source's
    three correlated subqueries; departments without a current member drop
    out as in the inner join of the source.
    """
    y0, y1 = F.lit(dt.date(as_of.year, 1, 1)), F.lit(dt.date(as_of.year + 1, 1, 1))
    de = t["dept_emp"].select("dept_no", "from_date", "to_date")
    agg = de.groupBy("dept_no").agg(
        F.count_if(is_open()).alias("current_count"),
        F.count_if((F.col("from_date") >= y0) & (F.col("from_date") < y1)).alias("new_hires_this_year"),
        F.count_if((F.col("to_date") >= y0) & (F.col("to_date") < y1) & ~is_open()).alias("departures_this_year"),
    ).filter(F.col("current_count") > 0)
    return with_dept_name(t, agg).select("dept_name", "current_count", "new_hires_this_year", "departures_this_year")


def rep_salary_by_title(t: Tables, as_of: dt.date = AS_OF) -> DataFrame:
    """Per current title: rows, rounded average, min, max and population stddev of current salaries."""
    rows = current(t, "titles", ["emp_no", "title"]).join(current(t, "salaries", ["emp_no", "salary"]), "emp_no")
    return (
        rows.groupBy("title")
        .agg(
            F.count(F.lit(1)).alias("employee_count"),
            avg_round("salary", 2).alias("avg_salary"),
            F.min("salary").alias("min_salary"),
            F.max("salary").alias("max_salary"),
            F.round(F.stddev_pop("salary"), 2).alias("salary_stddev"),
        )
        .orderBy(F.col("avg_salary").desc())
    )


def rep_long_tenure(t: Tables, as_of: dt.date = AS_OF, min_days: int = 3650) -> DataFrame:
    """Employees with tenure above ``min_days`` and their all-time distinct titles and departments.

    Each count is aggregated per employee on its own table and then joined,
    instead of counting over the titles x assignments fan-out.
    """
    e = t["employees"].filter(F.col("hire_date") < F.date_sub(F.lit(as_of), min_days))
    nt = t["titles"].groupBy("emp_no").agg(F.count_distinct("title").alias("number_of_titles"))
    nd = t["dept_emp"].groupBy("emp_no").agg(F.count_distinct("dept_no").alias("number_of_departments"))
    return (
        e.join(nt, "emp_no").join(nd, "emp_no")
        .select(
            "emp_no", "first_name", "last_name", "hire_date", days_since("hire_date", as_of).alias("tenure_days"),
            "number_of_titles", "number_of_departments",
        )
        .orderBy(F.col("tenure_days").desc(), "emp_no")
    )


def rep_top_salaries_by_dept(t: Tables, as_of: dt.date = AS_OF, k: int = 5) -> DataFrame:
    """Current members ranked by current salary within their department (dense rank <= k).

    ``dense_rank() <= k`` lets Catalyst insert a partial WindowGroupLimit
    before the shuffle, so a large department ships at most its local top
    ranks per partition.
    """
    rows = (
        current(t, "dept_emp", ["emp_no", "dept_no"])
        .join(t["employees"].select("emp_no", "first_name", "last_name"), "emp_no")
        .join(current(t, "salaries", ["emp_no", "salary"]), "emp_no")
    )
    w = Window.partitionBy("dept_no").orderBy(F.col("salary").desc())
    ranked = rows.withColumn("salary_rank_in_dept", F.dense_rank().over(w)).filter(F.col("salary_rank_in_dept") <= k)
    return (
        with_dept_name(t, ranked)
        .select("dept_name", "first_name", "last_name", "salary", "salary_rank_in_dept")
        .orderBy("dept_name", "salary_rank_in_dept")
    )


def rep_hired_range_detail(
    t: Tables, as_of: dt.date = AS_OF, first: dt.date = dt.date(1985, 1, 1), last: dt.date = dt.date(1995, 12, 31),
) -> DataFrame:
    """Employees hired in [first, last] with current salary and title."""
    e = t["employees"].filter(F.col("hire_date").between(F.lit(first), F.lit(last)))
    return snapshot(t, employees=e, dept=False).select(*EMP_COLS, "salary", "title")


def rep_search_by_salary_range(t: Tables, as_of: dt.date = AS_OF, low: int = 60000, high: int = 80000) -> DataFrame:
    """Current detail within a salary range, highest first."""
    s = current(t, "salaries", ["emp_no", "salary"]).filter(F.col("salary").between(int(low), int(high)))
    e = t["employees"].select("emp_no", "first_name", "last_name").join(s, "emp_no")
    e = snapshot(t, employees=e, emp_cols=["emp_no", "first_name", "last_name", "salary"], salary=False)
    return e.select("emp_no", "first_name", "last_name", "salary", "title", "dept_name").orderBy(F.col("salary").desc(), "emp_no")


def rep_search_by_name(
    t: Tables, as_of: dt.date = AS_OF, first_like: str = "John", last_like: str = "Smith", case_sensitive: bool = False,
) -> DataFrame:
    """Current detail of employees whose first or last name contains a pattern."""
    e = t["employees"].filter(
        like_contains("first_name", first_like, case_sensitive) | like_contains("last_name", last_like, case_sensitive)
    )
    s = snapshot(t, employees=e, emp_cols=["emp_no", "first_name", "last_name"])
    return s.select("emp_no", "first_name", "last_name", "title", "dept_name", "salary").orderBy("last_name", "first_name", "emp_no")
