"""Payroll reports: salary lookups, ranges and department salary figures."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenure.functions.dialect import in_years, ratio
from tenure.functions.keyfilter import in_ranges, ranges_of, ranges_of_list
from tenure.operators.current import EMP_COLS, current, snapshot, with_dept_name
from tenure.schema import AS_OF
from tenure.sources.tables import Tables


def pay_salary_by_employee(t: Tables, as_of: dt.date = AS_OF, emp_no: int = 10001) -> DataFrame:
    """One employee's current salary interval, department and title."""
    e = t["employees"].filter(F.col("emp_no") == emp_no).select("emp_no", "first_name", "last_name")
    s = current(t, "salaries", ["emp_no", "salary", "from_date", "to_date"]).filter(F.col("emp_no") == emp_no)
    out = snapshot(t, employees=e, emp_cols=["emp_no", "first_name", "last_name"], salary=False).join(s, "emp_no")
    return out.select("emp_no", "first_name", "last_name", "salary", "from_date", "to_date", "dept_name", "title")


def pay_salary_by_range(t: Tables, as_of: dt.date = AS_OF, low: int = 50000, high: int = 70000) -> DataFrame:
    """Current members whose current salary is within [low, high], highest first."""
    s = current(t, "salaries", ["emp_no", "salary"]).filter(F.col("salary").between(low, high))
    e = t["employees"].join(s, "emp_no")
    e = with_dept_name(t, e.join(current(t, "dept_emp", ["emp_no", "dept_no"]), "emp_no"))
    return e.select(*EMP_COLS, "salary", "dept_name").orderBy(F.col("salary").desc(), "emp_no")


def pay_list_by_salary(t: Tables, as_of: dt.date = AS_OF) -> DataFrame:
    """Current detail ordered by salary (range-partitioned global sort)."""
    s = snapshot(t, ["emp_no", "first_name", "last_name"])
    return s.select("emp_no", "first_name", "last_name", "salary", "title", "dept_name").orderBy(F.col("salary").desc(), "emp_no")


def pay_highest_earners(t: Tables, as_of: dt.date = AS_OF) -> DataFrame:
    """All current employees by salary, highest first (no limit, as in the source)."""
    return snapshot(t).select(*EMP_COLS, "salary", "dept_name", "title").orderBy(F.col("salary").desc(), "emp_no")


def pay_salary_by_year(t: Tables, as_of: dt.date = AS_OF, year: int = 1995) -> DataFrame:
    """Salary history rows that started in ``year`` (a date range, pushed to the scan)."""
    s = t["salaries"].filter(in_years("from_date", year))
    e = t["employees"].select("emp_no", "first_name", "last_name")
    return e.join(s, "emp_no").select("emp_no", "first_name", "last_name", "salary", "from_date", "to_date")


def pay_department_avg(t: Tables, as_of: dt.date = AS_OF) -> DataFrame:
    """Per department: distinct current members and average / max / min current salary."""
    members = current(t, "dept_emp", ["emp_no", "dept_no"]).join(t["employees"].select("emp_no"), "emp_no", "left_semi")
    rows = members.join(current(t, "salaries", ["emp_no", "salary"]), "emp_no")
    agg = rows.groupBy("dept_no").agg(
        F.count_distinct("emp_no").alias("emp_count"),
        F.sum(F.col("salary").cast("long")).alias("_sum"),
        F.count("salary").alias("_n"),
        F.max("salary").alias("max_salary"),
        F.min("salary").alias("min_salary"),
    )
    # dept_name is unique, so grouping by dept_no yields the same groups.
    named = with_dept_name(t, agg)
    return named.select(
        "dept_name", "emp_count", ratio("_sum", "_n", 4).alias("avg_salary"), "max_salary", "min_salary",
    )


def pay_search_by_salary(t: Tables, as_of: dt.date = AS_OF, low: int = 70000, high: int = 90000) -> DataFrame:
    """Current salary within typed bounds (the source compares int to text literals)."""
    s = current(t, "salaries", ["emp_no", "salary"]).filter(F.col("salary").between(int(low), int(high)))
    e = t["employees"].select("emp_no", "first_name", "last_name").join(s, "emp_no")
    e = e.join(current(t, "titles", ["emp_no", "title"]), "emp_no")
    return e.select("emp_no", "first_name", "last_name", "salary", "title")


_INT = (-(2**31), 2**31 - 1)  # what an employee number can be


def pay_lookup_many(t: Tables, as_of: dt.date = AS_OF, emp_nos: list[int] | DataFrame | None = None) -> DataFrame:
    """Many point lookups as one query: employees with their current salary.

    The ids, a list of any length or a DataFrame, are a key table that both sides meet in a left semi
    join. The ranges they fall in (at most ``keyfilter.MAX_RANGES``) go down to both scans. Ids that no employee number
    can be find nothing.
    """
    e, s = t["employees"], current(t, "salaries", ["emp_no", "salary"])
    if isinstance(emp_nos, DataFrame):
        wide = emp_nos.select(F.col(emp_nos.columns[0]).cast("long").alias("emp_no")).filter(F.col("emp_no").between(*_INT))
        ranges = ranges_of(wide, "emp_no")
    else:
        ids = [i for i in map(int, range(10001, 10021) if emp_nos is None else emp_nos) if _INT[0] <= i <= _INT[1]]
        wide = e.sparkSession.createDataFrame([(i,) for i in ids], "emp_no long")
        ranges = ranges_of_list(ids)
    keys = wide.select(F.col("emp_no").cast("int").alias("emp_no"))
    e, s = (x.filter(in_ranges("emp_no", ranges)).join(keys, "emp_no", "left_semi") for x in (e, s))
    return e.join(s, "emp_no").select(*EMP_COLS, "salary")
