"""The declared views and the materialized department statistics."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenure.functions.dialect import avg_round, avg_truncated
from tenure.operators.current import current, with_dept_name
from tenure.schema import AS_OF, OPEN_END
from tenure.sources.tables import Tables


def employee_stats(t: Tables, as_of: dt.date = AS_OF) -> DataFrame:
    """Per (birth year, gender): head count, average birth month, male count."""
    e = t["employees"]
    return e.groupBy(F.year("birth_date").alias("birth_year"), "gender").agg(
        F.count(F.lit(1)).alias("total_count"),
        avg_round(F.month("birth_date"), 4).alias("avg_birth_month"),
        F.count_if(F.col("gender") == "M").alias("male_count"),
    )


def salary_metrics(t: Tables, as_of: dt.date = AS_OF, int_avg: bool = False) -> DataFrame:
    """Per (department, start year of the current salary) over all assignments: sample stddev.

    ``int_avg=True`` gives the SQL Server form of the view (``AVG`` of an int column truncates).
    """
    rows = (
        t["employees"].select("emp_no")
        .join(t["dept_emp"].select("emp_no", "dept_no"), "emp_no")
        .join(current(t, "salaries", ["emp_no", "salary", "from_date"]), "emp_no")
    )
    agg = rows.groupBy("dept_no", F.year("from_date").alias("year")).agg(
        F.count_distinct("emp_no").alias("employee_count"),
        (avg_truncated("salary") if int_avg else avg_round("salary", 4)).alias("avg_salary"),
        F.max("salary").alias("max_salary"),
        F.min("salary").alias("min_salary"),
        F.round(F.stddev_samp("salary"), 2).alias("salary_stddev"),
    )
    return with_dept_name(t, agg).select(
        "dept_name", "year", "employee_count", "avg_salary", "max_salary", "min_salary", "salary_stddev",
    ).orderBy("dept_name", "year")


def dept_stats(t: Tables, as_of: dt.date = AS_OF, open_end: dt.date = OPEN_END) -> DataFrame:
    """Materialized per-department salary statistics (refresh with ``sinks.refresh_snapshot``).

    The source filters on a different open-end date than its loader writes,
    which leaves the view empty; the open end here is the one constant.
    """
    rows = (
        t["dept_emp"].select("emp_no", "dept_no")
        .join(t["employees"].select("emp_no"), "emp_no", "left_semi")
        .join(current(t, "salaries", ["emp_no", "salary"], open_end=open_end), "emp_no")
    )
    agg = rows.groupBy("dept_no").agg(
        F.count_distinct("emp_no").alias("emp_count"),
        avg_round("salary", 4).alias("avg_salary"),
        F.min("salary").alias("min_salary"),
        F.max("salary").alias("max_salary"),
        F.round(F.stddev_samp("salary"), 2).alias("salary_stddev"),
    )
    return with_dept_name(t, agg).select(
        "dept_no", "dept_name", "emp_count", "avg_salary", "min_salary", "max_salary", "salary_stddev",
    )


def high_salaries(t: Tables, as_of: dt.date = AS_OF, threshold: int = 200000) -> DataFrame:
    """Named subset from a partial-index predicate: salary rows above ``threshold`` (an older copy used 100000)."""
    return t["salaries"].filter(F.col("salary") > threshold).select("emp_no", "salary", "from_date", "to_date")


def current_assignments(t: Tables, as_of: dt.date = AS_OF, open_end: dt.date = OPEN_END) -> DataFrame:
    """Named subset from a partial-index predicate: open department assignments."""
    return current(t, "dept_emp", ["emp_no", "dept_no", "from_date", "to_date"], open_end=open_end)
