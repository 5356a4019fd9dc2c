"""Current-state building blocks shared by the reports.

All four HR fact tables are keyed by ``emp_no``; joining them on that one key
lets Catalyst shuffle each input once and reuse the partitioning for every
further join (no re-exchange). The ``departments`` dimension is broadcast only
behind a checked size.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenure.functions.dialect import is_open
from tenure.plans.sizing import dim
from tenure.schema import OPEN_END
from tenure.sources.tables import Tables

EMP_COLS = ["emp_no", "birth_date", "first_name", "last_name", "gender", "hire_date"]


def current(t: Tables, name: str, cols: list[str] | None = None, open_end: dt.date = OPEN_END) -> DataFrame:
    """Open rows of a validity-interval table (filter reaches the parquet scan)."""
    df = t[name].filter(is_open("to_date", open_end))
    return df.select(*cols) if cols else df


def with_dept_name(t: Tables, df: DataFrame, how: str = "inner") -> DataFrame:
    """Attach ``dept_name`` by ``dept_no`` (size-checked broadcast of the dimension)."""
    return df.join(dim(t, "departments", t["departments"].select("dept_no", "dept_name")), "dept_no", how)


def snapshot(
    t: Tables,
    emp_cols: list[str] | None = None,
    title: bool = True,
    salary: bool = True,
    dept: bool = True,
    salaries: str = "salaries",
    employees: DataFrame | None = None,
) -> DataFrame:
    """Employees inner-joined with their current title, salary and department.

    Mirrors ``employees JOIN titles JOIN salaries JOIN dept_emp JOIN departments
    WHERE <all current>``: several open rows of one kind fan out, as in SQL.
    """
    e = (employees if employees is not None else t["employees"]).select(*(emp_cols or EMP_COLS))
    if title:
        e = e.join(current(t, "titles", ["emp_no", "title"]), "emp_no")
    if salary:
        e = e.join(current(t, salaries, ["emp_no", "salary"]), "emp_no")
    if dept:
        e = with_dept_name(t, e.join(current(t, "dept_emp", ["emp_no", "dept_no"]), "emp_no"))
    return e


def count_per(df: DataFrame, key: str | list[str], name: str) -> DataFrame:
    """Per-key row count (partial aggregation before the shuffle)."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias(name))
