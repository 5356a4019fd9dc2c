"""Admin-console reports: searches, department audit, histories, salary and transfer audits, export."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenure.functions.dialect import after_year, avg_round, date_text_or_present, is_open, like_contains, ratio
from tenure.functions.neighbors import with_adjacent_dates
from tenure.functions.strings import chunked_concat, ordered_concat
from tenure.operators.current import EMP_COLS, current, snapshot, with_dept_name
from tenure.operators.paging import with_row_index
from tenure.operators.reports_perf import dept_avg_all_members
from tenure.plans.sizing import dim, dim_agg
from tenure.schema import AS_OF
from tenure.sources.tables import Tables


def admin_search(
    t: Tables, as_of: dt.date = AS_OF, first_like: str = "ar", last_like: str = "son", min_salary: int = 60000,
    hired_after_year: int = 1990, case_sensitive: bool = False,
) -> DataFrame:
    """Distinct current detail of name matches paid above ``min_salary``, hired after a year."""
    e = t["employees"].filter(
        (like_contains("first_name", first_like, case_sensitive) | like_contains("last_name", last_like, case_sensitive))
        & after_year("hire_date", hired_after_year)
    )
    s = current(t, "salaries", ["emp_no", "salary"]).filter(F.col("salary") > min_salary)
    stats = t["titles"].groupBy("emp_no").agg(F.count(F.lit(1)).alias("role_changes"))
    top = t["salaries"].groupBy("emp_no").agg(F.max("salary").alias("highest_salary"))
    j = (
        e.select("emp_no", "first_name", "last_name", "hire_date")
        .join(current(t, "titles", ["emp_no", "title"]), "emp_no")
        .join(s, "emp_no")
        .join(current(t, "dept_emp", ["emp_no", "dept_no"]), "emp_no")
        .join(stats, "emp_no", "left")
        .join(top, "emp_no", "left")
    )
    return with_dept_name(t, j).select(
        "emp_no", "first_name", "last_name", "hire_date", "title", "salary", "dept_name",
        F.coalesce("role_changes", F.lit(0)).alias("role_changes"), "highest_salary",
    ).distinct()


def admin_department_details(t: Tables, as_of: dt.date = AS_OF) -> DataFrame:
    """Per department (all kept): members, managers, first manager date, titles, average salary, past rows.

    The source multiplies member rows by manager rows; every member row is
    repeated equally, so the average is taken over member rows alone and the
    manager figures come from their own aggregate. No fan-out is built.
    """
    members = (
        current(t, "dept_emp", ["emp_no", "dept_no"])
        .join(current(t, "titles", ["emp_no", "title"]), "emp_no", "left")
        .join(current(t, "salaries", ["emp_no", "salary"]), "emp_no", "left")
        .groupBy("dept_no").agg(
            F.count_distinct("emp_no").alias("current_employees"),
            F.count_distinct("title").alias("unique_titles"),
            avg_round("salary", 4).alias("avg_salary"),
        )
    )
    managers = t["dept_manager"].groupBy("dept_no").agg(
        F.count_distinct("emp_no").alias("total_managers"), F.min("from_date").alias("first_manager_date"),
    )
    past = (
        t["dept_emp"].filter(F.col("to_date") < F.lit(as_of))
        .groupBy("dept_no").agg(F.count(F.lit(1)).alias("past_employees"))
    )
    d = t["departments"].select("dept_no", "dept_name")
    out = (
        d.join(dim_agg(t, "departments", members, "dept_no"), "dept_no", "left")
        .join(dim_agg(t, "departments", managers, "dept_no"), "dept_no", "left")
        .join(dim_agg(t, "departments", past, "dept_no"), "dept_no", "left")
    )
    return out.select(
        "dept_no", "dept_name",
        F.coalesce("current_employees", F.lit(0)).alias("current_employees"),
        F.coalesce("total_managers", F.lit(0)).alias("total_managers"),
        "first_manager_date",
        F.coalesce("unique_titles", F.lit(0)).alias("unique_titles"),
        "avg_salary",
        F.coalesce("past_employees", F.lit(0)).alias("past_employees"),
    )


def admin_employee_details(t: Tables, as_of: dt.date = AS_OF, emp_no: int | None = 10001) -> DataFrame:
    """Current detail with ordered title and department histories (one employee, or all when ``None``).

    Histories are per-employee aggregates. When the checked bound says one
    employee may hold a huge history, the strings are built per start year
    first and only those parts meet (``chunked_concat``).
    """
    e, ti, de = t["employees"], t["titles"], t["dept_emp"]
    if emp_no is not None:
        e, ti, de = (x.filter(F.col("emp_no") == emp_no) for x in (e, ti, de))
    entry = F.concat(
        F.col("dept_name"), F.lit(": "), F.col("from_date").cast("string"), F.lit(" to "), date_text_or_present("to_date"),
    )
    dept_rows = with_dept_name(t, de.select("emp_no", "dept_no", "from_date", "to_date"))
    th = _history(ti, "title_history", F.col("title"), [F.col("from_date"), F.col("title")], ", ")
    dh = _history(dept_rows, "department_history", entry,
                  [F.col("from_date"), F.col("dept_no")], "; ")
    s = snapshot(t, employees=e, emp_cols=["emp_no", "first_name", "last_name", "hire_date"])
    s = s.join(th, "emp_no", "left").join(dh, "emp_no", "left")
    return s.select(
        "emp_no", "first_name", "last_name", "hire_date", F.col("title").alias("current_title"),
        F.col("salary").alias("current_salary"), F.col("dept_name").alias("current_department"),
        "title_history", "department_history",
    )


def _history(rows: DataFrame, name: str, value, order: list, sep: str) -> DataFrame:
    """One ordered history string per employee, built by start year."""
    return chunked_concat(rows, ["emp_no"], {name: value}, order, [F.year("from_date")], sep)


def admin_salary_audit(t: Tables, as_of: dt.date = AS_OF) -> DataFrame:
    """Current salary, the most recently closed salary and the department average (past members included)."""
    prev = (
        t["salaries"].filter(~is_open())
        .groupBy("emp_no").agg(F.max(F.struct("to_date", "salary"))["salary"].alias("previous_salary"))
    )
    s = (
        t["employees"].select("emp_no", "first_name", "last_name")
        .join(current(t, "salaries", ["emp_no", F.col("salary").alias("current_salary"),
                                      F.col("from_date").alias("current_salary_date")]), "emp_no")
        .join(current(t, "dept_emp", ["emp_no", "dept_no"]), "emp_no")
        .join(current(t, "titles", ["emp_no", "title"]), "emp_no")
        .join(prev, "emp_no", "left")
    )
    s = with_dept_name(t, s).join(dept_avg_all_members(t), "dept_no", "left")
    return s.select(
        "emp_no", "first_name", "last_name", "current_salary", "current_salary_date", "previous_salary",
        "dept_name", "title", "dept_avg_salary",
    )


def admin_transfer_audit(t: Tables, as_of: dt.date = AS_OF, min_count: int = 1) -> DataFrame:
    """Department-to-department moves between consecutive assignment start dates.

    A pair (a, b) of one employee's assignments is consecutive when b starts
    on the next *distinct* start date after a; ``with_adjacent_dates`` gives that
    date.
    Rows are first counted per (employee, start date, department), so the
    pairs are built between those counts (at most departments^2 per date
    step) and weighted, never row by row: no range join, no all-pairs
    expansion.
    """
    de = t["dept_emp"].select("emp_no", "dept_no", "from_date")
    ann = with_adjacent_dates(de, "emp_no", "from_date").filter(F.col("next_date").isNotNull())
    # Grouping right after the per-employee window reuses its partitioning (no extra exchange).
    a = ann.groupBy("emp_no", "from_date", "next_date", "dept_no").agg(F.count(F.lit(1)).alias("n_a"))
    b = de.groupBy("emp_no", "from_date", "dept_no").agg(F.count(F.lit(1)).alias("n_b")).select(
        "emp_no", F.col("from_date").alias("next_date"), F.col("dept_no").alias("to_dept"), "n_b")
    pairs = a.join(b, ["emp_no", "next_date"]).withColumn("w", F.col("n_a") * F.col("n_b"))
    agg = pairs.groupBy("dept_no", "to_dept").agg(
        F.sum("w").alias("transfer_count"),
        ratio(F.sum(F.col("w") * F.datediff("next_date", "from_date")), F.sum("w"), 4).alias("avg_days_between_transfers"),
    ).filter(F.col("transfer_count") > min_count)
    names = t["departments"].select("dept_no", "dept_name")
    to_names = names.select(F.col("dept_no").alias("to_dept"), F.col("dept_name").alias("to_department"))
    out = with_dept_name(t, agg).join(dim(t, "departments", to_names), "to_dept")
    return out.select(
        F.col("dept_name").alias("from_department"), "to_department", "transfer_count", "avg_days_between_transfers",
    ).orderBy(F.col("transfer_count").desc(), "from_department", "to_department")


def admin_data_export(t: Tables, as_of: dt.date = AS_OF, page_size: int = 1000) -> DataFrame:
    """Full current detail with a page number under a total order (paged export).

    Pages are assigned from a distributed row index (range-partitioned sort,
    per-partition offsets), never from a single-partition window.
    """
    s = snapshot(t).select(*EMP_COLS, "salary", "title", "dept_name")
    idx = with_row_index(s, ["emp_no", "title", "dept_name", "salary"])
    return idx.select(*EMP_COLS, "salary", "title", "dept_name", F.floor(F.col("row_index") / page_size).alias("page_no"))
