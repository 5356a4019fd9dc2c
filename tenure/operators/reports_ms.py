"""SQL-Server workload reports: weighted hierarchy average, table scan, history strings."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenure.functions.dialect import col_, like, ratio, ratio_trunc
from tenure.functions.strings import ordered_concat
from tenure.operators.current import EMP_COLS, current, with_dept_name
from tenure.plans.sizing import dim, one_row
from tenure.schema import AS_OF
from tenure.sources.tables import Tables

EMP_CHUNK = 1024  # employees per partial string in chunked concatenation


def ms_hierarchy_salary(
    t: Tables, as_of: dt.date = AS_OF, depth: int = 3, salaries: str = "salaries_multi", int_avg: bool = False,
) -> DataFrame:
    """Department averages of the source's self-joining recursive CTE, in closed form.

    The recursion re-joins each employee's own assignments and current
    salaries at every level, so an (assignment, salary) pair of an employee
    with k assignments and q current salaries appears (kq)^(n-1) times at
    level n. Summing the levels gives a weight w = 1 + kq + ... + (kq)^(depth-1)
    per employee: one aggregate per employee replaces (kq)^depth rows.
    HAVING compares with the average of all current salaries exactly
    (cross-multiplied integers). ``int_avg=True`` is the SQL Server reading:
    both averages are truncated integers.
    """
    de = t["dept_emp"].select("emp_no", "dept_no").join(
        dim(t, "departments", t["departments"].select("dept_no")), "dept_no", "left_semi"
    ).join(t["employees"].select("emp_no"), "emp_no", "left_semi")
    cur = current(t, salaries, ["emp_no", "salary"])
    per_emp = cur.groupBy("emp_no").agg(F.count(F.lit(1)).alias("q"), F.sum(F.col("salary").cast("long")).alias("s"))
    k = de.groupBy("emp_no").agg(F.count(F.lit(1)).alias("k"))
    kq = (F.col("k") * F.col("q")).cast("decimal(38,0)")
    w, term = F.lit(1).cast("decimal(38,0)"), F.lit(1).cast("decimal(38,0)")
    for _ in range(depth - 1):
        term = term * kq
        w = w + term
    emp = per_emp.join(k, "emp_no").select("emp_no", (w * F.col("s")).alias("ws"), (w * F.col("q")).alias("wq"))
    rows = de.join(emp, "emp_no")
    agg = rows.groupBy("dept_no").agg(
        F.count_distinct("emp_no").alias("emp_count"), F.sum("ws").alias("num"), F.sum("wq").alias("den"),
    )
    g = one_row(cur.agg(F.sum(F.col("salary").cast("long")).alias("gsum"), F.count(F.lit(1)).alias("gcnt")))
    if int_avg:
        keep = ratio_trunc("num", "den") > ratio_trunc("gsum", "gcnt")
        avg = ratio_trunc("num", "den")
    else:
        keep = col_("num") * F.col("gcnt").cast("decimal(38,0)") > F.col("gsum").cast("decimal(38,0)") * col_("den")
        avg = ratio("num", "den", 4)
    out = agg.crossJoin(g).filter(keep)
    return with_dept_name(t, out).select(
        "dept_name", "emp_count", avg.alias("avg_salary"), F.lit(depth).alias("hierarchy_depth"),
    )


def ms_employee_scan(
    t: Tables, as_of: dt.date = AS_OF, prefix: str = "A%", born_after: dt.date = dt.date(1960, 1, 1),
    low: int = 40000, high: int = 100000,
) -> DataFrame:
    """Employees born after a date with a last-name prefix, every assignment x salary-history row in range."""
    e = t["employees"].filter((F.col("birth_date") > F.lit(born_after)) & like("last_name", prefix))
    s = t["salaries"].filter(F.col("salary").between(low, high)).select("emp_no", "salary", "from_date", "to_date")
    d = t["departments"]
    j = e.join(t["dept_emp"].select("emp_no", "dept_no"), "emp_no").join(dim(t, "departments", d), "dept_no").join(s, "emp_no")
    return j.select(
        *EMP_COLS, "dept_no", "dept_name", "manager_budget", "salary", "from_date", "to_date",
    ).orderBy(F.col("salary").desc(), "emp_no", "from_date", "dept_no")


def ms_history_chunks(t: Tables, as_of: dt.date = AS_OF, width: int = EMP_CHUNK) -> DataFrame:
    """Per (gender, birth year): first names, salaries and department names as ordered lists, in pieces.

    Rows are employee x salary-history x assignment. Ties in the source's sort keys are broken by
    (emp_no, salary from_date, dept_no). A piece (``items``) holds the ``n`` entries of one range
    of ``width`` employee numbers, for department_history of one department too (dept_no is empty
    elsewhere); a list is its pieces in the order (dept_no, emp_range). The fan-out is
    joined once, and no group that grows with the data meets in one task.
    """
    rows = (
        t["employees"].select("emp_no", "first_name", "gender", F.year("birth_date").alias("birth_year"))
        .join(t["salaries"].select("emp_no", "salary", F.col("from_date").alias("s_from")), "emp_no")
        .join(t["dept_emp"].select("emp_no", "dept_no"), "emp_no")
    )
    entries = F.array(
        *[F.struct(F.lit(n).alias("list"), F.lit("").alias("in_dept"), F.col(c).cast("string").alias("entry"))
          for n, c in (("employee_data", "first_name"), ("salary_history", "salary"))],
        F.struct(F.lit("department_history").alias("list"), F.col("dept_no").alias("in_dept"), F.col("dept_name").alias("entry")),
    )
    rows = with_dept_name(t, rows).select(
        "gender", "birth_year", "emp_no", "s_from", "dept_no", F.floor(F.col("emp_no") / width).alias("emp_range"), F.inline(entries),
    )
    order = [F.col("emp_no"), F.col("s_from"), F.col("dept_no")]
    return rows.groupBy("gender", "birth_year", "list", F.col("in_dept").alias("dept_no"), "emp_range").agg(
        F.count("entry").alias("n"), ordered_concat(F.col("entry"), order, ", ").alias("items"),
    )


def ms_history_strings(t: Tables, as_of: dt.date = AS_OF, n: int = 1000) -> DataFrame:
    """The source's form of ``ms_history_chunks``: each list as one string, the first ``n`` rows by their lists.

    One value holds a whole group, as in the source, so this form ends where a string of 2 GB
    does; ``ms_history_chunks`` has no such end.
    """
    g = ["gender", "birth_year"]
    pieces = F.struct("dept_no", "emp_range", "items")

    def joined(name: str):
        held = F.array_sort(F.collect_list(F.when(F.col("list") == name, pieces)))
        return F.array_join(F.transform(held, lambda s: s["items"]), ", ").alias(name)

    lists = ["employee_data", "salary_history", "department_history"]
    out = ms_history_chunks(t, as_of).groupBy(*g).agg(*[joined(name) for name in lists])
    return out.orderBy("employee_data", "salary_history", *g).limit(n)
