"""Performance-review reports: careers, department scores, top performers.

The source writes these with correlated subqueries. Here each subquery is an
aggregate keyed by employee or department, computed once and joined back;
"previous row" lookups use neighbour dates per employee (``with_adjacent_dates``).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenure.functions.dialect import (
    avg_round, days_since, in_years, is_open, like_contains, like_prefix, ratio, ratio_scaled_small, ratio_small,
)
from tenure.functions.neighbors import with_adjacent_dates
from tenure.operators.current import current, snapshot, with_dept_name
from tenure.plans.sizing import dim_agg
from tenure.schema import AS_OF
from tenure.sources.tables import Tables


def years_of_service(as_of: dt.date) -> Column:
    """``DATEDIFF(as_of, hire_date) / 365`` with MySQL's four-digit decimal result."""
    return ratio_small(days_since("hire_date", as_of), F.lit(365), 4)


def title_counts(t: Tables, distinct: bool) -> DataFrame:
    """All-time titles per employee: distinct titles, or all title rows."""
    agg = F.count_distinct("title") if distinct else F.count(F.lit(1))
    return t["titles"].groupBy("emp_no").agg(agg.alias("role_changes"))


def dept_avg_all_members(t: Tables) -> DataFrame:
    """Average current salary of everyone ever assigned to a department (past members included).

    Partial aggregation per department before the shuffle; the result is cut to the known
    departments, so it is joined back as a bounded broadcast.
    """
    rows = current(t, "salaries", ["emp_no", "salary"]).join(t["dept_emp"].select("emp_no", "dept_no"), "emp_no")
    agg = rows.groupBy("dept_no").agg(avg_round("salary", 4).alias("dept_avg_salary"))
    return dim_agg(t, "departments", agg, "dept_no")


def perf_employee_list(t: Tables, as_of: dt.date = AS_OF) -> DataFrame:
    """Current detail with years of service, distinct titles ever held and max-min salary ever."""
    growth = t["salaries"].groupBy("emp_no").agg((F.max("salary") - F.min("salary")).alias("salary_growth"))
    s = snapshot(t, ["emp_no", "first_name", "last_name", "hire_date"])
    s = s.join(title_counts(t, True), "emp_no", "left").join(growth, "emp_no", "left")
    return s.select(
        "emp_no", "first_name", "last_name", "title", "dept_name", "salary",
        years_of_service(as_of).alias("years_of_service"),
        F.coalesce("role_changes", F.lit(0)).alias("role_changes"), "salary_growth",
    )


def previous_at(t: Tables, name: str, value: str) -> DataFrame:
    """Open rows of ``name`` with ``previous_<value>``: the value held on the previous distinct start date.

    Ties on that date resolve to the largest value (deterministic).
    """
    hist = t[name].select("emp_no", "from_date", "to_date", value)
    out = with_adjacent_dates(hist, "emp_no", "from_date", value=value)
    return out.filter(is_open()).select("emp_no", "from_date", value, F.col("prev_value").alias(f"previous_{value}"))


def perf_career_progression(t: Tables, as_of: dt.date = AS_OF) -> DataFrame:
    """Current title and salary with the title and salary held just before each."""
    ti = previous_at(t, "titles", "title")
    sa = previous_at(t, "salaries", "salary")
    e = t["employees"].select("emp_no", "first_name", "last_name")
    out = (
        e.join(ti.select("emp_no", F.col("title").alias("current_title"),
                         F.col("from_date").alias("current_title_date"), "previous_title"), "emp_no")
        .join(sa.select("emp_no", F.col("salary").alias("current_salary"), "previous_salary"), "emp_no")
        .join(current(t, "dept_emp", ["emp_no", "dept_no"]), "emp_no")
    )
    return with_dept_name(t, out).select(
        "emp_no", "first_name", "last_name", "current_title", "current_title_date", "current_salary", "dept_name",
        "previous_title", "previous_salary",
    )


def perf_department_score(t: Tables, as_of: dt.date = AS_OF, senior_prefix: str = "Senior") -> DataFrame:
    """Department statistics plus the number of current members who ever held a senior title."""
    rows = (
        current(t, "dept_emp", ["emp_no", "dept_no"])
        .join(t["employees"].select("emp_no", "hire_date"), "emp_no")
        .join(current(t, "titles", ["emp_no", "title"]), "emp_no")
        .join(current(t, "salaries", ["emp_no", "salary"]), "emp_no")
    )
    agg = rows.groupBy("dept_no").agg(
        F.count_distinct("emp_no").alias("employee_count"),
        avg_round("salary", 4).alias("avg_salary"),
        F.max("salary").alias("max_salary"),
        F.min("salary").alias("min_salary"),
        F.count_distinct("title").alias("title_diversity"),
        ratio(F.sum(days_since("hire_date", as_of).cast("long")), F.count(F.lit(1)), 4).alias("avg_tenure_days"),
    )
    seniors = t["titles"].filter(like_prefix("title", senior_prefix)).select("emp_no").distinct()
    senior = (
        current(t, "dept_emp", ["emp_no", "dept_no"]).join(seniors, "emp_no", "left_semi")
        .groupBy("dept_no").agg(F.count_distinct("emp_no").alias("senior_employees"))
    )
    out = agg.join(dim_agg(t, "departments", senior, "dept_no"), "dept_no", "left")
    return with_dept_name(t, out).select(
        "dept_name", "employee_count", "avg_salary", "max_salary", "min_salary", "title_diversity", "avg_tenure_days",
        F.coalesce("senior_employees", F.lit(0)).alias("senior_employees"),
    )


def perf_reviews(t: Tables, as_of: dt.date = AS_OF) -> DataFrame:
    """Current detail with years of service, title rows and an experience band (15 / 10 / 5 years)."""
    s = snapshot(t, ["emp_no", "first_name", "last_name", "hire_date"]).join(title_counts(t, False), "emp_no", "left")
    y = years_of_service(as_of)
    level = (
        F.when(y >= 15, "Senior").when(y >= 10, "Experienced").when(y >= 5, "Mid-Level").otherwise("Junior")
    )
    return s.select(
        "emp_no", "first_name", "last_name", "title", "salary", "dept_name", y.alias("years_of_service"),
        F.coalesce("role_changes", F.lit(0)).alias("role_changes"), level.alias("experience_level"),
    ).orderBy(F.col("years_of_service").desc(), "emp_no")


def perf_department_comparison(t: Tables, as_of: dt.date = AS_OF, senior_prefix: str = "Senior") -> DataFrame:
    """Department comparison: seniors by current title, titles ever held by anyone ever assigned."""
    rows = (
        current(t, "dept_emp", ["emp_no", "dept_no"])
        .join(t["employees"].select("emp_no", "hire_date"), "emp_no")
        .join(current(t, "titles", ["emp_no", "title"]), "emp_no")
        .join(current(t, "salaries", ["emp_no", "salary"]), "emp_no")
    )
    years_scaled = ratio_scaled_small(days_since("hire_date", as_of), F.lit(365), 4)
    # Both distinct counts are over employees, so aggregate per (department, employee) first:
    # that step reuses the emp_no partitioning of the joins, and the department step then
    # needs no DISTINCT (no Expand of the rows).
    per_emp = rows.groupBy("dept_no", "emp_no").agg(
        F.sum(F.col("salary").cast("long")).alias("_s"), F.count("salary").alias("_c"),
        F.sum(years_scaled).alias("_ys"), F.count(F.lit(1)).alias("_n"),
        F.max(F.when(like_prefix("title", senior_prefix), 1).otherwise(0)).alias("_senior"),
        F.max("salary").alias("_mx"), F.min("salary").alias("_mn"),
    )
    agg = per_emp.groupBy("dept_no").agg(
        F.count(F.lit(1)).alias("employee_count"),
        ratio(F.sum("_s"), F.sum("_c"), 4).alias("avg_salary"),
        ratio(F.sum("_ys"), F.sum("_n") * 10**4, 4).alias("avg_years_of_service"),
        F.sum("_senior").cast("long").alias("senior_employee_count"),
        (F.max("_mx") - F.min("_mn")).alias("salary_range"),
    )
    roles = (
        t["titles"].select("emp_no", "title").join(t["dept_emp"].select("emp_no", "dept_no"), "emp_no")
        .groupBy("dept_no").agg(F.count_distinct("title").alias("unique_roles"))
    )
    out = agg.join(dim_agg(t, "departments", roles, "dept_no"), "dept_no", "left")
    return with_dept_name(t, out).select(
        "dept_name", "employee_count", "avg_salary", "avg_years_of_service", "senior_employee_count",
        F.coalesce("unique_roles", F.lit(0)).alias("unique_roles"), "salary_range",
    ).orderBy(F.col("avg_salary").desc(), "dept_name")


def perf_top_performers(t: Tables, as_of: dt.date = AS_OF) -> DataFrame:
    """Current employees paid above their department's average (past members count in the average)."""
    s = snapshot(t, ["emp_no", "first_name", "last_name"]).join(dept_avg_all_members(t), "dept_no")
    diff = F.col("salary") - F.col("dept_avg_salary")
    return (
        s.select("emp_no", "first_name", "last_name", "title", "salary", "dept_name", diff.alias("salary_above_dept_avg"))
        .filter(F.col("salary_above_dept_avg") > 0)
        .orderBy(F.col("salary_above_dept_avg").desc(), "emp_no")
    )


def perf_annual_summary(t: Tables, as_of: dt.date = AS_OF, senior_prefix: str = "Senior") -> DataFrame:
    """Per (start year of the current salary, department): people, pay, titles, senior rows."""
    rows = (
        t["employees"].select("emp_no")
        .join(current(t, "dept_emp", ["emp_no", "dept_no"]), "emp_no")
        .join(current(t, "titles", ["emp_no", "title"]), "emp_no")
        .join(current(t, "salaries", ["emp_no", "salary", "from_date"]), "emp_no")
    )
    agg = rows.groupBy(F.year("from_date").alias("year"), "dept_no").agg(
        F.count_distinct("emp_no").alias("total_employees"),
        avg_round("salary", 4).alias("avg_salary"),
        F.count_distinct("title").alias("title_count"),
        F.count_if(like_prefix("title", senior_prefix)).alias("senior_positions"),
    )
    return (
        with_dept_name(t, agg)
        .select("year", "dept_name", "total_employees", "avg_salary", "title_count", "senior_positions")
        .orderBy(F.col("year").desc(), "dept_name")
    )


def perf_search_name_year(
    t: Tables, as_of: dt.date = AS_OF, first_like: str = "John", last_like: str = "Smith", year: int = 1990,
    case_sensitive: bool = False,
) -> DataFrame:
    """Name search among employees hired in ``year`` with distinct titles ever held."""
    e = t["employees"].filter(
        (like_contains("first_name", first_like, case_sensitive) | like_contains("last_name", last_like, case_sensitive))
        & in_years("hire_date", year)
    )
    s = snapshot(t, employees=e, emp_cols=["emp_no", "first_name", "last_name", "hire_date"])
    s = s.join(title_counts(t, True), "emp_no", "left")
    return s.select(
        "emp_no", "first_name", "last_name", "hire_date", "title", "dept_name", "salary",
        F.year("hire_date").alias("hire_year"), F.coalesce("role_changes", F.lit(0)).alias("role_changes"),
    )


def perf_search_by_year(t: Tables, as_of: dt.date = AS_OF, year: int = 1990) -> DataFrame:
    """Employees hired in ``year``: distinct salary values over their whole history, per current title."""
    e = t["employees"].filter(in_years("hire_date", year)).select("emp_no", "first_name", "last_name", "hire_date")
    rows = e.join(current(t, "titles", ["emp_no", "title"]), "emp_no").join(t["salaries"].select("emp_no", "salary"), "emp_no")
    return rows.groupBy(
        "emp_no", "first_name", "last_name", "title", F.year("hire_date").alias("hire_year"),
    ).agg(F.count_distinct("salary").alias("salary_changes"))
