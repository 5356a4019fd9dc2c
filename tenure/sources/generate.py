"""Synthetic HR dataset of any size, generated on the executors.

``spark.range(n)`` fans out across tasks; every attribute is a hash of
(row id, seed), so the data is deterministic for a seed and no row passes
through the driver. Shape follows the source loader: one department
assignment and 1-4 open salary rows per employee, salaries 30000-200000,
salary start dates 365-1095 days apart from the hire date.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenure.schema import BUDGET_TYPE, DEFAULT_BUDGET, OPEN_END
from tenure.sources.tables import Tables

# The five seed departments of the source loader.
SEED_DEPARTMENTS = [
    ("d001", "Marketing"),
    ("d002", "Finance"),
    ("d003", "HR"),
    ("d004", "Engineering"),
    ("d005", "Sales"),
]
EMP_NO_LOW, EMP_NO_HIGH = 1000000, 9999999
SALARY_LOW, SALARY_HIGH = 30000, 200000


def seed_departments(spark: SparkSession) -> DataFrame:
    """The five seed departments (a fixed dimension)."""
    df = spark.createDataFrame(SEED_DEPARTMENTS, "dept_no string, dept_name string")
    return df.withColumn("manager_budget", F.lit(DEFAULT_BUDGET).cast(BUDGET_TYPE))


def _uniform(seed: int, salt: int, *cols: Column) -> Column:
    """Deterministic uniform [0, 1) from a 64-bit hash."""
    h = F.xxhash64(*cols, F.lit(seed), F.lit(salt))
    return F.pmod(h, F.lit(1 << 30)) / F.lit(float(1 << 30))


def _int_between(u: Column, low: int, high: int) -> Column:
    return (F.lit(low) + F.floor(u * (high - low + 1))).cast("int")


def generate_hr(
    spark: SparkSession, n: int, seed: int = 42, today: dt.date = dt.date(2001, 8, 1), partitions: int | None = None,
) -> Tables:
    """Employees, departments, dept_emp and salaries for ``n`` generated employees.

    Like the loader, ``emp_no`` is drawn at random and may repeat; repeated
    rows are what ``sinks.insert_if_absent`` resolves on load.
    """
    ids = spark.range(0, n, numPartitions=partitions) if partitions else spark.range(0, n)
    i = F.col("id")
    start_birth = F.add_months(F.lit(today), -65 * 12)
    start_hire = F.add_months(F.lit(today), -20 * 12)
    birth_span = F.datediff(F.add_months(F.lit(today), -20 * 12), start_birth)
    hire_span = F.datediff(F.lit(today), start_hire)
    emp = ids.select(
        i.alias("row_id"),
        _int_between(_uniform(seed, 1, i), EMP_NO_LOW, EMP_NO_HIGH).alias("emp_no"),
        F.date_add(start_birth, F.floor(_uniform(seed, 2, i) * birth_span).cast("int")).alias("birth_date"),
        F.concat(F.lit("First"), (F.pmod(F.xxhash64(i, F.lit(seed), F.lit(3)), F.lit(5000))).cast("string")).alias("first_name"),
        F.concat(F.lit("Last"), (F.pmod(F.xxhash64(i, F.lit(seed), F.lit(4)), F.lit(5000))).cast("string")).alias("last_name"),
        F.when(_uniform(seed, 5, i) < 0.5, "M").otherwise("F").alias("gender"),
        F.date_add(start_hire, F.floor(_uniform(seed, 6, i) * hire_span).cast("int")).alias("hire_date"),
    )
    employees = emp.select("emp_no", "birth_date", "first_name", "last_name", "gender", "hire_date")
    # 1-4 salary rows; each starts 365-1095 days after the previous one, all open (as the loader writes them).
    n_sal = _int_between(_uniform(seed, 7, F.col("row_id")), 1, 4)
    sal = emp.select("row_id", "emp_no", "hire_date", F.explode(F.sequence(F.lit(1), n_sal)).alias("j"))
    # Start date = hire date + sum of the previous gaps; gaps are hashes of (row, j), so the
    # cumulative sum is a small per-row array aggregate (at most four terms), no window.
    gaps = F.transform(F.sequence(F.lit(1), F.col("j")), lambda x: F.when(
        x < F.col("j"), _int_between(_uniform(seed, 8, F.col("row_id"), x), 365, 1095)).otherwise(0))
    offset = F.aggregate(gaps, F.lit(0), lambda acc, x: acc + x)
    salaries = sal.select(
        "emp_no",
        _int_between(_uniform(seed, 9, F.col("row_id"), F.col("j")), SALARY_LOW, SALARY_HIGH).alias("salary"),
        F.date_add("hire_date", offset).alias("from_date"),
        F.lit(OPEN_END).alias("to_date"),
    )
    depts = seed_departments(spark)
    dept_no = F.element_at(
        F.array(*[F.lit(d) for d, _ in SEED_DEPARTMENTS]),
        (F.floor(_uniform(seed, 10, F.col("row_id")) * len(SEED_DEPARTMENTS)) + 1).cast("int"),
    )
    dept_emp = emp.select("emp_no", dept_no.alias("dept_no"), F.col("hire_date").alias("from_date"),
                          F.lit(OPEN_END).alias("to_date"))
    return Tables({"employees": employees, "departments": depts, "dept_emp": dept_emp, "salaries": salaries})
