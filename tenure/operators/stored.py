"""Table changes and loads carried out on stored tables: each returns what a reader finds afterwards.

The tables are written below the shared checkpoint folder, under a new name at every call.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenure.operators import changes
from tenure.schema import NOT_NULL
from tenure.session import scratch_path
from tenure.sources.maintained import MaintainedDeptStats
from tenure.sources.sinks import write_range_partitioned, write_verified
from tenure.sources.tables import Tables
from tenure.sources.versions import BucketedTable

SALARY_KEY = ["emp_no", "from_date"]
ERA_BOUNDARIES = [dt.date(1994, 1, 1), dt.date(1996, 1, 1)]  # inside the fixture's years, so that every era holds rows


def _store(t: Tables, name: str, keys: list[str]) -> BucketedTable:
    spark = t[name].sparkSession
    table = BucketedTable(spark, scratch_path(spark, f"stored-{name}"), keys)
    table.create(t[name])
    return table


def apply_salary_adjust(t: Tables) -> DataFrame:
    """``salaries``, stored by employee, after the changed rows of C2 were applied to its buckets."""
    table = _store(t, "salaries", ["emp_no"])
    table.apply(changes.salary_adjust.changes(t), batch="salary_adjust")
    return table.read()


def late_salaries(t: Tables) -> DataFrame:
    """A batch to load: every salary row of every third employee again, twice raised, and a first row for each at hiring."""
    s = t["salaries"].filter(F.col("emp_no") % 3 == 0)
    again = [s.withColumn("salary", F.col("salary") + F.lit(more)) for more in (1, 2)]
    hired = t["employees"].filter(F.col("emp_no") % 3 == 0).select("emp_no", F.lit(1).cast("int").alias("salary"), F.col("hire_date").alias("from_date"), F.col("hire_date").alias("to_date"))
    return again[0].unionByName(again[1]).unionByName(hired).unionByName(hired.withColumn("salary", F.lit(0).cast("int")))


def insert_salaries_if_absent(t: Tables) -> DataFrame:
    """``salaries`` after ``late_salaries`` came twice under one batch id: keys that are there stay as they are."""
    table = _store(t, "salaries", SALARY_KEY)
    for _ in range(2):
        table.insert_if_absent(late_salaries(t), order=["salary"], batch="late")
    return table.read()


def salary_eras(t: Tables) -> DataFrame:
    """Per era of a range-partitioned ``salaries``: rows, first and last start, total (read back from its folders)."""
    spark = t["salaries"].sparkSession
    path = scratch_path(spark, "salary-eras")
    write_range_partitioned(t["salaries"], path, boundaries=ERA_BOUNDARIES)
    return spark.read.parquet(path).groupBy("era").agg(
        F.count(F.lit(1)).alias("row_count"), F.min("from_date").alias("first_start"), F.max("from_date").alias("last_start"), F.sum("salary").alias("total"))


def refreshed_dept_stats(t: Tables) -> DataFrame:
    """``dept_stats`` made from the tables, then refreshed after C2 changed ``salaries`` and after C3 changed ``dept_emp``."""
    spark = t["salaries"].sparkSession
    view = MaintainedDeptStats(spark, scratch_path(spark, "maintained"))
    view.create(t)
    for name in ("salary_adjust", "transfer"):
        change, table = changes.CHANGES[name]
        view.inputs[table].apply(change.changes(t), batch=name)
        view.refresh()
    return view.read(t)


def verified_load(t: Tables) -> DataFrame:
    """Every table written once, with the counts seen while it was written: a row for its rows and one for each NOT NULL column."""
    spark = t["salaries"].sparkSession
    base, out = scratch_path(spark, "load"), []
    for name, cols in NOT_NULL.items():
        rows, nulls = write_verified(t[name], f"{base}/{name}", cols)
        out += [(name, None, rows, None), *[(name, c, rows, nulls[c]) for c in cols]]
    return spark.createDataFrame(out, "table_name string, column_name string, row_count long, null_count long")
