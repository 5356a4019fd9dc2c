"""Department statistics that are refreshed from what changed since the last refresh.

    <base>/employees, dept_emp, salaries    stored tables in buckets by employee (``versions.BucketedTable``)
    <base>/dept_stats                       the state, in buckets by department

The state counts, for each department, the rows of each salary and the employees. Counts can be added and taken away,
and every figure of the report follows from them (also the smallest and largest salary, after a row has gone), so a
refresh reads the buckets that differ between two versions of the inputs, the employees in them whose relevant
columns differ, and the departments these belong to. The state has a row for each department and distinct salary:
it grows with the range of salaries, not with the employees.

Each state version names the input versions it stands for. A refresh that was lost is made up by the next one, over
any number of changes, and a refresh without news does nothing.
"""

from __future__ import annotations

import functools
import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tenure.functions.dialect import is_open, ratio
from tenure.operators.current import count_per, with_dept_name
from tenure.sources.tables import Tables
from tenure.sources.versions import BucketedTable

INPUTS = ("employees", "dept_emp", "salaries")
_COUNTS = ["row_count", "emp_count"]


def _reads(name: str, rows: DataFrame) -> DataFrame:
    """What the statistics read of an input: other columns can change without any effect."""
    if name == "employees":
        return rows.select("emp_no")
    if name == "dept_emp":
        return rows.select("emp_no", "dept_no")
    return rows.filter(is_open("to_date")).select("emp_no", "salary")


def contributions(t: Tables) -> DataFrame:
    """The state of whole tables: dept_no, salary, row_count, emp_count.

    An employee counts in the row of its smallest salary in the department. Repeats are counted on both sides before
    these meet, so an employee has at most a row for each of its salaries and departments.
    """
    in_dept = count_per(t["dept_emp"].join(t["employees"], "emp_no", "left_semi"), ["emp_no", "dept_no"], "_d")
    paid = in_dept.join(count_per(t["salaries"], ["emp_no", "salary"], "_s"), "emp_no")
    first = F.row_number().over(Window.partitionBy("emp_no", "dept_no").orderBy("salary")) == 1
    return _summed(paid.select("dept_no", "salary", (F.col("_d") * F.col("_s")).alias("row_count"), first.cast("long").alias("emp_count")))


def _summed(rows: DataFrame) -> DataFrame:
    sums = rows.groupBy("dept_no", "salary").agg(*[F.sum(c).alias(c) for c in _COUNTS])
    return sums.filter((F.col("row_count") != 0) | (F.col("emp_count") != 0))


def _signed(plus: DataFrame, minus: DataFrame) -> DataFrame:
    return plus.unionByName(minus.select("dept_no", "salary", *[(-F.col(c)).alias(c) for c in _COUNTS]))


def statistics(state: DataFrame, t: Tables) -> DataFrame:
    """The columns of ``views.dept_stats`` from the state and ``departments``."""
    n, s = F.col("row_count"), F.col("salary")
    known = s.isNotNull()

    def total(term: Column) -> Column:
        return F.coalesce(F.sum(F.when(known, term)), F.lit(0))

    wide = s.cast("decimal(10,0)")
    agg = state.groupBy("dept_no").agg(
        F.sum("emp_count").alias("emp_count"),
        total(n).alias("_n"),
        total(s.cast("long") * n).alias("_sum"),
        total((wide * wide).cast("decimal(20,0)") * n.cast("decimal(18,0)")).cast("decimal(38,0)").alias("_squares"),
        F.min("salary").alias("min_salary"),
        F.max("salary").alias("max_salary"),
    )
    # n * sum of squares - square of the sum is exact, so nothing is lost between two near numbers.
    spread = F.col("_n").cast("decimal(18,0)") * F.col("_squares") - F.col("_sum").cast("decimal(19,0)") * F.col("_sum").cast("decimal(19,0)")
    var = spread.cast("double") / (F.col("_n") * (F.col("_n") - 1))
    return with_dept_name(t, agg).select(
        "dept_no", "dept_name", "emp_count", ratio("_sum", "_n", 4).alias("avg_salary"),
        "min_salary", "max_salary", F.when(F.col("_n") > 1, F.round(F.sqrt(var), 2)).alias("salary_stddev"),
    )


class MaintainedDeptStats:
    """``dept_stats`` kept beside its stored inputs."""

    def __init__(self, spark: SparkSession, base: str, buckets: int = 64, dept_buckets: int = 16) -> None:
        base = base.rstrip("/")
        # One number of buckets for all inputs: an employee has the same bucket in each.
        self.inputs = {name: BucketedTable(spark, f"{base}/{name}", ["emp_no"], buckets) for name in INPUTS}
        self.state = BucketedTable(spark, f"{base}/dept_stats", ["dept_no"], dept_buckets)

    def create(self, t: Tables) -> None:
        for name, table in self.inputs.items():
            table.create(t[name])
        versions = dict.fromkeys(INPUTS, 0)
        self.state.create(contributions(self._tables(versions)), batch=json.dumps(versions))

    def _tables(self, versions: dict[str, int], buckets: set[int] | None = None) -> Tables:
        return Tables({name: _reads(name, table.read(versions[name], buckets)) for name, table in self.inputs.items()})

    def stands_for(self) -> dict[str, int]:
        """The input versions that the newest state was made from."""
        return json.loads(self.state.batch_of(self.state.version()))

    def refresh(self) -> int:
        """Bring the state up to the newest inputs; the state's version."""
        was, now = self.stands_for(), {name: table.version() for name, table in self.inputs.items()}
        if was == now:
            return self.state.version()
        hit = {name: table.differing(was[name], now[name]) for name, table in self.inputs.items()}
        buckets = set().union(*hit.values())
        if not buckets:
            return self.state.add(_COUNTS, None, batch=json.dumps(now))
        changed = [self._changed(name, was, now, b) for name, b in hit.items() if b]
        employees = functools.reduce(DataFrame.unionByName, changed).distinct().checkpoint()
        before, after = (
            contributions(Tables({k: v.join(employees, "emp_no", "left_semi") for k, v in self._tables(versions, buckets).items()}))
            for versions in (was, now)
        )
        return self.state.add(_COUNTS, _summed(_signed(after, before)).checkpoint(), batch=json.dumps(now))

    def _changed(self, name: str, was: dict[str, int], now: dict[str, int], buckets: set[int]) -> DataFrame:
        """Employees whose relevant rows (with repeats) of one input differ."""
        table = self.inputs[name]
        old, new = (_reads(name, table.read(v[name], buckets)).withColumn("_w", F.lit(w)) for v, w in ((was, -1), (now, 1)))
        rest = [c for c in new.columns if c != "_w"]
        return new.unionByName(old).groupBy(*rest).agg(F.sum("_w").alias("_w")).filter("_w <> 0").select("emp_no")

    def read(self, t: Tables) -> DataFrame:
        """The report; ``t`` gives the names of the departments."""
        return statistics(self.state.read(), t)
