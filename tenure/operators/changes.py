"""Table changes on validity-interval tables, as new table versions.

Parquet tables are immutable, so each change is a pure function from the
current table(s) to a new version of one table: rows to close get
``to_date = as_of`` and new open rows are appended. Affected keys are marked
with a left semi / equi join against a distinct key set, so one pass over
the table does the work of the source's per-row UPDATE/INSERT statements.
The caller writes the result to a new path and switches readers to it.

Each change is first a plan of *tracked* rows: ``old`` and ``new`` (structs of the table's columns; a row that is
opened has no ``old``) and ``touched``. The new table version is all ``new`` rows; ``changed_rows`` are the
touched ones, for which only the marked rows are joined (the outer join becomes an inner one).
``CHANGES`` names both forms of each change; ``tenure.sources.versions`` applies changed rows to a stored
table and rewrites only the buckets they fall in.
"""

from __future__ import annotations

import datetime as dt
import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenure.functions.dialect import is_open, scale_decimal, scale_to_int
from tenure.operators.current import current
from tenure.plans.sizing import dim, dim_agg
from tenure.schema import AS_OF, OPEN_END
from tenure.sources.tables import Tables

_HIT = "__close"


def _row(cols: list[str]) -> Column:
    return F.struct(*cols)


def _tracked(df: DataFrame, cols: list[str], touched: Column, **new: Column) -> DataFrame:
    """``df`` as tracked rows of ``cols``; where ``touched``, the columns in ``new`` get those values.

    Rows that have these values already are not touched.
    """
    touched = touched & functools.reduce(Column.__or__, [~F.col(c).eqNullSafe(v) for c, v in new.items()])
    changed = F.struct(*[F.when(touched, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in cols])
    return df.select(_row(cols).alias("old"), changed.alias("new"), touched.alias("touched"))


def _opened(tracked: DataFrame, rows: DataFrame) -> DataFrame:
    """``tracked`` and rows that were not there before."""
    kind = tracked.schema["new"].dataType
    new = F.struct(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in kind])
    made = rows.select(F.lit(None).cast(kind).alias("old"), new.alias("new"), F.lit(True).alias("touched"))
    return tracked.unionByName(made)


def new_version(tracked: DataFrame) -> DataFrame:
    """The whole new table."""
    return tracked.select("new.*")


def changed_rows(tracked: DataFrame) -> DataFrame:
    """The rows that a change touched: kind (update, insert), old_<column> (null for an insert), new_<column>."""
    hit = tracked.filter(F.col("touched"))
    cols = tracked.schema["new"].dataType.fieldNames()
    return hit.select(
        F.when(F.col("old").isNull(), "insert").otherwise("update").alias("kind"),
        *[F.col(f"{side}.{c}").alias(f"{side}_{c}") for side in ("old", "new") for c in cols],
    )


def _marked(table: DataFrame, keys: list[str], close: DataFrame, as_of: dt.date, open_end: dt.date = OPEN_END, also: Column | None = None) -> DataFrame:
    """``table`` as tracked rows: the open ones whose ``keys`` appear in ``close`` end at ``as_of``."""
    marks = close.select(*keys).distinct().withColumn(_HIT, F.lit(True))
    hit = F.coalesce(F.col(_HIT), F.lit(False)) & F.coalesce(is_open("to_date", open_end), F.lit(False))
    if also is not None:
        hit = hit & F.coalesce(also, F.lit(False))
    return _tracked(table.join(marks, keys, "left"), table.columns, hit, to_date=F.lit(as_of))


def scd2_close_open(
    table: DataFrame,
    keys: list[str],
    close: DataFrame,
    opened: DataFrame | None,
    as_of: dt.date = AS_OF,
    open_end: dt.date = OPEN_END,
    also: Column | None = None,
) -> DataFrame:
    """Close the open rows of ``table`` whose ``keys`` appear in ``close``; append ``opened``.

    ``also`` restricts which open rows of a marked key are closed (e.g. one
    title). Marks are de-duplicated first, so a key listed twice never fans
    the table out.
    """
    tracked = _marked(table, keys, close, as_of, open_end, also)
    return new_version(tracked if opened is None else _opened(tracked, opened))


def table_change(plan: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A change from its plan of tracked rows: called, it gives the new table; ``.changes`` gives the changed rows."""

    @functools.wraps(plan)
    def run(*args, **options) -> DataFrame:
        return new_version(plan(*args, **options))

    run.changes = lambda *args, **options: changed_rows(plan(*args, **options))
    return run


def _members(t: Tables, dept_no: str) -> DataFrame:
    return current(t, "dept_emp", ["emp_no", "dept_no"]).filter(F.col("dept_no") == dept_no).select("emp_no")


@table_change
def bulk_title_update(
    t: Tables, as_of: dt.date = AS_OF, dept_no: str = "d005", old_title: str = "Engineer",
    new_title: str = "Senior Engineer",
) -> DataFrame:
    """New ``titles``: current members of a department lose their open ``old_title`` and gain ``new_title``.

    Step two of the source re-selects every title row that ends on
    ``as_of`` (also ones that ended there before), joined with the current
    department rows; that is kept.
    """
    titles = t["titles"].select("emp_no", "title", "from_date", "to_date")
    step1 = _marked(titles, ["emp_no"], _members(t, dept_no), as_of, also=F.col("title") == old_title)
    de = current(t, "dept_emp", ["emp_no", "dept_no"]).filter(F.col("dept_no") == dept_no).select("emp_no")
    opened = new_version(step1).filter(F.col("to_date") == F.lit(as_of)).select("emp_no").join(de, "emp_no").select(
        "emp_no", F.lit(new_title).alias("title"), F.lit(as_of).alias("from_date"), F.lit(OPEN_END).alias("to_date"),
    )
    return _opened(step1, opened)


@table_change
def salary_adjust(t: Tables, as_of: dt.date = AS_OF, dept_no: str = "d005", factor: str = "1.1") -> DataFrame:
    """New ``salaries``: everyone ever assigned to a department gets open salaries closed and re-opened raised.

    The source joins all assignment rows (no current filter), so past members
    are raised too; the raise is an exact decimal product rounded half up into
    an integer.
    """
    s = t["salaries"].select("emp_no", "salary", "from_date", "to_date")
    ever = t["dept_emp"].filter(F.col("dept_no") == dept_no).select("emp_no")
    step1 = _marked(s, ["emp_no"], ever, as_of)
    opened = new_version(step1).filter(F.col("to_date") == F.lit(as_of)).join(ever, "emp_no").select(
        "emp_no", scale_to_int("salary", factor).alias("salary"), F.lit(as_of).alias("from_date"),
        F.lit(OPEN_END).alias("to_date"),
    )
    return _opened(step1, opened)


def transfer_candidates(t: Tables, from_dept: str = "d005", to_dept: str = "d001", n: int = 100) -> DataFrame:
    """Up to ``n`` current members of ``from_dept`` not currently in ``to_dept`` (smallest emp_no first)."""
    cur = current(t, "dept_emp", ["emp_no", "dept_no"])
    movers = cur.filter(F.col("dept_no") == from_dept).join(
        cur.filter(F.col("dept_no") == to_dept), "emp_no", "left_anti"
    )
    return movers.select("emp_no").distinct().orderBy("emp_no").limit(n)


@table_change
def transfer(
    t: Tables, as_of: dt.date = AS_OF, from_dept: str = "d005", to_dept: str = "d001", n: int = 100,
) -> DataFrame:
    """New ``dept_emp``: movers close every open assignment and open one in ``to_dept``.

    One set-based pass instead of 1 + 2n statements. A candidate who held ``to_dept`` before
    would repeat the key (emp_no, dept_no): the source's insert fails there, here the candidate is
    left as is and reported by ``transfer_conflicts``.
    """
    de = t["dept_emp"].select("emp_no", "dept_no", "from_date", "to_date")
    held = de.filter(F.col("dept_no") == to_dept).select("emp_no")
    movers = transfer_candidates(t, from_dept, to_dept, n).join(held, "emp_no", "left_anti")
    opened = movers.select(
        "emp_no", F.lit(to_dept).alias("dept_no"), F.lit(as_of).alias("from_date"), F.lit(OPEN_END).alias("to_date"),
    )
    return _opened(_marked(de, ["emp_no"], movers, as_of), opened)


def transfer_conflicts(t: Tables, from_dept: str = "d005", to_dept: str = "d001", n: int = 100) -> DataFrame:
    """Movers that already hold a (closed) row in ``to_dept``: the key the insert would repeat."""
    past = t["dept_emp"].filter(F.col("dept_no") == to_dept).select("emp_no", "dept_no", "from_date", "to_date")
    return past.join(transfer_candidates(t, from_dept, to_dept, n), "emp_no", "left_semi")


def seeded_hash(key: str, seed: int) -> Column:
    """MD5 of ``seed:key`` as hex text: even and reproducible in any engine."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def pick_seeded(df: DataFrame, key: str, seed: int) -> DataFrame:
    """The row whose MD5 of ``seed:key`` is smallest: a reproducible random pick (top-1, no sort)."""
    return df.withColumn("_h", seeded_hash(key, seed)).orderBy("_h", key).limit(1).drop("_h")


@table_change
def update_salary(
    t: Tables, as_of: dt.date = AS_OF, updates: DataFrame | None = None, emp_no: int | None = 10001,
    salary: int | None = 88888, seed: int = 42,
) -> DataFrame:
    """New ``salaries``: close the open salaries of each updated employee and open the given salary.

    ``updates`` is a DataFrame (emp_no, salary) for batch changes. Without it,
    one (emp_no, salary) is used; a missing emp_no is a seeded pick and a
    missing salary a seeded raise below 20% of the latest open salary.
    """
    s = t["salaries"].select("emp_no", "salary", "from_date", "to_date")
    if updates is None:
        emp = t["employees"].select("emp_no")
        emp = pick_seeded(emp, "emp_no", seed) if emp_no is None else emp.filter(F.col("emp_no") == emp_no)
        if salary is None:
            u = F.conv(F.substring(seeded_hash("emp_no", seed + 1), 1, 8), 16, 10).cast("long") / F.lit(float(2**32))
            cur = current(t, "salaries", ["emp_no", "salary", "from_date"]).join(emp, "emp_no")
            latest = cur.groupBy("emp_no").agg(F.max_by("salary", "from_date").alias("cur"))
            updates = latest.select("emp_no", F.floor(F.col("cur") * (1 + u * 0.2)).cast("int").alias("salary"))
        else:
            updates = emp.select("emp_no", F.lit(int(salary)).alias("salary"))
    # One update an employee (the largest salary given), and none for ids without an employee.
    updates = updates.select(F.col("emp_no").cast("int"), F.col("salary").cast("int")).groupBy("emp_no").agg(F.max("salary").alias("salary"))
    updates = updates.join(t["employees"].select("emp_no"), "emp_no", "left_semi")
    opened = updates.select("emp_no", "salary", F.lit(as_of).alias("from_date"), F.lit(OPEN_END).alias("to_date"))
    return _opened(_marked(s, ["emp_no"], updates, as_of), opened)


@table_change
def append_suffix(t: Tables, as_of: dt.date = AS_OF, suffix: str = "-updated", n: int = 100) -> DataFrame:
    """New ``employees``: the first ``n`` employees by emp_no get ``suffix`` on their last name."""
    e = t["employees"]
    first = e.select("emp_no").orderBy("emp_no").limit(n).withColumn(_HIT, F.lit(True))
    j = e.join(first, "emp_no", "left")
    return _tracked(j, e.columns, F.coalesce(F.col(_HIT), F.lit(False)), last_name=F.concat("last_name", F.lit(suffix)))


@table_change
def dept_budget_raise(
    t: Tables, as_of: dt.date = AS_OF, genders: tuple[str, ...] = ("M", "F", "M", "F", "M"), years: int = 20,
    factor: str = "1.1",
) -> DataFrame:
    """New ``departments``: one pass per gender; a department with an assignment of an employee of that
    gender hired in the last ``years`` gets ``manager_budget`` x factor (decimal(15,2), half up) per pass.

    The qualifying set of each gender is computed once (aggregate per
    department); the passes fold into one chained projection.
    """
    recent = t["employees"].filter(F.col("hire_date") >= F.add_months(F.lit(as_of), -12 * years))
    rows = t["dept_emp"].select("emp_no", "dept_no").join(recent.select("emp_no", "gender"), "emp_no")
    flags = rows.groupBy("dept_no").agg(*[
        F.max(F.when(F.col("gender") == g, 1).otherwise(0)).alias(f"g_{g}") for g in sorted(set(genders))
    ])
    cols = ["dept_no", "dept_name", "manager_budget"]
    d = t["departments"].select(*cols, _row(cols).alias("old")).join(dim_agg(t, "departments", flags, "dept_no"), "dept_no", "left")
    # One projection per pass: each pass reads the previous pass's column, so
    # the expression stays linear in the number of passes.
    for g in genders:
        hit = F.coalesce(F.col(f"g_{g}"), F.lit(0)) == 1
        d = d.withColumn("manager_budget", F.when(hit, scale_decimal("manager_budget", factor, 2))
                         .otherwise(F.col("manager_budget")).cast("decimal(15,2)"))
    touched = ~F.col("manager_budget").eqNullSafe(F.col("old.manager_budget"))
    return d.select("old", _row(cols).alias("new"), touched.alias("touched"))


@table_change
def bracket_raise(
    t: Tables, as_of: dt.date = AS_OF, passes: int = 10, base: int = 40000, step: int = 10000, width: int = 20000,
    factor: str = "1.1",
) -> DataFrame:
    """New ``salaries``: pass i raises rows of employees of gender M (even i) / F (odd i) with salary in
    [base + i*step, base + i*step + width]; passes apply in index order.
    """
    s = t["salaries"].select("emp_no", "salary", "from_date", "to_date")
    cols, touched = s.columns, F.lit(False)
    j = s.withColumn("old", _row(cols)).join(t["employees"].select("emp_no", "gender"), "emp_no", "left")
    for i in range(passes):
        g = "M" if i % 2 == 0 else "F"
        lo = base + i * step
        hit = (F.col("gender") == g) & F.col("salary").between(lo, lo + width)
        # The first raise is of the salary as it was: a row is touched if that is in any pass's bracket.
        touched = touched | F.coalesce((F.col("gender") == g) & F.col("old.salary").between(lo, lo + width), F.lit(False))
        j = j.withColumn("salary", F.when(hit, scale_to_int("salary", factor)).otherwise(F.col("salary")))
    return j.select("old", _row(cols).alias("new"), touched.alias("touched"))


@table_change
def touch_last_modified(t: Tables, as_of: dt.date = AS_OF) -> DataFrame:
    """New ``employees`` with ``last_modified`` = as_of for everyone holding an assignment to a known department."""
    e = t["employees"]
    if "last_modified" not in e.columns:
        e = e.withColumn("last_modified", F.lit(None).cast("timestamp_ntz"))
    de = t["dept_emp"].select("emp_no", "dept_no").join(
        dim(t, "departments", t["departments"].select("dept_no")), "dept_no", "left_semi"
    )
    hit = de.select("emp_no").distinct().withColumn(_HIT, F.lit(True))
    stamp = F.lit(as_of).cast("timestamp_ntz")
    return _tracked(e.join(hit, "emp_no", "left"), e.columns, F.coalesce(F.col(_HIT), F.lit(False)), last_modified=stamp)


# The entry that chg_log_maintenance adds: start, end, success.
MAINTENANCE = (dt.datetime(2001, 8, 1, 2), dt.datetime(2001, 8, 1, 2, 45, 30), True)
CHANGES = {  # name: (change, the table it changes)
    "bulk_title_update": (bulk_title_update, "titles"),
    "salary_adjust": (salary_adjust, "salaries"),
    "transfer": (transfer, "dept_emp"),
    "update_salary": (update_salary, "salaries"),
    "append_suffix": (append_suffix, "employees"),
    "dept_budget_raise": (dept_budget_raise, "departments"),
    "bracket_raise": (bracket_raise, "salaries"),
    "touch_last_modified": (touch_last_modified, "employees"),
}


def maintenance_log(t: Tables) -> DataFrame:
    """A maintenance log of the given events: one entry for each signup, as long as its request took."""
    ev = t["request_events"].filter(F.col("queryType") == "signup")
    took = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.round(F.col("duration")) / 1000).cast("decimal(18,6)"))
    return ev.select(F.col("event_id").alias("id"), F.col("queryType").alias("operation"), F.col("ts").alias("start_time"), (F.col("ts") + took).alias("end_time"), "success")


def log_maintenance(
    log: DataFrame, operation: str, start_time: dt.datetime, end_time: dt.datetime | None = None,
    success: bool = False,
) -> DataFrame:
    """New ``maintenance_log`` with one appended entry (id = max id + 1) and derived ``duration``."""
    spark = log.sparkSession
    nxt = log.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).cast("long").alias("id"))  # one row
    row = spark.createDataFrame(
        [(operation, start_time, end_time, success)],
        "operation string, start_time timestamp, end_time timestamp, success boolean",
    )
    cols = ["id", "operation", "start_time", "end_time", "success"]
    out = log.select(*cols).unionByName(F.broadcast(nxt).crossJoin(row).select(*cols))
    return out.withColumn("duration", F.col("end_time") - F.col("start_time"))


def maintenance_log_after(t: Tables) -> DataFrame:
    """``maintenance_log`` with one more entry (``MAINTENANCE``); wall-clock times, ``duration`` in seconds."""
    log = log_maintenance(maintenance_log(t), "VACUUM", *MAINTENANCE)
    times = [F.col(c).cast("timestamp_ntz").alias(c) for c in ("start_time", "end_time")]
    seconds = (F.unix_micros("end_time") - F.unix_micros("start_time")) / F.lit(1e6)
    return log.select("id", "operation", *times, "success", seconds.alias("duration"))
