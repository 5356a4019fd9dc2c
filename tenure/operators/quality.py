"""Data-quality checks from the declared constraints (keys, references, NOT NULL, CHECK, defaults).

Each check is one distributed pass: grouping by the key (partial aggregation),
a left anti join against the referenced key set, or conditional counts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenure.plans.sizing import dim
from tenure.schema import DOMAINS, FOREIGN_KEYS, NOT_NULL, PRIMARY_KEYS, UNIQUE_KEYS
from tenure.sources.tables import Tables


def _key_text(cols: list[str]) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("NULL")) for c in cols])


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key values held by more than one row, with their row count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def orphans(child: DataFrame, cols: list[str], parent: DataFrame, parent_cols: list[str]) -> DataFrame:
    """Child rows whose reference has no parent row (NULL references are not checked, as in SQL)."""
    p = parent.select(*[F.col(pc).alias(c) for pc, c in zip(parent_cols, cols)]).distinct()
    c = child
    for col in cols:
        c = c.filter(F.col(col).isNotNull())
    return c.join(p, cols, "left_anti")


def null_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row per column: how many rows are NULL there (one pass over the table)."""
    agg = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return agg.unpivot([], cols, "column_name", "null_count")


def domain_violations(df: DataFrame, col: str, allowed: list[str]) -> DataFrame:
    """Rows outside a CHECK ... IN (...) domain; NULL passes the check as in SQL."""
    return df.filter(F.col(col).isNotNull() & ~F.col(col).isin(allowed))


def with_defaults(df: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Column defaults applied at load: missing columns are added, NULLs replaced."""
    for c, v in defaults.items():
        df = df.withColumn(c, F.coalesce(F.col(c), v) if c in df.columns else v)
    return df


def employees_with_defaults(t: Tables, loaded_at=None) -> DataFrame:
    """Employees as loaded: generated ``name_upper`` = UPPER(last_name), ``last_modified`` defaulting to the load time."""
    import datetime as dt

    from tenure.schema import AS_OF

    stamp = F.lit(loaded_at or dt.datetime.combine(AS_OF, dt.time())).cast("timestamp_ntz")
    e = t["employees"]
    if "last_modified" not in e.columns:
        e = e.withColumn("last_modified", F.lit(None).cast("timestamp_ntz"))
    e = with_defaults(e, {"last_modified": stamp})
    return e.withColumn("name_upper", F.upper("last_name"))


def dq_duplicate_keys(t: Tables) -> DataFrame:
    """Primary-key and unique-key violations of all keyed tables."""
    parts = []
    for name, keys in PRIMARY_KEYS.items():
        if name in t:
            parts.append(duplicate_keys(t[name], keys).select(
                F.lit(name).alias("table_name"), F.lit(",".join(keys)).alias("key_columns"),
                _key_text(keys).alias("key_value"), "n"))
    for name, groups in UNIQUE_KEYS.items():
        for keys in groups:
            # UNIQUE lets rows with a NULL in the key repeat, as in SQL.
            parts.append(duplicate_keys(t[name].dropna(subset=keys), keys).select(
                F.lit(name).alias("table_name"), F.lit(",".join(keys)).alias("key_columns"),
                _key_text(keys).alias("key_value"), "n"))
    return reduce(DataFrame.unionByName, parts)


def dq_foreign_key_orphans(t: Tables) -> DataFrame:
    """Rows whose declared reference is missing, per (table, column).

    References to the same parent key are checked together: the tagged child
    keys are unioned and meet the parent's keys in one anti join (one shuffle
    of the parent instead of one per child table). A parent that is proven small is broadcast: children with few,
    crowded keys (``dept_no``) are then not shuffled by them.
    """
    by_parent: dict[tuple[str, str], list[tuple[str, str]]] = {}
    for name, fks in FOREIGN_KEYS.items():
        for col, parent, pcol in fks:
            by_parent.setdefault((parent, pcol), []).append((name, col))
    parts = []
    for (parent, pcol), children in by_parent.items():
        keys = reduce(DataFrame.unionByName, [
            t[name].filter(F.col(col).isNotNull()).select(
                F.lit(name).alias("table_name"), F.lit(col).alias("column_name"), F.col(col).alias("_k"))
            for name, col in children
        ])
        parent_keys = t[parent].select(F.col(pcol).alias("_k")).distinct()
        o = keys.join(dim(t, parent, parent_keys), "_k", "left_anti")
        parts.append(o.select("table_name", "column_name", F.lit(parent).alias("parent_table"),
                              F.col("_k").cast("string").alias("key_value")))
    return reduce(DataFrame.unionByName, parts)


def dq_not_null(t: Tables) -> DataFrame:
    """NULL counts of every NOT NULL column."""
    parts = [
        null_counts(t[name], cols).select(F.lit(name).alias("table_name"), "column_name", "null_count")
        for name, cols in NOT_NULL.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def dq_domain_violations(t: Tables) -> DataFrame:
    """Rows violating CHECK domains, as (table, column, value, rows)."""
    parts = []
    for name, doms in DOMAINS.items():
        for col, allowed in doms.items():
            v = domain_violations(t[name], col, allowed)
            parts.append(v.groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n")).select(
                F.lit(name).alias("table_name"), F.lit(col).alias("column_name"), "value", "n"))
    return reduce(DataFrame.unionByName, parts)


def dq_table_counts(t: Tables, names: list[str] | None = None) -> DataFrame:
    """Row count per table (load verification), as one union of global counts."""
    names = names or ["employees", "departments", "dept_emp", "salaries", "titles", "dept_manager"]
    return reduce(DataFrame.unionByName, [
        t[n].agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(n).alias("table_name"), "row_count") for n in names
    ])


def dq_interval_overlaps(t: Tables, name: str, key: str = "emp_no") -> DataFrame:
    """Rows whose validity interval overlaps another row of the same key (after a change, none should).

    A row overlaps when the key's next distinct start date falls before its end, when another
    row starts on the same day, or when a row that started earlier ends after its start. The
    dates are reduced to one row per (key, start) first.
    """
    df = t[name]
    days = df.groupBy(key, "from_date").agg((F.count(F.lit(1)) > 1).alias("_same_day"), F.max("to_date").alias("_end"))
    w = Window.partitionBy(key).orderBy("from_date")
    days = days.select(
        key, "from_date", "_same_day", F.lead("from_date").over(w).alias("_next"),
        F.max("_end").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("_open_until"))
    hit = F.col("_same_day") | (F.col("_next") < F.col("to_date")) | (F.col("_open_until") > F.col("from_date"))
    return df.join(days, [key, "from_date"]).filter(hit).select(*df.columns)


def with_planted_violations(t: Tables) -> Tables:
    """The tables with violations of each declared constraint, so that the checks have something to find.

    Repeated employees (emp_no divisible by 7), an unknown gender (by 11), assignments to an unknown
    department (by 13) and a department whose name another one has.
    """
    e, de, d = t["employees"], t["dept_emp"], t["departments"]
    e = e.unionByName(e.filter("emp_no % 7 = 0"))
    e = e.withColumn("gender", F.when(F.col("emp_no") % 11 == 0, "X").otherwise(F.col("gender")))
    de = de.withColumn("dept_no", F.when(F.col("emp_no") % 13 == 0, "d999").otherwise(F.col("dept_no")))
    d = d.unionByName(d.filter("dept_no = 'd003'").withColumn("dept_no", F.lit("x003")))
    return t.with_tables(employees=e, dept_emp=de, departments=d)
