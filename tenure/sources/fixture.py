"""Derive the temporal HR tables from the driver's star-schema tables.

The derivation is a set of column formulas over ``customer``, ``nation``,
``orders``, ``supplier`` and ``events`` (FIXTURES.md section 2), so the HR
tables grow with the inputs and every step is a distributed Spark job:
projections, one ``explode`` of at most three stints per customer, one
partial aggregate and one neighbour-date step over ``orders`` (window or
skew-safe row index, chosen by a checked bound).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenure.functions.neighbors import with_adjacent_dates
from tenure.schema import AS_OF, BUDGET_TYPE, DEFAULT_BUDGET, OPEN_END
from tenure.sources.tables import Tables, read_table

# Fixed values of the fixture derivation (FIXTURES.md section 2).
FIRST_NAMES = ["Georgi", "John", "Mary", "Parto", "Karen", "Geoff", "Suzanne", "Marc", "Tzvetan", "Johnny"]
LAST_NAMES = [
    "Smith", "Johnson", "Mason", "Facello", "Simmel", "Blacksmith", "Peterson",
    "Koblick", "Zielinski", "Peac", "Sluis", "Anderson", "Adams",
]
FIRST_TITLES = ["Engineer", "Staff", "Assistant Engineer", "Technique Leader"]
EMP_NO_BASE = 10001
BIRTH_BASE = dt.date(1950, 1, 1)
HIRE_BASE = dt.date(1985, 1, 1)
LEAVE_DATE = dt.date(2001, 6, 30)
MANAGER_BASE = dt.date(1990, 1, 1)
N_DEPTS = 25
SALARY_FLOOR = 30000
SALARY_SPAN = 170001


def _plus_days(base, days: Column) -> Column:
    return F.date_add(F.lit(base) if isinstance(base, dt.date) else base, days.cast("int"))


def dept_no_of(index: Column) -> Column:
    """Department key 'd' + zero-padded (index + 1)."""
    return F.concat(F.lit("d"), F.lpad((index + 1).cast("string"), 3, "0"))


def employees(customer: DataFrame) -> DataFrame:
    k = F.col("c_custkey")
    return customer.select(
        (F.lit(EMP_NO_BASE) + k).cast("int").alias("emp_no"),
        _plus_days(BIRTH_BASE, (k * 37) % 7000).alias("birth_date"),
        F.element_at(F.array(*map(F.lit, FIRST_NAMES)), (k % 10 + 1).cast("int")).alias("first_name"),
        F.element_at(F.array(*map(F.lit, LAST_NAMES)), ((k / 10).cast("long") % 13 + 1).cast("int")).alias("last_name"),
        F.when((F.floor(k / 2) % 2) == 0, "M").otherwise("F").alias("gender"),
        _plus_days(HIRE_BASE, ((k * 53) % 500) * 10).alias("hire_date"),
    )


def departments(nation: DataFrame) -> DataFrame:
    return nation.select(
        dept_no_of(F.col("n_nationkey")).alias("dept_no"),
        F.col("n_name").alias("dept_name"),
        F.lit(DEFAULT_BUDGET).cast(BUDGET_TYPE).alias("manager_budget"),
    )


def dept_emp(customer: DataFrame, as_of: dt.date = AS_OF) -> DataFrame:
    k, nk = F.col("c_custkey"), F.col("c_nationkey")
    hire = _plus_days(HIRE_BASE, ((k * 53) % 500) * 10)
    b = F.date_add(hire, (600 + (k * 7) % 3000).cast("int"))
    b400 = F.date_add(b, 400)
    asof, end, leave = F.lit(as_of), F.lit(OPEN_END), F.lit(LEAVE_DATE)
    m1 = ((k % 3) != 0) & (b <= asof)
    m2 = ((k % 3) != 0) & ((k % 5) == 1) & (b400 <= asof)
    leaver = (k % 10) == 9
    stints = F.array(
        F.struct(nk.alias("x"), hire.alias("f"),
                 F.when(m1, b).when(leaver, leave).otherwise(end).alias("t"), F.lit(True).alias("keep")),
        F.struct(((nk + 1 + k % 4) % N_DEPTS).cast("int").alias("x"), b.alias("f"),
                 F.when(m2, b400).when(leaver & (b < leave), leave).otherwise(end).alias("t"), m1.alias("keep")),
        F.struct(((nk + 6) % N_DEPTS).cast("int").alias("x"), b400.alias("f"),
                 F.when(leaver & (b400 < leave), leave).otherwise(end).alias("t"), m2.alias("keep")),
    )
    s = customer.select((F.lit(EMP_NO_BASE) + k).cast("int").alias("emp_no"), F.explode(stints).alias("s"))
    return s.filter("s.keep").select(
        "emp_no", dept_no_of(F.col("s.x")).alias("dept_no"),
        F.col("s.f").alias("from_date"), F.col("s.t").alias("to_date"),
    )


def titles(customer: DataFrame, as_of: dt.date = AS_OF) -> DataFrame:
    k = F.col("c_custkey")
    hire = _plus_days(HIRE_BASE, ((k * 53) % 500) * 10)
    p = F.date_add(hire, (900 + (k * 11) % 2000).cast("int"))
    promoted = ((F.floor(k / 4) % 2) == 1) & ((k % 4) != 3) & (p <= F.lit(as_of))
    t0 = F.element_at(F.array(*map(F.lit, FIRST_TITLES)), (k % 4 + 1).cast("int"))
    rows = F.array(
        F.struct(t0.alias("title"), hire.alias("f"),
                 F.when(promoted, p).otherwise(F.lit(OPEN_END)).alias("t"), F.lit(True).alias("keep")),
        F.struct(F.when(t0 == "Staff", "Senior Staff").otherwise("Senior Engineer").alias("title"),
                 p.alias("f"), F.lit(OPEN_END).alias("t"), promoted.alias("keep")),
    )
    s = customer.select((F.lit(EMP_NO_BASE) + k).cast("int").alias("emp_no"), F.explode(rows).alias("s"))
    return s.filter("s.keep").select(
        "emp_no", F.col("s.title").alias("title"), F.col("s.f").alias("from_date"), F.col("s.t").alias("to_date"),
    )


def _salary_points(orders: DataFrame) -> DataFrame:
    """One salary value per (customer, order day): the price of the lowest order key.

    A partial aggregate (map-side combine), so a customer with many orders
    never concentrates raw rows in one task.
    """
    return (
        orders.select("o_custkey", "o_orderkey", "o_totalprice", F.to_date("o_orderdate").alias("from_date"))
        .groupBy("o_custkey", "from_date")
        .agg(F.min_by("o_totalprice", "o_orderkey").alias("price"))
        .select(
            (F.lit(EMP_NO_BASE) + F.col("o_custkey")).cast("int").alias("emp_no"),
            (F.lit(SALARY_FLOOR) + F.floor("price").cast("long") % SALARY_SPAN).cast("int").alias("salary"),
            "from_date",
            (F.col("o_custkey") % 4 + 1).cast("int").alias("n_open"),
        )
    )


def salaries(orders: DataFrame) -> DataFrame:
    """Each salary runs until the customer's next order day (open if none)."""
    pts = with_adjacent_dates(_salary_points(orders), "emp_no", "from_date")
    return pts.select("emp_no", "salary", "from_date", F.coalesce("next_date", F.lit(OPEN_END)).alias("to_date"))


def salaries_multi(orders: DataFrame) -> DataFrame:
    """Variant with 1 + k % 4 open rows per employee (the loader's multi-current shape)."""
    pts = with_adjacent_dates(_salary_points(orders), "emp_no", "from_date")
    return pts.select(
        "emp_no", "salary", "from_date",
        F.when(F.col("pos_from_end") <= F.col("n_open"), F.lit(OPEN_END))
        .otherwise(F.coalesce("next_date", F.lit(OPEN_END))).alias("to_date"),
    )


def dept_manager(supplier: DataFrame) -> DataFrame:
    s = F.col("s_suppkey")
    return supplier.select(
        dept_no_of(F.col("s_nationkey")).alias("dept_no"),
        (F.lit(EMP_NO_BASE) + 7 * s).cast("int").alias("emp_no"),
        _plus_days(MANAGER_BASE, 91 * s).alias("from_date"),
        F.lit(OPEN_END).alias("to_date"),
    )


def request_events(events: DataFrame) -> DataFrame:
    """Request telemetry view of ``events`` (NTZ time cast to session-zone timestamp)."""
    ok = F.col("event_type") != "error"
    return events.select(
        "event_id",
        F.col("event_type").alias("queryType"),
        F.col("value").alias("duration"),
        ok.alias("success"),
        F.when(ok, 200).otherwise(500).alias("statusCode"),
        F.lit(50).alias("virtualUsers"),
        "user_id",
        F.col("ts").cast("timestamp").alias("ts"),
        "props",
    )


def hr_tables(spark: SparkSession, sf_dir: str, as_of: dt.date = AS_OF) -> Tables:
    """All HR tables as lazy DataFrames derived from the driver tables under ``sf_dir``."""
    customer = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    return Tables({
        "employees": employees(customer),
        "departments": departments(read_table(spark, sf_dir, "nation")),
        "dept_emp": dept_emp(customer, as_of),
        "titles": titles(customer, as_of),
        "salaries": salaries(orders),
        "salaries_multi": salaries_multi(orders),
        "dept_manager": dept_manager(read_table(spark, sf_dir, "supplier")),
        "request_events": request_events(read_table(spark, sf_dir, "events")),
    })
