"""Schema constants and table schemas of the temporal HR model.

Every HR row carries a validity interval ``[from_date, to_date)``; the open
end is a sentinel date.  Reports take an explicit ``as_of`` date instead of
reading the wall clock, so results are reproducible.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import types as T

# Fixed values that must match the source workload.
OPEN_END = dt.date(9999, 1, 1)  # open end of a validity interval
AS_OF = dt.date(2001, 8, 1)  # default "today" of every report
DEFAULT_BUDGET = "100000.00"  # departments.manager_budget default
SALARY_ERA_BOUNDARY = dt.date(2020, 1, 1)  # salaries range partitions: < and >= this date

BUDGET_TYPE = T.DecimalType(15, 2)

EMPLOYEES = T.StructType([
    T.StructField("emp_no", T.IntegerType(), False),
    T.StructField("birth_date", T.DateType(), False),
    T.StructField("first_name", T.StringType(), False),
    T.StructField("last_name", T.StringType(), False),
    T.StructField("gender", T.StringType(), True),
    T.StructField("hire_date", T.DateType(), False),
])

DEPARTMENTS = T.StructType([
    T.StructField("dept_no", T.StringType(), False),
    T.StructField("dept_name", T.StringType(), False),
    T.StructField("manager_budget", BUDGET_TYPE, True),
])

DEPT_EMP = T.StructType([
    T.StructField("emp_no", T.IntegerType(), False),
    T.StructField("dept_no", T.StringType(), False),
    T.StructField("from_date", T.DateType(), False),
    T.StructField("to_date", T.DateType(), False),
])

SALARIES = T.StructType([
    T.StructField("emp_no", T.IntegerType(), False),
    T.StructField("salary", T.IntegerType(), False),
    T.StructField("from_date", T.DateType(), False),
    T.StructField("to_date", T.DateType(), False),
])

TITLES = T.StructType([
    T.StructField("emp_no", T.IntegerType(), False),
    T.StructField("title", T.StringType(), False),
    T.StructField("from_date", T.DateType(), False),
    T.StructField("to_date", T.DateType(), True),
])

DEPT_MANAGER = T.StructType([
    T.StructField("dept_no", T.StringType(), False),
    T.StructField("emp_no", T.IntegerType(), False),
    T.StructField("from_date", T.DateType(), False),
    T.StructField("to_date", T.DateType(), True),
])

REQUEST_EVENTS = T.StructType([
    T.StructField("event_id", T.LongType(), True),
    T.StructField("queryType", T.StringType(), True),
    T.StructField("duration", T.DoubleType(), True),
    T.StructField("success", T.BooleanType(), True),
    T.StructField("statusCode", T.IntegerType(), True),
    T.StructField("virtualUsers", T.IntegerType(), True),
    T.StructField("user_id", T.LongType(), True),
    T.StructField("ts", T.TimestampType(), True),
])

MAINTENANCE_LOG = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("operation", T.StringType(), False),
    T.StructField("start_time", T.TimestampType(), False),
    T.StructField("end_time", T.TimestampType(), True),
    T.StructField("success", T.BooleanType(), True),
])

# Declared keys, references, non-null columns and domains (data-quality input).
PRIMARY_KEYS = {
    "employees": ["emp_no"],
    "departments": ["dept_no"],
    "dept_emp": ["emp_no", "dept_no"],
    "salaries": ["emp_no", "from_date"],
    "titles": ["emp_no", "title", "from_date"],
    "dept_manager": ["dept_no", "emp_no"],
}
UNIQUE_KEYS = {"departments": [["dept_name"]]}
FOREIGN_KEYS = {
    "dept_emp": [("emp_no", "employees", "emp_no"), ("dept_no", "departments", "dept_no")],
    "salaries": [("emp_no", "employees", "emp_no")],
    "titles": [("emp_no", "employees", "emp_no")],
    "dept_manager": [("emp_no", "employees", "emp_no"), ("dept_no", "departments", "dept_no")],
}
NOT_NULL = {
    "employees": ["emp_no", "birth_date", "first_name", "last_name", "hire_date"],
    "departments": ["dept_no", "dept_name"],
    "dept_emp": ["emp_no", "dept_no", "from_date", "to_date"],
    "salaries": ["emp_no", "salary", "from_date", "to_date"],
}
DOMAINS = {"employees": {"gender": ["M", "F"]}}
