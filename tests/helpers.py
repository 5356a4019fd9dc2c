"""Tiny hand-made HR tables for edge cases."""

from __future__ import annotations

import datetime as dt

from tenure import schema as S
from tenure.sources.tables import Tables

D = dt.date
END = S.OPEN_END


def make_tables(spark, employees=(), departments=(), dept_emp=(), salaries=(), titles=(), dept_manager=()):
    return Tables({
        "employees": spark.createDataFrame(list(employees), S.EMPLOYEES),
        "departments": spark.createDataFrame(
            [(d, n, None) for d, n in departments] if departments and len(departments[0]) == 2 else list(departments),
            S.DEPARTMENTS),
        "dept_emp": spark.createDataFrame(list(dept_emp), S.DEPT_EMP),
        "salaries": spark.createDataFrame(list(salaries), S.SALARIES),
        "titles": spark.createDataFrame(list(titles), S.TITLES),
        "dept_manager": spark.createDataFrame(list(dept_manager), S.DEPT_MANAGER),
    })


def emp(no, first="Ann", last="Lee", gender="F", hire=D(1990, 1, 1), birth=D(1960, 1, 1)):
    return (no, birth, first, last, gender, hire)
