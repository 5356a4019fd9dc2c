"""Department statistics refreshed from changed buckets against the statistics computed anew."""

from __future__ import annotations

import pytest
from helpers import D, END, emp, make_tables

from tenure.operators import changes
from tenure.operators.views import dept_stats
from tenure.session import scratch_path
from tenure.sources.maintained import INPUTS, MaintainedDeptStats


def _sorted(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def _now(view, t):
    return t.with_tables(**{name: table.read() for name, table in view.inputs.items()})


@pytest.fixture(scope="module")
def small(spark):
    return make_tables(
        spark,
        employees=[emp(i) for i in range(1, 41)],
        departments=[("d001", "Sales"), ("d002", "Research"), ("d005", "Development"), ("d009", "Empty")],
        dept_emp=[(i, "d005" if i % 2 else "d002", D(1990, 1, 1), END) for i in range(1, 41)]
        + [(3, "d001", D(1991, 1, 1), D(1992, 1, 1)), (5, "d002", D(1991, 1, 1), END), (99, "d001", D(1990, 1, 1), END)],
        salaries=[(i, 40000 + 700 * i, D(1990, 1, 1), END) for i in range(1, 41)]
        + [(7, 1, D(1980, 1, 1), D(1990, 1, 1)), (9, 50000, D(1995, 1, 1), END), (9, 50000, D(1996, 1, 1), END), (99, 7, D(1990, 1, 1), END)],
        titles=[(i, "Engineer", D(1990, 1, 1), END) for i in range(1, 41)],
    )


def test_refresh_after_each_change_equals_computing_anew(spark, small):
    view = MaintainedDeptStats(spark, scratch_path(spark, "maintained"), buckets=4, dept_buckets=4)
    view.create(small)
    assert _sorted(view.read(small)) == _sorted(dept_stats(small))
    t, states = small, set()
    for name, (change, table) in sorted(changes.CHANGES.items()):
        if name == "touch_last_modified":  # adds a column, which the stored table has not
            continue
        if table in INPUTS:
            view.inputs[table].apply(change.changes(t), batch=name)
            t = _now(view, t)
        else:
            t = t.with_tables(**{table: change(t)})
        states.add(view.refresh())
        assert _sorted(view.read(t)) == _sorted(dept_stats(t)), name
    assert states == {1, 2, 3, 4, 5}  # titles and departments are no inputs
    assert view.refresh() == 5  # nothing new


def test_only_touched_departments_are_rewritten(spark, small):
    view = MaintainedDeptStats(spark, scratch_path(spark, "maintained"), buckets=8, dept_buckets=64)
    view.create(small)
    before = set(view.state.read().inputFiles())
    one = spark.createDataFrame([(2, 90000)], "emp_no int, salary int")  # employee 2 is in d002 only
    view.inputs["salaries"].apply(changes.update_salary.changes(small, updates=one))
    view.refresh()
    after = set(view.state.read().inputFiles())
    bucket = spark.createDataFrame([("d002",)], "dept_no string").select(view.state.bucket_of()).first()[0]
    assert before & after and all(f"/bucket={bucket}/" in f for f in before ^ after)
    assert len(view.inputs["salaries"].differing(0, 1)) == 1  # one bucket of each input is read
    closed = spark.createDataFrame([(4, "d002", D(1990, 1, 1), END, 4, "d002", D(1990, 1, 1), D(2001, 8, 1))], (
        "old_emp_no int, old_dept_no string, old_from_date date, old_to_date date, "
        "new_emp_no int, new_dept_no string, new_from_date date, new_to_date date")).selectExpr("'update' as kind", "*")
    view.inputs["dept_emp"].apply(closed)
    view.refresh()  # the statistics do not read the end of an assignment
    assert set(view.state.read().inputFiles()) == after and view.stands_for()["dept_emp"] == 1


def test_lost_refreshes_are_made_up_and_extremes_go_back(spark, small):
    view = MaintainedDeptStats(spark, scratch_path(spark, "maintained"), buckets=8)
    view.create(small)
    salaries, cols = view.inputs["salaries"], ["emp_no", "salary", "from_date", "to_date"]

    def apply(kind, rows):
        side = "old" if kind == "delete" else "new"
        other = "new" if kind == "delete" else "old"
        df = spark.createDataFrame(rows, "emp_no int, salary int, from_date date, to_date date")
        df = df.selectExpr(f"'{kind}' as kind", *[f"{c} as {side}_{c}" for c in cols], *[f"cast(null as {df.schema[c].dataType.simpleString()}) as {other}_{c}" for c in cols])
        salaries.apply(df)

    apply("insert", [(1, 999999, D(2000, 1, 1), END), (2, 1, D(2000, 1, 1), END), (3, None, D(2000, 1, 1), END)])
    apply("insert", [(4, 5, D(2000, 1, 1), D(2001, 1, 1))])  # two changes, no refresh in between
    view.refresh()
    t = _now(view, small)
    assert _sorted(view.read(t)) == _sorted(dept_stats(t)) and view.read(t).agg({"max_salary": "max"}).first()[0] == 999999
    apply("delete", [(1, 999999, D(2000, 1, 1), END), (2, 1, D(2000, 1, 1), END)])
    apply("delete", [(i, 40000 + 700 * i, D(1990, 1, 1), END) for i in range(2, 41, 2)])  # d002 keeps one employee
    view.refresh()
    t = _now(view, small)
    assert _sorted(view.read(t)) == _sorted(dept_stats(t))
    assert view.state.version() == 2


def test_empty_tables(spark, small):
    view = MaintainedDeptStats(spark, scratch_path(spark, "maintained"), buckets=4)
    view.create(small.with_tables(**{name: small[name].limit(0) for name in INPUTS}))
    assert view.read(small).count() == 0
    view.inputs["employees"].insert_if_absent(small["employees"])
    view.inputs["dept_emp"].insert_if_absent(small["dept_emp"].dropDuplicates(["emp_no"]))
    view.inputs["salaries"].insert_if_absent(small["salaries"].dropDuplicates(["emp_no"]))
    view.refresh()
    t = _now(view, small)
    assert view.read(t).count() == 2 and _sorted(view.read(t)) == _sorted(dept_stats(t))
