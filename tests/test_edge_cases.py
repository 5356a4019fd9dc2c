"""Hand cases for what an order-insensitive hash cannot show: ties, NULLs, rounding, conflicts."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest

from pyspark.sql import functions as F

from helpers import END, D, emp, make_tables
from tenure.operators import changes, quality, reports_admin, reports_hr, reports_perf, reports_rep, views
from tenure.operators.telemetry import counter_rate
from tenure.sources.sinks import insert_if_absent
from tenure.plans.sizing import dim_agg

AS_OF = dt.date(2001, 8, 1)


def test_dense_rank_keeps_ties_at_rank_five(spark):
    pay = [100, 90, 90, 80, 70, 60, 60, 50]
    t = make_tables(
        spark,
        employees=[emp(i) for i in range(len(pay))],
        departments=[("d001", "One")],
        dept_emp=[(i, "d001", D(1990, 1, 1), END) for i in range(len(pay))],
        salaries=[(i, p, D(2000, 1, 1), END) for i, p in enumerate(pay)],
    )
    out = reports_rep.rep_top_salaries_by_dept(t).collect()
    assert sorted((r.salary, r.salary_rank_in_dept) for r in out) == sorted(
        [(100, 1), (90, 2), (90, 2), (80, 3), (70, 4), (60, 5), (60, 5)]
    )


def test_single_member_department_stddev(spark):
    t = make_tables(
        spark,
        employees=[emp(1)],
        departments=[("d001", "Solo")],
        dept_emp=[(1, "d001", D(1990, 1, 1), END)],
        salaries=[(1, 50000, D(2000, 1, 1), END)],
        titles=[(1, "Staff", D(1990, 1, 1), END)],
    )
    assert views.dept_stats(t).first().salary_stddev is None  # sample stddev of one value
    assert reports_rep.rep_salary_by_title(t).first().salary_stddev == 0.0  # population stddev


def test_left_joins_keep_employee_without_salary(spark):
    t = make_tables(
        spark,
        employees=[emp(1, hire=D(1990, 1, 15))],
        departments=[("d001", "One")],
        titles=[(1, "Staff", D(1990, 1, 15), END)],
    )
    r = reports_hr.hr_search_by_hire_date(t).collect()
    assert len(r) == 1 and r[0].salary is None and r[0].dept_name is None and r[0].title == "Staff"


def test_raise_rounds_half_up_into_int(spark):
    t = make_tables(
        spark,
        employees=[emp(1)],
        departments=[("d005", "Five")],
        dept_emp=[(1, "d005", D(1990, 1, 1), END)],
        salaries=[(1, 95, D(2000, 1, 1), END)],
    )
    new = changes.salary_adjust(t, AS_OF).collect()
    opened = [r for r in new if r.to_date == END]
    assert [r.salary for r in opened] == [105]  # 104.5 rounds half up, a plain cast would give 104
    assert [r.to_date for r in new if r.from_date == D(2000, 1, 1)] == [AS_OF]


def test_transfer_into_formerly_held_department_is_a_conflict(spark):
    t = make_tables(
        spark,
        employees=[emp(1), emp(2)],
        departments=[("d001", "One"), ("d005", "Five")],
        dept_emp=[(1, "d001", D(1990, 1, 1), D(1995, 1, 1)), (1, "d005", D(1995, 1, 1), END),
                  (2, "d005", D(1995, 1, 1), END)],
    )
    new = changes.transfer(t, AS_OF)
    assert sorted((r.emp_no, r.dept_no, r.to_date) for r in new.collect() if r.from_date == AS_OF) == [
        (2, "d001", END)]
    assert (1, "d005", END) in {(r.emp_no, r.dept_no, r.to_date) for r in new.collect()}  # left as is
    assert [r.emp_no for r in changes.transfer_conflicts(t).collect()] == [1]
    assert quality.duplicate_keys(new, ["emp_no", "dept_no"]).count() == 0


def test_orphan_departments_are_not_broadcast(spark):
    t = make_tables(spark, departments=[("d001", "One")])
    child = spark.range(1000).selectExpr("concat('o', id) AS dept_no").union(spark.sql("SELECT 'd001'"))
    side = dim_agg(t, "departments", child.groupBy("dept_no").count(), "dept_no")
    assert [r.dept_no for r in side.collect()] == ["d001"]


def test_two_open_titles_fan_out(spark):
    t = make_tables(
        spark,
        employees=[emp(1)],
        departments=[("d001", "One")],
        dept_emp=[(1, "d001", D(1990, 1, 1), END)],
        salaries=[(1, 50000, D(2000, 1, 1), END)],
        titles=[(1, "Staff", D(1990, 1, 1), END), (1, "Engineer", D(1990, 1, 1), END)],
    )
    assert reports_hr.hr_employee_list(t).count() == 2


def test_previous_title_skips_same_day_rows(spark):
    t = make_tables(
        spark,
        employees=[emp(1)],
        departments=[("d001", "One")],
        dept_emp=[(1, "d001", D(1990, 1, 1), END)],
        salaries=[(1, 1, D(1990, 1, 1), D(1995, 1, 1)), (1, 2, D(1995, 1, 1), END)],
        titles=[(1, "A", D(1990, 1, 1), D(1995, 1, 1)), (1, "B", D(1995, 1, 1), D(1995, 1, 1)),
                (1, "C", D(1995, 1, 1), END)],
    )
    r = reports_perf.perf_career_progression(t).first()
    assert (r.current_title, r.previous_title, r.current_salary, r.previous_salary) == ("C", "A", 2, 1)


def test_transfer_audit_pairs_equal_start_dates_with_the_next_distinct_date(spark):
    t = make_tables(
        spark,
        employees=[emp(1), emp(2)],
        departments=[("d001", "One"), ("d002", "Two"), ("d003", "Three")],
        dept_emp=[(e, "d001", D(1990, 1, 1), D(1991, 1, 1)) for e in (1, 2)]
        + [(e, "d002", D(1991, 1, 1), END) for e in (1, 2)]
        + [(e, "d003", D(1991, 1, 1), END) for e in (1, 2)],
    )
    out = {(r.from_department, r.to_department): (r.transfer_count, r.avg_days_between_transfers)
           for r in reports_admin.admin_transfer_audit(t).collect()}
    assert out == {("One", "Two"): (2, 365.0), ("One", "Three"): (2, 365.0)}


def test_null_gender_passes_the_domain_check(spark):
    t = make_tables(spark, employees=[emp(1, gender=None), emp(2, gender="X"), emp(3, gender="M")])
    rows = quality.dq_domain_violations(t).collect()
    assert [(r.value, r.n) for r in rows] == [("X", 1)]


def test_insert_if_absent_dedupes_batch_and_is_idempotent(spark):
    target = spark.createDataFrame([(1, "a")], "k int, v string")
    incoming = spark.createDataFrame([(1, "z"), (2, "b"), (2, "c"), (3, "d")], "k int, v string")
    once = insert_if_absent(target, incoming, ["k"])
    twice = insert_if_absent(once, incoming, ["k"])
    assert sorted(once.collect()) == sorted(twice.collect())
    assert sorted(tuple(r) for r in once.collect()) == [(1, "a"), (2, "b"), (3, "d")]


def test_counter_reset_rate(spark):
    s = spark.createDataFrame(
        [("a", dt.datetime(2024, 1, 1, 0, 0, 0), 10), ("a", dt.datetime(2024, 1, 1, 0, 0, 10), 30),
         ("a", dt.datetime(2024, 1, 1, 0, 0, 20), 5)],
        "k string, ts timestamp_ntz, v long",
    )
    rates = [r.rate for r in counter_rate(s, "k", "ts", "v").orderBy("ts").collect()]
    assert rates == [None, 2.0, 0.5]  # the drop to 5 is a reset: 5 / 10 s


def test_budget_passes_round_each_time(spark):
    t = make_tables(
        spark,
        employees=[emp(1, gender="M", hire=D(1995, 1, 1)), emp(2, gender="F", hire=D(1995, 1, 1))],
        departments=[("d001", "One", Decimal("100000.05")), ("d002", "Two", Decimal("100000.05"))],
        dept_emp=[(1, "d001", D(1995, 1, 1), END), (2, "d001", D(1995, 1, 1), END)],
    )
    got = {r.dept_no: r.manager_budget for r in changes.dept_budget_raise(t, AS_OF).collect()}
    b = Decimal("100000.05")
    for _ in range(5):
        b = (b * Decimal("1.1")).quantize(Decimal("0.01"), rounding="ROUND_HALF_UP")
    assert got == {"d001": b, "d002": Decimal("100000.05")}


def test_hierarchy_closed_form_equals_the_recursion(spark):
    """Run the recursive join three levels deep on a tiny input and compare with the closed form."""
    t = make_tables(
        spark,
        employees=[emp(1), emp(2), emp(3)],
        departments=[("d001", "One"), ("d002", "Two")],
        dept_emp=[(1, "d001", D(1990, 1, 1), D(1995, 1, 1)), (1, "d002", D(1995, 1, 1), END),
                  (2, "d001", D(1990, 1, 1), END), (3, "d002", D(1990, 1, 1), END)],
        salaries=[(1, 90000, D(2000, 1, 1), END), (1, 70000, D(2001, 1, 1), END), (2, 40000, D(2000, 1, 1), END),
                  (3, 65000, D(2000, 1, 1), END)],
    )
    t["salaries_multi"] = t["salaries"]
    from tenure.operators.reports_ms import ms_hierarchy_salary

    got = {r.dept_name: (r.emp_count, r.avg_salary) for r in ms_hierarchy_salary(t, depth=3).collect()}
    de = t["dept_emp"].join(t["departments"], "dept_no").select("emp_no", "dept_name")
    cur = t["salaries"].filter(F.col("to_date") == END).select("emp_no", "salary")
    level = de.join(cur, "emp_no")
    rows = level
    for _ in range(2):
        level = level.select("emp_no").join(de, "emp_no").join(cur, "emp_no")
        rows = rows.unionByName(level)
    agg = {r.dept_name: (r.c, r.a) for r in rows.groupBy("dept_name").agg(
        F.count_distinct("emp_no").alias("c"), F.avg("salary").alias("a")).collect()}
    gavg = sum(r.salary for r in cur.collect()) / cur.count()
    want = {k: (c, round(a, 4)) for k, (c, a) in agg.items() if a > gavg}
    assert got == want and got


def test_neighbour_dates_and_a_hot_employee(spark):
    """One employee holds most salary rows; the previous value is that of the previous distinct date."""
    from tenure.operators.reports_perf import perf_career_progression

    hot = [(1, 1000 + i, D(1990, 1, 1) + dt.timedelta(days=i), D(1990, 1, 1) + dt.timedelta(days=i + 1))
           for i in range(300)]
    hot[-1] = (1, 99, hot[-1][2], END)
    others = [(e, 500 * e, D(1995, 1, 1), D(1999, 1, 1)) for e in range(2, 40)] + [
        (e, 600 * e, D(1999, 1, 1), END) for e in range(2, 40)]
    t = make_tables(
        spark,
        employees=[emp(e) for e in range(1, 40)],
        departments=[("d001", "One")],
        dept_emp=[(e, "d001", D(1990, 1, 1), END) for e in range(1, 40)],
        salaries=hot + others,
        titles=[(e, "Staff", D(1990, 1, 1), END) for e in range(1, 40)],
    )
    rows = {r.emp_no: (r.current_salary, r.previous_salary) for r in perf_career_progression(t).collect()}
    assert rows == {1: (99, 1298)} | {e: (600 * e, 500 * e) for e in range(2, 40)}


def test_percentiles_equal_numpy(spark, tables):
    import numpy as np

    from tenure.functions.quantiles import percentile_cont

    ev = tables["request_events"]
    values = ev.select("queryType", "duration").toPandas().dropna().groupby("queryType").duration
    for p in (0.0, 0.5, 0.95, 1.0):
        got = {r.queryType: r.q for r in percentile_cont(ev, ["queryType"], "duration", p, "q").collect()}
        assert got == pytest.approx({k: np.quantile(v, p) for k, v in values})


def test_no_job_while_percentiles_and_neighbours_are_built(spark, tables):
    from tenure.operators.reports_perf import previous_at
    from tenure.operators.telemetry import request_metrics

    spark.sparkContext.setJobGroup("build-only", "")
    previous_at(tables, "titles", "title")
    request_metrics(tables)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("build-only")
    spark.sparkContext.setJobGroup("rest", "")


def test_lookup_takes_any_number_of_ids(spark, tables):
    from tenure.operators.reports_pay import pay_lookup_many

    few = pay_lookup_many(tables, emp_nos=list(range(10001, 10021))).count()
    assert 0 < few <= pay_lookup_many(tables, emp_nos=list(range(10001, 15001))).count()


def test_counter_samples_within_a_second(spark):
    from tenure.operators.telemetry import counter_rate

    at = [dt.datetime(2024, 1, 1, 0, 0, 0), dt.datetime(2024, 1, 1, 0, 0, 0, 250_000), dt.datetime(2024, 1, 1, 0, 0, 0, 250_000)]
    series = spark.createDataFrame([("a", t, v) for t, v in zip(at, (10, 15, 15))], "k string, ts timestamp, v long")
    assert sorted((r.rate for r in counter_rate(series, "k", "ts", "v").collect()), key=str) == [20.0, None, None]


def test_overlap_check_returns_both_rows(spark):
    from tenure.operators.quality import dq_duplicate_keys, dq_interval_overlaps

    t = make_tables(
        spark,
        employees=[emp(1), emp(2)],
        departments=[("d001", "One"), ("d002", "Two")],
        salaries=[(1, 1, D(2000, 1, 1), D(2000, 12, 31)), (1, 2, D(2000, 5, 1), D(2000, 6, 1)), (1, 3, D(2001, 1, 1), END), (2, 4, D(2000, 1, 1), END)],
    )
    assert sorted(r.salary for r in dq_interval_overlaps(t, "salaries").collect()) == [1, 2]
    t = t.with_tables(departments=t["departments"].withColumn("dept_name", F.lit(None).cast("string")))
    assert dq_duplicate_keys(t).filter("key_columns = 'dept_name'").count() == 0  # UNIQUE ignores NULL


def test_repeated_and_unknown_salary_updates(spark):
    t = make_tables(spark, employees=[emp(1)], salaries=[(1, 50, D(2000, 1, 1), END)])
    updates = spark.createDataFrame([(1, 60), (1, 70), (9, 80)], "emp_no int, salary int")
    rows = changes.update_salary(t, updates=updates).filter(f"to_date = date'{END}'").collect()
    assert [(r.emp_no, r.salary) for r in rows] == [(1, 70)]


def test_sql_server_integer_average(spark):
    t = make_tables(
        spark,
        employees=[emp(1), emp(2)],
        departments=[("d001", "One")],
        dept_emp=[(1, "d001", D(1990, 1, 1), END), (2, "d001", D(1990, 1, 1), END)],
        salaries=[(1, 50001, D(2000, 1, 1), END), (2, 50002, D(2000, 6, 1), END)],
    )
    pg = {r.year: r.avg_salary for r in views.salary_metrics(t).collect()}
    ms = {r.year: r.avg_salary for r in views.salary_metrics(t, int_avg=True).collect()}
    assert pg == {2000: 50001.5} and ms == {2000: 50001}
