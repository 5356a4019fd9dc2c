"""Property tests for the validity-interval change core (hypothesis)."""

from __future__ import annotations

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tenure.operators.changes import scd2_close_open
from tenure.schema import OPEN_END

AS_OF = dt.date(2001, 8, 1)
SCHEMA = "emp_no int, salary int, from_date date, to_date date"


@st.composite
def histories(draw):
    rows = []
    for emp in range(draw(st.integers(1, 6))):
        n = draw(st.integers(1, 4))
        starts = sorted(draw(st.sets(st.integers(0, 5000), min_size=n, max_size=n)))
        dates = [dt.date(1990, 1, 1) + dt.timedelta(days=d) for d in starts]
        for i, f in enumerate(dates):
            to = dates[i + 1] if i + 1 < len(dates) else OPEN_END
            rows.append((emp, draw(st.integers(1, 9)) * 1000, f, to))
    marks = draw(st.lists(st.integers(0, 7), max_size=6))
    return rows, marks


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(histories())
def test_close_open_keeps_one_open_row_and_touches_only_marked_keys(spark, case):
    rows, marks = case
    table = spark.createDataFrame(rows, SCHEMA)
    close = spark.createDataFrame([(m,) for m in marks], "emp_no int")
    keys = sorted({r[0] for r in rows} & set(marks))
    opened = spark.createDataFrame([(k, 1, AS_OF, OPEN_END) for k in keys], SCHEMA)
    out = sorted(tuple(r) for r in scd2_close_open(table, ["emp_no"], close, opened, AS_OF).collect())
    assert len(out) == len(rows) + len(keys)
    for emp in {r[0] for r in rows}:
        mine = [r for r in out if r[0] == emp]
        before = [r for r in rows if r[0] == emp]
        if emp in keys:
            assert [r for r in mine if r[3] == OPEN_END] == [(emp, 1, AS_OF, OPEN_END)]
            assert sorted(r for r in mine if r[2] != AS_OF or r[1] != 1) == sorted(
                (e, s, f, AS_OF if t == OPEN_END else t) for e, s, f, t in before)
        else:
            assert sorted(mine) == sorted(before)
