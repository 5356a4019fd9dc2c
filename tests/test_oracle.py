"""Every registered query against its DuckDB oracle on the sf0.001 tables."""

from __future__ import annotations

import datetime as dt
import decimal
import math

import pytest

import __spark_entry__ as entry
from conftest import SF_SMALL
from tenure.catalog import REPORTS

QUERIES = {name: q for name, q in entry.queries().items() if name in REPORTS}
ORACLES = {name: sql for name, sql in entry.oracle_sql().items() if name in REPORTS}


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    return v


def test_every_query_has_an_oracle():
    assert set(ORACLES) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF_SMALL)
    cols = sorted(df.columns)
    got = sorted((tuple(_norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    cur = duck.execute(ORACLES[name])
    dcols = [c[0] for c in cur.description]
    assert sorted(dcols) == cols
    idx = [dcols.index(c) for c in cols]
    want = sorted((tuple(_norm(r[i]) for i in idx) for r in cur.fetchall()), key=repr)
    assert got == want


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["dept_name", "emp_count", "avg_salary", "max_salary", "min_salary"]
    assert df.count() > 0
