"""Exact percentiles by narrowing against a plain version, for values that crowd one range."""

from __future__ import annotations

import math
import random

import pytest

from tenure.functions import quantiles


def plain(values, p):
    values = sorted(values)
    pos = (len(values) - 1) * p
    lo, hi = values[math.floor(pos)], values[min(math.floor(pos) + 1, len(values) - 1)]
    return lo + (hi - lo) * (pos - math.floor(pos))


@pytest.mark.parametrize("p", [0.0, 0.5, 0.95, 1.0])
def test_narrowing_equals_a_plain_version(spark, monkeypatch, p):
    monkeypatch.setattr(quantiles, "RANGES", 4)
    monkeypatch.setattr(quantiles, "MOST", 8)
    rng = random.Random(8)
    groups = {
        ("unit", 1): [rng.random() for _ in range(700)],  # all values in [0, 1)
        ("skew", 1): [rng.random() * 1e-9 for _ in range(300)] + [1e12, -1e12],
        ("same", None): [2.5] * 50,
        (None, 2): [float(i % 5) for i in range(100)],
        ("one", 3): [7.0],
        ("pair", 3): [1.0, 2.0],
    }
    rows = [(*g, v) for g, vs in groups.items() for v in vs] + [("nulls", 1, None), ("unit", 1, None)]
    df = spark.createDataFrame(rows, "a string, b int, v double").repartition(5)
    got = {(r.a, r.b): r.q for r in quantiles.percentile_narrowed(df, ["a", "b"], "v", p, "q").collect()}
    assert got.keys() == groups.keys()
    for g, vs in groups.items():
        assert got[g] == pytest.approx(plain(vs, p), rel=1e-12, abs=1e-15), g
