"""Physical-plan checks used by tests and the bench.

They read the formatted plan text that ``DataFrame.explain`` prints, so a
test can assert the shape Catalyst chose (pushdown, no cartesian product,
no single-partition window) without reaching into Spark internals.
"""

from __future__ import annotations

import contextlib
import io
import re

from pyspark.sql import DataFrame


def plan_text(df: DataFrame, mode: str = "formatted") -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode)
    return buf.getvalue()


def problems(df: DataFrame) -> list[str]:
    """Plan smells that would not survive scale-up."""
    text = plan_text(df)
    out = []
    if "CartesianProduct" in text:
        out.append("cartesian product")
    if unpartitioned_windows(text):
        out.append("window over a single partition")
    if re.search(r"BatchEvalPython|ArrowEvalPython|FlatMapGroupsInPandas|MapInPandas", text):
        out.append("python code in the plan")
    return out


def unpartitioned_windows(text: str) -> list[str]:
    """Window operators with an empty PARTITION BY (all rows meet in one task)."""
    found = []
    for m in re.finditer(r"\(\d+\) Window\n(?:.*\n)*?Arguments: (.*)\n", text):
        if re.search(r"\], \[\], \[", m.group(1)):
            found.append(m.group(1)[:120])
    return found


def shuffle_count(df: DataFrame) -> int:
    return len(re.findall(r"Exchange hashpartitioning|Exchange rangepartitioning", plan_text(df, "simple")))


def pushed_filters(df: DataFrame) -> list[str]:
    return re.findall(r"PushedFilters: \[([^\]]*)\]", plan_text(df))
