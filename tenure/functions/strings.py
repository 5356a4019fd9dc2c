"""Ordered string aggregation (GROUP_CONCAT / STRING_AGG ... WITHIN GROUP).

``ordered_concat`` is for small groups (one employee's history).
``chunked_concat`` is for groups that grow with the data (gender x birth
year over the whole fan-out): each group is first cut into chunks by a
range of its leading sort key, chunks are concatenated in parallel, and only
the already-built chunk strings meet in the last step. No task ever sorts
the raw rows of a whole group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ordered_concat(value: Column, order: list[Column], sep: str) -> Column:
    """Aggregate expression: ``value`` joined by ``sep`` in ``order`` (all keys ascending, total order)."""
    keyed = F.struct(*[o.alias(f"k{i}") for i, o in enumerate(order)], value.cast("string").alias("v"))
    return F.array_join(F.transform(F.array_sort(F.collect_list(keyed)), lambda s: s["v"]), sep)


def chunked_concat(
    df: DataFrame,
    group: list[str],
    values: dict[str, Column],
    order: list[Column],
    chunk: list[Column],
    sep: str,
) -> DataFrame:
    """Two-level ordered concatenation per ``group`` of every ``values`` column (same order).

    ``chunk`` must be a coarsening of ``order`` (sorting by the chunk key never
    contradicts sorting by ``order``), e.g. ``floor(emp_no / 1024)`` for an
    order led by ``emp_no``. Level one builds one string per chunk in
    parallel; level two joins the chunk strings in chunk order.
    """
    ck = [c.alias(f"c{i}") for i, c in enumerate(chunk)]
    ck_names = [f"c{i}" for i in range(len(chunk))]
    level1 = df.groupBy(*group, *ck).agg(*[ordered_concat(v, order, sep).alias(n) for n, v in values.items()])
    parts = []
    for n in values:
        part = F.struct(*[F.col(c) for c in ck_names], F.col(n).alias("v"))
        parts.append(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda s: s["v"]), sep).alias(n))
    return level1.groupBy(*group).agg(*parts)
