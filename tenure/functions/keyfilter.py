"""A key set as a few ranges that a scan can push down.

A left semi join keeps the rows of a key set, but the scan below it still reads the whole table. ``in_key_ranges`` adds
at most ``MAX_RANGES`` ranges that hold every key: files and row groups outside of them are skipped, for 20 keys as
for millions. The join stays the exact check.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_RANGES = 64

Range = tuple[int, int]


def ranges_of_list(keys: Iterable[int], most: int = MAX_RANGES) -> list[Range]:
    """Ranges of keys that are on the driver already: cut at the widest gaps."""
    ks = sorted(set(keys))
    if not ks:
        return []
    gaps = sorted(range(1, len(ks)), key=lambda i: ks[i - 1] - ks[i])[: most - 1]
    cuts = [0, *sorted(i for i in gaps if ks[i] - ks[i - 1] > 1), len(ks)]
    return [(ks[a], ks[b - 1]) for a, b in zip(cuts, cuts[1:])]


def ranges_of(keys: DataFrame, col: str, most: int = MAX_RANGES) -> list[Range]:
    """Ranges of a distributed key column: its extent cut into ``most`` equal cells, the smallest and largest key of each.

    Two aggregates over the keys; the driver gets at most ``most`` rows.
    """
    k = F.col(col).cast("decimal(20,0)")
    low, high = keys.agg(F.min(k), F.max(k)).first()
    if low is None:
        return []
    width = (int(high) - int(low)) // most + 1
    cell = ((k - F.lit(low)) / F.lit(width)).cast("long").alias("cell")
    cells = keys.filter(F.col(col).isNotNull()).groupBy(cell).agg(F.min(col), F.max(col)).collect()
    return sorted((int(r[1]), int(r[2])) for r in cells)


def in_ranges(col: str, ranges: list[Range]) -> Column:
    tests = [F.col(col) == F.lit(a) if a == b else F.col(col).between(a, b) for a, b in ranges]
    return functools.reduce(Column.__or__, tests, F.lit(False)) if tests else F.lit(False)
