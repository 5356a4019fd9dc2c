"""Join-side sizing: broadcast only behind a checked bound, shuffle otherwise."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenure.sources.tables import Tables

# A dimension (or an aggregate keyed by one) is broadcast only when the
# dimension is proven to hold at most this many rows (a few MB at most).
MAX_BROADCAST_ROWS = 100_000


def dim(t: Tables, name: str, df: DataFrame | None = None, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """``t[name]`` (or ``df``, a projection of it) as a join side.

    If the dimension table ``name`` is proven small, the side gets a broadcast
    hint; otherwise it stays a plain (shuffled) join side and AQE decides at
    run time, splitting skewed partitions if needed.
    """
    side = t[name] if df is None else df
    return F.broadcast(side) if t.rows_at_most(name, max_rows) else side


def dim_agg(t: Tables, name: str, agg: DataFrame, key: str, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """``agg`` (one row per ``key`` of a child table) as a join side.

    Nothing makes a child's keys exist in ``t[name]``, so when that table is small the aggregate
    keeps only its keys before it gets the hint: orphan keys cannot make the broadcast grow. The
    caller joins with ``t[name]``, where orphans would find no row.
    """
    if not t.rows_at_most(name, max_rows):
        return agg
    return F.broadcast(agg.join(F.broadcast(t[name].select(key)), key, "left_semi"))


def one_row(df: DataFrame) -> DataFrame:
    """A global aggregate without grouping has exactly one row: always safe to broadcast."""
    return F.broadcast(df)
