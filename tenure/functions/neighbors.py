"""Previous / next distinct date per key.

Validity-interval work needs, per row, the neighbouring *distinct* dates of
its key (the next salary start closes the current one; the previous title is
the one held on the previous start date). One plan at every size: the distinct
(key, date) pairs, reduced on the map side and bounded for each key by the calendar, get
their neighbours from a window, and the rows join them on (key, date).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_adjacent_dates(df: DataFrame, key: str, order: str, value: str | None = None) -> DataFrame:
    """``df`` plus ``prev_date`` / ``next_date`` (previous / next distinct ``order`` of the same key),
    ``pos_from_end`` (1 = latest distinct date) and, with ``value``, ``prev_value``: the largest
    ``value`` on ``prev_date``.
    """
    dates = df.groupBy(key, order).agg(F.max(value).alias("_v")) if value else df.select(key, order).distinct()
    w = Window.partitionBy(key).orderBy(order)
    cols = [
        F.lag(order).over(w).alias("prev_date"),
        F.lead(order).over(w).alias("next_date"),
        F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc())).alias("pos_from_end"),
    ]
    if value:
        cols.append(F.lag("_v").over(w).alias("prev_value"))
    return df.join(dates.select(key, order, *cols), [key, order], "left").select(*df.columns, "prev_date", "next_date", "pos_from_end", *(["prev_value"] if value else []))
