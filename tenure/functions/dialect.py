"""Column helpers that pin down source-dialect semantics on Spark expressions.

All helpers return built-in Spark expressions (JVM-side, whole-stage codegen);
none is a Python UDF.
"""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from tenure.schema import OPEN_END


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_open(c="to_date", open_end: dt.date = OPEN_END) -> Column:
    """Row is current: its validity interval has the open end."""
    return col_(c) == F.lit(open_end)


def like_contains(c, needle: str, case_sensitive: bool = False) -> Column:
    """``c LIKE '%needle%'``; MySQL / SQL Server default collations ignore case."""
    c = col_(c)
    if case_sensitive:
        return c.contains(needle)
    return F.lower(c).contains(needle.lower())


def like_prefix(c, prefix: str, case_sensitive: bool = False) -> Column:
    """``c LIKE 'prefix%'``."""
    c = col_(c)
    if case_sensitive:
        return c.startswith(prefix)
    return F.lower(c).startswith(prefix.lower())


def like(c, pattern: str, case_sensitive: bool = False) -> Column:
    """General LIKE; plain ``%x%`` / ``x%`` patterns map to contains / startswith."""
    body = pattern.strip("%")
    if "%" not in body and "_" not in body:
        if pattern.startswith("%") and pattern.endswith("%") and len(pattern) > 1:
            return like_contains(c, body, case_sensitive)
        if pattern.endswith("%") and not pattern.startswith("%"):
            return like_prefix(c, body, case_sensitive)
    c = col_(c)
    return c.like(pattern) if case_sensitive else F.lower(c).like(pattern.lower())


def in_years(c, first: int, last: int | None = None) -> Column:
    """``YEAR(c) BETWEEN first AND last`` as a half-open date range (pushes to the scan)."""
    last = first if last is None else last
    c = col_(c)
    return (c >= F.lit(dt.date(first, 1, 1))) & (c < F.lit(dt.date(last + 1, 1, 1)))


def after_year(c, year: int) -> Column:
    """``YEAR(c) > year``."""
    return col_(c) >= F.lit(dt.date(year + 1, 1, 1))


def days_since(c, as_of: dt.date) -> Column:
    """``DATEDIFF(as_of, c)`` in days."""
    return F.datediff(F.lit(as_of), col_(c))


def div4(num: Column, den) -> Column:
    """MySQL ``/``: a DECIMAL with four more fraction digits, here as a rounded double."""
    return F.round(num / F.lit(den) if not isinstance(den, Column) else num / den, 4)


def avg_exact(c) -> Column:
    """AVG of an integer column from an exact integer sum (order-independent result)."""
    c = col_(c)
    return F.sum(c.cast("long")) / F.count(c)


def scale_to_int(c, factor: str) -> Column:
    """``int_col * factor`` stored into an INT column: exact decimal, rounded half up."""
    prod = col_(c).cast("decimal(18,0)") * F.lit(Decimal(factor))
    return F.round(prod, 0).cast("int")


def scale_decimal(c, factor: str, scale: int = 2) -> Column:
    """``decimal_col * factor`` stored back with the column's scale (half up)."""
    return F.round(col_(c) * F.lit(Decimal(factor)), scale)


def date_text_or_present(c, open_end: dt.date = OPEN_END) -> Column:
    """``CASE WHEN c = open end THEN 'present' ELSE c END`` as text."""
    c = col_(c)
    return F.when(c == F.lit(open_end), F.lit("present")).otherwise(c.cast("string"))


def _dec(c: Column) -> Column:
    return c.cast("decimal(38,0)")


def ratio_scaled(num, den, digits: int) -> Column:
    """``round(num / den, digits) * 10**digits`` as an exact long (half up).

    For non-negative integral ``num`` and positive integral ``den``. Exact
    decimal arithmetic, so the result does not depend on summation order or
    on the engine's floating-point rounding.
    """
    num, den = col_(num), col_(den)
    n = _dec(num) * F.lit(2 * 10**digits) + _dec(den)
    d = _dec(den) * F.lit(2)
    return F.when(den > 0, ((n - F.pmod(n, d)) / d).cast("long"))


def ratio(num, den, digits: int = 4) -> Column:
    """``round(num / den, digits)`` as a double, exact for integral inputs."""
    return ratio_scaled(num, den, digits) / F.lit(10**digits)


def ratio_scaled_small(num, den, digits: int) -> Column:
    """``ratio_scaled`` for per-row use on small integers (|num * 2 * 10**digits| < 2**53).

    Long arithmetic only: the division is of an exact multiple, so the double
    quotient is exact. No wide decimals per row.
    """
    num, den = col_(num).cast("long"), col_(den).cast("long")
    n = num * F.lit(2 * 10**digits) + den
    d = den * F.lit(2)
    return F.when(den > 0, ((n - F.pmod(n, d)) / d).cast("long"))


def ratio_small(num, den, digits: int = 4) -> Column:
    """Per-row ``round(num / den, digits)`` for small integers (e.g. days / 365)."""
    return ratio_scaled_small(num, den, digits) / F.lit(10**digits)


def avg_truncated(c) -> Column:
    """SQL Server ``AVG(int_col)``: an integer, truncated toward zero (non-negative data)."""
    c = col_(c)
    return ratio_trunc(F.sum(c.cast("long")), F.count(c))


def ratio_trunc(num, den) -> Column:
    """Integer quotient of non-negative integers, exact (decimal arithmetic)."""
    num, den = _dec(col_(num)), _dec(col_(den))
    return F.when(den > 0, ((num - F.pmod(num, den)) / den).cast("long"))


def avg_round(c, digits: int = 4) -> Column:
    """``ROUND(AVG(int_col), digits)`` computed from the exact integer sum."""
    c = col_(c)
    return ratio(F.sum(c.cast("long")), F.count(c), digits)
