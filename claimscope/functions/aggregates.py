"""Aggregate expressions whose results do not depend on summation order.

Double sums depend on the order rows arrive in, and a rounded average can flip
at a tie.  Money is therefore summed as ``decimal(18,2)`` and averages of
3-decimal scores are computed from an exact integer sum, so every engine and
every partitioning gives the same digits.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def money(col: str | Column) -> Column:
    """A money value as ``decimal(18,2)``."""
    return _c(col).cast("decimal(18,2)")


def money_sum(col: str | Column, digits: int = 2) -> Column:
    """Exact sum of money rounded half-up to ``digits`` (may be negative), as double."""
    return F.round(F.sum(money(col)), digits).cast("double")


def money_sum_millions(col: str | Column, digits: int = 2) -> Column:
    """Exact sum in millions, rounded half-up to ``digits``, as double."""
    return (F.round(F.sum(money(col)), digits - 6).cast("double") / F.lit(1_000_000.0))


def _scaled_sum(col: str | Column, scale: int) -> Column:
    return F.sum(F.round(_c(col) * (10 ** scale)).cast("bigint"))


def exact_avg(col: str | Column, scale: int = 3) -> Column:
    """Average of values that carry at most ``scale`` decimals, as double.

    Sum of the values as integers in units of 10^-scale (exact), then one
    division: identical in every engine and for every row order.
    """
    return _scaled_sum(col, scale).cast("double") / (F.count(_c(col)) * F.lit(float(10 ** scale)))


def exact_avg_round(col: str | Column, scale: int = 3) -> Column:
    """``round(avg(col), scale)`` with half-up rounding of the exact mean.

    For values with at most ``scale`` decimals: S = sum in units of 10^-scale,
    N = count; the rounded mean in those units is ``(2|S| + N) div (2N)`` with
    the sign of S.
    """
    s = _scaled_sum(col, scale)
    n = F.count(_c(col))
    a = F.abs(s) * 2 + n
    b = n * 2
    q = ((a - F.pmod(a, b)) / b).cast("bigint")  # exact integer quotient a div b
    return (F.signum(s) * q / F.lit(float(10 ** scale))).cast("double")


def count_if(cond: Column) -> Column:
    """Rows where ``cond`` is true (NULL counts as false)."""
    return F.count_if(F.coalesce(cond, F.lit(False)))
