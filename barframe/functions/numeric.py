"""NULL-safe arithmetic. NaN and infinities never enter: they become NULL at the door."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Spark's cast also reads the type letters of Java literals, as in 1.5d.
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_finite(c: Column | str) -> Column:
    """Text or number to double; bad text, NaN and infinities become NULL."""
    v = col(c).try_cast("double")
    return F.when(col(c).cast("string").rlike(NUMBER) & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))), v)


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is 0 or NULL."""
    return F.try_divide(a, b)


def clip(c: Column, lo: float, hi: float) -> Column:
    """Clamp, keeping NULL (greatest/least alone would skip it)."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(lo)), F.lit(hi)))


def pct_change(now: Column | str, before: Column | str) -> Column:
    return ratio(col(now) - col(before), col(before)) * 100


def points(*rules: tuple[Column, int]) -> Column:
    """Sum of the points of every rule that holds; a NULL rule does not hold."""
    total = F.lit(0)
    for condition, value in rules:
        total = total + F.when(condition, value).otherwise(0)
    return total


def labels(*rules: tuple[Column, Column | str]) -> Column:
    """Array of the labels of every rule that holds, in order."""
    return F.array_compact(
        F.array(*[F.when(c, F.lit(v) if isinstance(v, str) else v) for c, v in rules])
    )
