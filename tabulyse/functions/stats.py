"""Statistics as aggregate columns that hold up under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STAT_DIGITS = 3
PERCENT_DIGITS = 2
FENCE_FACTOR = 1.5


def stat(c: Column, digits: int = STAT_DIGITS, zero_fill: bool = False) -> Column:
    """A reported statistic: rounded, and NULL (or 0) when undefined or not finite."""
    rounded = F.round(F.when(F.abs(c) < F.lit(float("inf")), c), digits)
    return F.coalesce(rounded, F.lit(0.0)) if zero_fill else rounded


def percent(part: Column, whole: Column) -> Column:
    return F.round(F.lit(100.0) * part / F.greatest(whole, F.lit(1)), PERCENT_DIGITS)


def sample_skewness(c: Column) -> Column:
    """Bias-corrected skewness; 0 for a constant column, NULL below three values."""
    n = F.count(c)
    correction = F.sqrt((n * (n - 1)).cast("double")) / (n - 2)
    return F.when(n >= 3, F.when(F.min(c) == F.max(c), F.lit(0.0)).otherwise(F.skewness(c) * correction))


def pearson(x: Column, y: Column) -> Column:
    """Pearson correlation over the rows where both are present; NULL when either is constant.

    ``corr`` divides by zero on a constant column under ANSI mode, so the sums of squares are asked for
    separately. The ``regr_`` family skips a row unless both values are present.
    """
    scale = F.sqrt(F.regr_sxx(y, x)) * F.sqrt(F.regr_syy(y, x))
    return F.try_divide(F.regr_sxy(y, x), scale)


def fences(q1: Column, q3: Column) -> tuple[Column, Column]:
    spread = (q3 - q1) * FENCE_FACTOR
    return q1 - spread, q3 + spread
