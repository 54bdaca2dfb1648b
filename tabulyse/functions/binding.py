"""Name an intermediate value inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(c: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body mentions it.

    Expressions are merged into one projection; a costly value mentioned in many branches would be
    generated, and often evaluated, once per mention.
    """
    return F.element_at(F.transform(F.array(c), body), 1)
