"""Human-readable labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNITS = ["B", "KB", "MB", "GB", "TB"]


def bytes_label(c: Column) -> Column:
    """A byte count scaled by 1024 with one decimal, from B up to TB."""
    size = c.cast("double")
    label = F.format_string("%.1f TB", size / 1024.0**4)
    for power in range(3, -1, -1):
        label = F.when(size < 1024.0 ** (power + 1), F.format_string(f"%.1f {_UNITS[power]}", size / 1024.0**power)).otherwise(label)
    return label


def range_label(lo: Column, hi: Column) -> Column:
    return F.format_string("%.2f-%.2f", lo, hi)
