"""Places of rows in an order, without one task that sees a whole group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulyse.functions import missing as m
from tabulyse.session import written


def numbered(df: DataFrame, keys: list[str], order: list[str], by: list[Column] | None = None, ties: list[Column] | None = None) -> DataFrame:
    """The distinct rows by ``keys`` and ``order`` with ``n``, their copies, and ``before``, the rows ahead of them in their group.

    Counting has two levels: rows are dealt into ranges of keys and order, the ranges' sizes are summed, and rows are counted
    on within their range. A group may thus span any number of tasks, and copies of one row are one row here. The ranged
    rows are written once, so every step sees the same ranges. Missing values count as values, and come first.

    ``by`` are expressions of the row that order it ahead of ``order``, and ``ties`` what comes between the two for the few
    rows that ``by`` leaves level. Neither is sent or written with the row; with ``ties``, ``by`` alone decides on the ranges.
    """
    names = [*keys, *order]
    counted = df.groupBy(*map(m.col, names)).agg(F.count("*").alias("n"))
    first, last = by or [], [*(ties or []), *map(m.col, order)]
    bounds = [*map(m.col, keys), *first, *([] if ties else last)]
    ranged = written(counted.repartitionByRange(*bounds).withColumn("range", F.spark_partition_id()), "ranges")
    group = [m.col(k) for k in keys]
    held = ranged.groupBy(*group, "range").agg(F.sum("n").alias("held"))
    so_far = Window.partitionBy(*group).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ahead = held.select(*group, "range", F.coalesce(F.sum("held").over(so_far), F.lit(0)).alias("ahead"))
    same = reduce(lambda a, b: a & b, [F.col("r.range") == F.col("a.range"), *(F.col(f"r.`{k}`").eqNullSafe(F.col(f"a.`{k}`")) for k in keys)])
    met = ranged.alias("r").join(ahead.alias("a"), same).select("r.*", "a.ahead")
    inside = Window.partitionBy(*group, "range").orderBy(*first, *last).rowsBetween(Window.unboundedPreceding, -1)
    return met.withColumn("before", F.col("ahead") + F.coalesce(F.sum("n").over(inside), F.lit(0))).drop("range", "ahead")
