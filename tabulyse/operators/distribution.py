"""How values spread: histogram, categories, box plot, outliers, days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulyse.functions import missing as m
from tabulyse.functions.labels import range_label
from tabulyse.functions.stats import fences, percent, stat
from tabulyse.operators.quantiles import numeric_long, quartiles
from tabulyse.operators.value_counts import top_values

HISTOGRAM_BINS = 20
CATEGORY_VALUES = 15
OUTLIER_ROWS = 50
LATEST_DAYS = 200
_MOST_BINS = 200_000  # counts of bins that are sent to every task at most


def histogram(df: DataFrame, columns: list[str], bins: int = HISTOGRAM_BINS, label: bool = False, extent: DataFrame | None = None) -> DataFrame:
    """(column, bin, lo, hi, n): equal-width bins over [min, max], empty bins included.

    The last bin is closed. A constant column spans half a unit either side of its value, an empty one
    [0, 1]. Infinite values are left out. Two passes; the first yields one row per column, or is spared if the caller has the
    least and largest finite values, as ``extent`` (column, a, b).
    """
    if bins < 1:
        raise ValueError("a histogram needs at least one bin")
    values = numeric_long(df, columns).where(m.finite(F.col("x")).isNotNull())
    names = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(c) for c in columns])).alias("column"))
    if extent is None:
        extent = values.groupBy("column").agg(F.min("x").alias("a"), F.max("x").alias("b"))
    flat = F.col("a") == F.col("b")
    bounds = names.join(F.broadcast(extent), "column", "left").select(
        "column",
        F.coalesce(F.when(flat, F.col("a") - 0.5).otherwise(F.col("a")), F.lit(0.0)).alias("start"),
        F.coalesce(F.when(flat, F.col("b") + 0.5).otherwise(F.col("b")), F.lit(1.0)).alias("stop"),
    )
    bounds = bounds.withColumn("step", (F.col("stop") - F.col("start")) / bins)

    def edge(i: Column) -> Column:
        return F.when(i == bins, F.col("stop")).otherwise(i * F.col("step") + F.col("start"))

    placed = values.join(F.broadcast(bounds), "column")
    guess = F.least(F.floor((F.col("x") - F.col("start")) / (F.col("stop") - F.col("start")) * bins), F.lit(bins - 1))
    placed = placed.select("column", "x", "start", "stop", "step", guess.alias("g"))
    # The edges decide; the division above can be off by one next to an edge.
    exact = (
        F.when(F.col("x") < edge(F.col("g")), F.col("g") - 1)
        .when((F.col("g") < bins - 1) & (F.col("x") >= edge(F.col("g") + 1)), F.col("g") + 1)
        .otherwise(F.col("g"))
    )
    counted = placed.groupBy("column", exact.alias("bin")).agg(F.count("*").alias("n"))
    every = bounds.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(bins - 1).cast("bigint"))).alias("bin"))
    every = every.select("column", "bin", edge(F.col("bin")).alias("lo"), edge(F.col("bin") + 1).alias("hi"))
    filled = every.join(F.broadcast(counted) if len(columns) * bins <= _MOST_BINS else counted, ["column", "bin"], "left")
    out = filled.select("column", "bin", "lo", "hi", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))
    return out.withColumn("label", range_label(F.col("lo"), F.col("hi"))) if label else out


def category_distribution(df: DataFrame, column: str, k: int = CATEGORY_VALUES) -> DataFrame:
    """(rank, value, n): the k most frequent values of one column."""
    m.field(df, column)
    return top_values(df, [column], k).select("rank", "value", "n")


def distribution(df: DataFrame, column: str, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """The histogram of a numeric column, the frequent values of any other."""
    if m.role_of_type(m.field(df, column).dataType) == m.NUMERIC:
        return histogram(df, [column], bins)
    return category_distribution(df, column)


def _bounds(df: DataFrame, columns: list[str], middle: DataFrame | None) -> DataFrame:
    q = middle.where(F.col("column").isin(columns)) if middle else quartiles(df, columns)
    lower, upper = fences(F.col("q1"), F.col("q3"))
    return q.select("column", "n", "q1", "median", "q3", lower.alias("lower"), upper.alias("upper"))


def _beyond() -> Column:
    return (F.col("x") < F.col("lower")) | (F.col("x") > F.col("upper"))


def against_fences(df: DataFrame, columns: list[str], middle: DataFrame | None) -> DataFrame:
    """Per column: quartiles, fences and what one more pass finds relative to them."""
    bounds = _bounds(df, columns, middle)
    placed = numeric_long(df, columns).join(F.broadcast(bounds), "column")
    found = placed.groupBy("column").agg(
        F.min("x").alias("min"),
        F.max("x").alias("max"),
        F.min(F.when(F.col("x") >= F.col("lower"), F.col("x"))).alias("lower_whisker"),
        F.max(F.when(F.col("x") <= F.col("upper"), F.col("x"))).alias("upper_whisker"),
        F.count_if(_beyond()).alias("outlier_count"),
    )
    return bounds.join(F.broadcast(found), "column", "left").withColumn(
        "outlier_count", F.coalesce("outlier_count", F.lit(0).cast("bigint"))
    )


def _status() -> Column:
    return F.when(F.col("n") == 0, "empty").otherwise("ok").alias("status")


def box_plot(df: DataFrame, columns: list[str], zero_fill: bool = False, middle: DataFrame | None = None, fenced: DataFrame | None = None) -> DataFrame:
    """(column, min, q1, median, q3, max, lower_whisker, upper_whisker, outlier_count, status).

    Whiskers are the outermost values inside the fences at 1.5 times the interquartile range. ``middle``
    holds the quartiles if the caller has them, ``fenced`` what ``against_fences`` gives.
    """
    m.require_numeric(df, *columns)
    shown = ["min", "q1", "median", "q3", "max", "lower_whisker", "upper_whisker"]
    rows = fenced.where(F.col("column").isin(columns)) if fenced else against_fences(df, columns, middle)
    return rows.select("column", *[stat(F.col(c), zero_fill=zero_fill).alias(c) for c in shown], "outlier_count", _status())


def outliers_iqr(
    df: DataFrame, columns: list[str] | None = None, zero_fill: bool = False, middle: DataFrame | None = None, fenced: DataFrame | None = None
) -> DataFrame:
    """(column, q1, q3, iqr, lower_fence, upper_fence, outlier_count, outlier_pct, min, max, median, status)."""
    columns = columns or m.numeric_columns(df)
    m.require_numeric(df, *columns)
    rows = fenced.where(F.col("column").isin(columns)) if fenced else against_fences(df, columns, middle)
    rows = rows.withColumn("iqr", F.col("q3") - F.col("q1"))
    shown = {"q1": "q1", "q3": "q3", "iqr": "iqr", "lower_fence": "lower", "upper_fence": "upper"}
    extremes = {"min": "min", "max": "max", "median": "median"}

    def reported(pairs: dict[str, str]) -> list[Column]:
        return [stat(F.col(source), zero_fill=zero_fill).alias(name) for name, source in pairs.items()]

    return rows.select(
        "column",
        *reported(shown),
        "outlier_count",
        percent(F.col("outlier_count"), F.col("n")).alias("outlier_pct"),
        *reported(extremes),
        _status(),
    )


def outlier_rows(df: DataFrame, columns: list[str], keys: list[str], limit: int = OUTLIER_ROWS) -> DataFrame:
    """(column, rank, keys..., x, distance): the values farthest outside the fences, ties by key.

    Each task keeps ``limit`` rows per column before the ranking shuffle.
    """
    m.require_numeric(df, *columns)
    kept = [m.col(k).alias(f"key_{i}") for i, k in enumerate(keys)]
    if len(columns) == 1:
        values = df.select(*kept, F.lit(columns[0]).alias("column"), m.number(df, columns[0]).alias("x"))
    else:
        wide = df.select(*kept, *[m.number(df, c).alias(c) for c in columns])
        ids = [F.col(f"key_{i}") for i in range(len(keys))]
        values = wide.unpivot(ids, [m.col(c) for c in columns], "column", "x")
    lower, upper = F.col("lower"), F.col("upper")
    outside = values.join(F.broadcast(_bounds(df, columns, None)), "column").where(_beyond())
    distance = F.greatest(lower - F.col("x"), F.col("x") - upper)
    order = [F.desc("distance"), *[F.asc(f"key_{i}") for i in range(len(keys))]]
    ranked = outside.withColumn("distance", distance).withColumn(
        "rank", F.row_number().over(Window.partitionBy("column").orderBy(*order))
    )
    named = [F.col(f"key_{i}").alias(k) for i, k in enumerate(keys)]
    return ranked.where(F.col("rank") <= limit).select("column", "rank", *named, stat(F.col("x")).alias("x"), stat(F.col("distance")).alias("distance"))


def daily_counts(df: DataFrame, columns: list[str] | None = None, latest: int = LATEST_DAYS) -> DataFrame:
    """(column, day, n): rows per calendar day for each datetime column, its latest days only.

    A column with fewer than two dates is left out; days without rows are not filled in.
    """
    if latest < 2:
        raise ValueError("ask for two days or more")
    columns = columns or m.columns_with_role(df, m.DATETIME)
    days = df.select(*[m.instant(df, c).cast("date").alias(c) for c in columns])
    if len(columns) == 1:
        long = days.select(F.lit(columns[0]).alias("column"), m.col(columns[0]).alias("day"))
    else:
        long = days.unpivot([], [m.col(c) for c in columns], "column", "day")
    counted = long.where("day is not null").groupBy("column", "day").agg(F.count("*").alias("n"))
    newest = Window.partitionBy("column").orderBy(F.desc("day"))
    tail = counted.withColumn("back", F.row_number().over(newest)).where(F.col("back") <= latest)
    return tail.withColumn("rows", F.sum("n").over(Window.partitionBy("column"))).where("rows >= 2").select("column", "day", "n")
