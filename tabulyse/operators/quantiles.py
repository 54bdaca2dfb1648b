"""Exact quantiles without sorting or collecting a column.

``percentile`` keeps every distinct value of a column in one task. Here the wanted order statistics are
narrowed down instead: each pass counts the values in cells that keep their order (a partial aggregate
with a bounded number of groups, so next to nothing is shuffled), finds the cell every wanted rank falls
into, and the next pass looks only inside those cells. The first pass cuts by relative size, so outliers
do not stretch the cells; later passes cut a cell into equal widths, or into its single values once it
holds few rows. Cells shrink to neighbouring doubles after four passes; most columns are done after two.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulyse.functions.missing import col, comparable, number
from tabulyse.session import small_table

CELLS_PER_E = 128
CELLS_PER_PASS = 65_536
VALUES_PER_PASS = 100_000
_ZERO_OFFSET = 100_000  # above 128 * ln of the largest and smallest double
_INFINITE_CELL = 1_000_000
_CELLS_PUSHED = 64  # up to this many cells the scan is asked to skip what lies outside all of them


@dataclass(frozen=True)
class _Wanted:
    """One wanted order statistic: the value at ``rank`` among the values of a column in [lo, hi]."""

    column: str
    overall: int
    rank: int
    lo: float
    hi: float
    rows: int


def numeric_long(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, x) for every present numeric value, in one pass over the needed columns."""
    doubles = df.select(*[number(df, c).alias(c) for c in columns])
    if len(columns) == 1:
        long = doubles.select(F.lit(columns[0]).alias("column"), col(columns[0]).alias("x"))
    else:
        long = doubles.unpivot([], [col(c) for c in columns], "column", "x")
    return long.where("x is not null")


def _relative_cell(x: Column) -> Column:
    """A cell number that grows with x: about 0.8 % of the value wide, whatever the magnitude."""
    size = F.floor(F.ln(F.abs(x)) * CELLS_PER_E) + _ZERO_OFFSET
    size = F.when(F.abs(x) == float("inf"), F.lit(_INFINITE_CELL)).otherwise(size)
    return F.when(x == 0, F.lit(0)).otherwise(F.signum(x).cast("int") * size).cast("bigint")


def _locate(cells: DataFrame, group: list[str], order: list[str], ranks: DataFrame) -> list:
    """The cell each wanted rank falls into. ``cells`` is small: one row per occupied cell."""
    ahead = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = cells.withColumn("below", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
    found = placed.join(F.broadcast(ranks), group).where("rank >= below and rank < below + n")
    return found.select(*group, "overall", (F.col("rank") - F.col("below")).alias("rank"), "n", "lo", "hi").collect()


def _first_pass(values: DataFrame) -> DataFrame:
    cells = values.groupBy("column", _relative_cell(F.col("x")).alias("cell"))
    return cells.agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))


def _within(df: DataFrame, column: str, lo: float, hi: float) -> Column:
    (x, low), (_, high) = comparable(df, column, lo), comparable(df, column, hi)
    return (x >= low) & (x <= high)


def _narrow(df: DataFrame, wanted: list[_Wanted]) -> list[_Wanted]:
    spark = df.sparkSession
    columns = sorted({w.column for w in wanted})
    cells = sorted({(w.column, w.lo, w.hi, w.rows) for w in wanted})
    rows = df
    if len(cells) <= _CELLS_PUSHED:
        rows = df.where(reduce(lambda a, b: a | b, [_within(df, c, lo, hi) for c, lo, hi, _ in cells]))
    values = numeric_long(rows, columns)
    bounds = small_table(spark, cells, "c string, c_lo double, c_hi double, c_rows bigint")
    hit = values.join(
        F.broadcast(bounds),
        (F.col("column") == F.col("c")) & F.col("x").between(F.col("c_lo"), F.col("c_hi")),
    )
    few = F.col("c_rows") <= VALUES_PER_PASS
    step = F.floor((F.col("x") - F.col("c_lo")) / (F.col("c_hi") - F.col("c_lo")) * CELLS_PER_PASS)
    cut = hit.groupBy(
        "column",
        "c_lo",
        F.when(~few, F.least(step, F.lit(CELLS_PER_PASS - 1))).alias("bin"),
        F.when(few, F.col("x")).alias("exact"),
    ).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    ranks = small_table(
        spark,
        [(w.column, w.lo, w.overall, w.rank) for w in wanted],
        "column string, c_lo double, overall bigint, rank bigint",
    )
    found = _locate(cut, ["column", "c_lo"], ["bin", "exact"], ranks)
    return [_Wanted(r["column"], r.overall, r["rank"], r.lo, r.hi, r.n) for r in found]


def quantiles(df: DataFrame, columns: list[str], probs: list[float]) -> DataFrame:
    """(column, p, value, n): exact quantiles with linear interpolation, n present values.

    Runs one job per pass while it is called; what reaches the driver is two numbers per column and
    quantile. A column without values gets NULLs.
    """
    if any(not 0 <= p <= 1 for p in probs):
        raise ValueError("quantiles lie between 0 and 1")
    positions = [F.lit(float(p)) * (F.col("total") - 1) for p in probs]
    found, sizes = _order_statistics(df, columns, [edge(at) for at in positions for edge in (F.floor, F.ceil)])
    rows = []
    for column in columns:
        n = sizes.get(column, 0)
        for p in probs:
            rows.append((column, float(p), _interpolate(found, column, n, p), n))
    return small_table(df.sparkSession, rows, "column string, p double, value double, n bigint")


def approx_quantiles(df: DataFrame, columns: list[str], probs: list[float], accuracy: int = 10_000) -> DataFrame:
    """The same in one pass from a sketch: each value's rank is off by at most n / accuracy."""
    asked = F.array(*[F.lit(float(p)) for p in probs])
    entries = []
    for c in columns:
        x = number(df, c)
        values = F.arrays_zip(asked.alias("p"), F.percentile_approx(x, asked, accuracy).alias("value"))
        entries.append(F.struct(F.lit(c).alias("column"), F.count(x).alias("n"), values.alias("q")))
    rows = df.agg(F.array(*entries).alias("e")).select(F.inline("e"))
    return rows.select("column", "n", F.inline("q").alias("p", "value")).select("column", "p", "value", "n")


def quartiles(df: DataFrame, columns: list[str], accuracy: int | None = None) -> DataFrame:
    """One row per column: n, q1, median, q3; exact, or approximate with the given accuracy."""
    probs = [0.25, 0.5, 0.75]
    q = quantiles(df, columns, probs) if accuracy is None else approx_quantiles(df, columns, probs, accuracy)
    at = {p: F.max(F.when(F.col("p") == p, F.col("value"))) for p in (0.25, 0.5, 0.75)}
    return q.groupBy("column").agg(
        F.max("n").alias("n"), at[0.25].alias("q1"), at[0.5].alias("median"), at[0.75].alias("q3")
    )


def value_at_rank(df: DataFrame, column: str, rank: int) -> tuple[float, int, int] | None:
    """The value at a position (from 0) of a sorted column, how many are smaller and how many equal.

    None when the column has no such position.
    """
    found, _ = _order_statistics(df, [column], [F.lit(rank)])
    if (column, rank) not in found:
        return None
    at = found[column, rank]
    x = number(df, column)
    around = df.agg(F.count_if(x < at).alias("below"), F.count_if(x == at).alias("tied")).first()
    return at, around.below, around.tied


def _interpolate(found: dict[tuple[str, int], float], column: str, n: int, p: float) -> float | None:
    if n == 0:
        return None
    position = (n - 1) * p
    low, high = found[column, math.floor(position)], found[column, math.ceil(position)]
    share = position - math.floor(position)
    return low if low == high else low * (1.0 - share) + high * share


def _order_statistics(
    df: DataFrame, columns: list[str], ranks: list[Column]
) -> tuple[dict[tuple[str, int], float], dict[str, int]]:
    """Values by (column, rank), and the number of values per column; ranks may refer to ``total``."""
    group = Window.partitionBy("column")
    running = group.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        _first_pass(numeric_long(df, columns))
        .withColumn("total", F.sum("n").over(group))
        .withColumn("below", F.coalesce(F.sum("n").over(running), F.lit(0)))
    )
    asked = F.array_distinct(F.array(*[r.cast("bigint") for r in ranks]))
    hits = placed.select("*", F.explode(asked).alias("overall")).where("overall >= below and overall < below + n")
    wanted, sizes = [], {}
    for r in hits.collect():
        sizes[r["column"]] = r.total
        wanted.append(_Wanted(r["column"], r.overall, r.overall - r.below, r.lo, r.hi, r.n))
    found = {}
    while wanted:
        found.update({(w.column, w.overall): w.lo for w in wanted if w.lo == w.hi})
        wanted = [w for w in wanted if w.lo != w.hi]
        wanted = _narrow(df, wanted) if wanted else []
    return found, sizes
