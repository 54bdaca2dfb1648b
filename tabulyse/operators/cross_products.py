"""Moments and cross products of many columns, block by block, as matrix products inside Arrow batches.

One expression per pair of columns stops compiling at a few dozen columns. Here every task turns its batches into matrices
and adds up their products; what it emits at its end is one row per column or pair of a block, whatever the number of rows,
and Spark sums those. A pass holds the products of two blocks of ``BLOCK_COLUMNS`` columns and reads these columns only, so
memory does not grow with the width of the table.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulyse.functions import missing as m

# Ship this module with the functions, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK_COLUMNS = 256


def _matrix(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Values with 0 where there is none, and whether there is one, as floats."""
    there = np.column_stack([np.asarray(c.is_valid()) for c in batch.columns]) if batch.num_columns else np.zeros((0, 0), bool)
    values = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float, copy=False) for c in batch.columns])
    return np.where(there, values, 0.0), there.astype(float)


def moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """(i, total, n, mean, variance, low, high) of every column, i counting from 0; ``total`` counts all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, state = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            x, there = _matrix(batch)
            n = there.sum(0)
            with np.errstate(invalid="ignore", divide="ignore"):
                mean = np.where(n > 0, x.sum(0) / n, 0.0)
                spread = (np.where(there > 0, x - mean, 0.0) ** 2).sum(0)
                low, high = np.where(there > 0, x, np.inf).min(0), np.where(there > 0, x, -np.inf).max(0)
                if state is not None:  # two means and spreads make one
                    n0, mean0, spread0, low0, high0 = state
                    both, gap = n + n0, mean - mean0
                    share = np.where(both > 0, n / both, 0.0)
                    mean, spread = mean0 + gap * share, spread + spread0 + np.where(both > 0, gap * gap * n0 * share, 0.0)
                    n, low, high = both, np.minimum(low, low0), np.maximum(high, high0)
            state, total = (n, mean, spread, low, high), total + batch.num_rows
        if state is not None:
            n, mean, spread, low, high = state
            fields = [np.arange(len(n)), np.full(len(n), total), n.astype(np.int64), mean, spread, low, high]
            yield pa.RecordBatch.from_arrays([pa.array(f) for f in fields], names)

    names = ["i", "total", "n", "mean", "spread", "low", "high"]
    numbers = df.select(*[m.number(df, c).alias(f"c{i}") for i, c in enumerate(columns)])
    parts = numbers.mapInArrow(run, "i long, total long, n long, mean double, spread double, low double, high double")
    same = Window.partitionBy("i")
    centre = F.sum(F.col("mean") * F.col("n")).over(same) / F.greatest(F.sum("n").over(same), F.lit(1))
    placed = parts.withColumn("centre", centre).withColumn("moved", F.col("spread") + F.col("n") * (F.col("mean") - F.col("centre")) * (F.col("mean") - F.col("centre")))
    found = placed.groupBy("i").agg(*[F.sum(c).alias(c) for c in ("total", "n", "moved")], F.max("centre").alias("mean"), F.min("low").alias("low"), F.max("high").alias("high"))
    variance = F.when(F.col("n") > 1, F.col("moved") / (F.col("n") - 1))
    return found.select("i", "total", "n", F.when(F.col("n") > 0, F.col("mean")).alias("mean"), variance.alias("variance"), "low", "high")


def _centred(batch: pa.RecordBatch, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values less their centre by column, 0 where there is none; the different patterns of gaps, as floats; each column's pattern.

    NULL and NaN are gaps. A centre that is NaN is set to the value next to the mean, so that a constant column is all 0.
    """
    values, patterns, which = np.empty((batch.num_columns, batch.num_rows)), {}, []
    full = np.ones(batch.num_rows, bool).tobytes()
    for k, c in enumerate(batch.columns):
        row = values[k]
        row[:] = c.to_numpy(zero_copy_only=False)
        there = ~np.isnan(row)
        gaps = not there.all()
        which.append(patterns.setdefault(there.tobytes() if gaps else full, len(patterns)))
        if np.isnan(centres[k]):
            known = row[there & np.isfinite(row)]
            if len(known):
                centres[k] = known[np.argmin(np.abs(known - known.mean()))]
        row -= np.nan_to_num(centres[k])
        if gaps:
            row[~there] = 0.0
    return values, np.array([np.frombuffer(p, bool) for p in patterns], float), np.array(which)


def pair_sums(df: DataFrame, columns: list[str], centres: list[float | None] | None, block: int = BLOCK_COLUMNS) -> DataFrame:
    """(i, j, n, x, y, xx, yy, xy) for i before j: sums over the rows where both columns have a value, of values less
    their centre. Without centres every task takes its own, and the sums are moved to the mean of those: one pass does."""
    blocks = [range(k, min(k + block, len(columns))) for k in range(0, len(columns), block)]
    parts = reduce(DataFrame.unionAll, [_block_pair(df, columns, centres, a, b) for k, a in enumerate(blocks) for b in blocks[k:]])
    if centres is None:
        parts = _same_centre(parts)
    sums = parts.groupBy("i", "j")
    return sums.agg(*[F.sum(c).alias(c) for c in ("n", "x", "y", "xx", "yy", "xy")])


def _same_centre(parts: DataFrame) -> DataFrame:
    """The sums of each pair about the mean of the centres of its parts, weighted by their rows."""
    same = Window.partitionBy("i", "j")
    n = F.greatest(F.sum("n").over(same), F.lit(1))
    off = parts.withColumns({f"d{s}": F.col(f"c{s}") - F.sum(F.col("n") * F.col(f"c{s}")).over(same) / n for s in "xy"})
    plain = ["x + n * dx as x", "y + n * dy as y"]
    squares = [f"{s}{s} + 2 * d{s} * {s} + n * d{s} * d{s} as {s}{s}" for s in "xy"]
    return off.selectExpr("i", "j", "n", *plain, *squares, "xy + dx * y + dy * x + n * dx * dy as xy")


def _block_pair(df: DataFrame, columns: list[str], centres: list[float | None] | None, left: range, right: range) -> DataFrame:
    wanted = list(left) if left == right else [*left, *right]
    m.require_numeric(df, *[columns[i] for i in wanted])
    numbers = df.select(*[m.col(columns[i]).cast("double").alias(f"c{i}") for i in wanted])
    # The places of the pairs in a matrix of left by right, and their columns.
    at_left, at_right = np.triu_indices(len(left), 1) if left == right else map(np.ravel, np.indices((len(left), len(right))))
    i, j = np.array(left)[at_left], np.array(right)[at_right]
    a, b = slice(0, len(left)), slice(0 if left == right else len(left), len(wanted))
    given = np.array([np.nan if centres is None else centres[i] or 0.0 for i in wanted])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, own = None, given.copy()
        for batch in batches:
            if not batch.num_rows:
                continue
            with np.errstate(invalid="ignore", over="ignore"):
                values, gaps, which = _centred(batch, own)
                # Sums of one column over the rows where another has a value differ by the pattern of the other's gaps only.
                both, once, squares = gaps @ gaps.T, values @ gaps.T, (values * values) @ gaps.T
                l, r = which[a], which[b]
                new = [both[l][:, r], once[a][:, r], once[b][:, l].T, squares[a][:, r], squares[b][:, l].T, values[a] @ values[b].T]
            sums = new if sums is None else [x + y for x, y in zip(sums, new)]
        if sums is not None:
            n, *rest = (s[at_left, at_right] for s in sums)
            own = np.nan_to_num(own)
            centre = [own[a][at_left], own[b][at_right]]
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(n.astype(np.int64)), *map(pa.array, rest), *map(pa.array, centre)], names)

    names = ["i", "j", "n", "x", "y", "xx", "yy", "xy", "cx", "cy"]
    return numbers.mapInArrow(run, "i long, j long, n long, x double, y double, xx double, yy double, xy double, cx double, cy double")
