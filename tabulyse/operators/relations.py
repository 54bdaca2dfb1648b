"""How columns relate: correlation, scatter samples, linear what-if."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulyse.functions import missing as m
from tabulyse.functions.hashing import keyed_md5
from tabulyse.functions.stats import pearson, stat
from tabulyse.operators import cross_products
from tabulyse.session import small_table

CORRELATED_COLUMNS = 15
WIDE = 24  # columns; up to here one aggregate of plain sums compiles well and is faster
SCATTER_POINTS = 500
SCATTER_SEED = 42
WHAT_IF_ROWS = 8
_NEAR_ZERO = 1e-8
_ROUNDING = "1e-14D"


@dataclass(frozen=True)
class _Column:
    """What one light aggregate says about a column before pairs are formed."""

    name: str
    mean: float
    variance: float
    varies: bool
    gaps: bool


def _survey(df: DataFrame, names: list[str], keep: int | None) -> list[_Column]:
    """The columns to correlate: all of them, or the ones with the largest variance, largest first."""
    if len(names) > WIDE:
        rows = {r.i: r for r in cross_products.moments(df, names).collect()}
        found = [_Column(c, r.mean, r.variance, r.low < r.high, r.n < r.total) if (r := rows.get(i)) else _Column(c, None, None, False, False) for i, c in enumerate(names)]
    elif not names:
        return []
    else:
        measures = []
        for i, c in enumerate(names):
            x = m.number(df, c)
            facts = {"mean": F.avg(x), "variance": F.var_samp(x), "varies": F.min(x) < F.max(x), "gaps": F.count(x) < F.count(F.lit(1))}
            measures.append(F.struct(*[f.alias(k) for k, f in facts.items()]).alias(str(i)))
        row = df.agg(*measures).first()
        found = [_Column(c, row[i].mean, row[i].variance, bool(row[i].varies), bool(row[i].gaps)) for i, c in enumerate(names)]
    if keep is None or len(found) <= keep:
        return found
    known = [c for c in found if c.variance is not None and c.variance == c.variance]
    return sorted(known, key=lambda c: -c.variance)[:keep]


def _pair_r(x: str, y: str, x_gaps: bool, y_gaps: bool) -> Column:
    """Pearson correlation of two centred columns over the rows where both are present.

    A sum over one column alone serves every pair whose other column has no gaps; Spark computes equal
    sums once. So 15 columns without gaps take about 150 plain sums. What is left of a sum of squares
    that is constant over the common rows is rounding, and such a pair has no correlation.
    """
    xs = f"if({y} is null, null, {x})" if y_gaps else x
    ys = f"if({x} is null, null, {y})" if x_gaps else y

    def spread(v: str) -> str:
        return f"(sum({v} * {v}) - sum({v}) * sum({v}) / count({xs}))"

    varies = f"{spread(xs)} > sum({xs} * {xs}) * {_ROUNDING} and {spread(ys)} > sum({ys} * {ys}) * {_ROUNDING}"
    shared = f"sum({x} * {y}) - sum({xs}) * sum({ys}) / count({xs})"
    r = f"try_divide({shared}, sqrt({spread(xs)}) * sqrt({spread(ys)}))"
    return F.expr(f"case when count({xs}) > 1 then case when {varies} then {r} end end")


def _pairs(df: DataFrame, columns: list[_Column]) -> DataFrame:
    """(i, j, column_a, column_b, r) for a before b: pairwise-complete, all pairs in one aggregate or, of many columns, by blocks."""
    if len(columns) > WIDE:
        return _pairs_by_blocks(df, [c.name for c in columns], [c.mean for c in columns])
    centred = df.select(*[(m.number(df, c.name) - F.lit(c.mean)).alias(f"c{i}") for i, c in enumerate(columns)])
    entries = [
        F.struct(
            F.lit(i).alias("i"),
            F.lit(j).alias("j"),
            F.lit(columns[i].name).alias("column_a"),
            F.lit(columns[j].name).alias("column_b"),
            _pair_r(f"c{i}", f"c{j}", columns[i].gaps, columns[j].gaps).alias("r"),
        )
        for i, j in combinations(range(len(columns)), 2)
    ]
    pairs = centred.agg(F.array(*entries).alias("e")).select(F.inline("e"))
    return pairs.withColumn("r", F.coalesce(stat(F.col("r")), F.lit(0.0)))


def _pairs_by_blocks(df: DataFrame, names: list[str], centres: list[float | None] | None) -> DataFrame:
    sums = cross_products.pair_sums(df, names, centres)

    def spread(v: str) -> Column:
        return F.col(v + v) - F.col(v) * F.col(v) / F.col("n")

    varies = (spread("x") > F.col("xx") * F.expr(_ROUNDING)) & (spread("y") > F.col("yy") * F.expr(_ROUNDING))
    r = F.try_divide(F.col("xy") - F.col("x") * F.col("y") / F.col("n"), F.sqrt(spread("x")) * F.sqrt(spread("y")))
    called = F.array(*[F.lit(n) for n in names])
    spelled = [F.get(called, F.col(k).cast("int")).alias(f"column_{s}") for k, s in (("i", "a"), ("j", "b"))]
    own = F.when(F.col("n") > 1, F.when(varies, r))
    return sums.select(F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), *spelled, F.coalesce(stat(own), F.lit(0.0)).alias("r"))


def correlation_matrix(df: DataFrame, columns: list[str] | None = None, keep: int = CORRELATED_COLUMNS) -> DataFrame:
    """(row, col, column_a, column_b, r): the full matrix in long form; an undefined r is 0.

    Needs two numeric columns, else it is empty. Above ``keep`` columns the ones with the largest
    variance stay, in that order. Means and variances take one pass when the function is called. More than ``WIDE`` columns
    are correlated by blocks.
    """
    chosen = _survey(df, columns or m.numeric_columns(df), keep)
    schema = "row int, col int, column_a string, column_b string, r double"
    if len(chosen) < 2:
        return small_table(df.sparkSession, [], schema)
    sides = F.array(
        F.struct(F.col("i").alias("row"), F.col("j").alias("col"), "column_a", "column_b", "r"),
        F.struct(F.col("j").alias("row"), F.col("i").alias("col"), F.col("column_b").alias("column_a"), F.col("column_a").alias("column_b"), "r"),
    )
    # A column correlates with itself unless it is constant.
    own = [(i, i, c.name, c.name, float(c.varies)) for i, c in enumerate(chosen)]
    return _pairs(df, chosen).select(F.inline(sides)).unionByName(small_table(df.sparkSession, own, schema))


def top_correlations(df: DataFrame, columns: list[str] | None = None, n: int = 10, keep: int | None = None) -> DataFrame:
    """(column_a, column_b, strength, r): the n pairs with the largest absolute correlation, over all columns.

    ``keep`` limits them to that many columns, those with the largest variance. More than ``WIDE`` columns that all stay
    take one pass.
    """
    names = columns or m.numeric_columns(df)
    if len(names) > WIDE and (keep is None or len(names) <= keep):
        return strongest(_pairs_by_blocks(df, names, None), n)
    chosen = _survey(df, names, keep)
    if len(chosen) < 2:
        return small_table(df.sparkSession, [], "column_a string, column_b string, strength double, r double")
    return strongest(_pairs(df, chosen), n)


def strongest(pairs: DataFrame, n: int) -> DataFrame:
    """The n pairs of (column_a, column_b, r) with the largest absolute r, ties by name."""
    sized = pairs.select("column_a", "column_b", F.abs("r").alias("strength"), "r")
    return sized.orderBy(F.desc("strength"), "column_a", "column_b").limit(n)


def scatter_sample(
    df: DataFrame, x: str, y: str, keys: list[str], max_points: int = SCATTER_POINTS, seed: int = SCATTER_SEED
) -> DataFrame:
    """(keys..., x, y): up to ``max_points`` complete pairs, the same ones whatever the partitioning.

    Rows are ordered by a hash of seed and key and the first ones kept, so every task forwards at most
    ``max_points`` rows.
    """
    m.require_numeric(df, x, y)
    ids = [m.col(k).alias(k) for k in keys]
    lot = keyed_md5(seed, *[m.col(k) for k in keys])
    complete = df.where(m.present(df, x, y)).select(*ids, stat(m.number(df, x)).alias("x"), stat(m.number(df, y)).alias("y"), lot.alias("lot"))
    return complete.orderBy("lot", *[m.col(k) for k in keys]).limit(max_points).drop("lot")


def scatter_samples(
    df: DataFrame, pairs: list[tuple[str, str]], keys: list[str], max_points: int = SCATTER_POINTS, seed: int = SCATTER_SEED
) -> DataFrame:
    """(column_a, column_b, keys..., x, y): what ``scatter_sample`` finds for each of the pairs, in one pass over the table."""
    m.require_numeric(df, *{c for pair in pairs for c in pair})
    ids = [m.col(k).alias(k) for k in keys]
    points = [
        F.when(m.present(df, a, b), F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), stat(m.number(df, a)).alias("x"), stat(m.number(df, b)).alias("y")))
        for a, b in pairs
    ]
    each = df.select(*ids, keyed_md5(seed, *[m.col(k) for k in keys]).alias("lot"), F.inline(F.array_compact(F.array(*points))))
    first = Window.partitionBy("column_a", "column_b").orderBy("lot", *[m.col(k) for k in keys])
    kept = each.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= max_points)
    return kept.select("column_a", "column_b", *[m.col(k) for k in keys], "x", "y")


def what_if(df: DataFrame, target: str, driver: str, change_pct: float | list[float], zero_fill: bool = False) -> DataFrame:
    """One row per change: what a straight-line fit says happens to the target when the driver's mean moves.

    (target, driver, change_pct, baseline_driver, baseline_target, simulated_driver, simulated_target,
    target_delta, target_delta_pct, direction, slope, intercept, correlation, confidence, sample_size,
    status). Below eight complete rows, or with a driver that hardly varies, only the status is filled.
    """
    m.require_numeric(df, target, driver)
    changes = change_pct if isinstance(change_pct, list) else [change_pct]
    x, y = F.col("x"), F.col("y")
    complete = df.where(m.present(df, target, driver)).select(m.number(df, driver).alias("x"), m.number(df, target).alias("y"))
    fit = complete.agg(
        F.count("*").alias("sample_size"),
        F.avg("x").alias("x_mean"),
        F.stddev_pop("x").alias("x_spread"),
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        pearson(x, y).alias("correlation"),
    )
    few = F.col("sample_size") < WHAT_IF_ROWS
    flat = F.coalesce(F.col("x_spread"), F.lit(0.0)) <= _NEAR_ZERO
    status = F.when(few, "few_rows").when(flat, "flat_driver").otherwise("ok")
    swept = fit.withColumn("status", status).withColumn("change", F.explode(F.array(*[F.lit(float(c)) for c in changes])))
    moved = F.col("x_mean") * (1 + F.col("change") / 100)
    base, after = F.col("intercept") + F.col("slope") * F.col("x_mean"), F.col("intercept") + F.col("slope") * moved
    delta = after - base
    relative = F.when(F.abs(base) <= _NEAR_ZERO, F.lit(0.0)).otherwise(F.try_divide(delta, base) * 100)
    correlation = F.coalesce(F.col("correlation"), F.lit(0.0))
    numbers = {
        "baseline_driver": F.col("x_mean"),
        "baseline_target": base,
        "simulated_driver": moved,
        "simulated_target": after,
        "target_delta": delta,
        "target_delta_pct": relative,
        "slope": F.col("slope"),
        "intercept": F.col("intercept"),
        "correlation": correlation,
        "confidence": F.least(F.abs(correlation), F.lit(1.0)),
    }
    good = F.col("status") == "ok"
    return swept.select(
        F.lit(target).alias("target"),
        F.lit(driver).alias("driver"),
        F.round("change", 3).alias("change_pct"),
        *[F.when(good, stat(c, zero_fill=zero_fill)).alias(name) for name, c in numbers.items()],
        F.when(good, F.when(delta >= 0, "increase").otherwise("decrease")).alias("direction"),
        "sample_size",
        "status",
    )
