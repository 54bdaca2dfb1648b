"""The profile report: nine sections over one table."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulyse.functions import missing as m
from tabulyse.functions.stats import stat
from tabulyse.operators.distribution import against_fences, box_plot, histogram, outliers_iqr
from tabulyse.operators.profile import column_profile, dataset_summary, moments, numeric_stats, top_values
from tabulyse.operators.quantiles import quartiles
from tabulyse.operators.relations import correlation_matrix, scatter_samples, strongest
from tabulyse.session import small_table, written


@dataclass(frozen=True)
class ReportLimits:
    """How much each section shows; None is all. Columns count in the order of the table."""

    bins: int = 25
    histograms: int | None = 4
    bar_charts: int | None = 3
    bar_values: int = 8
    pie_values: int = 8
    correlated: int | None = 15
    correlation_pairs: int | None = 10
    scatters: int = 3
    boxes: int | None = 6
    outlier_columns: int | None = 10
    categoricals: int | None = 6
    categorical_values: int = 5

    @classmethod
    def whole(cls) -> ReportLimits:
        """Every column in every section."""
        every = ("histograms", "bar_charts", "correlated", "correlation_pairs", "boxes", "outlier_columns", "categoricals")
        return cls(**dict.fromkeys(every))


def profile_report(df: DataFrame, keys: list[str], limits: ReportLimits = ReportLimits()) -> dict[str, DataFrame]:
    """The sections of the report by name. ``keys`` identify a row for the scatter samples.

    A section a table has no columns for is left out. What several sections show is found once, when the function is called:
    moments, quartiles, fences, correlations and frequent values, in written tables of a few rows per column. The sections
    themselves read the table once for the histograms, once for the scatters, and for the summary and the columns, which read
    different columns each. Whoever wants it cached persists it first.
    """
    numerics = m.numeric_columns(df)
    categoricals = m.columns_with_role(df, m.CATEGORICAL, m.BOOLEAN)
    sections = {"summary": dataset_summary(df), "columns": column_profile(df)}
    if numerics:
        middle = quartiles(df, numerics)
        facts = written(moments(df, numerics), "report")
        sections["numeric_stats"] = numeric_stats(df, numerics, middle=middle, facts=facts)
        bins = histogram(df, numerics[: limits.histograms], limits.bins, extent=facts.select("column", F.col("low").alias("a"), F.col("high").alias("b")))
        sections["histograms"] = bins.withColumns({edge: stat(F.col(edge)) for edge in ("lo", "hi")})
    if categoricals:
        tops = written(top_values(df, categoricals, max(limits.bar_values, limits.pie_values + 1, limits.categorical_values)), "report")
        bars, listed = categoricals[: limits.categoricals][: limits.bar_charts], categoricals[: limits.categoricals]
        sections["bar_charts"] = tops.where(F.col("column").isin(bars) & (F.col("rank") <= limits.bar_values))
        sections["pie_chart"] = _pie(tops, categoricals, limits.pie_values)
    if len(numerics) >= 2:
        matrix = correlation_matrix(df, keep=len(numerics) if limits.correlated is None else limits.correlated)
        # One number for each pair of the columns asked for, wanted three times over.
        known = small_table(df.sparkSession, [tuple(r) for r in matrix.collect()], "row int, col int, column_a string, column_b string, r double")
        pairs = known.where("row < col")
        sections["correlation"] = known
        sections["top_correlations"] = strongest(pairs, len(numerics) ** 2 if limits.correlation_pairs is None else limits.correlation_pairs)
        sections["scatters"] = _scatters(df, strongest(pairs, limits.scatters), keys)
    if numerics:
        boxes, outside = numerics[: limits.boxes], numerics[: limits.outlier_columns]
        fenced = written(against_fences(df, max(boxes, outside, key=len), middle), "report")
        sections["box_plots"] = box_plot(df, boxes, fenced=fenced)
        sections["outliers"] = outliers_iqr(df, outside, fenced=fenced)
    if categoricals:
        sections["categoricals"] = tops.where(F.col("column").isin(listed) & (F.col("rank") <= limits.categorical_values))
    return sections


def _pie(tops: DataFrame, categoricals: list[str], most: int) -> DataFrame:
    """All values of the first categorical column that has few."""
    order = F.element_at(F.create_map(*[x for i, c in enumerate(categoricals) for x in (F.lit(c), F.lit(i))]), F.col("column"))
    sized = tops.groupBy("column").agg(F.max("rank").alias("values")).where(F.col("values") <= most)
    return tops.join(sized.orderBy(order).limit(1).select("column"), "column")


def _scatters(df: DataFrame, pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Samples of a few pairs of columns."""
    points = scatter_samples(df, [(p.column_a, p.column_b) for p in pairs.collect()], keys)
    return points.select("column_a", "column_b", F.concat_ws("/", *[m.col(k).cast("string") for k in keys]).alias("key"), "x", "y")


def _melted(section: str, df: DataFrame, item: list[str], metrics: list[str]) -> DataFrame:
    """(section, item, metric, value) with every value as text."""
    name = F.concat_ws("/", *[m.col(c).cast("string") for c in item]) if item else F.lit("table")
    entries: list[Column] = [F.struct(F.lit(c).alias("metric"), m.col(c).cast("string").alias("value")) for c in metrics]
    return df.select(F.lit(section).alias("section"), name.alias("item"), F.inline(F.array(*entries)))


def report_long(df: DataFrame, keys: list[str], limits: ReportLimits = ReportLimits()) -> DataFrame:
    """The whole report as one table (section, item, metric, value)."""
    identity = {
        "summary": [],
        "columns": ["column"],
        "numeric_stats": ["column"],
        "histograms": ["column", "bin"],
        "bar_charts": ["column", "rank"],
        "pie_chart": ["column", "rank"],
        "correlation": ["column_a", "column_b"],
        "top_correlations": ["column_a", "column_b"],
        "scatters": ["column_a", "column_b", "key"],
        "box_plots": ["column"],
        "outliers": ["column"],
        "categoricals": ["column", "rank"],
    }
    parts = []
    for section, table in profile_report(df, keys, limits).items():
        item = identity[section]
        parts.append(_melted(section, table, item, [c for c in table.columns if c not in item]))
    return reduce(DataFrame.unionByName, parts)
