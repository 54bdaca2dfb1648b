"""What is in the table: summary, columns, statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulyse.functions import missing as m
from tabulyse.functions.labels import bytes_label
from tabulyse.functions.stats import percent, sample_skewness, stat
from tabulyse.operators.quantiles import quartiles
from tabulyse.operators.value_counts import (
    approx_distinct_and_missing,
    as_text,
    distinct_and_missing,
    duplicate_rows,
    top_values,
)

_WIDTH = {
    T.BooleanType: 1,
    T.ByteType: 1,
    T.ShortType: 2,
    T.IntegerType: 4,
    T.LongType: 8,
    T.FloatType: 4,
    T.DoubleType: 8,
    T.DateType: 4,
    T.TimestampType: 8,
    T.TimestampNTZType: 8,
}


def _value_bytes(df: DataFrame, name: str) -> Column:
    """Bytes held by the present values of a column: fixed width, or the length of the text."""
    dtype = m.field(df, name).dataType
    if isinstance(dtype, T.DecimalType):
        return F.count(m.col(name)) * (8 if dtype.precision <= 18 else 16)
    width = _WIDTH.get(type(dtype))
    if width:
        return F.count(m.col(name)) * width
    size = F.octet_length(m.col(name)) if isinstance(dtype, (T.StringType, T.BinaryType)) else F.octet_length(as_text(df, name))
    return F.coalesce(F.sum(size.cast("bigint")), F.lit(0))


def _total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns, F.lit(0).cast("bigint"))


def data_bytes(df: DataFrame) -> DataFrame:
    """(column, bytes, label): an estimate of the uncompressed size, from one aggregate."""
    entries = [F.struct(F.lit(c).alias("column"), _value_bytes(df, c).alias("bytes")) for c in df.columns]
    rows = df.agg(F.array(*entries).alias("e")).select(F.inline("e"))
    return rows.withColumn("label", bytes_label(F.col("bytes")))


def dataset_summary(df: DataFrame, approx: bool = False) -> DataFrame:
    """One row: size, column counts by role, missing cells, duplicate rows; with ``approx`` the duplicates are estimated, and
    nothing but sketches is shuffled."""
    width = len(df.columns)
    counted = df.agg(
        F.count("*").alias("rows"),
        _total([F.count_if(m.missing(df, c)) for c in df.columns]).alias("missing_values"),
        _total([_value_bytes(df, c) for c in df.columns]).alias("data_bytes"),
    )
    copies = duplicate_rows(df, approx).select("duplicates")
    # Two tables of one row each, side by side.
    both = counted.unionByName(copies, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns]).select(
        "rows",
        F.lit(width).cast("bigint").alias("columns"),
        F.lit(len(m.numeric_columns(df))).cast("bigint").alias("numeric_columns"),
        F.lit(len(m.columns_with_role(df, m.CATEGORICAL))).cast("bigint").alias("categorical_columns"),
        "missing_values",
        percent(F.col("missing_values"), F.col("rows") * width).alias("missing_pct"),
        "duplicates",
        "data_bytes",
        bytes_label(F.col("data_bytes")).alias("size_label"),
    )


def column_types(df: DataFrame, sniff_text: bool = False) -> dict[str, tuple[str, str]]:
    """column -> (type name, role)."""
    roles = m.column_roles(df, sniff_text)
    return {f.name: (f.dataType.simpleString(), roles[f.name]) for f in df.schema.fields}


def column_profile(df: DataFrame, sniff_text: bool = False, approx: bool = False) -> DataFrame:
    """(position, column, type, role, missing, missing_pct, distinct): one row per column."""
    types = column_types(df, sniff_text)
    counts = (approx_distinct_and_missing if approx else distinct_and_missing)(df, df.columns)
    position, type_name, role = F.lit(None).cast("int"), F.lit(None), F.lit(None)
    if types:
        lookup = {c: F.struct(F.lit(i).alias("i"), F.lit(t).alias("t"), F.lit(r).alias("r")) for i, (c, (t, r)) in enumerate(types.items())}
        found = F.element_at(F.create_map(*[part for c, s in lookup.items() for part in (F.lit(c), s)]), F.col("column"))
        position, type_name, role = found["i"], found["t"], found["r"]
    full = _every_column(df, counts)
    return full.select(
        position.alias("position"),
        "column",
        type_name.alias("type"),
        role.alias("role"),
        "missing",
        percent(F.col("missing"), F.col("n")).alias("missing_pct"),
        "distinct",
    )


def _every_column(df: DataFrame, counts: DataFrame) -> DataFrame:
    """Counts of 0 for the columns of an empty table."""
    names = F.explode(F.array(*[F.lit(c) for c in df.columns]))
    every = df.sparkSession.range(1).select(names.alias("column"))
    zero = F.lit(0).cast("bigint")
    return every.join(F.broadcast(counts), "column", "left").select(
        "column", *[F.coalesce(c, zero).alias(c) for c in ("n", "missing", "distinct")]
    )


def moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n, mean, std, min, max, skew, low, high): as computed, ``low`` and ``high`` of the finite values; one pass for every
    hundred columns."""
    return reduce(DataFrame.unionByName, [_moments(df, part) for part in m.chunks(columns)])


def _moments(df: DataFrame, columns: list[str]) -> DataFrame:
    entries = []
    for c in columns:
        x = m.number(df, c)
        measures = {"n": F.count(x), "mean": F.avg(x), "std": F.stddev_samp(x), "min": F.min(x), "max": F.max(x), "skew": sample_skewness(x)}
        measures |= {"low": F.min(m.finite(x)), "high": F.max(m.finite(x))}
        entries.append(F.struct(F.lit(c).alias("column"), *[e.alias(name) for name, e in measures.items()]))
    return df.agg(F.array(*entries).alias("e")).select(F.inline("e"))


def numeric_stats(
    df: DataFrame, columns: list[str] | None = None, zero_fill: bool = False, middle: DataFrame | None = None, facts: DataFrame | None = None
) -> DataFrame:
    """(column, n, mean, median, std, min, max, q25, q75, skew, status), one row per numeric column.

    Moments come from one aggregate over all columns, quartiles from the exact quantile search, or from
    ``facts`` and ``middle`` if the caller has them.
    """
    columns = columns or m.numeric_columns(df)
    m.require_numeric(df, *columns)
    facts = facts or moments(df, columns)
    middle = (middle or quartiles(df, columns)).select("column", "q1", "median", "q3")
    reported = {"mean": "mean", "median": "median", "std": "std", "min": "min", "max": "max", "q25": "q1", "q75": "q3", "skew": "skew"}
    return facts.join(F.broadcast(middle), "column").select(
        "column",
        "n",
        *[stat(F.col(source), zero_fill=zero_fill).alias(name) for name, source in reported.items()],
        F.when(F.col("n") == 0, "empty").when(F.col("n") < 3, "few_rows").otherwise("ok").alias("status"),
    )


def datetime_stats(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, n, min, max, range_days, parse_failures): whole elapsed days, not midnights crossed.

    Text columns may be named too; what does not parse is left out and counted. A column in which
    nothing parses is left out.
    """
    columns = columns or m.columns_with_role(df, m.DATETIME)
    # Parsed in a projection of its own, so that text is parsed once and not once per aggregate.
    parsed = df.select(
        *[m.instant(df, c).alias(f"t{i}") for i, c in enumerate(columns)],
        *[m.present(df, c).alias(f"there{i}") for i, c in enumerate(columns)],
    )
    entries = []
    for i, c in enumerate(columns):
        t = F.col(f"t{i}")
        measures = {"n": F.count(t), "min": F.min(t), "max": F.max(t), "parse_failures": F.count_if(F.col(f"there{i}") & t.isNull())}
        entries.append(F.struct(F.lit(c).alias("column"), *[e.alias(name) for name, e in measures.items()]))
    elapsed = (F.unix_micros(F.col("max").cast("timestamp")) - F.unix_micros(F.col("min").cast("timestamp"))) / 86_400_000_000
    rows = parsed.agg(F.array(*entries).alias("e")).select(F.inline("e")).where("n > 0")
    return rows.select("column", "n", "min", "max", F.floor(elapsed).alias("range_days"), "parse_failures")


__all__ = [
    "column_profile",
    "column_types",
    "data_bytes",
    "dataset_summary",
    "datetime_stats",
    "duplicate_rows",
    "numeric_stats",
    "top_values",
]
