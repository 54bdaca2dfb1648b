"""A table as SQL text: one CREATE TABLE, one INSERT per row and per line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulyse.functions import fixed_values as fixed
from tabulyse.functions import missing as m
from tabulyse.functions.semantic_types import ColumnSpec
from tabulyse.operators.value_counts import as_text

_CONTEXT_LETTERS = 30


def table_name(context: str | None) -> str:
    """A table name from a free-text context: a known word, else its first letters, else a default."""
    text = (context or "").lower()
    for word in fixed.TABLE_WORDS:
        if word in text:
            return f"{word}_data"
    safe = "".join(ch if ch.isalnum() or ch == "_" else "_" for ch in text[:_CONTEXT_LETTERS])
    return safe.strip("_") or fixed.DEFAULT_TABLE


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def specs_of(df: DataFrame) -> list[ColumnSpec]:
    """The semantic types that fit a table's column types."""

    def semantic(dtype: T.DataType) -> str:
        if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            return "integer"
        if isinstance(dtype, T.NumericType):
            return "float"
        if isinstance(dtype, T.BooleanType):
            return "boolean"
        if isinstance(dtype, T.DateType):
            return "date"
        return "timestamp" if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)) else "text"

    return [ColumnSpec(f.name, semantic(f.dataType)) for f in df.schema.fields]


def create_table_statement(specs: list[ColumnSpec], table: str = fixed.DEFAULT_TABLE) -> str:
    columns = ", ".join(f"{quoted(s.name)} {s.ddl}" for s in specs)
    return f"CREATE TABLE {quoted(table)} ({columns});"


def _literal(df: DataFrame, name: str) -> Column:
    if name not in df.columns:
        return F.lit("NULL")
    dtype = df.schema[name].dataType
    c = m.value(df, name)
    if isinstance(dtype, T.BooleanType):
        text = F.when(c, "TRUE").otherwise("FALSE")
    elif isinstance(dtype, (T.FloatType, T.DoubleType)):
        # Infinity has no bare form in SQL.
        text = F.when(F.abs(c) == float("inf"), F.concat(F.lit("'"), c.cast("string"), F.lit("'"))).otherwise(c.cast("string"))
    elif isinstance(dtype, T.NumericType):
        text = c.cast("string")
    else:
        plain = as_text(df, name)
        if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
            # To the microsecond, without the zeros at its end.
            plain = F.regexp_replace(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.?0+$", "")
        for found, put in (("\\", "\\\\"), ("'", "''"), ("\n", "\\n"), ("\r", "\\r")):
            plain = F.replace(plain, F.lit(found), F.lit(put))
        text = F.concat(F.lit("'"), plain, F.lit("'"))
    return F.when(c.isNotNull(), text).otherwise("NULL")


def insert_statements(df: DataFrame, specs: list[ColumnSpec] | None = None, table: str = fixed.DEFAULT_TABLE) -> DataFrame:
    """(value): an INSERT per row, columns in the order of the spec."""
    specs = specs or specs_of(df)
    columns = ", ".join(quoted(s.name) for s in specs)
    values = F.concat_ws(", ", *[_literal(df, s.name) for s in specs])
    head = F.lit(f"INSERT INTO {quoted(table)} ({columns}) VALUES (")
    return df.select(F.concat(head, values, F.lit(");")).alias("value"))
