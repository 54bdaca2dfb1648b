"""A messy table to a clean one: by a stated schema, or by one inferred from names and values."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulyse.functions import fixed_values as fixed
from tabulyse.functions import missing as m
from tabulyse.functions import normalize as n
from tabulyse.functions.semantic_types import SPARK_TYPE, ColumnSpec, convert
from tabulyse.session import small_table

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def normalize(df: DataFrame, specs: list[ColumnSpec], null_policy: str = "typed_default", keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns of the spec, clean and typed, in one projection that also works on streams.

    Columns outside the spec are dropped unless named in ``keep``; a column the table lacks is filled
    with the default of its type. ``typed_default`` turns what is missing or unreadable into 0, False or
    empty text (dates stay NULL); ``null`` turns it into NULL.
    """
    return df.select(*[m.col(k) for k in keep], *[_normalized(df, s, null_policy).alias(s.name) for s in specs])


def _normalized(df: DataFrame, spec: ColumnSpec, null_policy: str) -> Column:
    if spec.name not in df.columns:
        return convert(F.lit(None).cast("string"), T.StringType(), spec.kind, null_policy)
    return convert(m.col(spec.name), df.schema[spec.name].dataType, spec.kind, null_policy)


def target_schema(specs: list[ColumnSpec]) -> T.StructType:
    return T.StructType([T.StructField(s.name, SPARK_TYPE[s.kind]) for s in specs])


def type_from_name(name: str) -> str | None:
    """The type a column name alone decides, by whole words; None if it decides nothing."""
    plain = re.sub(r"\s+", "_", name.strip().lower())
    words = set(plain.split("_"))
    if plain in fixed.ID_NAMES or plain.endswith("_id"):
        return "Number"
    if plain in fixed.DATE_NAMES or words & set(fixed.DATE_WORDS):
        return "Date"
    if plain in fixed.BOOL_NAMES:
        return "Boolean"
    if words & set(fixed.FLOAT_WORDS):
        return "Float"
    if words & set(fixed.INT_WORDS):
        return "Number"
    return None


def looks_like_date(c: Column) -> Column:
    return n.strip(c).rlike(fixed.DATE_LOOK)


def type_from_counts(present: int, booleans: int, whole: int, numbers: int, dates: int) -> str:
    """The type the values decide, given how many of the present ones are of each sort."""
    if present == 0:
        return "String"
    if booleans == present:
        return "Boolean"
    if whole == present:
        return "Number"
    if numbers == present:
        return "Float"
    return "Date" if dates >= present * fixed.DATE_LOOK_SHARE else "String"


def _value_evidence(df: DataFrame, name: str) -> list[Column]:
    """Counts that feed ``type_from_counts`` for one column."""
    dtype = df.schema[name].dataType
    c = m.value(df, name)
    is_bool, is_whole = isinstance(dtype, T.BooleanType), isinstance(dtype, _INTEGRAL)
    is_number = isinstance(dtype, T.NumericType)
    text = c if isinstance(dtype, T.StringType) else None
    there = ~n.is_null_token(text) if text is not None else c.isNotNull()
    date_like = looks_like_date(text) if text is not None else F.lit(m.role_of_type(dtype) == m.DATETIME)
    return [
        F.count_if(there),
        F.count_if(there & F.lit(is_bool)),
        F.count_if(there & F.lit(is_whole)),
        F.count_if(there & F.lit(is_number)),
        F.count_if(there & date_like),
    ]


def infer_specs(df: DataFrame) -> list[ColumnSpec]:
    """One spec per column. Names decide first; one aggregate over all values decides the rest."""
    named = {c: type_from_name(c) for c in df.columns}
    open_columns = [c for c, t in named.items() if t is None]
    if open_columns:
        evidence = [F.array(*_value_evidence(df, c)).alias(str(i)) for i, c in enumerate(open_columns)]
        counts = df.agg(*evidence).first()
        named.update({c: type_from_counts(*counts[i]) for i, c in enumerate(open_columns)})
    return [ColumnSpec(c, named[c]) for c in df.columns]


def infer_types(df: DataFrame) -> DataFrame:
    """(position, column, type): the inferred type of each column as a table."""
    rows = [(i, s.name, s.type) for i, s in enumerate(infer_specs(df))]
    return small_table(df.sparkSession, rows, "position int, column string, type string")


def normalize_inferred(df: DataFrame, null_policy: str = "typed_default") -> DataFrame:
    return normalize(df, infer_specs(df), null_policy)
