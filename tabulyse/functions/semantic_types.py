"""Semantic type names: what kind of value they hold, in Spark and in SQL.

The registry is open: ``register_semantic_type`` adds a name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulyse.functions import fixed_values as fixed
from tabulyse.functions import normalize as n

INT, FLOAT, BOOLEAN, DATE, DATETIME, TIME, TEXT = "int", "float", "boolean", "date", "datetime", "time", "text"

SPARK_TYPE = {
    INT: T.LongType(),
    FLOAT: T.DoubleType(),
    BOOLEAN: T.BooleanType(),
    DATE: T.DateType(),
    DATETIME: T.TimestampNTZType(),
    TIME: T.StringType(),
    TEXT: T.StringType(),
}

_PARSE = {
    INT: n.parse_long,
    FLOAT: n.parse_double,
    BOOLEAN: n.parse_boolean,
    DATE: n.parse_date,
    DATETIME: n.parse_timestamp,
    TIME: n.parse_time,
    TEXT: n.clean_string,
}

_DEFAULT = {INT: 0, FLOAT: 0.0, BOOLEAN: False, TEXT: ""}

_KINDS: dict[str, str] = {}
for _kind, _names in (
    (INT, fixed.INT_TYPES),
    (FLOAT, fixed.FLOAT_TYPES),
    (BOOLEAN, fixed.BOOL_TYPES),
    (DATE, fixed.DATE_TYPES),
    (DATETIME, fixed.DATETIME_TYPES),
    (TIME, fixed.TIME_TYPES),
):
    _KINDS.update({name: _kind for name in _names})

_DDL: dict[str, str] = dict(fixed.DDL_TYPES)


@dataclass(frozen=True)
class ColumnSpec:
    """A column by name and semantic type, such as ("unit price", "price")."""

    name: str
    type: str

    @property
    def key(self) -> str:
        return self.type.strip().lower()

    @property
    def kind(self) -> str:
        return _KINDS.get(self.key, TEXT)

    @property
    def ddl(self) -> str:
        return _DDL.get(self.key, "TEXT")


def register_semantic_type(name: str, kind: str, ddl: str = "TEXT") -> None:
    if kind not in SPARK_TYPE:
        raise ValueError(f"kind is one of {sorted(SPARK_TYPE)}")
    _KINDS[name.strip().lower()] = kind
    _DDL[name.strip().lower()] = ddl


def convert(c: Column, dtype: T.DataType, kind: str, null_policy: str) -> Column:
    """A column of any type as a clean value of one kind."""
    if null_policy not in ("typed_default", "null"):
        raise ValueError("null_policy is 'typed_default' or 'null'")
    typed = _direct(c, dtype, kind)
    if typed is None:
        typed = _PARSE[kind](_text(c, dtype))
    if null_policy == "typed_default" and kind in _DEFAULT:
        typed = F.coalesce(typed, F.lit(_DEFAULT[kind]))
    return typed.cast(SPARK_TYPE[kind])


def _text(c: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        return F.to_json(c)
    return c.cast("string")


def _direct(c: Column, dtype: T.DataType, kind: str) -> Column | None:
    """The conversion that needs no text, if there is one."""
    number = isinstance(dtype, T.NumericType)
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        c = F.when(F.abs(c) < float("inf"), c)
    if kind == INT and (number or isinstance(dtype, T.BooleanType)):
        whole = c.cast("int") if isinstance(dtype, T.BooleanType) else c
        return whole.try_cast("bigint")
    if kind == FLOAT and (number or isinstance(dtype, T.BooleanType)):
        return c.cast("int").cast("double") if isinstance(dtype, T.BooleanType) else c.cast("double")
    if kind == BOOLEAN and isinstance(dtype, T.BooleanType):
        return c
    if kind == BOOLEAN and number:
        return c != 0
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        if kind in (DATE, DATETIME):
            return c.cast(SPARK_TYPE[kind])
        if kind == TIME:
            return F.date_format(c.cast("timestamp_ntz"), "HH:mm:ss")
    return None
