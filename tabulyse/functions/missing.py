"""One notion of a missing value, and the role each column plays.

NULL and NaN are both missing. Everything that counts, filters or aggregates goes through here.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = "numeric"
DATETIME = "datetime"
BOOLEAN = "boolean"
CATEGORICAL = "categorical"
NESTED = "nested"

EXACT_DOUBLE = 2**53  # below it every whole number is a double of its own


def col(name: str) -> Column:
    """A column by its exact name, also when the name holds dots or spaces."""
    return F.col("`" + name.replace("`", "``") + "`")


def field(df: DataFrame, name: str) -> T.StructField:
    if name not in df.columns:
        raise ValueError(f"no column {name!r}; columns are {df.columns}")
    return df.schema[name]


def _is_float(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.FloatType, T.DoubleType))


def missing(df: DataFrame, name: str) -> Column:
    c = col(name)
    if _is_float(field(df, name).dataType):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def present(df: DataFrame, *names: str) -> Column:
    """True where every named column has a value."""
    return reduce(lambda a, b: a & b, [~missing(df, n) for n in names])


def value(df: DataFrame, name: str) -> Column:
    """The column with NaN turned into NULL."""
    c = col(name)
    if _is_float(field(df, name).dataType):
        return F.when(~F.isnan(c), c)
    return c


def number(df: DataFrame, name: str) -> Column:
    """A numeric column as double, missing values as NULL."""
    require_numeric(df, name)
    return value(df, name).cast("double")


def comparable(df: DataFrame, name: str, at: float) -> tuple[Column, Column]:
    """A numeric column and a bound in a form whose comparison reaches the file scan.

    Without the conversion to double that ``number`` makes, Parquet can skip row groups. NaN sorts above
    every bound, as missing values do. Whole numbers too large for a double are compared as doubles.
    """
    dtype = field(df, name).dataType
    if isinstance(dtype, T.DoubleType):
        return col(name), F.lit(at)
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) and abs(at) < EXACT_DOUBLE:
        return col(name), F.lit(int(at)).cast(dtype)
    return number(df, name), F.lit(at)


def finite(c: Column) -> Column:
    """The double where it is finite, else NULL."""
    return F.when(F.abs(c) < F.lit(float("inf")), c)


def role_of_type(dtype: T.DataType) -> str:
    if isinstance(dtype, T.BooleanType):
        return BOOLEAN
    if isinstance(dtype, T.NumericType):
        return NUMERIC
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return DATETIME
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        return NESTED
    return CATEGORICAL


def column_roles(df: DataFrame, sniff_text: bool = False) -> dict[str, str]:
    """The role of each column, from its type and, if asked, from the values of text columns.

    With ``sniff_text`` a text column whose values all parse as dates counts as datetime. One aggregate over all rows
    decides for all text columns.
    """
    roles = {f.name: role_of_type(f.dataType) for f in df.schema.fields}
    if sniff_text:
        text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
        roles.update({n: DATETIME for n in _date_like(df, text)})
    return roles


def _date_like(df: DataFrame, names: list[str]) -> list[str]:
    from tabulyse.functions.normalize import parse_timestamp

    found = []
    for part in chunks(names):
        evidence = [F.array(F.count(col(c)), F.count(parse_timestamp(col(c)))).alias(str(i)) for i, c in enumerate(part)]
        counts = df.agg(*evidence).first()
        found += [c for i, c in enumerate(part) if counts[i][0] and counts[i][0] == counts[i][1]]
    return found


def chunks(names: list[str], size: int = 100) -> list[list[str]]:
    """Column names in groups, so that one aggregate over a very wide table stays compilable.

    A columnar scan reads each group's columns only, so splitting reads nothing twice.
    """
    return [names[i : i + size] for i in range(0, len(names), size)]


def columns_with_role(df: DataFrame, *roles: str) -> list[str]:
    return [f.name for f in df.schema.fields if role_of_type(f.dataType) in roles]


def numeric_columns(df: DataFrame) -> list[str]:
    return columns_with_role(df, NUMERIC)


def require_numeric(df: DataFrame, *names: str) -> None:
    for name in names:
        if role_of_type(field(df, name).dataType) != NUMERIC:
            raise ValueError(f"column {name!r} is not numeric")


def instant(df: DataFrame, name: str) -> Column:
    """A datetime column as timestamp without zone; text is parsed, junk becomes NULL."""
    dtype = field(df, name).dataType
    if isinstance(dtype, T.StringType):
        from tabulyse.functions.normalize import parse_timestamp

        return parse_timestamp(col(name))
    if role_of_type(dtype) != DATETIME:
        raise ValueError(f"column {name!r} is not a date or timestamp")
    return col(name).cast("timestamp_ntz")
