"""Write a table as json lines, csv, sql text or parquet, and count its rows on the way."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulyse.functions import missing as m
from tabulyse.functions.semantic_types import ColumnSpec
from tabulyse.operators.value_counts import as_text
from tabulyse.session import small_table
from tabulyse.sinks.insert_text import create_table_statement, insert_statements, specs_of, table_name

#: Both kinds of timestamp to the microsecond.
TIMESTAMP_FORMATS = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]XXX"}


def _projected(df: DataFrame, specs: list[ColumnSpec] | None) -> DataFrame:
    return df.select(*[m.col(s.name) for s in specs]) if specs else df


def write_json(df: DataFrame, path: str, specs: list[ColumnSpec] | None = None, context: str = "") -> None:
    """One JSON object per line; NULLs are written, NaN is one of them, decimals become floats."""
    chosen = _projected(df, specs)
    floats = [
        m.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, T.DecimalType) else m.value(chosen, f.name).alias(f.name)
        for f in chosen.schema.fields
    ]
    chosen.select(*floats).write.options(**TIMESTAMP_FORMATS).json(path, ignoreNullFields=False)


def write_csv(df: DataFrame, path: str, specs: list[ColumnSpec] | None = None, context: str = "") -> None:
    """With a header; missing values empty, line breaks inside text as spaces, quotes where needed."""
    chosen = _projected(df, specs)

    def cell(f: T.StructField):
        if m.role_of_type(f.dataType) in (m.CATEGORICAL, m.NESTED):
            # \r\n is two characters and becomes two spaces.
            return F.translate(as_text(chosen, f.name), "\n\r", "  ").alias(f.name)
        return m.value(chosen, f.name).alias(f.name)

    flat = chosen.select(*[cell(f) for f in chosen.schema.fields])
    flat.write.options(**TIMESTAMP_FORMATS).csv(
        path, header=True, emptyValue="", escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )


def write_sql(df: DataFrame, path: str, specs: list[ColumnSpec] | None = None, context: str = "") -> None:
    """INSERT lines in files under ``path``, the CREATE TABLE line in a file beside them."""
    specs, table = specs or specs_of(df), table_name(context)
    insert_statements(df, specs, table).write.text(f"{path}/rows")
    ddl = small_table(df.sparkSession, [(create_table_statement(specs, table),)], "value string")
    ddl.coalesce(1).write.text(f"{path}/table")


def write_parquet(df: DataFrame, path: str, specs: list[ColumnSpec] | None = None, context: str = "") -> None:
    _projected(df, specs).write.parquet(path, compression="snappy")


_WRITERS: dict[str, Callable[..., None]] = {
    "json": write_json,
    "csv": write_csv,
    "sql": write_sql,
    "parquet": write_parquet,
}


def register_writer(fmt: str, writer: Callable[..., None]) -> None:
    _WRITERS[fmt.strip().lower()] = writer


def write_table(df: DataFrame, path: str, fmt: str, specs: list[ColumnSpec] | None = None, context: str = "") -> int:
    """Write to a new path and return the number of rows, counted while they are written."""
    writer = _WRITERS.get(fmt.strip().lower())
    if writer is None:
        raise ValueError(f"unknown format {fmt!r}; formats are {sorted(_WRITERS)}")
    seen = Observation()
    writer(df.observe(seen, F.count(F.lit(1)).alias("rows")), path, specs, context)
    return seen.get["rows"]
