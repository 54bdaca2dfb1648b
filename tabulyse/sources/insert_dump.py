"""Read INSERT text: CREATE TABLE and INSERT statements, each ending in a semicolon, with line feeds or Windows line ends.

Statements are split and parsed on the executors, once, and written by table; only the CREATE TABLE statements and one row
count per table reach the driver. An INSERT may name its columns or not, hold any number of value groups and span lines, also
inside quotes. One that cannot be read is set aside: ``read_dump`` returns it next to the tables, and with ``strict`` it is
an error.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulyse.session import scratch_dir
from tabulyse.sources.ranges import QuotedLines, cut_records, pieces_of, range_starts

MOST_TABLES = 1_000
_IDENTIFIER = r'(?:"(?:[^"]++|"")*+"|`[^`]++`|[A-Za-z_][\w$.]*+)'
_VALUE = r"(?:'(?:[^']++|'')*+'|[^,()'\s]++)"
_GROUP = rf"\(\s*+{_VALUE}(?:\s*+,\s*+{_VALUE})*+\s*+\)"
_COMMENTS = r"^(?:\s++|--[^\n]*+(?:\n|\z))*+"
_HEAD = rf"^(?i:INSERT\s++INTO)\s++({_IDENTIFIER})\s*+(?:\(\s*+({_IDENTIFIER}(?:\s*+,\s*+{_IDENTIFIER})*+)\s*+\)\s*+)?(?i:VALUES)"
# A group of values, or a letter that should not be there.
_PIECE = rf"({_GROUP}|[^\s,;])"
_CREATE = rf"(?s)^(?i:CREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?)({_IDENTIFIER})\s*\((.*)\)[^)]*;\Z"
_CREATE_SPARK = _CREATE.replace(r"\Z", r"\z")
# One entry between the commas of a CREATE TABLE: its name, its type, the rest.
_ENTRY = rf"(?s)\s*({_IDENTIFIER})\s+([A-Za-z]+(?:\s*\([0-9, ]+\))?)(?:[^,()\"'`]|\([^)]*\)|\"[^\"]*\"|'(?:[^']|'')*')*"
_NO_COLUMN = re.compile(r"(?i)(?:PRIMARY|FOREIGN|UNIQUE|CONSTRAINT|CHECK|KEY|INDEX)\b")

_WHOLE = T.LongType()
_SPARK_TYPE = {
    **dict.fromkeys(("INT", "INTEGER", "BIGINT", "SMALLINT", "TINYINT"), _WHOLE),
    **dict.fromkeys(("BOOLEAN", "BOOL"), T.BooleanType()),
    **dict.fromkeys(("TIMESTAMP", "DATETIME"), T.TimestampNTZType()),
    **dict.fromkeys(("DOUBLE", "FLOAT", "REAL"), T.DoubleType()),
    "DATE": T.DateType(),
}
_DOUBLE_DIGITS = 15  # decimal digits that every double keeps
_MOST_DIGITS = 38


# Quoted texts, names in quotes, and what is neither; in lines, a comment runs to their end.
_QUOTED = "'(?:[^']|'')*'|\"[^\"]*\"|`[^`]*`"
_CODE = rf"(?:[^'\"`-]|-[^'\"`-]|-?(?:{_QUOTED}))*"
_LINES = QuotedLines(
    "['\"`]",
    rf"\A(?:[^'\"`]|{_QUOTED})*(?:--.*)?\z",
    rf"\A(?:[^']|'')*'(?:[^'\"`]|{_QUOTED})*(?:--.*)?\z",
    rf"\A{_CODE};\s*(?:--.*)?\z",
    rf"\A(?:[^']|'')*'{_CODE};\s*(?:--.*)?\z",
)
# A quoted text or name, which stays, or a comment.
_COMMENT = rf"({_QUOTED})|--[^\n]*"
# Outside of these a semicolon ends a statement, on the same line too; an open quote holds all that follows.
_BALANCED = "(?:[^'\"`]++|'(?:[^']++|'')*+'|\"[^\"]*+\"|`[^`]*+`)*+"
_STATEMENT = "(?:--[^\n]*+|[^;'\"`-]++|-|'(?:[^']++|'')*+'|\"[^\"]*+\"|`[^`]*+`|['\"`][\\s\\S]*+)++;?"


@dataclass(frozen=True)
class Dump:
    """What a dump holds: its tables by name, the statements that were not read, and the number of rows of each table."""

    tables: dict[str, DataFrame]
    quarantine: DataFrame
    rows: dict[str, int]


def _statements(spark: SparkSession, path: str) -> DataFrame:
    """(value): one statement a row, without comment lines before it, with its semicolon.

    A statement ends with a semicolon outside of quotes. Where every line holds whole statements the lines are taken; else
    lines are put together by byte range.
    """
    lines = spark.read.option("recursiveFileLookup", True).option("lineSep", "\n").text(path)
    lone = F.col("value").rlike(rf"\A\s*\z|;\s*\z") & F.col("value").rlike(rf"\A{_BALANCED}\z")
    if not lines.where(~lone).limit(1).isEmpty():
        pieces = pieces_of(spark, path, "\n", recursiveFileLookup=True)
        lines = cut_records(pieces, range_starts(pieces, _LINES), _LINES).select("value")
    bare = F.regexp_replace("value", r"[;\s]++\z", "")
    each = F.when(F.col("bare").contains(";"), F.regexp_extract_all(F.col("bare"), F.lit(f"({_STATEMENT})"))).otherwise(F.array("bare"))
    parts = lines.select(bare.alias("bare")).select(F.explode(each).alias("value"))
    first = F.substring("value", 1, 1)
    statement = F.when((first >= "A") & (first <= "z"), F.col("value")).otherwise(F.regexp_replace("value", _COMMENTS, ""))
    cleaned = parts.select(F.regexp_replace(statement, r"[;\s]++\z", "").alias("value"))
    return cleaned.where("value != ''").select(F.concat("value", F.lit(";")).alias("value"))


def _unquoted(identifier: str) -> str:
    if identifier[0] == '"':
        return identifier[1:-1].replace('""', '"')
    return identifier.strip("`")


def _plain(identifier: Column) -> Column:
    """The same on a column."""
    inner = F.substring(identifier, F.lit(2), F.length(identifier) - 2)
    return F.when(identifier.startswith('"'), F.replace(inner, F.lit('""'), F.lit('"'))).when(identifier.startswith("`"), inner).otherwise(identifier)


def parse_dump(spark: SparkSession, path: str) -> DataFrame:
    """(kind, routed, table, listed, groups, value): the statements of a dump taken apart once and written, each where its
    table is. ``kind`` is create, insert or other; ``groups`` are the value groups of an INSERT, as text."""
    statements = _statements(spark, path)
    head = F.nullif(F.regexp_extract("value", _HEAD, 0), F.lit(""))
    listed = F.transform(F.regexp_extract_all(F.regexp_extract("head", _HEAD, 2), F.lit(f"({_IDENTIFIER})")), _plain)
    create = F.col("value").rlike(_CREATE_SPARK)
    headed = statements.withColumn("create", create).withColumn("head", F.when(~create, head))
    body = F.substring("value", F.length("head") + 1, F.length("value"))
    pieces = headed.select("value", "create", _plain(F.regexp_extract("head", _HEAD, 1)).alias("table"), listed.alias("listed"), F.regexp_extract_all(body, F.lit(_PIECE)).alias("pieces"))
    whole = (F.size("pieces") > 0) & F.forall("pieces", lambda g: F.length(g) > 1)  # a stray letter is a piece of its own
    inner = F.transform("pieces", lambda g: F.regexp_extract_all(F.substring(g, F.lit(2), F.length(g) - 2), F.lit(f"({_VALUE})")))
    kind = F.when(F.col("create"), "create").when(whole, "insert").otherwise("other")
    found = pieces.withColumn("kind", kind).select("kind", F.when(F.col("kind") == "insert", F.col("table")).alias("routed"), "table", "listed", F.when(F.col("kind") == "insert", inner).alias("groups"), "value")
    folder = scratch_dir(spark, "dump")
    found.write.partitionBy("kind", "routed").parquet(folder)
    schema = T.StructType([f for f in found.schema if f.name not in ("kind", "routed")] + [found.schema["kind"], found.schema["routed"]])
    return spark.read.schema(schema).parquet(folder)


def dump_tables(spark: SparkSession, path: str, most_tables: int = MOST_TABLES) -> dict[str, T.StructType]:
    """The tables a dump creates, in name order, with the Spark types of their columns; more than ``most_tables`` are an error."""
    return _created(parse_dump(spark, path), most_tables)


def _created(parsed: DataFrame, most_tables: int) -> dict[str, T.StructType]:
    found = parsed.where("kind = 'create'").select("value").distinct().orderBy("value").limit(most_tables + 1).collect()
    if len(found) > most_tables:
        raise ValueError(f"the dump creates more than {most_tables} tables")
    tables = {}
    for row in found:
        bare = re.sub(_COMMENT, lambda c: c[1] or "", row.value)
        table, body = re.match(_CREATE, bare).groups()
        entries = [e.groups() for e in re.finditer(_ENTRY, body)]
        fields = [T.StructField(_unquoted(n), _spark_type(t)) for n, t in entries if not _NO_COLUMN.match(n)]
        tables[_unquoted(table)] = T.StructType(fields)
    return dict(sorted(tables.items()))


def _spark_type(ddl: str) -> T.DataType:
    """The Spark type of a column type; a decimal of more digits than a double keeps stays one."""
    name, *sizes = re.findall(r"\w+", ddl.upper())
    if name in ("DECIMAL", "NUMERIC"):
        digits, scale = [*map(int, sizes), 0][:2] if sizes else (_DOUBLE_DIGITS, 0)
        if digits > _MOST_DIGITS:
            return T.StringType()
        return T.DecimalType(digits, scale) if digits > _DOUBLE_DIGITS else T.DoubleType()
    return _SPARK_TYPE.get(name, T.StringType())


def _judged(inserts: DataFrame, tables: dict[str, T.StructType]) -> DataFrame:
    """(value, table, names, groups, good): ``good`` if every group fits the columns of a known table."""
    known = F.lit(None).cast("array<string>")
    for name, schema in tables.items():
        known = F.when(F.col("table") == name, F.array(*[F.lit(f.name) for f in schema.fields]).cast("array<string>")).otherwise(known)
    placed = inserts.withColumn("known", known).withColumn("names", F.when(F.size("listed") > 0, F.col("listed")).otherwise(F.col("known")))
    fits = F.forall("groups", lambda g: F.size(g) == F.size("names")) & (F.size("groups") > 0) & (F.size(F.array_except("names", "known")) == 0)
    return placed.select("value", "table", "names", "groups", F.coalesce(fits, F.lit(False)).alias("good"))


def _unread(parsed: DataFrame, tables: dict[str, T.StructType]) -> DataFrame:
    others = parsed.where("kind = 'other'").select("value")
    return others.unionByName(_judged(parsed.where("kind = 'insert'"), tables).where(~F.col("good")).select("value"))


def dump_quarantine(spark: SparkSession, path: str) -> DataFrame:
    """(value): the statements that are neither a CREATE TABLE nor an INSERT that can be read."""
    parsed = parse_dump(spark, path)
    return _unread(parsed, _created(parsed, MOST_TABLES))


def _text(literal: Column) -> Column:
    """The text behind a literal: quotes off, doubled quotes and backslash escapes undone."""
    inner = F.replace(F.substring(literal, F.lit(2), F.length(literal) - 2), F.lit("''"), F.lit("'"))

    def plain(piece: Column) -> Column:
        return F.replace(F.replace(piece, F.lit("\\n"), F.lit("\n")), F.lit("\\r"), F.lit("\r"))

    # A doubled backslash is a backslash; cutting there keeps \\n from being read as a line break.
    unescaped = F.array_join(F.transform(F.split(inner, r"\\\\"), plain), "\\")
    return F.when(literal.startswith("'"), unescaped).when(F.upper(literal) != "NULL", literal)


def read_dump_table(spark: SparkSession, path: str, table: str, schema: T.StructType, strict: bool = False) -> DataFrame:
    """The rows of one table. With ``strict`` an INSERT that cannot be read, into whichever table, is an error."""
    return _table_rows(parse_dump(spark, path), table, schema, strict)


def _table_rows(parsed: DataFrame, table: str, schema: T.StructType, strict: bool) -> DataFrame:
    inserts = _judged(parsed.where((F.col("kind") == "insert") & (F.col("routed") == table)), {table: schema})
    if strict:
        # An INSERT that cannot be taken apart has no table to tell.
        fail = F.raise_error(F.concat(F.lit("INSERT that cannot be read: "), F.substring("value", 1, 200))).cast("array<array<string>>")
        others = parsed.where((F.col("kind") == "other") & F.col("value").rlike(r"^(?i:INSERT)\b"))
        inserts = inserts.withColumn("groups", F.when(F.col("good"), F.col("groups")).otherwise(fail)).withColumn("good", F.lit(True))
        inserts = inserts.unionByName(others.select("value", "table", F.lit(None).cast("array<string>").alias("names"), fail.alias("groups"), F.lit(True).alias("good")))
    rows = inserts.where("good").select("names", F.explode("groups").alias("parts"))
    cells = rows.select(F.map_from_arrays("names", "parts").alias("cells"))

    def cell(f: T.StructField) -> Column:
        return _text(F.element_at("cells", F.lit(f.name))).try_cast(f.dataType).alias(f.name)

    return cells.select(*[cell(f) for f in schema.fields])


def largest_table(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, position, n): the table with the most rows, the first one named if several have as many."""
    if not tables:
        raise ValueError("no tables to choose from")
    counts = [
        t.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), F.lit(i).alias("position"), "n")
        for i, (name, t) in enumerate(tables.items())
    ]
    return reduce(DataFrame.unionByName, counts).orderBy(F.desc("n"), "position").limit(1)


def read_insert_dump(spark: SparkSession, path: str, table: str | None = None, strict: bool = False) -> DataFrame:
    """One table of a dump: the one named, or the one with the most rows."""
    parsed = parse_dump(spark, path)
    tables = _created(parsed, MOST_TABLES)
    if not tables:
        raise ValueError(f"no CREATE TABLE in {path}")
    if table is None:
        counts = _row_counts(parsed, tables) if len(tables) > 1 else {}
        table = min(tables, key=lambda t: (-counts.get(t, 0), t))
    if table not in tables:
        raise ValueError(f"no table {table!r}; tables are {sorted(tables)}")
    return _table_rows(parsed, table, tables[table], strict)


def _row_counts(parsed: DataFrame, tables: dict[str, T.StructType]) -> dict[str, int]:
    good = _judged(parsed.where("kind = 'insert'"), tables).where("good")
    counts = good.groupBy("table").agg(F.sum(F.size("groups")).alias("n")).collect()  # one row per table the dump creates
    return dict.fromkeys(tables, 0) | {r.table: r.n for r in counts}


def read_dump(spark: SparkSession, path: str) -> Dump:
    """All tables of a dump together with the statements that could not be read, which the tables leave out.

    The dump is read and taken apart once, whatever the number of tables.
    """
    parsed = parse_dump(spark, path)
    tables = _created(parsed, MOST_TABLES)
    rows = {name: _table_rows(parsed, name, schema, strict=False) for name, schema in tables.items()}
    return Dump(rows, _unread(parsed, tables), _row_counts(parsed, tables))


__all__ = ["Dump", "dump_quarantine", "dump_tables", "largest_table", "parse_dump", "read_dump", "read_dump_table", "read_insert_dump"]
