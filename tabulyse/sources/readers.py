"""Read csv, json, parquet and INSERT text into DataFrames."""

from __future__ import annotations

import csv
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulyse.functions import fixed_values as fixed
from tabulyse.functions import missing as m
from tabulyse.functions.labels import bytes_label
from tabulyse.session import scratch_dir, small_table
from tabulyse.sources.insert_dump import read_insert_dump
from tabulyse.sources.ranges import JsonMembers, QuotedLines, cut_records, pieces_of, range_starts

MOST_COLUMNS = 2_000
#: Documents above this size are read by several tasks, if they are arrays.
RANGE_BYTES = 64 << 20
_MOST_HEADERS = 1_000
_RECORD = "__record"
# A cell of a CSV line, for Java and, without possessive quantifiers, for Arrow. What follows a closing quote belongs to the cell.
_CELL = r'(?:"(?:[^"]++|"")*+"(?:[^",][^,]*+)?|[^",][^,]*+|)'
_PLAIN_CELL = r'(?:"(?:[^"]|"")*"(?:[^",][^,]*)?|[^",][^,]*|)'
_CSV_LINES = QuotedLines('"', rf"\A{_PLAIN_CELL}(?:,{_PLAIN_CELL})*\z", rf'\A(?:[^"]|"")*"(?:[^",][^,]*)?(?:,{_PLAIN_CELL})*\z')
_WHOLE = r"^\s*[+-]?[0-9]++\s*\z"
_REAL = r"^\s*[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\s*\z"
_INFINITE = r"^\s*[+-]?(?i:inf(?:inity)?)\s*\z"
_BOOLEAN = r"^(?:true|True|TRUE|false|False|FALSE)\z"


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None, multi_line: bool = True, strict: bool = False) -> DataFrame:
    """CSV with a header; the usual tokens for a missing value are read as NULL.

    Without a schema one aggregate over the text decides bigint, decimal(38,0), double, boolean or string per column; whole
    numbers never lose digits. Line breaks inside quotes are read as such, and large files are split among tasks all the same:
    a first look at the lines tells whether there are any, and if so records are cut by byte range. ``multi_line=False`` says
    that there are none.

    Repeated names in the header are numbered (a, a.1, a.2), columns without a name are called after their place. A row with
    fewer cells than the header has NULL in the rest. A row with more is left out, and ``csv_quarantine`` lists it; with
    ``strict`` it is an error. Files of one folder need the same header.
    """
    names, rows = _csv_rows(spark, path, multi_line)
    too_long = _too_long(rows)
    if strict:
        fail = F.raise_error(F.concat(F.lit("more cells than the header: "), F.substring(_RECORD, 1, 200)))
        rows = rows.where(F.when(too_long, fail.cast("boolean")).otherwise(True))
    else:
        rows = rows.where(~too_long)
    raw = rows.drop(_RECORD).toDF(*names)
    text = raw.select(*[_without_null_tokens(m.col(c)).alias(c) if isinstance(raw.schema[c].dataType, T.StringType) else m.col(c) for c in raw.columns])
    if schema is not None:
        return text.select(*[_read_as(m.col(f.name), f.dataType).alias(f.name) for f in schema.fields])
    types = _csv_types(text)
    return text.select(*[_read_as(m.col(c), t).alias(c) for c, t in types.items()])


def csv_quarantine(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """(value): the rows with more cells than the header."""
    names, rows = _csv_rows(spark, path, multi_line)
    if not names:
        return small_table(spark, [], "value string")
    # Spark refuses to read the record alone; no cell is longer than its record.
    some = F.length(_RECORD) >= F.coalesce(F.length("c0"), F.lit(0))
    return rows.where(_too_long(rows) & some).select(F.col(_RECORD).alias("value"))


def _too_long(rows: DataFrame) -> Column:
    """Whether the record has more cells than the header. Spark hands out records of another number of cells only."""
    width = rows.columns.index(_RECORD)
    return F.coalesce(F.size(F.regexp_extract_all(F.col(_RECORD), F.lit(rf"(?:\A|,){_CELL}"), F.lit(0))) > width, F.lit(False))


def _csv_rows(spark: SparkSession, path: str, multi_line: bool) -> tuple[list[str], DataFrame]:
    """The names of the header, and the rows as text in columns c0, c1, ... with the record where its cells are not as many.
    Columns that the folders name come last; such files, if they have line breaks in quotes, are read whole."""
    options = {"escape": '"', "nullValue": "", "columnNameOfCorruptRecord": _RECORD, "columnPruning": "false"}
    lines = spark.read.text(path)
    folders = lines.columns[1:]
    broken = lines.where(F.col("value").contains('"') & ~F.col("value").rlike(rf"\A{_CELL}(?:,{_CELL})*+\z"))
    breaks = multi_line and not broken.limit(1).isEmpty()
    ranges = breaks and not folders
    if ranges:
        pieces = pieces_of(spark, path, "\n")
        records = cut_records(pieces, range_starts(pieces, _CSV_LINES), _CSV_LINES)
        heads = [r.value for r in records.where("number = 0").select("value").distinct().limit(_MOST_HEADERS).collect()]
        tops = [next(csv.reader([h.lstrip("\ufeff").rstrip("\r\n")]), []) for h in heads]
        if len({tuple(c.lower() for c in t) for t in tops}) > 1:
            raise ValueError(f"the files of {path} have different headers: {tops[0]} and {tops[1]}")
        top = tops[0]
    else:
        first = spark.read.csv(path, header=False, escape='"', multiLine=breaks)
        top = first.select(*first.columns[: len(first.columns) - len(folders)]).first() or []
    cells = [c if c else f"_c{i}" for i, c in enumerate(top)]
    if not cells:
        return [], small_table(spark, [], f"{_RECORD} string")
    fields = [f"c{i}" for i in range(len(cells))] + [_RECORD]
    schema = T.StructType([T.StructField(f, T.StringType()) for f in fields])
    if ranges:
        values = records.where("coalesce(number, 1) > 0").select(F.regexp_replace("value", r"\r\z", "").alias("value")).where(r"value RLIKE '\\S'")
        return _numbered(cells), values.select(F.from_csv("value", schema.simpleString()[7:-1].replace(":", " "), options).alias("r")).select("r.*")
    same = len({c.lower() for c in cells}) == len(cells)
    named = T.StructType([T.StructField(c if same else f, T.StringType()) for c, f in zip(cells, fields)] + [schema[_RECORD]])
    # Where names repeat there is no schema with which Spark could compare the headers of several files.
    read = spark.read.options(header=True, enforceSchema=not same, multiLine=breaks, **options).schema(named).csv(path)
    return [*_numbered(cells), *folders], read.toDF(*fields, *folders)


def _numbered(names: list[str]) -> list[str]:
    """Names made unique: the second a is a.1."""
    out: list[str] = []
    for name in names:
        k, new = 0, name
        while new.lower() in {o.lower() for o in out}:
            k += 1
            new = f"{name}.{k}"
        out.append(new)
    return out


def _without_null_tokens(c: Column) -> Column:
    return F.when(~c.isin(fixed.CSV_NULLS), c)


def _read_as(c: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.StringType):
        return c
    trimmed = F.trim(c)
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        # A trailing d or f is a number to the JVM but not in a CSV file.
        return F.when(c.rlike(_REAL) | c.rlike(_INFINITE), trimmed.try_cast(dtype))
    return trimmed.try_cast(dtype)


def _csv_types(text: DataFrame) -> dict[str, T.DataType]:
    def evidence(name: str) -> Column:
        c = m.col(name)
        return F.array(
            F.count(c),
            F.count_if(c.rlike(_BOOLEAN)),
            F.count_if(c.rlike(_WHOLE) & F.trim(c).try_cast("bigint").isNotNull()),
            F.count_if(c.rlike(_WHOLE) & F.trim(c).try_cast("decimal(38,0)").isNotNull()),
            F.count_if(c.rlike(_REAL) | c.rlike(_INFINITE)),
        )

    if not text.columns:
        return {}
    counts = text.agg(*[evidence(c).alias(str(i)) for i, c in enumerate(text.columns)]).first()

    def decide(n: int, booleans: int, whole: int, long_whole: int, real: int) -> T.DataType:
        if n and n == booleans:
            return T.BooleanType()
        if n and n == whole:
            return T.LongType()
        if n and n == long_whole:
            return T.DecimalType(38, 0)
        return T.DoubleType() if n == real else T.StringType()

    return {c: decide(*counts[i]) for i, c in enumerate(text.columns)}


def flatten_structs(df: DataFrame) -> DataFrame:
    """Nested objects as dotted columns (``who.name``), to any depth; arrays and maps stay."""

    def leaves(c: Column, name: str, dtype: T.DataType) -> list[Column]:
        if not isinstance(dtype, T.StructType):
            return [c.alias(name)]
        return [leaf for f in dtype.fields for leaf in leaves(c.getField(f.name), f"{name}.{f.name}", f.dataType)]

    return df.select(*[leaf for f in df.schema.fields for leaf in leaves(m.col(f.name), f.name, f.dataType)])


def read_json(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    lines: bool = True,
    record_path: str | None = None,
    by_column: bool = False,
    strict: bool = False,
    range_bytes: int = RANGE_BYTES,
    most_columns: int = MOST_COLUMNS,
) -> DataFrame:
    """JSON lines, or with ``lines=False`` one document per file, flattened.

    A document is an array of records, one record, or an object that holds the records in an array member: the one named by
    ``record_path``, else its first. Each document decides for itself, and their records are one table. A member of the array
    that is no object becomes the value of a column named like the array (``value`` in a bare array). JSON lines split across
    tasks. So do documents above ``range_bytes`` that are bare arrays, of any size: their members are cut by byte range, and
    what is no JSON is set aside member by member. Any other document is read by one task, of up to 128 MiB. ``by_column``
    reads documents that map each column name to its values, as a list or by row label, of up to ``most_columns`` columns.

    What is no JSON is left out, and ``json_quarantine`` lists it; a field that does not fit a given schema is NULL in its
    record. With ``strict`` both are errors.
    """
    if by_column:
        return _read_columns(spark, path, most_columns)
    if lines and not record_path:
        if strict:
            reader = spark.read.schema(schema) if schema is not None else spark.read
            return flatten_structs(reader.json(path, mode="FAILFAST"))
        parsed = _json_lines(spark, path, schema)
        folders = [m.col(c) for c in parsed.columns[2:]]
        return flatten_structs(parsed.select(F.explode("records").alias("r"), *folders).select("r.*", *folders))
    records = _records(_json_documents(spark, path, lines, range_bytes), record_path, strict)
    if schema is not None:
        return flatten_structs(records.select(F.from_json("value", schema).alias("r")).select("r.*"))
    # Written as lines, the records of a long document are spread over tasks, and parsed a single time for their schema.
    folder = scratch_dir(spark, "records")
    records.write.text(folder)
    return flatten_structs(spark.read.json(folder))


def json_quarantine(spark: SparkSession, path: str, lines: bool = True, schema: T.StructType | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(value): the lines or documents that are no JSON array or object; of lines, those that ``read_json`` with this schema finds
    no record in."""
    if lines:
        return _json_lines(spark, path, schema).where(F.col("records").isNull()).select("value")
    return _json_documents(spark, path, lines, range_bytes).where(~_holds_records("json")).select("value")


def _json_lines(spark: SparkSession, path: str, schema: T.StructType | None) -> DataFrame:
    """(value, records, columns of the folders): each line that is not blank; ``records`` is NULL where it is no record or array
    of records."""
    texts = spark.read.text(path).where(~F.col("value").rlike(r"^\s*\z"))
    folders = texts.columns[1:]
    if schema is None:
        schema = spark.read.json(path, mode="DROPMALFORMED").schema
    schema = T.StructType([f for f in schema.fields if f.name not in folders])
    records = F.from_json("value", T.ArrayType(schema))
    return texts.select("value", F.when(~F.exists(records, lambda r: r.isNull()), records).alias("records"), *map(m.col, folders))


def _json_documents(spark: SparkSession, path: str, lines: bool, range_bytes: int) -> DataFrame:
    """(value, json): each document, or line, that is not blank; ``json`` is NULL where it is no JSON.

    A large array comes as documents of one array each, which together hold its members.
    """
    texts = spark.read.text(path, wholetext=not lines)
    if not lines:
        size = F.col("_metadata.file_size")  # filters on it are decided on the file listing
        if not spark.read.format("binaryFile").load(path).where(size > range_bytes).select("length").isEmpty():
            texts = texts.where(size <= range_bytes).select("value").unionByName(_large_documents(spark, path, size > range_bytes))
    texts = texts.where(~F.col("value").rlike(r"^\s*\z"))
    return texts.select("value", F.try_parse_json("value").alias("json"))


def _large_documents(spark: SparkSession, path: str, large: Column) -> DataFrame:
    """(value): of the files that are ``large``, arrays as one array for what lies between two closing braces of members; other
    documents whole."""
    scanner = JsonMembers()
    pieces = pieces_of(spark, path, scanner.separator, large)
    starts = range_starts(pieces, scanner)
    arrays = starts.where("first = '['")
    records = cut_records(pieces.join(F.broadcast(arrays.select("file").distinct()), "file", "left_semi"), arrays, scanner)  # a row per range
    inside = F.when(F.col("number") == 0, F.regexp_replace("value", r"\A[\ufeff\s]*+\[", "")).otherwise(F.regexp_replace("value", r"\A\s*+,", ""))
    inside = F.when(F.col("last"), F.regexp_replace(inside, r"\]\s*+\z", "")).otherwise(inside)
    members = records.select(inside.alias("value")).where(~F.col("value").rlike(r"^\s*\z"))
    cut = members.select(F.concat(F.lit("["), "value", F.lit("]")).alias("value"))
    others = starts.where("first != '['").select("file").distinct()
    whole = spark.read.text(path, wholetext=True).where(large).withColumn("file", F.xxhash64("_metadata.file_path")).join(F.broadcast(others), "file", "left_semi")
    return cut if others.isEmpty() else cut.unionByName(whole.select("value"))


def _holds_records(json: str) -> Column:
    return F.coalesce(F.schema_of_variant(json).rlike("^(?:ARRAY|OBJECT)<"), F.lit(False))


def _records(documents: DataFrame, record_path: str | None, strict: bool) -> DataFrame:
    """(value): the records of all documents, as JSON text."""
    good = _holds_records("json")
    if strict:
        fail = F.raise_error(F.concat(F.lit("no JSON array or object: "), F.substring("value", 1, 200)))
        good = F.when(~good, fail).otherwise(good).cast("boolean")
    whole = documents.where(good).select(
        "value", "json", F.json_object_keys("value").alias("names"), F.try_variant_get("json", "$", "map<string,variant>").alias("members")
    )
    # Members are kept in name order; the text knows which array comes first.
    first = F.get(F.filter("names", lambda name: F.schema_of_variant(F.element_at("members", name)).startswith("ARRAY")), 0)
    named = whole.withColumn("name", F.when(F.col("members").isNotNull(), F.lit(record_path) if record_path else first))
    inside = F.try_variant_get(F.element_at("members", F.col("name")), "$", "array<variant>")
    array = F.coalesce(inside, F.try_variant_get("json", "$", "array<variant>"))
    # A variant forgets that 1.0 is no whole number, so the records themselves are cut from the text.
    text = F.when(F.col("name").isNotNull(), F.element_at(F.from_json("value", "map<string,string>"), F.col("name"))).otherwise(F.col("value"))
    parts = named.select("name", "value", array.alias("array"), F.from_json(text, "array<string>").alias("texts"))
    one = F.array(F.struct(F.regexp_replace("value", r"[\r\n]+", " ").alias("text"), F.lit(None).cast("variant").alias("item")))
    both = F.zip_with("texts", "array", lambda t, v: F.struct(t.alias("text"), v.alias("item")))
    record = parts.select("name", F.explode(F.when(F.col("array").isNull(), one).otherwise(both)).alias("r")).select("name", "r.*")
    is_record = F.col("item").isNull() | F.schema_of_variant("item").startswith("OBJECT")
    wrapped = F.to_json(F.create_map(F.coalesce("name", F.lit("value")), F.col("item")))
    return record.select(F.when(is_record, F.col("text")).otherwise(wrapped).alias("value"))


def _read_columns(spark: SparkSession, path: str, most_columns: int) -> DataFrame:
    document = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.try_parse_json("value").alias("v"))
    members = document.select("file", F.explode(F.try_variant_get("v", "$", "map<string,variant>")).alias("name", "cells"))
    listed = members.select("file", "name", F.posexplode(F.try_variant_get("cells", "$", "array<variant>")).alias("at", "v"))
    labelled = members.select("file", "name", F.explode(F.try_variant_get("cells", "$", "map<string,variant>")).alias("at", "v"))
    cells = listed.withColumn("at", F.col("at").cast("string")).unionByName(labelled)
    names = [r["name"] for r in cells.select("name").distinct().orderBy("name").limit(most_columns + 1).collect()]
    if len(names) > most_columns:
        raise ValueError(f"more than {most_columns} columns; the documents are probably not written by column")
    text = cells.withColumn("v", F.try_variant_get("v", "$", "string"))
    wide = text.groupBy("file", "at").agg(*[F.max(F.when(F.col("name") == n, F.col("v"))).alias(n) for n in names])
    rows = wide.select(*[_without_null_tokens(m.col(n)).alias(n) for n in names])
    return rows.select(*[_read_as(m.col(c), t).alias(c) for c, t in _csv_types(rows).items()])


def source_size(spark: SparkSession, path: str) -> DataFrame:
    """(files, bytes, label): what a source holds on disk, from the file listing alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    total = files.agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))
    return total.withColumn("label", bytes_label(F.col("bytes")))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


_READERS: dict[str, Callable[..., DataFrame]] = {
    "csv": read_csv,
    "json": read_json,
    "parquet": read_parquet,
    "sql": read_insert_dump,
}


def register_reader(fmt: str, reader: Callable[..., DataFrame]) -> None:
    _READERS[fmt.strip().lower()] = reader


def read_table(spark: SparkSession, path: str, fmt: str | None = None, **options) -> DataFrame:
    """Read a file or folder by format, or by the extension of its name."""
    kind = (fmt or path.rstrip("/").rsplit(".", 1)[-1]).strip().lower()
    reader = _READERS.get(kind)
    if reader is None:
        raise ValueError(f"unsupported file type {kind!r}; types are {sorted(_READERS)}")
    return reader(spark, path, **options)
