"""How often each value of each column occurs, in one pass per family of column types.

Columns are unpivoted within their family, so every column is read once and no number is turned into
text. Long text is grouped by its SHA-256: a 100 kB document moves 64 bytes through the shuffle. The
partial aggregate collapses hot values before the shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulyse.functions.missing import col, field, value
from tabulyse.session import written

TRACKED_VALUES = 10_000
BUCKETS = 1 << 14
SKETCH_BITS = 14
# Rows of a few dozen bytes that are sent to every task at most.
_MOST_SENT = 200_000
# A hex SHA-256 has 64 characters, so no text kept as it is can look like a digest.
_LONGEST_KEPT = 63
# Nested values as JSON keep the microseconds of both kinds of timestamp.
_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def _family(dtype: T.DataType) -> str:
    if isinstance(dtype, (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "whole"
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return "real"
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "instant"
    return "text"


def _settled(c: Column, dtype: T.DataType) -> Column:
    """A nested value of which equal ones are written alike: no negative zeros, maps in the order of their keys."""
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return c + F.lit(0).cast(dtype)
    if isinstance(dtype, T.ArrayType):
        return F.transform(c, lambda x: _settled(x, dtype.elementType))
    if isinstance(dtype, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[_settled(c.getField(f.name), f.dataType).alias(f.name) for f in dtype.fields]))
    if isinstance(dtype, T.MapType):
        entries = F.array_sort(F.map_entries(c), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
        return F.map_from_entries(F.transform(entries, lambda e: F.struct(e["key"], _settled(e["value"], dtype.valueType))))
    return c


def as_text(df: DataFrame, name: str) -> Column:
    """Any column as text that is equal where the values are equal."""
    dtype = field(df, name).dataType
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        return F.to_json(_settled(col(name), dtype), _JSON)
    if isinstance(dtype, T.BinaryType):
        return F.hex(col(name))
    return value(df, name).cast("string")


def text_key(text: Column) -> Column:
    return F.when(F.octet_length(text) > _LONGEST_KEPT, F.sha2(text, 256)).otherwise(text)


def _typed(df: DataFrame, name: str, family: str) -> Column:
    if family == "whole":
        return col(name).cast("bigint")
    if family == "real":
        return value(df, name).cast("double")
    if family == "instant":
        return col(name).cast("timestamp_ntz")
    return text_key(as_text(df, name))


def _families(df: DataFrame, columns: list[str]) -> dict[str, list[str]]:
    families: dict[str, list[str]] = {}
    for name in columns:
        families.setdefault(_family(field(df, name).dataType), []).append(name)
    return families


def _long(df: DataFrame, columns: list[str], family: str) -> DataFrame:
    typed = df.select(*[_typed(df, c, family).alias(c) for c in columns])
    if len(columns) == 1:
        return typed.select(F.lit(columns[0]).alias("column"), col(columns[0]).alias("key"))
    return typed.unpivot([], [col(c) for c in columns], "column", "key")


def _counted(df: DataFrame, columns: list[str], family: str) -> DataFrame:
    return _long(df, columns, family).groupBy("column", "key").agg(F.count("*").alias("n"))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def distinct_and_missing(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n, missing, distinct), all exact; missing values are not a distinct value."""
    parts = []
    for family, members in _families(df, columns).items():
        per_value = _counted(df, members, family)
        parts.append(
            per_value.groupBy("column").agg(
                F.sum("n").alias("n"),
                F.sum(F.when(F.col("key").isNull(), F.col("n")).otherwise(0)).alias("missing"),
                F.count("key").alias("distinct"),
            )
        )
    return _union(parts)


def approx_distinct_and_missing(df: DataFrame, columns: list[str], rsd: float = 0.02) -> DataFrame:
    """The same from one aggregate without a shuffle of values; distinct within about ``rsd``."""
    entries = [
        F.struct(
            F.lit(c).alias("column"),
            F.count("*").alias("n"),
            F.count_if(value(df, c).isNull()).alias("missing"),
            F.approx_count_distinct(text_key(as_text(df, c)), rsd).alias("distinct"),
        )
        for c in columns
    ]
    return df.agg(F.array(*entries).alias("e")).select(F.inline("e"))


def top_values(df: DataFrame, columns: list[str], k: int = 10) -> DataFrame:
    """(column, rank, value, n): the k most frequent present values per column, ties by value ascending.

    Values come back as text. Each task keeps k rows per column before anything is shuffled for the
    ranking. Only if a digest makes the list is the text behind it looked up, with a second pass over
    the text columns; AQE drops that pass when there is none.
    """
    best = Window.partitionBy("column").orderBy(F.desc("n"), F.asc("key"))
    parts = []
    for family, members in _families(df, columns).items():
        counted = _counted(df, members, family).where("key is not null")
        top = counted.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        if family == "text":
            parts.append(_with_long_text(df, members, top, k))
            continue
        parts.append(top.select("column", "rank", _shown(df, members, family), "n"))
    return _union(parts)


def frequent_values(df: DataFrame, columns: list[str], k: int = 10, tracked: int = TRACKED_VALUES, buckets: int = BUCKETS) -> DataFrame:
    """The rows of ``top_values``, found without shuffling the distinct values of the columns.

    Two passes, run when the function is called. In the first every task keeps a summary of ``tracked`` values per column; the
    merged summaries name candidates. The second counts the candidates exactly, and all other rows by one of ``buckets``
    hashes of their value. No value is more frequent than its bucket: where the k-th candidate beats every bucket of the
    others, none is missing. Only values of buckets that it does not beat are counted by themselves, in a third pass. For a
    column without frequent values that is most of them, and no cheaper than ``top_values``.
    """
    parts = []
    best = Window.partitionBy("column").orderBy(F.desc("n"), F.asc("key"))
    for family, members in _families(df, columns).items():
        long = _long(df, members, family).where("key is not null")
        if family == "real":
            long = long.withColumn("key", F.col("key") + F.lit(0.0))
        counted = candidate_counts(long, len(members), k, tracked, buckets)
        known = counted.where("key is not null").select("column", "key", "n")
        ranked = known.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k)
        least = ranked.select("column", F.col("n").alias("least"))
        rest = counted.where("key is null").join(least, "column", "left").where(F.col("n") >= F.coalesce("least", F.lit(0)))
        unsettled = rest.select("column", "bucket")
        every = known
        if not unsettled.isEmpty():
            some = buckets * len(members) <= _MOST_SENT
            candidates = known.select("column", "key")
            open_rows = long.withColumn("bucket", _bucket(buckets)).join(F.broadcast(unsettled) if some else unsettled, ["column", "bucket"], "left_semi")
            others = open_rows.join(F.broadcast(candidates) if some else candidates, ["column", "key"], "left_anti")
            every = known.unionByName(others.groupBy("column", "key").agg(F.count("*").alias("n")))
        top = every.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        parts.append(_with_long_text(df, members, top, k) if family == "text" else top.select("column", "rank", _shown(df, members, family), "n"))
    return _union(parts)


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("key"), F.lit(buckets))


def candidate_counts(long: DataFrame, columns: int, k: int, tracked: int, buckets: int) -> DataFrame:
    """(column, bucket, key, n), written: exact counts of the candidates, and of all other values by bucket (key NULL).

    At most ``buckets`` and 8 k rows a column, however many values there are.
    """
    wanted = 8 * k
    summary = long.groupBy("column").agg(F.expr(f"approx_top_k(key, {wanted}, {max(tracked, wanted)})").alias("top"))
    candidates = written(summary.select("column", F.explode("top.item").alias("key"), F.lit(True).alias("listed")), "candidates")
    small = F.broadcast(candidates) if wanted * columns <= _MOST_SENT else candidates
    met = long.join(small, ["column", "key"], "left")
    by = met.groupBy("column", _bucket(buckets).alias("bucket"), F.when(F.col("listed"), F.col("key")).alias("key"))
    return written(by.agg(F.count("*").alias("n")), "candidate-counts")


def _shown(df: DataFrame, members: list[str], family: str) -> Column:
    shown = F.col("key").cast("string")
    if family == "whole":
        flags = [m for m in members if isinstance(field(df, m).dataType, T.BooleanType)]
        if flags:
            shown = F.when(F.col("column").isin(flags), (F.col("key") == 1).cast("string")).otherwise(shown)
    if family == "instant":
        dates = [m for m in members if isinstance(field(df, m).dataType, T.DateType)]
        if dates:
            shown = F.when(F.col("column").isin(dates), F.col("key").cast("date").cast("string")).otherwise(shown)
    return shown.alias("value")


def _with_long_text(df: DataFrame, members: list[str], top: DataFrame, k: int) -> DataFrame:
    """Digests turned back into texts. The texts are found where they are read; only those that made the list move."""
    texts = df.select(*[as_text(df, c).alias(c) for c in members])
    if len(members) == 1:
        long = texts.select(F.lit(members[0]).alias("column"), col(members[0]).alias("text"))
    else:
        long = texts.unpivot([], [col(c) for c in members], "column", "text")
    digests = top.where(F.octet_length("key") > _LONGEST_KEPT).select("column", "key")
    if k * len(members) <= _MOST_SENT:  # digests, never texts: at most k of 64 bytes a column
        digests = F.broadcast(digests)
    behind = (
        long.where(F.octet_length("text") > _LONGEST_KEPT)
        .withColumn("key", F.sha2("text", 256))
        .join(digests, ["column", "key"])
        .groupBy("column", "key")
        .agg(F.element_at(F.collect_set("text"), 1).alias("text"))  # one text per digest, found without a sort
    )
    joined = top.join(behind, ["column", "key"], "left")
    return joined.select("column", "rank", F.coalesce("text", "key").alias("value"), "n")


def _spelled_row(df: DataFrame) -> Column:
    """What makes two rows copies, as text.

    Each value is written exactly (doubles by their shortest text, instants by their microseconds) behind its length, so no
    two different rows spell alike.
    """

    def spelled(f: T.StructField) -> Column:
        family = _family(f.dataType)
        if family == "instant":
            text = F.unix_micros(col(f.name).cast("timestamp_ntz").cast("timestamp")).cast("string")
        elif family == "real":
            text = (value(df, f.name).cast("double") + F.lit(0.0)).cast("string")
        else:
            text = as_text(df, f.name)
        return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.concat(F.lit(""), *map(spelled, df.schema.fields))


def row_key(df: DataFrame) -> Column:
    """The row as the 32 bytes of its SHA-256, for rows of any width."""
    return F.unhex(F.sha2(_spelled_row(df), 256))


def row_copies(df: DataFrame) -> DataFrame:
    """(n): one row per distinct row of the table with its number of copies; NULL equals NULL.

    Copies collapse in the partial aggregate, so a row that makes up a third of the table is shuffled
    once per task, as 128 bits of its digest.
    """
    return df.groupBy(F.substring(row_key(df), 1, 16).alias("row")).agg(F.count("*").alias("n")).select("n")


def duplicate_rows(df: DataFrame, approx: bool = False) -> DataFrame:
    """(rows, duplicates): rows beyond the first copy, over all columns.

    With ``approx`` no row is shuffled: one sketch a task is, and ``margin`` says how far off the estimate may be.
    """
    if approx:
        return sketched_duplicates(row_sketches(df))
    total = F.coalesce(F.sum("n"), F.lit(0))
    return row_copies(df).agg(total.alias("rows"), (total - F.count("*")).alias("duplicates"))


def row_sketches(df: DataFrame, parts: list[str] | None = None, bits: int = SKETCH_BITS) -> DataFrame:
    """(parts..., rows, sketch): a HyperLogLog sketch of the distinct rows of each part of the table.

    Sketches can be kept, for instance one per day, and merged later by ``sketched_duplicates`` without reading the rows
    again. The columns that name the part count as columns of the row. A sketch has 2^bits cells of a byte at most.
    """
    word = F.xxhash64(_spelled_row(df))
    marked = df.select(*map(col, parts or []), word.alias("_word"))
    return marked.groupBy(*map(col, parts or [])).agg(F.count("*").alias("rows"), F.hll_sketch_agg("_word", bits).alias("sketch"))


def sketched_duplicates(sketches: DataFrame, bits: int = SKETCH_BITS) -> DataFrame:
    """(rows, duplicates, margin) over all sketches given: the exact number of rows, the estimated number of them beyond the
    first copy, and three standard errors of the estimate."""
    merged = sketches.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct"))
    distinct = F.coalesce("distinct", F.lit(0))
    error = F.ceil(3 * 1.04 / 2 ** (bits / 2) * distinct)
    return merged.select("rows", F.greatest(F.col("rows") - distinct, F.lit(0)).cast("bigint").alias("duplicates"), error.cast("bigint").alias("margin"))
