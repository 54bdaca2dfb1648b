"""Pages of rows in a stated order."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulyse.functions import missing as m
from tabulyse.operators.quantiles import value_at_rank
from tabulyse.operators.value_counts import as_text, row_key

PAGE_SIZE = 50
LARGEST_PAGE = 200
# Up to this many rows a page is the tail of a top-n; beyond it the start of the page is looked up.
SHALLOW_ROWS = 2_000
_PIECE_BYTES = 6
_ROW = "__row"
_ORDERED = (T.StringType, T.BinaryType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType, T.NumericType)


def shown(df: DataFrame, name: str) -> Column:
    return F.coalesce(as_text(df, name), F.lit("")).alias(name)


def check_page(page: int, page_size: int) -> None:
    if page < 1:
        raise ValueError("pages count from 1")
    if not 1 <= page_size <= LARGEST_PAGE:
        raise ValueError(f"a page has 1 to {LARGEST_PAGE} rows")


def preview_page(
    df: DataFrame, order_by: list[str], page: int = 1, page_size: int = PAGE_SIZE, shallow_rows: int = SHALLOW_ROWS
) -> DataFrame:
    """The rows of one page as text, missing values as empty text, in the order of ``order_by``.

    Rows that tie go by the digest of the whole row, so pages never overlap. A shallow page is a top-n with an offset. For a
    deep page one task would have to take all rows before it, so the value of the order columns at the page's first row is
    looked up instead (exact, with bounded state per task) and only the rows from there on are ordered; no task orders more
    than ``shallow_rows`` and a page. For a shallow one the value at its end is. Lookups run when the function is called. Order columns are numbers, dates,
    timestamps, booleans, text or binary.
    """
    check_page(page, page_size)
    for name in order_by:
        if not isinstance(m.field(df, name).dataType, _ORDERED):
            raise ValueError(f"no pages by column {name!r} of type {m.field(df, name).dataType.simpleString()}")
    skip, order = (page - 1) * page_size, [*order_by, _ROW]
    if skip > shallow_rows:
        rest, skip = _seek(df.withColumn(_ROW, row_key(df)), order, skip, page_size, shallow_rows)
    else:
        near = _up_to(df, order_by, skip + page_size)
        rest = near.withColumn(_ROW, row_key(near))
    ordered = rest.orderBy(*[m.value(rest, c).asc_nulls_last() for c in order]).offset(skip).limit(page_size)
    return ordered.select(*[shown(df, c) for c in df.columns])


def _up_to(df: DataFrame, order_by: list[str], rows: int) -> DataFrame:
    """The first ``rows`` rows in the order, and those that tie with the last of them: only these are digested.

    The keys of that last row are looked up first; the rest is a filter that the scan can use.
    """
    if not order_by or any(isinstance(m.field(df, c).dataType, T.TimestampType) for c in order_by):
        return df  # an instant with zone may not survive the way
    keys = df.select(*[m.value(df, c).alias(f"k{i}") for i, c in enumerate(order_by)])
    edge = keys.orderBy(*[F.col(k).asc_nulls_last() for k in keys.columns]).offset(rows - 1).limit(1).collect()
    if not edge:
        return df
    within = F.lit(True)
    for name, at in reversed(list(zip(order_by, edge[0]))):
        c = m.value(df, name)
        if at is None:
            within = c.isNotNull() | within
        else:
            bound = F.lit(at).cast(m.field(df, name).dataType)
            within = (c < bound) | ((c == bound) & within)
    return df.where(within)


def _bytes_places(c: Column) -> Iterator[Column]:
    """Text or binary as doubles, one per six bytes, that sort as it does."""
    return (_piece_place(c.cast("binary"), piece) for piece in itertools.count())


def _piece_place(c: Column, piece: int) -> Column:
    """Six bytes make 48 bits; three more hold how many there are, so a text sorts before its extensions."""
    part = F.substring(c, 1 + piece * _PIECE_BYTES, _PIECE_BYTES)
    padded = F.rpad(F.hex(part), 2 * _PIECE_BYTES, "0")
    return F.conv(padded, 16, 10).cast("double") * 8 + F.octet_length(part)


def _decimal_text(c: Column, dtype: T.DecimalType) -> Column:
    """A decimal as text of fixed length that sorts as the number does."""
    digits = F.lpad(F.replace(F.abs(c).cast("string"), F.lit(".")), dtype.precision + 1, "0")
    return F.when(c < 0, F.concat(F.lit("0"), F.translate(digits, "0123456789", "9876543210"))).otherwise(F.concat(F.lit("1"), digits))


def _places(df: DataFrame, name: str) -> Iterator[Column]:
    """An order column as doubles that sort the same way, the later ones for what the earlier leave tied."""
    dtype, c = m.field(df, name).dataType, m.col(name)
    if isinstance(dtype, (T.StringType, T.BinaryType)):
        yield from _bytes_places(c)
    elif isinstance(dtype, T.DateType):
        yield F.unix_date(c).cast("double")
    elif isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        yield F.unix_micros(c.cast("timestamp")).cast("double")
    elif isinstance(dtype, T.BooleanType):
        yield c.cast("int").cast("double")
    else:
        yield m.number(df, name)
        if isinstance(dtype, T.LongType):  # two halves, where a double cannot tell neighbours apart
            yield F.shiftright(c, 32).cast("double")
            yield c.bitwiseAND(F.lit(2**32 - 1)).cast("double")
        if isinstance(dtype, T.DecimalType):
            yield from _bytes_places(_decimal_text(c, dtype))


def _seek(df: DataFrame, order_by: list[str], skip: int, page_size: int, enough: int) -> tuple[DataFrame, int]:
    """The rows from a point shortly before row ``skip`` on, and how many of them are still to skip.

    Column by column the rows that share the value at the target row are kept, until few are left. If many are left by the
    digest of the row, they are copies of one row, and as many of them are taken as the page shows.
    """
    ahead, tied, same = skip, 0, df
    equal: list[Column] = []
    later: list[Column] = []

    def rows_after() -> Column:
        return reduce(lambda a, b: a | b, later, F.lit(False))

    def rows_from_here() -> tuple[DataFrame, int]:
        return df.where(reduce(lambda a, b: a & b, equal) | rows_after()), ahead

    for name in order_by:
        dtype = m.field(df, name).dataType
        bytewise = isinstance(dtype, (T.StringType, T.BinaryType))
        for step, place in enumerate(_places(df, name)):
            plain = step == 0 and isinstance(dtype, T.NumericType)
            found = value_at_rank(same, name, ahead) if plain else value_at_rank(same.select(place.alias("place")), "place", ahead)
            if found is None:  # the target row is among those without a value, which come last
                gap = m.missing(df, name)
                counted = same.agg(F.count_if(~gap).alias("below"), F.count_if(gap).alias("tied")).first()
                ahead, tied = ahead - counted.below, counted.tied
                equal.append(gap)
                same = same.where(gap)
                break
            at, below, tied = found
            ahead -= below
            here, bound = m.comparable(df, name, at) if plain else (place, F.lit(at))
            later.append(reduce(lambda a, b: a & b, [*equal, (here > bound) | m.missing(df, name)]))
            equal.append(here == bound)
            same = same.where(here == bound)
            if tied <= enough:
                return rows_from_here()
            if (bytewise or (step and isinstance(dtype, T.DecimalType))) and at % 8 < _PIECE_BYTES:
                break  # the text ends in this piece
            if isinstance(dtype, T.LongType) and abs(at) < m.EXACT_DOUBLE and step == 0:
                break
        if tied <= enough:
            return rows_from_here()
    copies = same.limit(min(page_size, max(tied - ahead, 0)))
    return copies.unionByName(df.where(rows_after())), 0


def preview_pages(df: DataFrame, page_size: int = PAGE_SIZE) -> DataFrame:
    """(total_rows, page_size, total_pages); an empty table has one page."""
    check_page(1, page_size)
    pages = F.greatest(F.ceil(F.col("total_rows") / page_size), F.lit(1).cast("bigint"))
    counted = df.agg(F.count("*").alias("total_rows"))
    return counted.select("total_rows", F.lit(page_size).cast("bigint").alias("page_size"), pages.alias("total_pages"))
