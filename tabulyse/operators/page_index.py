"""Pages of a table that is written once in its order, with a sparse index, so any page is one pruned read."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulyse.functions import missing as m
from tabulyse.operators.positions import numbered
from tabulyse.operators.preview import LARGEST_PAGE, PAGE_SIZE, check_page, shown
from tabulyse.operators.value_counts import row_key

_PLACE, _KEY, _CHUNK = "__place", "__row", "__chunk"
#: Rows of one folder, and bytes of one row group: what a page has to look at.
CHUNK_ROWS = 1_000_000
GROUP_BYTES = 1 << 20


def write_pages(df: DataFrame, order_by: list[str], path: str, chunk_rows: int = CHUNK_ROWS) -> str:
    """Write the table in the order of ``order_by`` with the place of each row; returns ``path``, for ``read_page``.

    Places are counted in two levels (ranges of the order, rows within a range), so no task orders the whole table. Rows that
    tie go by the digest of the row, missing values last. ``rows/`` holds them by chunks of ``chunk_rows`` places, sorted in
    small row groups whose statistics tell the places they hold; ``index/`` has a row per chunk: its first place, its number
    of rows and its first keys.
    """
    for name in order_by:
        m.field(df, name)
    # A flag ahead of each key puts missing values last, in an order that Spark can range by.
    marks = [x for c in order_by for x in (m.missing(df, c), m.value(df, c))]
    if set(df.columns) <= set(order_by):  # rows that tie are spellings of the same missing values
        places = numbered(df, [], df.columns, marks, [row_key(df)])
    else:
        places = numbered(df.withColumn(_KEY, row_key(df)), [], [_KEY, *df.columns], marks)
    copies = places.withColumn(_PLACE, F.explode(F.sequence(F.col("before"), F.col("before") + F.col("n") - 1)))
    chunked = copies.select(*map(m.col, df.columns), _PLACE, F.floor(F.col(_PLACE) / chunk_rows).cast("long").alias(_CHUNK))
    # Places are dense, so chunks are even, and ranges of places need not be sought by another run of all steps before.
    dealt = chunked.repartition(_CHUNK).sortWithinPartitions(_CHUNK, _PLACE)
    dealt.write.partitionBy(_CHUNK).option("parquet.block.size", GROUP_BYTES).parquet(os.path.join(path, "rows"))
    rows = _rows(df.sparkSession, path)
    first = [F.min_by(m.col(c), F.col(_PLACE)).alias(f"first_{c}") for c in order_by]
    rows.groupBy(_CHUNK).agg(F.min(_PLACE).alias("place"), F.count("*").alias("n"), *first).write.parquet(os.path.join(path, "index"))
    return path


def _rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(os.path.join(path, "rows"))


def read_page(spark: SparkSession, path: str, page: int = 1, page_size: int = PAGE_SIZE) -> DataFrame:
    """The rows of one page as text, as ``preview_page`` shows them; reads the row groups that hold the page, and no others."""
    check_page(page, page_size)
    begin = (page - 1) * page_size
    index = spark.read.parquet(os.path.join(path, "index"))
    here = index.where((F.col("place") < begin + page_size) & (F.col("place") + F.col("n") > begin)).select(_CHUNK)
    chunks = [r[0] for r in here.limit(LARGEST_PAGE).collect()]  # a chunk holds one row at least
    rows = _rows(spark, path)
    wanted = rows.where(F.col(_CHUNK).isin(chunks) & F.col(_PLACE).between(begin, begin + page_size - 1)).orderBy(_PLACE).limit(page_size)
    return wanted.select(*[shown(rows, c) for c in rows.columns if c not in (_PLACE, _CHUNK)])
