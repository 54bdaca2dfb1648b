"""Token counts: the exact histogram of encoded lengths, and what its suffix sums answer for every context limit.

Tasks encode whole texts and count equal lengths of a batch before anything is shuffled. Suffix sums run within ranges of
``SPAN`` lengths and over the ranges' totals, so no task holds all lengths.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulyse.llm.staging import ships, staged
from tabulyse.llm.words import named

ships(__name__)

#: How the vocabulary below splits text before it merges bytes; a fixed value that belongs to it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
SPAN = 1024
#: The white space of the pattern. A run of so many letters is encoded by itself.
WHITE = "[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
LONG_RUN = 4096

_LONG = re.compile(f"{WHITE}{{{LONG_RUN},}}")


def encoder(vocabulary: bytes, pattern: str = PATTERN):
    """Byte-level BPE of a file of ranks; nothing in a text is special."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_count(encoding, text: str) -> int:
    """How many tokens a text has, whatever its length.

    The pattern engine gives up on about a million blanks in a row, so long runs of white space do not pass through it. What
    the pattern makes of a run is known: one piece, but for its last character where text follows.
    """
    total, begin = 0, 0
    for run in _LONG.finditer(text):
        end = run.end() - (run.end() < len(text))
        total += len(encoding.encode_ordinary(text[begin : run.start()])) + len(encoding._encode_single_piece(text[run.start() : end].encode()))
        begin = end
    return total + len(encoding.encode_ordinary(text[begin:] if begin else text))


def lengths(df: DataFrame, text: str, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(n_tokens, n_docs): how many texts of an Arrow batch have each encoded length. Null texts have none, as empty ones."""
    sent = df.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = encoder(sent.value, pattern)
        for batch in batches:
            sizes = np.array([token_count(encoding, t) if t else 0 for t in batch.column(0).to_pylist()], np.int64)
            values, times = np.unique(sizes, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(times.astype(np.int64))], ["n_tokens", "n_docs"])

    return df.select(named(text)).mapInArrow(run, "n_tokens long, n_docs long")


def histogram(df: DataFrame, text: str, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """One row per encoded length that occurs: n_tokens, n_docs, total_tokens (of these texts), docs_at_least and
    tokens_at_least (suffix sums over texts this long or longer), truncated_tokens (of all texts cut to this length), and
    docs_up_to (texts this short or shorter).

    An empty table gives no rows; null and empty texts have length 0; repeated rows count each. Texts of one length are one
    row. Columns other than ``text`` are not read, whatever their names.
    """
    # Two steps use the counts; written, they are encoded once.
    counts = staged(lengths(df, text, vocabulary, pattern).groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs")), "token-counts")
    counts = counts.withColumn("total_tokens", F.col("n_tokens") * F.col("n_docs")).withColumn("span", F.floor(F.col("n_tokens") / SPAN))
    return _suffix_sums(counts)


def _suffix_sums(counts: DataFrame) -> DataFrame:
    # Windows keep the rows and add what lies beyond them: first in the row's span, then in the spans above and below.
    inside = Window.partitionBy("span").orderBy(F.col("n_tokens").desc())
    spans = counts.groupBy("span").agg(F.sum("n_docs").alias("span_docs"), F.sum("total_tokens").alias("span_tokens"))
    above = Window.orderBy(F.col("span").desc()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    spans = spans.select(
        "span",
        F.coalesce(F.sum("span_docs").over(above), F.lit(0)).alias("docs_above"),
        F.coalesce(F.sum("span_tokens").over(above), F.lit(0)).alias("tokens_above"),
        F.sum("span_docs").over(everything).alias("all_docs"),
        F.sum("span_tokens").over(everything).alias("all_tokens"),
    )
    docs = F.sum("n_docs").over(inside) + F.col("docs_above")
    tokens = F.sum("total_tokens").over(inside) + F.col("tokens_above")
    summed = counts.join(spans, "span").withColumn("docs_at_least", docs).withColumn("tokens_at_least", tokens)
    cut = F.col("all_tokens") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")
    up_to = F.col("all_docs") - F.col("docs_at_least") + F.col("n_docs")
    return summed.select("n_tokens", "n_docs", "total_tokens", "docs_at_least", "tokens_at_least", cut.alias("truncated_tokens"), up_to.alias("docs_up_to"))


def truncated_totals(counts: DataFrame, limits: list[int]) -> DataFrame:
    """(limit, tokens): tokens of all texts if each is cut to ``limit``, for any limits, from a histogram."""
    wanted = F.explode(F.array(*(F.lit(x).cast("long") for x in limits))).alias("limit")
    rows = counts.select("n_tokens", "n_docs", wanted)
    return rows.groupBy("limit").agg(F.sum(F.least("n_tokens", "limit") * F.col("n_docs")).alias("tokens"))


def quantiles(counts: DataFrame, shares: list[float]) -> DataFrame:
    """(share, n_tokens): the smallest length that at least this share of the texts does not exceed, from a histogram."""
    wanted = F.explode(F.array(*map(F.lit, shares))).alias("share")
    whole = counts.agg(F.sum("n_docs").alias("all_docs"))
    rows = counts.select("n_tokens", "docs_up_to", wanted).crossJoin(F.broadcast(whole))  # one row
    return rows.where(F.col("docs_up_to") >= F.col("share") * F.col("all_docs")).groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))
