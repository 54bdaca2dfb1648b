"""Text of Arrow batches as bytes, and words of bytes, for the functions that run inside tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tabulyse.llm.staging import ships

ships(__name__)

#: A word is a run of anything but these; bytes.split() divides text at just these characters.
SPACE_WORDS = r"[^\x20\x09-\x0D]+"

#: Bytes that op2's words are made of keep their place (A-Z as a-z), all others become a blank.
_FOLDED = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def raw(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a text column, None for null."""
    return column.cast(pa.large_binary()).to_pylist()


def named(column: str) -> Column:
    """A column by its name, dots and backticks included."""
    return F.col("`" + column.replace("`", "``") + "`")


def per_text(df: DataFrame, text: str, columns: list[str], schema: str, produce: Callable[[list[bytes | None]], list]) -> DataFrame:
    """``columns`` of the table, then one column per field of ``schema``, made of each Arrow batch of texts by ``produce``.

    Columns go through under names of their own, so a table's names never clash with the new ones.
    """
    kept = [f"_{i}" for i in range(len(columns))]
    source = df.select(named(text).alias("_text"), *(named(c).alias(k) for c, k in zip(columns, kept)))
    added = StructType.fromDDL(schema)
    whole = StructType([*source.drop("_text").schema, *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *produce(raw(batch.column(0)))], whole_names)

    whole_names = whole.fieldNames()
    return source.mapInArrow(run, whole).toDF(*columns, *added.fieldNames())


def alnum_words(text: bytes | None) -> list[bytes]:
    """Lower-cased (A-Z) runs of ASCII letters, digits and all characters beyond ASCII."""
    return text.translate(_FOLDED).split() if text else []


def space_words(text: bytes | None) -> list[bytes]:
    return text.split() if text else []


class WordHashes(dict):
    """XXH64 of a word, remembered; forgets everything beyond ``most`` words, so memory stays bounded."""

    def __init__(self, most: int = 500_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def in_groups(items: Iterator, weight, limit: int) -> Iterator[list]:
    """Consecutive items in lists whose weights sum to ``limit`` or little more."""
    group, total = [], 0
    for item in items:
        group.append(item)
        total += weight(item)
        if total >= limit:
            yield group
            group, total = [], 0
    if group:
        yield group
