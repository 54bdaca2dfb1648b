"""Hash-derived integers that do not depend on how rows are partitioned."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD_RANGE = 2**32


def keyed_md5(*parts: Column | str | int) -> Column:
    """md5 of the parts joined by colons."""
    return F.md5(F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]))


def hash_word(digest: Column, word: int = 0) -> Column:
    """The 32-bit unsigned integer in hex digits ``8*word .. 8*word+7`` of a digest."""
    return F.conv(F.substring(digest, 8 * word + 1, 8), 16, 10).cast("bigint")
