"""Quality rules: counts of words, symbols and repeats, and bands of zstandard ratios.

A text is compressed whole and in fixed chunks. Compressed size over raw size, low for repetitive text and high for
noise, must stay inside limits that depend on the length compressed: short texts carry more overhead.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from tabulyse.llm.staging import ships
from tabulyse.llm.words import per_text

ships(__name__)

#: (bytes from which the limits hold, lowest ratio, highest ratio); below the first there is no verdict by compression.
#: Random text in 64 characters carries 6 bits a byte: 0.75 and what zstandard adds, which the upper limits from 512 bytes on are below.
BANDS = ((128, 0.45, 0.95), (256, 0.40, 0.90), (512, 0.33, 0.77), (1024, 0.27, 0.70), (4096, 0.22, 0.70), (16384, 0.18, 0.70))
CHUNK_BYTES = 2048
#: A text goes if more than this share of its chunks' bytes is outside the limits.
MOST_BAD_CHUNKS = 0.3
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50

FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, ratio double, bad_chunks double, base_failed boolean, kept boolean"
_SYMBOLS = b"#*$%&|<>"
_NO_CHARACTER = bytes([0x20, *range(0x09, 0x0E), *range(0x80, 0xC0)])  # white space, and all but the first byte of a code point


def repeated_words(words: list[bytes], size: int = 3) -> int:
    """How many words lie in a window of ``size`` words that the text has twice or more."""
    if len(words) <= size:
        return 0
    ids: dict[bytes, int] = {}
    codes = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    windows = codes[: len(words) - size + 1]
    for k in range(1, size):  # at each step a code for every different start of a window
        windows = windows * len(ids) + codes[k : k + len(windows)]
        if k + 1 < size and len(ids) > 1 << 20:
            windows = np.unique(windows, return_inverse=True)[1]
    _, which, times = np.unique(windows, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(times[which] > 1)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + size, -1)
    return int(np.count_nonzero(np.cumsum(edge)))


def limits(size: int, bands=BANDS) -> tuple[float, float] | None:
    found = None
    for least, low, high in bands:
        if size >= least:
            found = (low, high)
    return found


def compression(data: bytes, compressor: zstandard.ZstdCompressor, chunk: int = CHUNK_BYTES, bands=BANDS) -> tuple[float | None, float, bool]:
    """Ratio of the whole text, share of its chunk bytes outside the limits, and whether the whole is inside its limits."""
    if not data:
        return None, 0.0, True
    ratio = len(compressor.compress(data)) / len(data)
    band = limits(len(data), bands)
    inside = band is None or band[0] <= ratio <= band[1]
    bad = judged = 0
    for k in range(0, len(data), chunk):
        piece = data[k : k + chunk]
        if band := limits(len(piece), bands):
            judged += len(piece)
            bad += len(piece) * (not band[0] <= len(compressor.compress(piece)) / len(piece) <= band[1])
    return ratio, bad / judged if judged else 0.0, inside


def judge(data: bytes | None, compressor: zstandard.ZstdCompressor, level_bands=BANDS) -> tuple:
    data = data or b""
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    repeats = repeated_words(words)
    ratio, bad, inside = compression(data, compressor, bands=level_bands)
    failed = len(words) < LEAST_WORDS or 100 * repeats > MOST_REPEATED_PERCENT * len(words)
    kept = not failed and inside and bad <= MOST_BAD_CHUNKS
    return len(words), len(data.translate(None, _NO_CHARACTER)), len(data) - len(data.translate(None, _SYMBOLS)), len(lines) - len(set(lines)), repeats, ratio, bad, failed, kept


def with_quality(df: DataFrame, text: str, columns: list[str], level: int = 3, bands=BANDS) -> DataFrame:
    """``columns`` of the table and the fields n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ratio (null for an
    empty text), bad_chunks, base_failed, kept of every row, in one pass without a shuffle.

    Null and empty texts have no words and fail the base. Repeated rows are judged alike, each by itself. An empty table
    gives an empty table. Names of other columns don't matter.
    """
    types = [pa.int64()] * 5 + [pa.float64()] * 2 + [pa.bool_()] * 2

    def produce(texts: list[bytes | None]) -> list[pa.Array]:
        compressor = zstandard.ZstdCompressor(level=level)
        rows = [judge(t, compressor, bands) for t in texts]
        return [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(types)]

    return per_text(df, text, columns, FIELDS, produce)
