"""Records of large text files whose bounds depend on all that came before, cut in parallel.

Whether a line break ends a record depends on the quotes before it, so a file seems to ask for one reader. But what a byte
range does to the state of the reader is a small table: for each state it may begin in, the state it ends in. A first pass
makes that table for every range, folding the tables of its pieces (what lies between two separators). One row per range then
gives the state each range begins in, and a second pass cuts the records of all ranges at once. What lies before the first
record end of a range and after its last is a fragment; fragments of neighbouring ranges are put together.

There are two modes: outside and inside of a quoted text; scanners say what a piece does from either, and may count a depth.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabulyse.session import written

# Ship this module with the functions, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

OUTSIDE, INSIDE = 0, 1


class QuotedLines:
    """Lines with quoted texts that may hold line breaks. ``closed``: from outside, the line ends outside; ``closing``: the same
    from inside a quoted text. A record ends with the line, or where ``ends`` and ``ends_after`` (from inside) match it."""

    separator = "\n"
    tail = ""  # what follows the last piece of a record

    def __init__(self, quotes: str, closed: str, closing: str, ends: str | None = None, ends_after: str | None = None):
        self.quotes, self.closed, self.closing, self.ends, self.ends_after = quotes, closed, closing, ends, ends_after

    def step(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per piece the mode after it and the rise of the depth, from outside and from inside."""
        flat = np.zeros(len(pieces), np.int64)
        out, inside = flat.copy(), flat + INSIDE
        some = np.flatnonzero(_matches(pieces, self.quotes))
        if len(some):
            quoted = pieces.take(pa.array(some))
            out[some] = np.where(_matches(quoted, self.closed), OUTSIDE, INSIDE)
            inside[some] = np.where(_matches(quoted, self.closing), OUTSIDE, INSIDE)
        return out, inside, flat, flat

    def record_ends(self, pieces: pa.Array, before: np.ndarray, after: np.ndarray, depth: np.ndarray) -> np.ndarray:
        ends = after == OUTSIDE
        if self.ends:
            ends &= np.where(before == OUTSIDE, _matches(pieces, self.ends), _matches(pieces, self.ends_after))
        return ends


class JsonMembers:
    """Text between closing braces. A record ends where a brace closes a member of the outermost array."""

    separator = tail = "}"
    _STRING, _REST, _HEAD = r'"(?:[^"\\]|\\[\s\S])*"', r'"[\s\S]*', r'^(?:[^"\\]|\\[\s\S])*"'

    def step(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        out, up_out = self._from_outside(pieces)
        closes = _matches(pieces, self._HEAD)
        inside, up_in = self._from_outside(pc.replace_substring_regex(pieces, self._HEAD, "", max_replacements=1))
        return out, np.where(closes, inside, INSIDE), up_out, np.where(closes, up_in, 0)

    def _from_outside(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        bare = pc.replace_substring_regex(pieces, self._STRING, "")
        open_ = np.asarray(pc.match_substring(bare, '"'))
        bare = pc.replace_substring_regex(bare, self._REST, "")
        up, down = (sum(np.asarray(pc.count_substring(bare, c)).astype(np.int64) for c in pair) for pair in ("{[", "}]"))
        return np.where(open_, INSIDE, OUTSIDE), up - down - ~open_  # the brace that follows counts, unless it is text

    def record_ends(self, pieces: pa.Array, before: np.ndarray, after: np.ndarray, depth: np.ndarray) -> np.ndarray:
        return (after == OUTSIDE) & (depth == 1)


def _matches(pieces: pa.Array, pattern: str) -> np.ndarray:
    return np.asarray(pc.match_substring_regex(pieces, pattern))


def _modes(out: np.ndarray, inside: np.ndarray, start: int) -> np.ndarray:
    """The mode before each piece, and after the last: pieces set the mode, keep it or turn it round."""
    sets = out == inside
    turns = np.cumsum((out == INSIDE) & (inside == OUTSIDE))
    index = np.arange(len(out))
    last = np.maximum.accumulate(np.where(sets, index, -1)) if len(out) else index
    base = np.where(last >= 0, out[last], start)
    turned = turns - np.where(last >= 0, turns[last], 0)
    return np.append(start, base ^ (turned & 1)).astype(np.int64)


def pieces_of(spark: SparkSession, path: str, separator: str, files: Column | None = None, **options) -> DataFrame:
    """(file, block, value): what lies between two separators, with the file and the byte range it was read from. ``files`` is a
    condition on the files to read."""
    text = spark.read.options(lineSep=separator, **options).text(path)
    text = text if files is None else text.where(files)
    return text.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, int], pa.RecordBatch]]:
    """Parts of the batch that belong to one range. A task reads a range from its start to its end."""
    file, block = (np.asarray(batch.column(k)) for k in (0, 1))
    edges = np.flatnonzero((file[1:] != file[:-1]) | (block[1:] != block[:-1])) + 1
    for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(file)]):
        if b > a:
            yield (int(file[a]), int(block[a])), batch.slice(a, b - a)


def range_starts(pieces: DataFrame, scanner) -> DataFrame:
    """(file, block, mode, depth, first): the state in which each range begins, and the first letter of the file.

    One row per range of the file, that is per ``spark.sql.files.maxPartitionBytes`` of input.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, *state[0], *state[1], state[2])], names)

        for batch in batches:
            for at, part in _slices(batch):
                if at != key:
                    if key is not None:
                        yield row()
                    key, state = at, [[OUTSIDE, 0], [INSIDE, 0], ""]
                values = part.column(2)
                out, inside, up_out, up_in = scanner.step(values)
                for s in (0, 1):
                    modes = _modes(out, inside, state[s][0])
                    state[s] = [int(modes[-1]), state[s][1] + int(np.where(modes[:-1] == OUTSIDE, up_out, up_in).sum())]
                if not state[2]:
                    state[2] = next((t[0] for t in (x.lstrip("﻿ \t\r\n") for x in values.slice(0, 100).to_pylist()) if t), "")
        if key is not None:
            yield row()

    names = ["file", "block", "mode0", "rise0", "mode1", "rise1", "letter"]
    tables = pieces.mapInArrow(fold, "file long, block long, mode0 long, rise0 long, mode1 long, rise1 long, letter string")

    def starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, mode, depth, first = None, OUTSIDE, 0, ""
        for batch in batches:
            found = []
            for at, block, m0, r0, m1, r1, letter in zip(*(c.to_pylist() for c in batch.columns)):
                if at != file:
                    file, mode, depth, first = at, OUTSIDE, 0, letter
                found.append((at, block, mode, depth, first))
                mode, depth = (m0, depth + r0) if mode == OUTSIDE else (m1, depth + r1)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found) if found else [()] * 5, kinds)], states)

    states, kinds = ["file", "block", "mode", "depth", "first"], [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    # The ranges of a file follow one another in one task, which keeps no more than the state it is in.
    dealt = tables.repartition("file").sortWithinPartitions("file", "block")
    return written(dealt.mapInArrow(starts, "file long, block long, mode long, depth long, first string"), "range-starts")


def cut_records(pieces: DataFrame, starts: DataFrame, scanner) -> DataFrame:
    """(file, number, last, value), written: the records of all files. ``number`` is 0 for the first record of a file, NULL for
    those that lie within a range, and ``last`` is true for what follows the last record end of a file."""
    joint = pieces.join(F.broadcast(starts.select("file", "block", "mode", "depth")), ["file", "block"])  # a row per range

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, mode, depth, held, ended = None, OUTSIDE, 0, [], False

        def fragment(whole: bool) -> tuple:
            text = scanner.separator.join(held) + (scanner.tail if whole else "")
            return (*key, int(ended), whole, text)

        for batch in batches:
            found: list[tuple] = []
            records: list[str] = []
            for at, part in _slices(batch):
                if at != key:
                    if held:
                        found.append(fragment(False))
                    key, held, ended = at, [], False
                    mode, depth = part.column(3)[0].as_py(), part.column(4)[0].as_py()
                values = part.column(2)
                out, inside, up_out, up_in = scanner.step(values)
                modes = _modes(out, inside, mode)
                depths = depth + np.cumsum(np.where(modes[:-1] == OUTSIDE, up_out, up_in))
                ends = np.flatnonzero(scanner.record_ends(values, modes[:-1], modes[1:], depths)).tolist()
                texts, begin = values.to_pylist(), 0
                for end in ends:
                    held += texts[begin : end + 1]
                    begin = end + 1
                    if ended:
                        records.append((held[0] if len(held) == 1 else scanner.separator.join(held)) + scanner.tail)
                    else:
                        found.append(fragment(True))
                        ended = True
                    held = []
                held += texts[begin:]
                mode, depth = int(modes[-1]), int(depths[-1])
            yield rows(found, records)
        yield rows([fragment(False)] if held else [], [])

    def rows(found: list[tuple], records: list[str]) -> pa.RecordBatch:
        blank = [None] * len(records)
        columns = [*zip(*found)] if found else [()] * 5
        return pa.RecordBatch.from_arrays([pa.array([*c, *more], t) for c, more, t in zip(columns, [blank] * 4 + [records], types)], names)

    names, types = ["file", "block", "part", "ends", "value"], [pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.string()]
    cuts = written(joint.select("file", "block", "value", "mode", "depth").mapInArrow(cut, "file long, block long, part int, ends boolean, value string"), "cuts")
    whole = cuts.where("ends IS NULL").select(F.lit(None).cast("long").alias("file"), F.lit(None).cast("long").alias("number"), F.lit(False).alias("last"), "value")
    # Two fragments a range at most: what is before the first end, and after the last.
    order = Window.partitionBy("file").orderBy("block", "part").rowsBetween(Window.unboundedPreceding, -1)
    numbered = cuts.where("ends IS NOT NULL").withColumn("number", F.coalesce(F.sum(F.col("ends").cast("long")).over(order), F.lit(0).cast("long")))
    pieces_there = F.sort_array(F.collect_list(F.struct("block", "part", "value")))
    joined = numbered.groupBy("file", "number").agg(pieces_there.alias("p"), (~F.bool_or("ends")).alias("last"))
    return whole.unionByName(joined.select("file", "number", "last", F.array_join("p.value", scanner.separator).alias("value")))
