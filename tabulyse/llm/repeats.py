"""Duplicate passages by looking up every window of words, in place of a greedy relative Lempel-Ziv parse.

A window (``window`` words) that also starts earlier in the corpus is duplicate, with the earliest place as its reference;
windows that follow one another in a document and in the reference are one factor. A greedy parse keeps a factor's first
reference as long as it lasts; here the earliest place of each window decides, so a factor ends where that changes. Covered
are the words of all windows that start earlier, also of those that would straddle two greedy factors.

A block is what one task holds at a time: about ``BLOCK_WORDS`` words of whole documents. For the removal of repeats, what
repeats inside a block is settled in the task; against all other blocks it is one lookup: blocks send the first place of
each window to the window's hash, and the earliest place wins. ``factors`` looks up all windows, whatever their block.

Sending every window would cost several times the corpus. So an anchor stands for windows first: the smallest hash of the
``anchor`` words that start in the window's first ``window - anchor + 1`` places. Equal windows have equal anchors, thus only
windows whose anchor occurs at more than one place can repeat, and only they are looked up.

Windows are one if 88 bits of two hashes agree. Of the 10^13 windows of 100 TB about a quarter has an anchor that repeats; the
odds that any two of these differ and agree are below one in a hundred. Anchors are only a filter, and 48 bits suffice.

What repeats inside a block is settled there, so a passage in a third of all documents puts one row per block, not per
document, on its hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StructType

from tabulyse.llm.staging import ships
from tabulyse.llm.words import WordHashes, in_groups, named, raw, space_words

ships(__name__)

WINDOW = 20
ANCHOR = 8
BLOCK_WORDS = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_OTHER_BASE = 0xD6E8FEB86659FD93


def sequence_hashes(words: np.ndarray, size: int, base: int = _BASE) -> np.ndarray:
    """A hash of every ``size`` consecutive word hashes."""
    out, done, part, length = None, 0, words, 1
    while True:
        scale = np.uint64(pow(base, length, 1 << 64))
        if size & 1:
            many = len(words) - done - length + 1
            out = part if out is None else out[:many] * scale + part[done : done + many]
            done += length
        size >>= 1
        if not size:
            break
        part = part[:-length] * scale + part[length:]
        length *= 2
    out = (out ^ (out >> np.uint64(31))) * _MIX
    return out ^ (out >> np.uint64(29))


def _slide(values: np.ndarray, width: int, pick) -> np.ndarray:
    """The least (or largest) of every ``width`` consecutive values."""
    have = 1
    while 2 * have <= width:
        values, have = pick(values[:-have], values[have:]), 2 * have
    rest = width - have
    return pick(values[:-rest], values[rest:]) if rest else values


class Block:
    """The words of some documents, numbered through, and the hashes of what starts at each of them."""

    def __init__(self, documents: list[list[bytes]], hashes: WordHashes, window: int, anchor: int):
        lengths = np.array([len(d) for d in documents], np.int64)
        self.begin = np.cumsum(lengths) - lengths
        words = np.fromiter((h for d in documents for h in map(hashes.__getitem__, d)), np.uint64, int(lengths.sum()))
        ok = lengths >= window
        size = len(words) - window + 1
        if size < 1 or not ok.any():
            self.starts = np.zeros(0, np.int64)
            return
        inside = np.zeros(size + 1, np.int64)  # windows that lie in one document
        np.add.at(inside, self.begin[ok], 1)
        np.add.at(inside, (self.begin + lengths - window + 1)[ok], -1)
        inside = np.cumsum(inside[:size]) > 0
        self.small = sequence_hashes(words, anchor) >> np.uint64(16) | np.uint64(1)
        self.least = _slide(self.small, window - anchor + 1, np.minimum)  # the anchor's hash, per window
        self.starts = np.flatnonzero(inside)
        self.windows = sequence_hashes(words, window)[self.starts]
        self.checks = (sequence_hashes(words, window, _OTHER_BASE)[self.starts] >> np.uint64(40)).astype(np.int32)
        width = window - anchor + 1
        # A place is an anchor if it has the least hash of some window; then that is the largest least around it.
        used = np.concatenate([np.zeros(width - 1, np.uint64), np.where(inside, self.least, np.uint64(0)), np.zeros(width - 1, np.uint64)])
        self.anchors = np.flatnonzero(_slide(used, width, np.maximum)[: len(self.small)] == self.small)

    def document(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begin, places, side="right") - 1


def _blocks(batch: pa.RecordBatch, text: int, window: int, anchor: int, hashes: WordHashes) -> Iterator[tuple[int, Block]]:
    """(row of the first document, block); empty documents after a full one belong to no window, so ties in begin are harmless."""
    first = 0
    for group in in_groups(map(space_words, raw(batch.column(text))), len, BLOCK_WORDS):
        yield first, Block(group, hashes, window, anchor)
        first += len(group)


def _anchor_rows(window: int, anchor: int, names: list[str]):
    """Rows (doc, anchor, at): each anchor of the block once per document. ``at`` packs the document's mark, a salt, and in the
    last bit whether the anchor has a second place here.

    The first document of an anchor gets salt 0 and speaks for the block; the others are settled and salted apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for first, block in _blocks(batch, 2, window, anchor, hashes):
                if not len(block.starts):
                    continue
                values, documents = block.small[block.anchors], block.document(block.anchors)
                order = np.lexsort((documents, values))
                values, documents = values[order], documents[order]
                new_value = np.append(True, values[1:] != values[:-1])
                new_pair = new_value | np.append(True, documents[1:] != documents[:-1])
                sure = ~(new_value & np.append(new_value[1:], True))
                keep = np.flatnonzero(new_pair)
                keep = keep[np.argsort(documents[keep], kind="stable")]
                rows = pa.array(documents[keep] + first)
                salt = np.where(new_value[keep], 0, documents[keep] + 1)
                at = np.asarray(batch.column(1).take(rows)) << 32 | salt << 1 | sure[keep]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), pa.array(values[keep].view(np.int64)), pa.array(at)], names)

    return run


def _ranks(keys: list) -> np.ndarray:
    """Rank of each key among the keys, null first; equal keys have one rank."""
    place = {k: i for i, k in enumerate(sorted(set(keys) - {None}))}
    return np.array([-1 if k is None else place[k] for k in keys], np.int64)


def _pairs_in(owner: np.ndarray, values: np.ndarray, lists: pa.ListArray) -> np.ndarray:
    """Which values are in their owner's list. Owners come in order."""
    wanted = np.asarray(lists.flatten()).view(np.uint64)
    whose = np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths()))
    pick = np.isin(values, wanted)
    at = np.flatnonzero(pick)
    everything = np.unique(wanted)
    pairs = owner[at] * len(everything) + np.searchsorted(everything, values[at])
    pick[at] = np.isin(pairs, whose * len(everything) + np.searchsorted(everything, wanted))
    return pick


def _window_rows(window: int, anchor: int, names: list[str], settle: bool = True):
    """Rows (hash, check, doc, at, settled) of the windows whose anchor repeats. ``at`` packs the word a window starts at and the
    document's mark; ``check`` is 24 bits of a second hash. Without ``settle`` it is (hash, check, doc, at) of each.

    First places in the block have nothing in ``settled`` yet. The others come as runs that follow one reference: (salt, count,
    ref_doc, ref_start), salted apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            repeated = batch.column(3)
            for first, block in _blocks(batch, 2, window, anchor, hashes):
                if not len(block.starts):
                    continue
                owner = block.document(block.starts)
                pick = _pairs_in(owner, block.least[block.starts], repeated.slice(first, len(block.begin)))
                starts, owner, found, check = block.starts[pick], owner[pick], block.windows[pick], block.checks[pick]
                if not len(starts):
                    continue
                start = starts - block.begin[owner]
                keys = batch.column(0).slice(first, len(block.begin)).to_pylist()
                at = start << 32 | np.asarray(batch.column(1).slice(first, len(block.begin)))[owner]
                if not settle:
                    yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(check), batch.column(0).take(pa.array(owner + first)), pa.array(at)], names)
                    continue
                rank = _ranks(keys)[owner]
                order = np.lexsort((at, rank, check, found))
                owner, found, check, start, at, rank = (x[order] for x in (owner, found, check, start, at, rank))
                head = np.append(True, (found[1:] != found[:-1]) | (check[1:] != check[:-1]))
                top = np.maximum.accumulate(np.where(head, np.arange(len(head)), 0))
                same = (rank == rank[top]) & (at == at[top])  # the first place itself, repeated rows included
                later = np.flatnonzero(~same)
                later = later[np.lexsort((start[later], owner[later]))]
                ref = top[later]
                joins = np.zeros(len(later), bool)
                joins[1:] = (owner[later][1:] == owner[later][:-1]) & (np.diff(start[later]) == 1) & (owner[ref][1:] == owner[ref][:-1]) & (np.diff(start[ref]) == 1)
                opens = np.flatnonzero(~joins)
                count = np.diff(np.append(opens, len(later)))
                later, ref = later[opens], ref[opens]
                top = np.flatnonzero(head)
                top = top[np.lexsort((start[top], owner[top]))]
                rows = np.concatenate([top, later])
                open_ = np.arange(len(rows)) < len(top)
                blank = np.zeros(len(top), np.int64)
                refs = pa.array(np.concatenate([blank, owner[ref] + first]), mask=open_)
                told = [np.concatenate([blank, x]).astype(np.int32) for x in (1 + np.arange(len(later)), count, start[ref])]
                settled = pa.StructArray.from_arrays([pa.array(told[0]), pa.array(told[1]), batch.column(0).take(refs), pa.array(told[2])], ["salt", "count", "ref_doc", "ref_start"], mask=pa.array(open_))
                yield pa.RecordBatch.from_arrays([pa.array(found[rows].view(np.int64)), pa.array(check[rows]), batch.column(0).take(pa.array(owner[rows] + first)), pa.array(at[rows]), settled], names)

    return run


def factors(df: DataFrame, key: str, text: str, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(doc, mark, start, words, ref_doc, ref_start): passages of at least ``window`` words that also start earlier, in a
    smaller key or at an earlier word of the same key, with one earlier place of each. ``mark`` tells apart rows that share
    a key but not the text. Positions count words from 0. A factor is as long as the earliest places of its windows follow one
    another. Factors of one document may overlap; neither blocks nor batches nor the order of documents matter.

    Null keys are smaller than any other. Rows equal in key and text are one document. Rows equal in key but not in text
    come in the order of a window's start in them, then of their marks. Texts that are null or below ``window`` words have none.
    """
    asked = _asked(_documents(df, key, text), window, anchor)
    schema = StructType([*StructType.fromDDL("hash long, check int"), asked.schema["doc"], *StructType.fromDDL("at long")])
    windows = asked.mapInArrow(_window_rows(window, anchor, schema.fieldNames(), settle=False), schema).distinct()
    place = F.struct("doc", "at")
    told = windows.join(windows.groupBy("hash", "check").agg(F.min(place).alias("first")), ["hash", "check"]).where(~place.eqNullSafe(F.col("first")))
    low = F.lit(0xFFFFFFFF)
    start, ref_start = (F.shiftright(c, 32).cast("int") for c in ("at", "first.at"))
    each = told.select("doc", F.col("at").bitwiseAND(low).alias("mark"), start.alias("start"), F.col("first.doc").alias("ref_doc"), F.col("first.at").bitwiseAND(low).alias("ref_mark"), ref_start.alias("ref_start"))
    apart = ["doc", "mark", "ref_doc", "ref_mark", F.col("start") - F.col("ref_start")]
    run = F.col("start") - F.row_number().over(Window.partitionBy(*apart).orderBy("start"))
    runs = each.withColumn("run", run).groupBy(*apart[:4], (F.col("start") - F.col("ref_start")).alias("apart"), "run")
    whole = runs.agg(F.min("start").alias("start"), (F.count("*") + (window - 1)).cast("int").alias("words"), F.min("ref_start").alias("ref_start"))
    return whole.select("doc", "mark", "start", "words", "ref_doc", "ref_start")


def _documents(df: DataFrame, key: str, text: str, columns: list[str] | None = None) -> DataFrame:
    """doc, mark, group, text and the columns: ``group`` is the key without nulls, which the last bit of ``mark`` tells, so that
    grouping and joining by (group, mark) share one partitioning. The rest of the mark is a hash of the text, which is only
    needed, and only sent along, if any two rows share a key."""
    shared = df.groupBy(named(key).alias("key")).agg(F.count("*").alias("n")).where("n > 1")
    text_hash = F.lit(0).cast("long") if shared.limit(1).isEmpty() else F.hash(named(key), named(text)).cast("long").bitwiseAND(F.lit(0x3FFFFFFF))
    mark = text_hash * 2 + named(key).isNull().cast("long")
    rows = df.select(named(key).alias("doc"), mark.alias("mark"), named(text).alias("text"), *(named(c).alias(f"_{i}") for i, c in enumerate(columns or [])))
    return rows.withColumn("group", _group(rows))


def _group(rows: DataFrame) -> Column:
    if isinstance(rows.schema["doc"].dataType, NumericType):
        return F.coalesce("doc", F.lit(0).cast(rows.schema["doc"].dataType))
    return F.coalesce(F.col("doc").cast("string"), F.lit(""))


def _asked(documents: DataFrame, window: int, anchor: int) -> DataFrame:
    """(doc, mark, text, anchors): the documents in which an anchor repeats."""
    source = documents.select("doc", "mark", "text", "group")
    doc = source.schema["doc"]
    schema = StructType([doc, *StructType.fromDDL("anchor long, at long")])
    places = source.drop("group").mapInArrow(_anchor_rows(window, anchor, schema.fieldNames()), schema)
    low = F.col("at").bitwiseAND(F.lit(0xFFFFFFFF))
    times = F.count("*").over(Window.partitionBy("anchor", F.shiftright(low, 1)))
    counted = places.withColumn("times", times).where((F.col("at") % 2 == 1) | (F.col("times") > 1))
    repeated = counted.groupBy(_group(counted).alias("group"), F.shiftright("at", 32).alias("mark")).agg(F.collect_list("anchor").alias("anchors"))
    return source.join(repeated, ["group", "mark"]).select("doc", "mark", "text", "anchors")


def _found(documents: DataFrame, window: int, anchor: int) -> DataFrame:
    """What ``factors`` covers, in pieces that depend on blocks: (doc, mark, start, words, ref_doc, ref_start)."""
    asked = _asked(documents, window, anchor)
    doc = asked.schema["doc"]
    settled = StructType.fromDDL("salt int, count int").add("ref_doc", doc.dataType).add("ref_start", "integer")
    schema = StructType([*StructType.fromDDL("hash long, check int"), doc, *StructType.fromDDL("at long")]).add("settled", settled)
    looked_up = asked.mapInArrow(_window_rows(window, anchor, schema.fieldNames()), schema)
    place = F.struct("doc", "at")
    first = F.first(place).over(Window.partitionBy("hash", "check", "settled.salt").orderBy("doc", "at"))
    known = F.col("settled").isNotNull()
    told = looked_up.withColumn("first", first).where(known | ~place.eqNullSafe(F.col("first")))
    ref_doc = F.when(known, F.col("settled.ref_doc")).otherwise(F.col("first.doc")).alias("ref_doc")
    ref_start = F.when(known, F.col("settled.ref_start")).otherwise(F.shiftright("first.at", 32).cast("int")).alias("ref_start")
    words = (F.coalesce("settled.count", F.lit(1)) + (window - 1)).alias("words")
    return told.select("doc", F.col("at").bitwiseAND(F.lit(0xFFFFFFFF)).alias("mark"), F.shiftright("at", 32).cast("int").alias("start"), words, ref_doc, ref_start)


def without_repeats(df: DataFrame, key: str, text: str, columns: list[str] | None = None, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """``key``, ``columns``, n_words, n_removed, spans (removed words: starts and ends in turn) and kept_text (the other words
    joined by one blank) of every row. See ``factors`` for nulls, ties and repeated rows; repeated rows come back repeated,
    null texts with no words. An empty table gives an empty table. Names of other columns don't matter."""
    columns = columns or []
    documents = _documents(df, key, text, columns)
    packed = F.shiftleft(F.col("start").cast("long"), 32).bitwiseOR(F.col("words").cast("long"))
    found = _found(documents, window, anchor)
    spans = found.groupBy(_group(found).alias("group"), "mark").agg(F.collect_list(packed).alias("factors"))
    kept = [f"_{i}" for i in range(len(columns))]
    joined = documents.join(spans, ["group", "mark"], "left").select("doc", *kept, "factors", "text")
    added = StructType.fromDDL("n_words long, n_removed long, spans array<int>, kept_text string")
    schema = StructType([*joined.drop("factors", "text").schema, *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for data, factors_there in zip(raw(batch.column(len(kept) + 2)), batch.column(len(kept) + 1)):
                words = space_words(data)
                if not factors_there.is_valid:
                    out.append((len(words), 0, [], b" ".join(words).decode()))
                    continue
                edge, spans_there = np.zeros(len(words) + 1, np.int64), np.asarray(factors_there.values)
                np.add.at(edge, spans_there >> 32, 1)
                np.add.at(edge, (spans_there >> 32) + (spans_there & 0xFFFFFFFF), -1)
                gone = np.cumsum(edge)[:-1] > 0
                turns = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0)).tolist()
                rest = [w for w, g in zip(words, gone.tolist()) if not g]
                out.append((len(words), len(words) - len(rest), turns, b" ".join(rest).decode()))
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept) + 1], *(pa.array([r[i] for r in out], k) for i, k in enumerate(kinds))], names)

    names = schema.fieldNames()
    return joined.mapInArrow(run, schema).toDF(key, *columns, *added.fieldNames())
