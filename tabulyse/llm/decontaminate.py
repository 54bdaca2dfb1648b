"""Benchmark decontamination with suffix arrays of the training text.

Every task numbers the words of its documents by the benchmark's vocabulary (0: a word the benchmark lacks, which ends
any match), builds suffix arrays over shards of whole documents, and binary-searches every suffix of every test item in
them, one more word at a time up to the window: that gives each window all places where it occurs. Longest verbatim matches
of any length come from sorting test suffixes among the training ones: the longest match of a suffix is with a neighbour.

The benchmark is the query set. It is dealt into blocks of ``block_chars`` characters; one block at a time is sent to the
tasks, and the documents are read once for each block. With several blocks the documents are written once, numbered; each
block leaves a row per document that it hits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tabulyse.llm.staging import ships, staged
from tabulyse.llm.words import alnum_words, in_groups, named, raw

ships(__name__)

WINDOW = 10
SHARD_WORDS = 1 << 20
BLOCK_CHARS = 20_000_000
#: The label of items without a key; no text of a key looks like it.
NO_KEY = "\x00null"


class Queries:
    """The suffixes of the test items: numbered words with a 0 after each item, and per suffix where it starts, its item,
    its place in the item, and the length of the window that starts there (0: none does)."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        items = [(label, words) for label, words in items if words]
        self.labels = [label for label, _ in items]
        self.vocabulary: dict[bytes, int] = {}
        tokens, starts, owner, place, need = [], [], [], [], []
        for k, (_, words) in enumerate(items):
            first, n = len(tokens), len(words)
            tokens += [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words] + [0]
            starts += range(first, first + n)
            owner += [k] * n
            place += range(n)
            need += [window if i + window <= n else 0 for i in range(n)] if n >= window else [n] + [0] * (n - 1)
        self.tokens, self.starts = np.array([*tokens, 0], np.int64), np.array(starts, np.int64)
        self.owner, self.place, self.need = np.array(owner, np.int64), np.array(place, np.int64), np.array(need, np.int64)


def suffix_array(ids: np.ndarray) -> np.ndarray:
    """Positions of the words above 0, sorted by what follows up to the next 0. ``ids`` ends with a 0.

    Prefix doubling; a round sorts only the positions whose run of words is longer than what is sorted already.
    """
    size = len(ids)
    zeros = np.flatnonzero(ids == 0)
    at = np.flatnonzero(ids)
    run = np.zeros(size, np.int64)
    run[at] = zeros[np.searchsorted(zeros, at)] - at
    rank = np.zeros(size, np.int64)  # of a position: 1 + how many positions sort before all its equals
    rank[at] = np.searchsorted(np.sort(ids[at]), ids[at]) + 1
    known = 1
    active = at[run[at] > known]
    while len(active):
        first, second = rank[active], rank[active + known]
        order = np.argsort(first * (size + 1) + second, kind="stable")
        first, second, moved = first[order], second[order], active[order]
        new_group = np.append(True, first[1:] != first[:-1])
        new_part = new_group | np.append(True, second[1:] != second[:-1])
        index = np.arange(len(moved))
        group_at, part_at = np.maximum.accumulate(np.where(new_group, index, 0)), np.maximum.accumulate(np.where(new_part, index, 0))
        members = np.bincount(rank[at], minlength=size + 1)
        ended = members[first] - np.bincount(first, minlength=size + 1)[first]  # equals that end here come first
        rank[moved] = first + ended + part_at - group_at
        known *= 2
        active = active[run[active] > known]
    return at[np.argsort(rank[at], kind="stable")]


def _bound(ids: np.ndarray, suffixes: np.ndarray, low: np.ndarray, high: np.ndarray, depth: int, word: np.ndarray) -> np.ndarray:
    """Per query the first place of its interval at which the word ``depth`` words on is not below ``word``."""
    low, high = low.copy(), high.copy()
    last = len(suffixes) - 1
    while (some := low < high).any():
        middle = (low + high) >> 1
        below = some & (ids[suffixes[np.minimum(middle, last)] + np.where(some, depth, 0)] < word)
        low, high = np.where(below, middle + 1, low), np.where(some & ~below, middle, high)
    return low


def search(ids: np.ndarray, suffixes: np.ndarray, queries: Queries) -> np.ndarray:
    """The intervals (low, high, length, suffix) of ``suffixes`` that begin with a window of a test item."""
    many = len(queries.starts)
    low, high = np.zeros(many, np.int64), np.full(many, len(suffixes))
    alive, depth, windows = np.flatnonzero(queries.need) if len(suffixes) else np.arange(0), 0, []
    while len(alive):
        word = queries.tokens[queries.starts[alive] + depth]
        alive, word = alive[word > 0], word[word > 0]
        left = _bound(ids, suffixes, low[alive], high[alive], depth, word)
        right = _bound(ids, suffixes, left, high[alive], depth, word + 1)
        found = left < right
        alive, depth = alive[found], depth + 1
        low[alive], high[alive] = left[found], right[found]
        whole = queries.need[alive] == depth
        done, alive = alive[whole], alive[~whole]
        windows.append(np.stack([low[done], high[done], queries.need[done], done], axis=1))
    return np.concatenate(windows) if windows else np.zeros((0, 4), np.int64)


def longest(ids: np.ndarray, queries: Queries) -> tuple[np.ndarray, np.ndarray]:
    """Per test suffix the length of its longest match in ``ids``, and one place of it.

    Both texts are sorted as one; the neighbours of a test suffix among the training suffixes share more words with it than
    any other. What it shares is found word by word for all suffixes at once; the suffix of the next word shares one word less
    at least, so one that continues a match is not compared anew.
    """
    many, size = len(queries.starts), len(ids)
    both = np.concatenate([ids, queries.tokens])
    order = suffix_array(both)
    training = order < size
    index = np.arange(len(order))
    before = np.maximum.accumulate(np.where(training, index, -1))
    after = np.minimum.accumulate(np.where(training, index, len(order))[::-1])[::-1]
    nth = np.zeros(len(both), np.int64)
    nth[order] = index
    own = queries.starts + size
    best, place = np.zeros(many, np.int64), np.zeros(many, np.int64)
    for side, some in ((before, before >= 0), (after, after < len(order))):
        here = nth[own]
        there = np.flatnonzero(some[here])
        other = np.zeros(many, np.int64)
        other[there] = order[side[here[there]]]
        shared = np.zeros(many, np.int64)
        # A suffix whose neighbour's next word neighbours its own next word is settled by that one.
        follows = np.zeros(many, bool)
        follows[there] = True
        last = len(own) - 1
        nxt = np.minimum(np.arange(many) + 1, last)
        joined = follows & follows[nxt] & (own[nxt] == own + 1) & (other[nxt] == other + 1) & (np.arange(many) < last)
        alone = np.flatnonzero(follows & ~joined)
        depth = 0
        while len(alone):
            equal = (both[own[alone] + depth] == both[other[alone] + depth]) & (both[own[alone] + depth] > 0)
            alone = alone[equal]
            depth += 1
            shared[alone] = depth
        # One word more for each step back along a joined run, as long as that word is shared.
        same = follows & (both[own] == both[other]) & (both[own] > 0)
        runs = np.flatnonzero(joined)
        if len(runs):
            ends = np.flatnonzero(~joined)
            end = ends[np.searchsorted(ends, runs)]
            breaks = np.flatnonzero(~same)
            first_break = breaks[np.minimum(np.searchsorted(breaks, runs), max(len(breaks) - 1, 0))] if len(breaks) else np.full(len(runs), many)
            first_break = np.where(first_break < runs, many, first_break)
            shared[runs] = np.where(first_break < end, first_break - runs, end - runs + shared[end])
        better = shared > best
        best[better], place[better] = shared[better], other[better]
    return best, place


def _shard(texts: list[list[bytes]], queries: Queries) -> tuple[np.ndarray, np.ndarray]:
    """Numbered words of the documents, a 0 after each, and where each document starts."""
    lengths = np.array([len(w) + 1 for w in texts], np.int64)
    ids = np.zeros(int(lengths.sum()) + 1, np.int64)
    begin = np.cumsum(lengths) - lengths
    get = queries.vocabulary.get
    for words, a in zip(texts, begin.tolist()):
        ids[a : a + len(words)] = np.fromiter(map(get, words, repeat(0)), np.int64, len(words))
    return ids, begin


def _hits(texts: list[list[bytes]], queries: Queries) -> tuple[list[list[int]], list[list[str]]]:
    """Per document the spans of words inside a window, as starts and ends in turn, and the labels of the items hit."""
    ids, begin = _shard(texts, queries)
    suffixes = suffix_array(ids)
    windows = search(ids, suffixes, queries)
    edge = np.zeros(len(ids) + 1, np.int64)
    items: list[set[str]] = [set() for _ in texts]
    owners: dict[tuple[int, int, int], set[int]] = {}
    for low, high, need, which in windows.tolist():
        owners.setdefault((low, high, need), set()).add(int(queries.owner[which]))
    for (low, high, need), items_there in owners.items():
        places = suffixes[low:high]
        np.add.at(edge, places, 1)
        np.add.at(edge, places + need, -1)
        labels = {queries.labels[k] for k in items_there}
        for d in np.unique(np.searchsorted(begin, places, side="right") - 1).tolist():
            items[d] |= labels
    inside = np.cumsum(edge) > 0
    turns = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0))
    spans: list[list[int]] = [[] for _ in texts]
    for t, d in zip(turns.tolist(), (np.searchsorted(begin, turns, side="right") - 1).tolist()):
        spans[d].append(t - int(begin[d]))
    return spans, [sorted(x) for x in items]


def benchmark_blocks(items: DataFrame, key: str, text: str, block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The items, dealt by a hash into blocks of about ``block_chars`` characters: what the driver and a task hold at once."""
    rows = items.where(named(text).isNotNull()).select(F.coalesce(named(key).cast("string"), F.lit(NO_KEY)).alias("label"), named(text).alias("text"))
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-chars // block_chars)
    for k in range(blocks):
        block = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("label", "text"), F.lit(blocks)) == k)
        yield [(r.label, alnum_words(r.text.encode())) for r in block.toLocalIterator()]


def contamination(df: DataFrame, text: str, columns: list[str], items: DataFrame, item_key: str, item_text: str, window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``columns`` of every row, and n_words, n_hit, items (sorted labels of the items with windows in the text), spans
    (array of word positions: starts and ends in turn) and contaminated.

    Words are runs of ASCII letters and digits and characters beyond ASCII, A-Z lower-cased. A window is ``window``
    consecutive words of an item, or a whole item that is shorter. Null and wordless texts hit nothing, null or wordless
    items hit no text; the label of a null item key is ``NO_KEY``; items that share a key count as one. Repeated rows come back
    repeated. Empty tables give no rows, or no hits. Names of other columns don't matter.
    """
    kept = [f"_{i}" for i in range(len(columns))]
    rows = df.select(*(named(c).alias(k) for c, k in zip(columns, kept)), named(text).alias("text"))
    blocks = benchmark_blocks(items, item_key, item_text, block_chars)
    first, second = next(blocks, []), next(blocks, None)
    if second is None:
        found = _scanned(rows, kept, first, window)
    else:
        rows = staged(rows.withColumn("row", F.monotonically_increasing_id()), "numbered-documents")
        whole = staged(_scanned(rows, [*kept, "row"], first, window), "contamination")
        hits = whole.where(F.size("spans") > 0).select("row", "spans", "items")
        for block in chain([second], blocks):
            more = _scanned(rows, ["row"], block, window).where(F.size("spans") > 0).select("row", "spans", "items")
            hits = staged(hits.unionByName(more), "contamination")
        merged = hits.groupBy("row").agg(F.collect_list("spans").alias("lists"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        spans = F.coalesce(_joined(F.col("lists")), F.array().cast("array<int>"))
        found = whole.select(*kept, "row", "n_words").join(merged, "row", "left").select(*kept, "n_words", spans.alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    n_hit = F.aggregate(F.transform("spans", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    out = found.select(*kept, "n_words", n_hit.alias("n_hit"), "items", "spans").withColumn("contaminated", F.col("n_hit") > 0)
    return out.toDF(*columns, "n_words", "n_hit", "items", "spans", "contaminated")


def _joined(lists: Column) -> Column:
    """Spans of several lists (starts and ends in turn) as one list, those that overlap or touch made one."""

    def pairs(spans: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(spans) - 2, F.lit(2)), lambda i: F.struct(F.get(spans, i).alias("s"), F.get(spans, i + 1).alias("e")))

    def step(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        grown = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.greatest(last, x["e"])))
        return F.when((F.size(done) > 0) & (x["s"] <= F.coalesce(last, F.lit(-1))), grown).otherwise(F.concat(done, F.array(x["s"], x["e"])))

    ordered = F.array_sort(F.flatten(F.transform(lists, pairs)))
    return F.aggregate(ordered, F.array().cast("array<int>"), step)


def _scanned(rows: DataFrame, kept: list[str], items: list[tuple[str, list[bytes]]], window: int) -> DataFrame:
    """``kept``, n_words, spans and items of every row, for one block of the benchmark."""
    source = rows.select(*kept, "text")
    schema = StructType([*source.drop("text").schema, *StructType.fromDDL("n_words long, spans array<int>, items array<string>")])
    sent, names = rows.sparkSession.sparkContext.broadcast(Queries(items, window)), schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = sent.value
        for batch in batches:
            lengths, spans, labels = [], [], []
            for group in in_groups(map(alnum_words, raw(batch.column(len(kept)))), len, SHARD_WORDS):
                new_spans, new_labels = _hits(group, queries)
                lengths += map(len, group)
                spans += new_spans
                labels += new_labels
            found = [pa.array(lengths, pa.int64()), pa.array(spans, pa.list_(pa.int32())), pa.array(labels, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *found], names)

    return source.mapInArrow(run, schema)


def longest_matches(df: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, least: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(item, item_word, words, doc, doc_word): for every word position of an item from which at least ``least`` words are
    found in the documents, the length of the longest verbatim match and one place of it (ties: smallest document key, then
    position). Each shard leaves one row per suffix that matches; the longest of all shards is taken after that."""
    source = df.select(named(key).alias("doc"), named(text).alias("text"))
    schema = StructType([*StructType.fromDDL("item string, item_word long, words long, doc_word long"), source.schema["doc"]])

    def scan(sent):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            queries = sent.value
            for batch in batches:
                first = 0
                for group in in_groups(map(alnum_words, raw(batch.column(1))), len, SHARD_WORDS):
                    ids, begin = _shard(group, queries)
                    most, at = longest(ids, queries)
                    which = np.flatnonzero(most >= least)
                    places = at[which]
                    docs = np.searchsorted(begin, places, side="right") - 1
                    columns = [pa.array([queries.labels[k] for k in queries.owner[which]], pa.string()), pa.array(queries.place[which]), pa.array(most[which]), pa.array(places - begin[docs])]
                    yield pa.RecordBatch.from_arrays([*columns, batch.column(0).take(pa.array(docs + first))], schema.fieldNames())
                    first += len(group)

        return run

    found = None
    for block in benchmark_blocks(items, item_key, item_text, block_chars):
        part = source.mapInArrow(scan(df.sparkSession.sparkContext.broadcast(Queries(block, least))), schema)
        found = part if found is None else found.unionAll(part)
    if found is None:
        found = df.sparkSession.createDataFrame([], schema)
    best = F.min(F.struct((-F.col("words")).alias("less"), "doc", "doc_word")).alias("best")
    return found.groupBy("item", "item_word").agg(best).select("item", "item_word", (-F.col("best.less")).alias("words"), "best.doc", "best.doc_word")
