"""Alignment of two tokenizers' tokens over the bytes of each text, by interval coalescing.

A text is cut at single blanks between printed characters, where both tokenizers always end a token (checked against the
piece vocabulary), so equal segments are encoded and aligned once per task and memory follows the segments, not the text.
All new segments of a batch are laid end to end; the tokens of both sides are lexsorted by start, ``maximum.accumulate``
runs over their ends, and a group breaks where a start reaches the running maximum. Inside a group every A token is linked
to every B token; equal ids of a group are counted once with their product, so a long group costs its distinct ids.

The id pairs of a document with their numbers of links are written once. Counting documents by pair pre-aggregates in each
task. The counts meet the documents again by broadcast up to ``most`` pairs, and by a join that shuffles beyond it.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tabulyse.llm.staging import ships, staged
from tabulyse.llm.words import in_groups, named

ships(__name__)

BYTE_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"

#: Both tokenizers end a token before such a blank: no pattern of A and no piece of B holds a blank behind another character.
_CUT = re.compile(r"(?<=[\w!-~]) (?=[\w!-~])")
#: Such a segment can be joined to others by blanks again.
_EDGES = re.compile(r"(?s)[\w!-~](?:.*[\w!-~])?\Z")
_RUN = 4096
_BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")
_BLANK = "▁"

ALIGNED = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printed Latin-1 stands for itself, the rest follow from U+0100."""
    printed = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = sorted(set(range(256)) - set(printed))
    return {chr(b): b for b in printed} | {chr(0x100 + i): b for i, b in enumerate(others)}


def piece_bytes(piece: str) -> bytes:
    found = _BYTE_PIECE.fullmatch(piece)
    return bytes([int(found[1], 16)]) if found else piece.replace(_BLANK, " ").encode()


class Tokenizers:
    """Both encoders, and the bytes of every id."""

    def __init__(self, byte_vocabulary: bytes, piece_vocabulary: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(byte_vocabulary.decode())
        self.a.encode_special_tokens = True
        letters = byte_letters()
        words = json.loads(byte_vocabulary)["model"]["vocab"]
        self.a_bytes = [b""] * max(len(words), self.a.get_vocab_size())
        for word, i in words.items():
            self.a_bytes[i] = bytes(letters.get(c, 0) for c in word)
        self.b = sentencepiece.SentencePieceProcessor(model_proto=piece_vocabulary)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [piece_bytes(p) for p in pieces]
        self.can_cut = not any(_BLANK in p.lstrip(_BLANK) for p in pieces)

    def segments(self, text: str) -> list[str]:
        return _CUT.split(text) if self.can_cut else [text]

    def encode(self, segments: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        a = [e.ids for e in self.a.encode_batch_fast([" " + s for s in segments], add_special_tokens=False)]
        return a, self.b.encode(segments, num_threads=1)


def coalesced(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The group of each interval: intervals in order of start belong together until one starts where all before have ended."""
    order = np.lexsort((ends, starts))
    reach = np.maximum.accumulate(ends[order])
    group = np.zeros(len(order), np.int64)
    group[order[1:]] = np.cumsum(starts[order[1:]] >= reach[:-1])
    return group


def _expanded(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For lists of these lengths laid end to end: the list of each element, and its place in the list."""
    owner = np.repeat(np.arange(len(lengths)), lengths)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths)


class Aligner:
    """Aligns texts ``chars`` characters at a time, remembering about ``most`` segments."""

    def __init__(self, tokenizers: Tokenizers, most: int = 300_000, chars: int = 1 << 20):
        self.tokenizers, self.most, self.chars = tokenizers, most, chars
        self.a_size = np.array([len(x) for x in tokenizers.a_bytes], np.int64)
        self.b_size = np.array([len(x) for x in tokenizers.b_bytes], np.int64)
        self.width = len(tokenizers.b_bytes)
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.texts: list[str | None] = []  # of the groups; None where the bytes differ
        self.numbers = np.zeros((0, 4), np.int64)
        self.pairs, self.times, self.ends = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64)

    def places(self, segments: list[str]) -> list[int]:
        place = self.place
        new = [s for s in dict.fromkeys(segments) if s not in place]
        if new:
            self._learn(new)
        return [place[s] for s in segments]

    def _encoded(self, segments: list[str]) -> tuple[list[str], list[list[int]], list[list[int]], list[str]]:
        """Segments whose bytes both sides keep, in an order of its own, with the ids of runs of them; and the other segments.

        Segments are encoded many at a time, joined by the blanks that were cut: the tokens are the same.
        """
        t = self.tokenizers
        odd, runs = [], []
        for s in segments:
            if not (_EDGES.match(s) and t.can_cut):
                odd.append([s])
            elif runs and size < _RUN:
                runs[-1].append(s)
                size += len(s)
            else:
                runs.append([s])
                size = len(s)
        good, a_ids, b_ids, bad = [], [], [], []
        todo = odd + runs
        while todo:
            texts, again = [" ".join(r) for r in todo], []
            for run, text, a, b in zip(todo, texts, *t.encode(texts)):
                own = b" " + text.encode()
                if b"".join(map(t.a_bytes.__getitem__, a)) == own and b"".join(map(t.b_bytes.__getitem__, b)) == own:
                    good += run
                    a_ids.append(a)
                    b_ids.append(b)
                elif len(run) > 1:
                    again += [[s] for s in run]
                else:
                    bad += run
            todo = again
        return good, a_ids, b_ids, bad

    def _learn(self, segments: list[str]) -> None:
        good, a_ids, b_ids, bad = self._encoded(segments)
        self.place.update(zip(good + bad, range(len(self.place), len(self.place) + len(segments))))
        numbers, strings, counts = np.zeros((len(segments), 4), np.int64), [], np.zeros(len(segments), np.int64)
        if good:
            a, b = (np.fromiter(chain.from_iterable(x), np.int64) for x in (a_ids, b_ids))
            a_ends, b_ends = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
            group = coalesced(np.concatenate([a_ends - self.a_size[a], b_ends - self.b_size[b]]), np.concatenate([a_ends, b_ends]))
            a_group, b_group = group[: len(a)], group[len(a) :]
            n_groups = int(group.max()) + 1
            n_a, n_b = np.bincount(a_group, minlength=n_groups), np.bincount(b_group, minlength=n_groups)
            last = np.searchsorted(a_ends, np.cumsum([len(s.encode()) + 1 for s in good]))  # a segment's end is a common end
            owner = np.repeat(np.arange(len(good)), np.diff(a_group[last], prepend=-1))
            for k, x in enumerate((n_a, n_b, np.ones(n_groups, np.int64), n_a * n_b)):
                numbers[: len(good), k] = np.bincount(owner, x, len(good)).astype(np.int64)
            strings = self._spelled(numbers[: len(good), 2], a, b, n_a, n_b)
            pairs, times, at = self._linked(a, b, a_group, b_group, n_groups)
            at = owner[at]
            order = np.argsort(at, kind="stable")
            self.pairs, self.times = np.concatenate([self.pairs, pairs[order]]), np.concatenate([self.times, times[order]])
            counts = np.bincount(at, minlength=len(segments))
        self.texts += strings + [None] * len(bad)
        self.numbers = np.concatenate([self.numbers, numbers])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(counts)])

    def _linked(self, a: np.ndarray, b: np.ndarray, a_group: np.ndarray, b_group: np.ndarray, n_groups: int):
        """Distinct id pairs of each group, their links, and the group."""
        (ka, ca), (kb, cb) = (np.unique(g * w + x, return_counts=True) for g, x, w in ((a_group, a, len(self.a_size)), (b_group, b, self.width)))
        ga, gb = ka // len(self.a_size), kb // self.width
        in_b = np.bincount(gb, minlength=n_groups)
        first_b = np.cumsum(in_b) - in_b
        of, nth = _expanded(in_b[ga])
        other = first_b[ga[of]] + nth
        return (ka[of] % len(self.a_size)) * self.width + kb[other] % self.width, ca[of] * cb[other], ga[of]

    def _spelled(self, groups_of: np.ndarray, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> list[str]:
        """The groups of each segment as text."""
        a_text, b_text = list(map(str, a.tolist())), list(map(str, b.tolist()))
        groups, i, j = [], 0, 0
        for x, y in zip(n_a.tolist(), n_b.tolist()):
            left = a_text[i] if x == 1 else ",".join(a_text[i : i + x])
            groups.append(f"{left}|{b_text[j]}" if y == 1 else f"{left}|{','.join(b_text[j : j + y])}")
            i, j = i + x, j + y
        ends = np.cumsum(groups_of).tolist()
        return [groups[p] if q - p == 1 else ";".join(groups[p:q]) for p, q in zip([0, *ends], ends)]

    def _chunks(self, texts: list[str | None]) -> Iterator[tuple[int, str]]:
        """Texts by their place; long ones in chunks that end where a segment does."""
        for i, text in enumerate(texts):
            begin = 0
            while text and self.tokenizers.can_cut and (cut := _CUT.search(text, begin + self.chars)):
                yield i, text[begin : cut.start()]
                begin = cut.end()
            if text:
                yield i, text[begin:] if begin else text

    def align(self, texts: list[str | None]) -> list[pa.Array]:
        """The columns of ``ALIGNED`` for these texts."""
        n, space = len(texts), len(self.a_size) * self.width
        digests, whole, numbers = [None] * n, np.array([bool(t) for t in texts], bool), np.zeros((n, 4), np.int64)
        linked, links = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for part in in_groups(self._chunks(texts), lambda c: len(c[1]), self.chars):
            if len(self.place) > self.most or len(self.pairs) > 40 * self.most:
                self.forget()
            cut = [self.tokenizers.segments(c) for _, c in part]
            at = np.array(self.places([s for c in cut for s in c]), np.int64)
            begin = 0
            for (i, _), c in zip(part, cut):
                words = list(map(self.texts.__getitem__, at[begin : begin + len(c)].tolist()))
                begin += len(c)
                if None in words:
                    whole[i] = False
                else:
                    spelled = ";".join(words).encode()
                    if digests[i]:
                        digests[i].update(b";" + spelled)
                    else:
                        digests[i] = hashlib.sha256(spelled)
            known = len(self.texts)
            seen, often = np.unique(np.repeat([i for i, _ in part], [len(c) for c in cut]) * known + at, return_counts=True)
            owner, at = seen // known, seen % known
            for k in range(4):
                np.add.at(numbers[:, k], owner, self.numbers[at, k] * often)
            of, nth = _expanded(self.ends[at + 1] - self.ends[at])
            source = self.ends[at[of]] + nth
            keys, times = _summed(owner[of] * space + self.pairs[source], self.times[source] * often[of])
            linked.append(keys)
            links.append(times)
        keys, times = _summed(np.concatenate(linked), np.concatenate(links))
        held = whole[keys // space]
        keys, times = keys[held], times[held]
        numbers[~whole] = 0
        texts_of = [d.hexdigest() if w else "" for d, w in zip(digests, whole)]
        offsets = pa.array(np.searchsorted(keys, np.arange(n + 1) * space).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (keys % space, times)]
        return [*(pa.array(numbers[:, k]) for k in range(4)), pa.array(texts_of, pa.string()), *lists]


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of each one's values."""
    keys, back = np.unique(keys, return_inverse=True)
    sums = np.zeros(len(keys), np.int64)
    np.add.at(sums, back, values)
    return keys, sums


def aligned(df: DataFrame, text: str, columns: list[str], byte_vocabulary: str = BYTE_VOCABULARY, piece_vocabulary: str = PIECE_VOCABULARY, chars: int = 1 << 20) -> DataFrame:
    """``columns``, then per text: tokens of each side, groups, links, the digest of the groups written as
    ``a1,a2|b1;a3|b2,b3``, and the distinct linked id pairs (A id * size of B's vocabulary + B id) with their links.

    A is given a blank and the text, B the text, to which it adds one. A text that is null or empty, or whose tokens' bytes
    differ from blank and text (B may normalise, U+2581 reads as a blank), has no tokens: zeros, '' and empty lists.
    Strings of special tokens are plain text. Names of other columns don't matter; repeated rows come back repeated.
    ``chars`` bounds what is aligned at once; longer texts are aligned in chunks that end where a segment does.
    """
    context = df.sparkSession.sparkContext
    sent = [context.broadcast(Path(p).read_bytes()) for p in (byte_vocabulary, piece_vocabulary)]
    kept = [f"_{i}" for i in range(len(columns))]
    source = df.select(named(text).alias("_text"), *(named(c).alias(k) for c, k in zip(columns, kept)))
    added = StructType.fromDDL(ALIGNED)
    whole = StructType([*source.drop("_text").schema, *added])
    names = whole.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(Tokenizers(*(x.value for x in sent)), chars=chars)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            done = 0
            for part in in_groups(iter(texts), lambda t: len(t or "") + 1, chars):
                found = aligner.align(part)
                yield pa.RecordBatch.from_arrays([*(c.slice(done, len(part)) for c in batch.columns[1:]), *found], names)
                done += len(part)

    return source.mapInArrow(run, whole).toDF(*columns, *added.fieldNames())


def pair_counts(pairs: DataFrame, width: int) -> DataFrame:
    """(pair, n_docs, best) of rows that list each document's distinct pairs: its documents, and whether no pair of its A id has more."""
    counts = pairs.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n_docs"))
    same = Window.partitionBy(F.floor(F.col("pair") / width))
    return counts.select("pair", "n_docs", (F.col("n_docs") == F.max("n_docs").over(same)).alias("best"))


def with_links(df: DataFrame, key: str, text: str, byte_vocabulary: str = BYTE_VOCABULARY, piece_vocabulary: str = PIECE_VOCABULARY, most: int = 2_000_000) -> DataFrame:
    """Per row: ``key``, n_a, n_b, n_groups, n_links, n_best (links whose pair is in as many documents as any of its A id),
    count_sum (documents of the pair, over the links) and groups_sha256.

    Every row is a document, also repeated ones and those with a null key. An empty table gives an empty table.
    ``most`` only chooses how the counts reach the documents: by broadcast, or by a join that shuffles.
    """
    width = _pieces(piece_vocabulary)
    rows = staged(aligned(df, text, [key], byte_vocabulary, piece_vocabulary).toDF("key", *StructType.fromDDL(ALIGNED).fieldNames()).withColumn("row", F.monotonically_increasing_id()), "aligned")
    counts = staged(pair_counts(rows, width), "pair-counts")
    links = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("at")).select("row", F.col("at.pairs").alias("pair"), F.col("at.times").alias("times"))
    met = links.join(F.broadcast(counts) if counts.count() <= most else counts, "pair")
    sums = met.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n_docs")).alias("count_sum"))
    found = rows.drop("pairs", "times").join(sums, "row", "left")
    totals = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")]
    return found.select("key", "n_a", "n_b", "n_groups", "n_links", *totals, "groups_sha256").withColumnRenamed("key", key)


def _pieces(vocabulary: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=Path(vocabulary).read_bytes()).get_piece_size()
