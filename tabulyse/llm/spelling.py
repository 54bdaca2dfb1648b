"""Spelling variants of the words of a corpus, by pivotal grams.

Words are counted inside Arrow batches, so what is shuffled is a count per word and task. Bigrams are ranked by the number of
words that hold them, rare first. The prefix of a word is its three rarest bigrams (and those as rare as the third); one
edit destroys at most three bigrams less one, so three hold two disjoint ones: the pivots, chosen by dynamic programming to
be in the fewest words together. Of two words one edit apart, take the one whose prefix ends no later in the ranking: one of
its pivots survives, and the other word has it in its prefix.

Position limits: the edit lies either behind the first pivot, and both words agree up to its end, or before the second, and
they agree from its start on. So a pivot meets the prefix bigrams of words of at most one letter less or more whose place
from that end, and text on that side, are its own. Both sides are join keys; the edit distance is verified.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulyse.llm.staging import ships, staged
from tabulyse.llm.words import named, raw

ships(__name__)

#: Letters of words: a-z and U+00C0 to U+00FF, so there are at most 90 * 90 bigrams.
LETTERS = "[a-zÀ-ÿ]"
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def misspelt(run: str, start: int, every: int) -> str:
    """The run without one letter, if its CRC-32, continued from ``start``, is a multiple of ``every``."""
    h = zlib.crc32(run.encode(), start)
    return run[: h % len(run)] + run[h % len(run) + 1 :] if h % every == 0 else run


def words(df: DataFrame, key: str, text: str, shortest: int = 6, fewest: int = 5, every: int = 199, most: int = 200_000) -> DataFrame:
    """(word, n): words of at least ``shortest`` letters and ``fewest`` occurrences over all texts.

    Runs of letters, A-Z lower-cased, of which one in ``every`` loses a letter: a null key hashes as the empty text, null
    texts have no words, repeated rows count each. A task keeps up to about ``most`` words before it passes their counts on.
    """
    runs = re.compile(f"{LETTERS}{{{shortest},}}")  # a shorter one cannot become a word

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()
        for batch in batches:
            for doc, content in zip(batch.column(0).to_pylist(), raw(batch.column(1))):
                start = zlib.crc32(f"{doc or ''}:".encode())
                for run, n in Counter(runs.findall((content or b"").translate(_LOWER).decode())).items():
                    found[misspelt(run, start, every)] += n
                if len(found) > most:
                    yield listed(found)
                    found.clear()
        yield listed(found)

    def listed(found: Counter[str]) -> pa.RecordBatch:
        kept = [(w, n) for w, n in found.items() if len(w) >= shortest]
        return pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], ["word", "n"])

    rows = df.select(named(key).cast("string").alias("key"), named(text).alias("text"))
    return rows.mapInArrow(counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= fewest)


def bigram_words(listed: DataFrame) -> dict[str, int]:
    """How many of the distinct words hold each bigram; at most 90 * 90 entries."""
    grams = F.expr("array_distinct(transform(sequence(1, length(word) - 1), i -> substring(word, i, 2)))")
    return {r.gram: r.n for r in listed.select(F.explode(grams).alias("gram")).groupBy("gram").agg(F.count("*").alias("n")).toLocalIterator()}


def prefix(word: str, ranks: dict[str, int]) -> tuple[list[int], int]:
    """Places of the three rarest bigrams, and of those as rare as the third, in order; and the rank of the third."""
    held = [ranks[word[i : i + 2]] for i in range(len(word) - 1)]
    last = sorted(held)[2]
    return [i for i, r in enumerate(held) if r <= last], last


def pivots(word: str, places: list[int], often: dict[str, int]) -> tuple[int, int]:
    """Two disjoint bigrams among ``places`` that are in the fewest words together; the leftmost of equally good ones.

    Dynamic programming from left to right: the cheapest single bigram that has ended before this one, then the cheapest two.
    """
    single: list[tuple[int, int]] = []  # the cheapest (words, place) up to each place
    both = None
    for k, p in enumerate(places):
        cost = often[word[p : p + 2]]
        before = next((single[j] for j in range(k - 1, -1, -1) if places[j] <= p - 2), None)
        if before and (both is None or before[0] + cost < both[0]):
            both = (before[0] + cost, before[1], p)
        single.append(min(single[-1], (cost, p)) if single else (cost, p))
    return both[1], both[2]


def _grams(listed: DataFrame, often: dict[str, int]) -> DataFrame:
    """(pivot, side, size, word, last): each word's keys, as a prefix of its own length or as a pivot for each length it may meet."""
    ranks = {g: i for i, (_, g) in enumerate(sorted((n, g) for g, n in often.items()))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for word in batch.column(0).to_pylist():
                places, last = prefix(word, ranks)
                for p in places:
                    out += [(False, f">{word[: p + 2]}", len(word), word, last), (False, f"<{word[p:]}", len(word), word, last)]
                p, q = pivots(word, places, often)
                for size in (len(word) - 1, len(word), len(word) + 1):
                    out += [(True, f">{word[: p + 2]}", size, word, last), (True, f"<{word[q:]}", size, word, last)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)] if out else [pa.array([], t) for t in types], names)

    names, types = ["pivot", "side", "size", "word", "last"], [pa.bool_(), pa.string(), pa.int32(), pa.string(), pa.int32()]
    return listed.select("word").mapInArrow(run, "pivot boolean, side string, size int, word string, last int")


def near_words(listed: DataFrame) -> DataFrame:
    """(word, near): every two words of ``listed`` (column word, distinct, four letters or more) that one edit parts, both ways."""
    grams = staged(_grams(listed, bigram_words(listed)), "grams")
    mine = grams.where("pivot").select("side", "size", F.col("word").alias("a"), F.col("last").alias("a_last"))
    theirs = grams.where("NOT pivot").select("side", "size", F.col("word").alias("b"), F.col("last").alias("b_last"))
    met = mine.join(theirs, ["side", "size"]).where("a_last <= b_last AND a != b AND levenshtein(a, b, 1) = 1")
    ways = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"))))
    return met.select(ways.alias("at")).select("at.word", "at.near").distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): the end of each word's chain of ``forms`` (word, form). Every round doubles the steps that a root is away.

    A form is at least five times as frequent as its word, so chains have no cycles and a few dozen steps at most.
    """
    reached = staged(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = reached.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = staged(reached.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        if moved.where("moved").isEmpty():
            return moved.select("word", "root")
        reached = moved.select("word", "root")


def spelling_variants(df: DataFrame, key: str, text: str, shortest: int = 6, fewest: int = 5, factor: int = 5, every: int = 199) -> DataFrame:
    """Per word of ``words``: n, n_near (words that one inserted, deleted or replaced letter parts from it), form (the near
    word of largest n, of equally frequent ones the first in code-point order, if that n is ``factor`` times the word's or
    more), form_n, and root (the end of the chain of forms, the word itself without one).

    An empty table, and texts without words, give an empty table. Names of other columns don't matter.
    """
    listed = staged(words(df, key, text, shortest, fewest, every), "words")
    near = near_words(listed).join(listed.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("rank"), "near")).alias("best"))
    fits = -F.col("best.rank") >= factor * F.col("n")
    found = listed.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("best.near")).alias("form"), F.when(fits, -F.col("best.rank")).alias("form_n"))
    found = staged(found, "forms")
    roots = _roots(found.where("form IS NOT NULL").select("word", "form"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
