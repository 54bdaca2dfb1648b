"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over a bounded sample of labelled text. A text is parsed from left to right
into the longest phrases the automaton knows; the fewer phrases it takes, the closer the language. A phrase costs log2 of
the sample's size, which makes samples of different sizes comparable: bits per byte, the cross entropy. The language with
the fewest bits wins.

Texts are folded first: lower case, and every run of ASCII characters that are no letters becomes one blank. Whole texts
are parsed, pieces of ``PIECE`` bytes side by side in arrays. Each piece is parsed as if a phrase began there; then the state
that the piece before it ends in is carried in, until both parses meet in one state, from where on they are the same. So
phrases run across pieces, and the count is that of one parse from left to right.

Automata are kept as sparse edges, about 0.8 MB for a language written in up to 63 different bytes, 2.5 MB at most.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulyse.llm.staging import ships, staged
from tabulyse.llm.words import named
from tabulyse.session import small_table

ships(__name__)

PIECE = 512
LANES = 8192
#: The labelled sample that the automata are built from: so many different texts of each language, and of each a passage of so
#: many characters at a place that its hash names.
SAMPLE_ROWS = 200
SAMPLE_CHARS = 160
#: What a model may measure that is sent to every task; some 400 languages.
MOST_MODEL_BYTES = 1 << 30
UNKNOWN = "und"
HELD_OUT = (4, 2)

_LETTER = np.array([0x61 <= b <= 0x7A or b >= 0x80 for b in range(256)])


def remainder(key: Column, divisor: int = HELD_OUT[0]) -> Column:
    return F.crc32(key.cast("string")) % divisor


def folded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, lower case with one blank for each run of other ASCII, and where each text begins (and the end)."""
    column = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    begin = offsets - offsets[0]
    letter = _LETTER[data]
    first = np.zeros(len(data) + 1, bool)
    first[begin] = True
    keep = letter | first[:-1] | np.append(True, letter[:-1])
    place = np.append(0, np.cumsum(keep))
    return np.where(letter, data, 0x20)[keep].astype(np.uint8), place[begin]


class Automaton:
    """Suffix automaton of a byte string: transitions per state."""

    def __init__(self, data: bytes):
        self.next: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in data:
            now = len(self.next)
            self.next.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = now
                p = link[p]
            if p >= 0:
                q = self.next[p][c]
                if length[p] + 1 == length[q]:
                    link[now] = q
                else:
                    copy = len(self.next)
                    self.next.append(dict(self.next[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = copy
                        p = link[p]
                    link[q] = link[now] = copy
            last = now


@dataclass
class Model:
    """All automata in one table of sparse edges.

    A state has a mask of 64 bits for every 64 byte classes: those that lead on. Its edges follow one another in the order of
    classes, so the place of an edge is that of the first plus the number of mask bits below.
    """

    languages: list[str]
    classes: np.ndarray  # byte to class; 0 for bytes that no sample has
    words: int  # masks of a state
    masks: np.ndarray
    firsts: np.ndarray
    edges: np.ndarray
    roots: np.ndarray
    openers: np.ndarray  # by language and class: the state after the first byte of a phrase, -1 where there is none
    bits: np.ndarray  # of a phrase

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.masks, self.firsts, self.edges, self.openers))

    def step(self, state: np.ndarray, opener: np.ndarray, root: np.ndarray, column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states after one more byte, and the phrases that it ends. A byte that leads nowhere begins the next phrase; one
        that no phrase begins with is a phrase of its own."""
        slot = state * self.words + (column >> 6)
        mask, shift = self.masks[slot], (column & 63).astype(np.uint64)
        leads = (mask >> shift) & np.uint64(1) != 0
        place = self.firsts[slot] + np.bitwise_count(mask & ((np.uint64(1) << shift) - np.uint64(1)))
        onward = self.edges[np.where(leads, place, 0)]
        unknown = opener < 0
        ended = np.where(leads, 0, (state != root) + unknown.astype(np.int64))
        return np.where(leads, onward, np.where(unknown, root, opener)), ended


def build(samples: dict[str, bytes]) -> Model:
    """The model of folded samples by language."""
    languages = sorted(samples)
    known = sorted({b for s in samples.values() for b in s})
    classes = np.zeros(256, np.int64)
    classes[known] = np.arange(1, len(known) + 1)
    width = len(known) + 1
    words = -(-width // 64)
    slots, bits, targets, roots, openers, first = [], [], [], [], [], 0
    for language in languages:
        states = Automaton(samples[language]).next
        state = np.repeat(np.arange(len(states)), [len(row) for row in states])
        column = classes[np.fromiter((b for row in states for b in row), np.int64, len(state))]
        target = np.fromiter((to for row in states for to in row.values()), np.int64, len(state))
        order = np.lexsort((column, state))
        state, column, target = state[order], column[order], target[order] + first
        slots.append((state + first) * words + (column >> 6))
        bits.append(np.uint64(1) << (column & 63).astype(np.uint64))
        targets.append(target)
        opener = np.full(width, -1, np.int64)
        opener[column[state == 0]] = target[state == 0]
        openers.append(opener)
        roots.append(first)
        first += len(states)
    masks, counts = np.zeros(first * words, np.uint64), np.zeros(first * words + 1, np.int64)
    if languages:
        slot = np.concatenate(slots)
        np.bitwise_or.at(masks, slot, np.concatenate(bits))
        counts[1:] = np.bincount(slot, minlength=first * words)
    edges = np.concatenate(targets) if languages else np.zeros(0, np.int64)
    firsts = np.cumsum(counts)[:-1]
    table = np.stack(openers) if languages else np.zeros((0, width), np.int64)
    return Model(languages, classes, words, masks, firsts.astype(np.int32), edges.astype(np.int32), np.array(roots, np.int64), table.astype(np.int32), np.array([math.log2(len(samples[x]) + 2) for x in languages]))


def phrases(model: Model, data: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Number of phrases per language (rows) and text (columns)."""
    coded = model.classes[data]
    lengths = np.diff(begin)
    pieces = -(-lengths // PIECE)
    owner = np.repeat(np.arange(len(lengths)), pieces)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = begin[owner] + nth * PIECE
    size = np.minimum(begin[owner + 1] - start, PIECE)
    roots = model.roots[:, None]
    ended, last = np.zeros((len(roots), len(owner)), np.int64), np.repeat(roots, len(owner), axis=1)
    order = np.argsort(-size, kind="stable")  # pieces of like size share a group; those that have ended are at its end
    for k in range(0, len(order), LANES):
        lanes = order[k : k + LANES]
        state, count = np.repeat(roots, len(lanes), axis=1), np.zeros((len(roots), len(lanes)), np.int64)
        for t, n in enumerate(np.searchsorted(-size[lanes], -np.arange(int(size[lanes[0]])))):
            column = coded[start[lanes[:n]] + t]
            state[:, :n], more = model.step(state[:, :n], model.openers[:, column], roots, column)
            count[:, :n] += more
        ended[:, lanes], last[:, lanes] = count, state
    final = _carried(model, coded, nth, start, size, ended, last)
    out = np.zeros((len(roots), len(lengths)), np.int64)
    for language in range(len(out)):
        out[language] = np.bincount(owner, ended[language], minlength=len(lengths)).astype(np.int64)
    whole = np.flatnonzero(lengths)
    out[:, whole] += final[:, np.cumsum(pieces)[whole] - 1] != roots  # the phrase that the text's end ends
    return out


def _carried(model: Model, coded: np.ndarray, nth: np.ndarray, start: np.ndarray, size: np.ndarray, ended: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The states at the ends of the pieces when each begins in the state the one before it ends in; ``ended`` is set right."""
    alone, final = ended.copy(), last.copy()
    language, piece = np.nonzero((nth > 0)[None, :] & (np.roll(last, 1, axis=1) != model.roots[:, None]))
    while len(piece):
        more, state, met = _until_met(model, coded, start[piece], size[piece], language, final[language, piece - 1])
        ended[language, piece] = alone[language, piece] + more
        now = np.where(met, last[language, piece], state)
        changed = np.flatnonzero(now != final[language, piece])
        final[language, piece] = now
        # A piece that ends elsewhere now begins the next one anew.
        language, piece = language[changed], piece[changed] + 1
        inside = piece < len(nth)
        inside[inside] = nth[piece[inside]] > 0
        language, piece = language[inside], piece[inside]
    return final


def _until_met(model: Model, coded: np.ndarray, start: np.ndarray, size: np.ndarray, language: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parses pieces from ``state`` and from the root until both are in one state: phrases more, the state, whether they met."""
    more, final, met = np.zeros(len(start), np.int64), state.copy(), state == model.roots[language]
    at = np.flatnonzero(~met)
    root = model.roots[language[at]]
    a, b, t = state[at], root.copy(), 0
    while len(at):
        column = coded[start[at] + t]
        opener = model.openers[language[at], column]
        a, ended_a = model.step(a, opener, root, column)
        b, ended_b = model.step(b, opener, root, column)
        more[at] += ended_a - ended_b
        t += 1
        same = a == b
        met[at[same]] = True
        final[at] = a
        on = ~same & (size[at] > t)
        at, a, b, root = at[on], a[on], b[on], root[on]
    return more, final, met


def sampled(df: DataFrame, text: str, language: str, learn: Column, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> dict[str, bytes]:
    """Folded samples by language, of the rows where ``learn`` holds, and text and language are not null.

    Of each language the ``rows`` different texts of the smallest MD5, and of each the ``chars`` characters from a place that
    the MD5 names: that is what the driver sees. Only texts whose MD5 lies below a bound are looked at; it is raised where
    copies leave too few.
    """
    usable = df.where(learn & named(text).isNotNull() & named(language).isNotNull() & (F.length(named(text)) > 0))
    marked = usable.select(named(language).alias("language"), named(text).alias("text"), F.md5(named(text)).alias("mark"))
    sizes = {r.language: r.n for r in usable.groupBy(named(language).alias("language")).agg(F.count("*").alias("n")).collect()}
    shares = {k: min(1.0, 16 * rows / n) for k, n in sizes.items()}
    place = F.pmod(F.conv(F.substring("mark", 9, 8), 16, 10).cast("long"), F.greatest(F.length("text") - chars, F.lit(0)) + 1) + 1
    passage = F.substring(F.col("text"), place.cast("int"), F.lit(chars)).alias("passage")
    while True:
        bounds = F.broadcast(small_table(df.sparkSession, list(shares.items()), "language string, share double"))  # a row a language
        near = marked.join(bounds, "language").where(F.conv(F.substring("mark", 1, 8), 16, 10).cast("double") / 2**32 < F.col("share"))
        found = staged(near.groupBy("language", "mark").agg(F.min(passage).alias("passage")), "language-sample")
        many = {r.language: r.n for r in found.groupBy("language").agg(F.count("*").alias("n")).collect()}
        few = [k for k in shares if shares[k] < 1 and many.get(k, 0) < rows]
        if not few:
            break
        shares |= {k: min(1.0, 32 * shares[k]) for k in few}
    ranked = found.withColumn("n", F.row_number().over(Window.partitionBy("language").orderBy("mark"))).where(F.col("n") <= rows)
    samples: dict[str, bytes] = {}
    for row in ranked.orderBy("language", "n").toLocalIterator():
        samples[row.language] = samples.get(row.language, b"") + folded(pa.array([row.passage]))[0].tobytes() + b" "
    return {k: v for k, v in samples.items() if v.strip()}


def fit(df: DataFrame, text: str, language: str, learn: Column, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> Model:
    """The model of the rows where ``learn`` holds; see ``sampled`` for its bounds. Other columns, ties and repeated rows don't
    matter: copies of a text are one text."""
    return build(sampled(df, text, language, learn, rows, chars))


def with_language(df: DataFrame, text: str, columns: list[str], model: Model, most_bytes: int = MOST_MODEL_BYTES) -> DataFrame:
    """``columns`` of the table, lang_pred, score (0 to 1: how much fewer bits than the second language) and bits_per_byte.

    A text that is null or has no letter is ``und`` with score 0, as is every text if nothing was learned. Languages that
    tie go by name. Repeated rows are judged alike. An empty table gives an empty table. Names of other columns don't matter.
    """
    kept = [f"_{i}" for i in range(len(columns))]
    source = df.select(named(text).alias("_text"), *(named(c).alias(k) for c, k in zip(columns, kept)))
    schema = source.drop("_text").schema.add("lang_pred", "string").add("score", "double").add("bits_per_byte", "double")
    if model.nbytes > most_bytes:
        raise ValueError(f"the model of {len(model.languages)} languages has {model.nbytes} bytes; learn from fewer rows or raise most_bytes")
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = sent.value
        for batch in batches:
            texts = batch.column(0)
            letters = np.asarray(pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False))
            many = len(texts)
            if not model.languages:
                columns = [pa.array([UNKNOWN] * many, pa.string()), pa.array(np.zeros(many)), pa.nulls(many, pa.float64())]
            else:
                data, begin = folded(texts)
                bits = phrases(model, data, begin) * model.bits[:, None] / np.maximum(np.diff(begin), 1)
                best = bits.argmin(0)
                ranked = np.sort(bits, axis=0)
                second = ranked[1] if len(ranked) > 1 else np.full(many, np.inf)
                score = np.where(second > 0, 1 - ranked[0] / np.where(second > 0, second, 1), 0.0)
                names = np.array(model.languages, object)[best]
                columns = [pa.array(np.where(letters, names, UNKNOWN), pa.string()), pa.array(np.where(letters, score, 0.0)), pa.array(np.where(letters, ranked[0], 0.0), mask=~letters)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *columns], names_out)

    names_out = schema.fieldNames()
    return source.mapInArrow(run, schema).toDF(*columns, "lang_pred", "score", "bits_per_byte")
