"""Token alignment against common ends found by sets, on texts that tempt either tokenizer to cross a cut."""

import hashlib
import random
from collections import Counter, defaultdict
from itertools import accumulate
from pathlib import Path

import numpy as np
import pytest

from tabulyse.llm.alignment import BYTE_VOCABULARY, PIECE_VOCABULARY, Aligner, Tokenizers, coalesced, with_links
from tabulyse.llm.queries import QUERIES

BITS = [" ", "  ", "a", "b", "é", "ß", "\n", "\t", "\xa0", "\x85", " ", "᠎", "\x1c", "1", "23", ".", ",", "'s", "'", "<|endoftext|>", "<s>", "</s>", "日本", "🙂", "é", "̈", "ﬁ", "Ａ", "▁", "<0x41>", "Hello", "world", "the", "ʼ", "क्षि", "​", "½", "_", "-"]


@pytest.fixture(scope="module")
def both():
    return Tokenizers(Path(BYTE_VOCABULARY).read_bytes(), Path(PIECE_VOCABULARY).read_bytes())


def plain(t, both):
    """Numbers, digest and linked pairs of one text, encoded whole."""
    none = (0, 0, 0, 0, "", Counter())
    if not t:
        return none
    a, b = both.a.encode(" " + t, add_special_tokens=False).ids, both.b.encode(t)
    if b"".join(both.a_bytes[i] for i in a) != (" " + t).encode() or b"".join(both.b_bytes[i] for i in b) != (" " + t).encode():
        return none
    a_ends, b_ends = (list(accumulate(len(of[i]) for i in ids)) for ids, of in ((a, both.a_bytes), (b, both.b_bytes)))
    groups, links = defaultdict(lambda: ([], [])), Counter()
    common = sorted(set(a_ends) & set(b_ends))
    for side, ids, ends in ((0, a, a_ends), (1, b, b_ends)):
        for i, end in zip(ids, ends):
            groups[next(c for c in common if c >= end) if len(common) < 50 else common[np.searchsorted(common, end)]][side].append(i)
    for x, y in groups.values():
        links.update((i, j) for i in x for j in y)
    spelled = ";".join(",".join(map(str, groups[c][0])) + "|" + ",".join(map(str, groups[c][1])) for c in common)
    return len(a), len(b), len(groups), sum(links.values()), hashlib.sha256(spelled.encode()).hexdigest(), links


def corpus(rows, both):
    """The query's rows for (doc_id, text) rows."""
    found = [(k, plain(t, both)) for k, t in rows]
    counts = Counter(p for _, f in found for p in f[5])
    best = {}
    for (a, _), n in counts.items():
        best[a] = max(best.get(a, 0), n)
    sums = lambda links: (sum(n for p, n in links.items() if counts[p] == best[p[0]]), sum(n * counts[p] for p, n in links.items()))
    return sorted(((k, *f[:4], *sums(f[5]), f[4]) for k, f in found), key=str)


@pytest.mark.parametrize("chars, most", [(1 << 20, 300_000), (40, 300)])
def test_any_text(both, chars, most):
    rng = random.Random(3)
    texts = ["".join(rng.choices(BITS, k=rng.randint(0, 25))) for _ in range(1500)] + [None, "", " ", "a" * 3000, " " * 3000, "\n" * 500, "one two three, four. five " * 30]
    aligner, width = Aligner(both, most, chars), len(both.b_bytes)
    columns = [c.to_pylist() for c in aligner.align(texts)]
    for text, *numbers, pairs, times in zip(texts, *columns):
        assert (*numbers, Counter({(p // width, p % width): n for p, n in zip(pairs, times)})) == plain(text, both), repr(text)


def test_groups_break_where_all_before_have_ended():
    starts, ends = np.array([0, 2, 3, 6, 0, 1, 3, 5]), np.array([2, 3, 6, 8, 1, 3, 5, 8])
    assert coalesced(starts, ends).tolist() == [0, 0, 1, 1, 0, 0, 1, 1]


@pytest.mark.parametrize("run", [" ", "\n", "\t", "a", "é", "ab", "🙂"])
def test_very_long_runs(both, run):
    text = run * 200_000
    n_a, n_b, n_groups, *_ = (c.to_pylist()[0] for c in Aligner(both).align([text + " end"]))
    assert n_a and n_b and n_groups


@pytest.mark.parametrize("most", [2_000_000, 0])
def test_rows(spark, documents, both, most):
    rows = [(1, "the cat, the dog"), (2, "the cat"), (2, "the cat"), (None, "the catalogue"), (4, None), (5, ""), (6, "ﬁsh ▁ x"), (7, "über straße " * 400), (8, "<|endoftext|></s> ok")]
    got = with_links(documents(rows).repartition(3), "doc_id", "text", most=most)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == corpus(rows, both)
    assert with_links(documents([]).where("false"), "doc_id", "text", most=most).collect() == []


def test_query(spark, sf, both):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, QUERIES["op13_alignment"](spark, sf).collect()), key=str) == corpus(rows, both)
