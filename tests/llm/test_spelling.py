"""Spelling variants against comparing all words, and the pivots against trying all pairs of bigrams."""

import re
import zlib
from collections import Counter
from itertools import combinations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tabulyse.llm.queries import QUERIES
from tabulyse.llm.spelling import near_words, pivots, prefix, spelling_variants, words


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain_words(rows, shortest=6, fewest=5, every=199):
    found = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lowered(run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= shortest and n >= fewest}


def deleted(word):
    return {word[:i] + word[i + 1 :] for i in range(len(word))}


def plain_near(listed):
    """Near words by the words that each gives when a letter is taken out or made a wildcard."""
    holes = {}
    for w in listed:
        for i in range(len(w)):
            holes.setdefault(w[:i] + "*" + w[i + 1 :], set()).add(w)
        for d in deleted(w):
            holes.setdefault(d, set())
    near = {w: set() for w in listed}
    for w in listed:
        for i in range(len(w)):
            near[w] |= holes[w[:i] + "*" + w[i + 1 :]] - {w}
        for d in deleted(w) & near.keys():
            near[w].add(d)
            near[d].add(w)
    return near


def plain(rows, **kw):
    listed = plain_words(rows, **kw)
    near, form = plain_near(listed), {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-listed[x], x), default=None)
        form[w] = best if best and listed[best] >= 5 * listed[w] else None
    out = []
    for w, n in listed.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), listed[form[w]] if form[w] else None))
    return sorted(out)


ALPHABET = "abÀÿé"


@settings(max_examples=300, deadline=None)
@given(st.sets(st.text(ALPHABET, min_size=4, max_size=9), min_size=1, max_size=30))
def test_a_pivot_of_one_meets_the_prefix_of_the_other(listed):
    often = Counter(g for w in listed for g in {w[i : i + 2] for i in range(len(w) - 1)})
    ranks = {g: i for i, (_, g) in enumerate(sorted((n, g) for g, n in often.items()))}
    held = {w: prefix(w, ranks) for w in listed}
    for w, (places, _) in held.items():
        cost = lambda p: often[w[p : p + 2]]  # noqa: B023, E731
        p, q = pivots(w, places, often)
        assert q - p >= 2 and {p, q} <= set(places)
        assert cost(p) + cost(q) == min(cost(a) + cost(b) for a, b in combinations(places, 2) if b - a >= 2)
    for w, others in plain_near(listed).items():
        for x in others:
            s, r = (w, x) if held[w][1] <= held[x][1] else (x, w)
            p, q = pivots(s, held[s][0], often)
            heads, tails = {r[: i + 2] for i in held[r][0]}, {r[i:] for i in held[r][0]}
            assert s[: p + 2] in heads or s[q:] in tails


def test_near_words(spark):
    listed = {a + b + c for a in ("color", "colour", "cölour", "aaaa") for b in ("", "s", "a", "aa") for c in ("", "x", "ing", "ings")} | {"aaaaaa", "aaaaaaa", "abababab", "babababa"}
    got = near_words(spark.createDataFrame([(w,) for w in sorted(listed)], "word string")).collect()
    assert sorted(map(tuple, got)) == sorted((w, x) for w, others in plain_near(listed).items() for x in others)


def text(counts):
    return " ".join(f"{w} " * n for w, n in counts.items())


ROWS = [
    (1, text({"separate": 130, "seperate": 26, "seperrate": 5, "seperates": 5, "Separaté": 6, "abc": 50, "aaaaaa": 30, "aaaaaaa": 150})),
    (2, text({"SEPARATE": 5, "tiebetter": 5, "tiebettar": 25, "tiebettor": 25, "ÀÉÎÕÜß": 9, "àéîõüß": 9, "naïveté": 7, "naivete": 5})),
    (3, None), (4, ""), (5, "word1word2 d'accord" * 6), (None, "nullkeyed " * 400), (6, "z" * 200_000 + " " + "longlong " * 2000), (6, "longlong " * 2000),
]


@pytest.mark.parametrize("every", [199, 3, 1])
def test_variants(spark, documents, every):
    got = spelling_variants(documents(ROWS).repartition(4), "doc_id", "text", every=every)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, got.collect())) == plain(ROWS, every=every)


def test_chains_lead_to_their_end(spark, documents):
    found = {r.word: r for r in spelling_variants(documents(ROWS), "doc_id", "text", every=10**9).collect()}
    assert (found["seperrate"].form, found["seperrate"].root) == ("seperate", "separate")
    assert (found["tiebetter"].form, found["tiebetter"].form_n, found["separate"].root) == ("tiebettar", 25, "separate")


def test_counts_passed_on_in_parts(spark, documents):
    got = words(documents(ROWS), "doc_id", "text", most=1)
    assert dict(map(tuple, got.collect())) == plain_words(ROWS)


def test_empty(spark, documents):
    assert spelling_variants(documents([]).where("false"), "doc_id", "text").collect() == []
    assert spelling_variants(documents([(1, None), (2, "few")]), "doc_id", "text").collect() == []


def test_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, QUERIES["op11_spelling"](spark, sf).collect())) == plain(rows)
