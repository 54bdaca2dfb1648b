import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulyse.llm.decontaminate import NO_KEY, Queries, _hits, contamination, longest, longest_matches, search, suffix_array
from tabulyse.llm.queries import QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, window=10):
    windows = {}
    for label, text in items:
        words = words_of(text)
        for i in range(max(1, len(words) - window + 1)) if words else ():
            windows.setdefault(tuple(words[i : i + window]), set()).add(NO_KEY if label is None else str(label))
    out = []
    for key, text in docs:
        words, hit, found = words_of(text), set(), set()
        for size in {len(w) for w in windows}:
            for i in range(len(words) - size + 1):
                if owners := windows.get(tuple(words[i : i + size])):
                    hit |= set(range(i, i + size))
                    found |= owners
        out.append((key, len(words), len(hit), sorted(found)))
    return out


def rows_of(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in df.collect()), key=str)


def test_suffix_array_against_sorting():
    rng = np.random.default_rng(5)
    for top, size in ((2, 60), (3, 200), (5, 400)):
        for _ in range(20):
            ids = np.append(rng.integers(0, top, size), 0)

            def rest(p):
                return tuple(ids[p : p + int(np.flatnonzero(ids[p:] == 0)[0])])

            found = suffix_array(ids)
            assert sorted(found.tolist()) == np.flatnonzero(ids).tolist()
            assert [rest(p) for p in found] == sorted(rest(p) for p in found)
    assert len(suffix_array(np.zeros(1, np.int64))) == 0
    assert suffix_array(np.append(np.ones(5000, np.int64), 0)).tolist() == list(range(4999, -1, -1))


def test_search_finds_longest_matches():
    queries = Queries([("q", [b"a", b"b", b"c", b"d"]), ("r", [b"c", b"a"])], 2)
    ids = np.array([queries.vocabulary.get(w, 0) for w in b"b c x a b c y c d z c a b".split()] + [0])
    assert longest(ids, queries)[0].tolist() == [3, 2, 2, 1, 2, 1]
    windows = search(ids, suffix_array(ids), queries)
    assert sorted(windows[:, 3].tolist()) == [0, 1, 2, 4]


def test_longest_matches_by_neighbours():
    rng = np.random.default_rng(8)
    for top in (1, 2, 3, 6):
        for _ in range(60):
            items = [(str(k), [b"%d" % x for x in rng.integers(0, top, rng.integers(1, 12))]) for k in range(rng.integers(1, 4))]
            queries = Queries(items, 3)
            ids = np.append(rng.integers(0, top + 1, rng.integers(0, 40)), 0)
            best, place = longest(ids, queries)
            for k, s in enumerate(queries.starts):
                rest = queries.tokens[s : s + int(np.flatnonzero(queries.tokens[s:] == 0)[0])].tolist()
                most = max((n for n in range(1, len(rest) + 1) if any(ids[i : i + n].tolist() == rest[:n] for i in range(len(ids) - n + 1))), default=0)
                assert best[k] == most and ids[place[k] : place[k] + most].tolist() == rest[:most]


@pytest.mark.parametrize("words", [["w"] * 8000, [f"w{i % 977}x{i % 1009}" for i in range(8000)]])
def test_long_verbatim_items_cost_little(words):
    words = [w.encode() for w in words]
    queries = Queries([("q", words)])
    start = time.perf_counter()
    spans, items = _hits([words], queries)
    took = time.perf_counter() - start
    assert spans == [[0, 8000]] and items == [["q"]] and took < 1.5
    ids = np.append(queries.tokens[:8000], 0)
    assert longest(ids, queries)[0].tolist() == list(range(8000, 0, -1))


def test_query_against_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    found = QUERIES["op2_decontaminate"](spark, sf).collect()
    expected = plain(docs, items)
    assert sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in found) == sorted((k, n, h, len(i), h > 0) for k, n, h, i in expected)
    assert any(r.contaminated for r in found)


ITEMS = [(1, "one two three four five six seven eight nine ten eleven TWELVE"), (1, "short item"), (2, "Short, item!"), (3, None), (4, " ?! "), (None, "nobody owns this"), (10, "é1 漢字 z")]
DOCS = [(1, "x one two three four five six seven eight nine ten y"), (2, "one two three four five six seven eight nine x"), (3, "a short item; a SHORT item. short"), (4, None), (5, ""), (None, "nobody owns this é1 漢字 Z"), (6, "w " * 90_000 + "two three four five six seven eight nine ten eleven twelve one two"), (3, "a short item; a SHORT item. short"), (7, "nobody owns\x85this")]


@pytest.mark.parametrize("block_chars", [20, 10**6])
def test_odd_rows(spark, documents, block_chars):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    out = contamination(documents(DOCS), "text", ["doc_id", "key", "size"], items, "item_id", "text", block_chars=block_chars)
    assert rows_of(out) == sorted(plain(DOCS, ITEMS), key=str)
    assert out.where("doc_id = 1").first().spans == [1, 11]


def test_longest_matches(spark, documents):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = {(r["item"], r.item_word): (r.words, r.doc, r.doc_word) for r in longest_matches(documents(DOCS), "doc_id", "text", items, "item_id", "text", 3).collect()}
    assert found["1", 0] == (10, 1, 1) and found["1", 1] == (11, 6, 90_000) and found["1", 9] == (3, 6, 90_008)
    assert found["10", 0] == (3, None, 3)


def test_empty_tables(spark, documents):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    none = items.where(F.lit(False))
    assert contamination(documents(DOCS).where(F.lit(False)), "text", ["doc_id"], items, "item_id", "text").count() == 0
    assert rows_of(contamination(documents(DOCS), "text", ["doc_id"], none, "item_id", "text")) == sorted(plain(DOCS, []), key=str)
    assert longest_matches(documents(DOCS), "doc_id", "text", none, "item_id", "text").count() == 0
