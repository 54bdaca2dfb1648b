import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulyse.llm import repeats
from tabulyse.llm.queries import QUERIES
from tabulyse.llm.repeats import Block, factors, sequence_hashes, without_repeats
from tabulyse.llm.words import WordHashes


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain(docs, marks=None, window=20):
    """{(key, text): removed word positions}; rows that share a key come by a window's start, then by their marks."""
    docs = {(k is not None, k or 0, t) for k, t in docs if t is not None}
    marks = marks or {}
    places = {}
    for some, k, t in docs:
        w = words_of(t)
        for i in range(len(w) - window + 1):
            places.setdefault(tuple(w[i : i + window]), set()).add((some, k, i, marks.get((k if some else None, t), 0), t))
    out = {(k if some else None, t): set() for some, k, t in docs}
    for found in places.values():
        for some, k, i, _, t in sorted(found)[1:]:
            out[k if some else None, t] |= set(range(i, i + window))
    return out


def expected(docs, marks=None):
    gone = plain(docs, marks)
    rows = []
    for k, t in docs:
        w, g = words_of(t), gone.get((k, t), set())
        rows.append((k, len(w), len(g), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in g).encode()).hexdigest()))
    return sorted(rows, key=str)


def found(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.withColumn("kept_sha256", F.sha2("kept_text", 256)).collect()), key=str)


def test_sequence_hashes():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 2**63, 200, dtype=np.uint64)
    words[100:130] = words[10:40]
    for size in (1, 2, 3, 7, 8, 20, 30):
        hashes = sequence_hashes(words, size)
        assert len(hashes) == 201 - size and len(set(hashes.tolist())) == 201 - size - (31 - size)
        assert hashes[10] == hashes[100]


def test_anchors_are_all_places_of_the_least_hash():
    rng = np.random.default_rng(2)
    documents = [[str(x).encode() for x in rng.integers(0, 3, n)] for n in (0, 5, 20, 60, 19, 0, 33, 21)]
    block = Block(documents, WordHashes(), 20, 8)
    want, windows = set(), 0
    for d, b in zip(documents, block.begin):
        for s in range(b, b + len(d) - 19):
            windows += 1
            span = block.small[s : s + 13]
            want |= set((s + np.flatnonzero(span == span.min())).tolist())
    assert windows == len(block.starts) and set(block.anchors.tolist()) == want


def test_query_against_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    out = QUERIES["op9_repeats"](spark, sf)
    assert sorted((tuple(r) for r in out.collect()), key=str) == expected(docs)


def some_documents():
    rng = np.random.default_rng(4)
    vocabulary = [f"w{i}" for i in range(40)]
    passages = [" ".join(rng.choice(vocabulary, n)) for n in (20, 21, 55, 19, 30, 80)]
    docs = []
    for i in range(60):
        parts = [str(rng.choice(passages)) if rng.random() < 0.5 else " ".join(rng.choice(vocabulary, int(rng.integers(1, 30)))) for _ in range(int(rng.integers(1, 6)))]
        docs.append((int(rng.integers(0, 50)), "\n ".join(parts)))
    docs += [(None, passages[2]), (None, passages[2] + " x"), (99, None), (98, ""), docs[0], docs[0], (3, "ha " * 70), (200, "q " * 9 + " ".join(f"u{i}" for i in range(60_000)) + " q" * 30)]
    return docs


@pytest.mark.parametrize("block_words, parts", [(1 << 20, 1), (50, 4)])
def test_odd_rows(spark, documents, monkeypatch, block_words, parts):
    monkeypatch.setattr(repeats, "BLOCK_WORDS", block_words)
    docs = some_documents()
    table = documents(docs).repartition(parts)
    marks = {(r.doc_id, r.text): r.mark & 0x3FFFFFFF for r in table.select("doc_id", "text", F.hash("doc_id", "text").alias("mark")).collect()}
    assert found(without_repeats(table, "doc_id", "text", ["size", "key"])) == expected(docs, marks)


def test_factors_point_at_equal_earlier_words(spark, documents):
    docs = [(i, t) for i, (_, t) in enumerate(some_documents())]
    texts = dict(docs)
    rows = factors(documents(docs), "doc_id", "text").collect()
    covered = {}
    for r in rows:
        a, b = words_of(texts[r.doc]), words_of(texts[r.ref_doc])
        assert r.words >= 20 and (r.ref_doc, r.ref_start) < (r.doc, r.start)
        assert a[r.start : r.start + r.words] == b[r.ref_start : r.ref_start + r.words]
        covered.setdefault(r.doc, set()).update(range(r.start, r.start + r.words))
    assert covered == {k: g for (k, _), g in plain(docs).items() if g}


def test_factors_do_not_depend_on_blocks(spark, documents, monkeypatch):
    docs = [(i, t) for i, (_, t) in enumerate(some_documents())] + [(None, " ".join(f"p{i}" for i in range(500))), (1000, "x " + " ".join(f"p{i}" for i in range(500)))]

    def rows(parts):
        return sorted((tuple(r) for r in factors(documents(docs).repartition(parts), "doc_id", "text").collect()), key=str)

    whole = rows(1)
    monkeypatch.setattr(repeats, "BLOCK_WORDS", 50)
    assert rows(1) == whole and rows(5) == whole and len(set(whole)) == len(whole)
    assert [(r[2:]) for r in whole if r[0] == 1000] == [(1, 500, None, 0)]


def test_equal_hashes_are_checked(spark, documents, monkeypatch):
    """With a first hash that tells nothing apart, the second one still does."""
    docs = [(i, t) for i, (_, t) in enumerate(some_documents()[:25])]
    real = repeats.sequence_hashes
    monkeypatch.setattr(repeats, "sequence_hashes", lambda words, size, base=repeats._BASE: real(words, size, base) if size < 20 or base != repeats._BASE else real(words, size) % np.uint64(3))
    for parts in (1, 4):
        assert found(without_repeats(documents(docs).repartition(parts), "doc_id", "text")) == expected(docs)


def test_empty_table(spark, documents):
    assert without_repeats(documents([(1, "a")]).where(F.lit(False)), "doc_id", "text").count() == 0
