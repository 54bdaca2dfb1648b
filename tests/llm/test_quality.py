import re
from collections import Counter

import pytest
import zstandard
from pyspark.sql import functions as F

from tabulyse.llm.queries import QUERIES
from tabulyse.llm.quality import compression, limits, repeated_words, with_quality


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    triples = Counter(zip(words, words[1:], words[2:]))
    hit = {i + k for i, t in enumerate(zip(words, words[1:], words[2:])) if triples[t] > 1 for k in range(3)}
    failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), sum(c - 1 for c in Counter(lines).values()), len(hit), failed)


def found(df):
    return {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in df.collect()}


def test_query_against_brute_force(spark, sf):
    documents = spark.read.parquet(f"{sf}/documents.parquet").collect()
    out = QUERIES["op6_quality"](spark, sf)
    assert found(out) == {r.doc_id: plain(r.text) for r in documents}
    kept = {r.doc_id: r.kept for r in out.collect()}
    failed = {r.doc_id for r in documents if plain(r.text)[-1]}
    assert not any(kept[k] for k in failed)
    assert sum(kept.values()) >= 0.97 * (len(kept) - len(failed))  # no clean text goes


ODD = ["", None, " \n\t\n", "a\nb\na\n a\n\n", "a b a b a b", "é 漢字# x\x85y <p> | $5 " * 20, "x " * 60, "same line here\n" * 80, "w" * 300_000, "u v w " * 30]


def test_odd_rows(spark, documents):
    rows = [(i, t) for i, t in enumerate(ODD)]
    out = with_quality(documents(rows), "text", ["doc_id", "size", "key"])
    assert out.columns[:3] == ["doc_id", "size", "key"]
    assert found(out) == {i: plain(t) for i, t in rows}
    assert with_quality(documents(rows).where(F.lit(False)), "text", ["doc_id"]).count() == 0


def test_repeated_words_with_many_different_words():
    words = [str(i).encode() for i in range((1 << 20) + 5)] + [b"1", b"2", b"3"]
    assert repeated_words(words) == 6
    assert repeated_words([b"a"] * 3) == 0 and repeated_words([b"a"] * 4) == 4


def test_bands_reject_repetition_and_noise():
    import base64
    import random

    rng = random.Random(1)
    compressor = zstandard.ZstdCompressor(level=3)
    prose = " ".join(rng.choice(["water", "stone", "moving", "under", "bright", "through"]) + rng.choice(["", "ly", "er", "ing", "s", "ed"]) + str(rng.randint(0, 99)) for _ in range(900)).encode()
    noise = base64.b85encode(rng.randbytes(6000))
    loop = b"buy now at our shop today " * 400
    for data, good in ((prose, True), (noise, False), (loop, False)):
        ratio, bad, inside = compression(data, compressor)
        assert (inside and bad <= 0.3) == good, ratio
    assert compression(prose + loop, compressor)[1] > 0.3  # the whole may pass where a part does not
    assert limits(100) is None and limits(300) == (0.40, 0.90)


@pytest.mark.parametrize("size", [512, 1000, 1024, 2000, 4096, 20_000, 200_000])
def test_bands_reject_base64_of_every_size(size):
    import base64
    import random

    data = base64.b64encode(random.Random(size).randbytes(size))[:size]
    words = b" ".join(data[i : i + 7] for i in range(0, size, 7))[:size]
    for text in (data, words):
        ratio, bad, inside = compression(text, zstandard.ZstdCompressor(level=3))
        assert not inside and (bad > 0.3 or size < 512), ratio


@pytest.mark.parametrize("text, kept", [("one two " * 10, False), (None, False)])
def test_base_comes_first(spark, documents, text, kept):
    assert with_quality(documents([(1, text)]), "text", ["doc_id"]).first().kept is kept
