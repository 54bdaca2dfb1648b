import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tabulyse.llm import language
from tabulyse.llm.language import HELD_OUT, Automaton, build, fit, folded, phrases, remainder, sampled, with_language
from tabulyse.llm.queries import QUERIES


def plain_phrases(text, sample):
    """Longest phrases of the sample from the left, by substring search; a byte the sample lacks is one."""
    count, i = 0, 0
    while i < len(text):
        j = i + 1
        while j < len(text) and text[i : j + 1] in sample:
            j += 1
        i, count = j, count + 1
    return count


def test_automaton_knows_exactly_the_substrings():
    rng = random.Random(3)
    data = bytes(rng.choice(b"abc") for _ in range(60))
    states = Automaton(data).next
    seen, todo = set(), [(0, b"")]
    while todo:
        state, word = todo.pop()
        seen.add(word)
        todo += [(to, word + bytes([c])) for c, to in states[state].items()]
    assert seen == {data[i:j] for i in range(61) for j in range(i, 61)}


@pytest.mark.parametrize("piece", [1, 2, 7, 64, 512])
def test_phrases_against_plain_parsing(monkeypatch, piece):
    monkeypatch.setattr(language, "LANES", 3)
    monkeypatch.setattr(language, "PIECE", piece)
    rng = random.Random(5)
    samples = {x: "".join(rng.choice(a) for _ in range(400)).encode() for x, a in (("x", "abcd "), ("y", "abef "), ("z", "é gh"))}
    texts = ["".join(rng.choice("abcdefgh é!") for _ in range(n)) for n in (0, 1, 7, 511, 512, 513, 2000, 40, 0)]
    texts += [samples["x"].decode() * 4, "?" * 1500, "abcd " * 500]
    model = build(samples)
    data, begin = folded(pa.array(texts))
    found = phrases(model, data, begin)
    for k, name in enumerate(model.languages):
        assert found[k].tolist() == [plain_phrases(data[a:b].tobytes(), samples[name]) for a, b in zip(begin, begin[1:])]


def test_folding():
    data, begin = folded(pa.array(["Été  1, ON", None, "!!", "a", ""]))
    assert [data[a:b].tobytes().decode() for a, b in zip(begin, begin[1:])] == ["été on", "", " ", "a", ""]
    sliced = pa.array(["zzz", "B!!C", "d"]).slice(1)
    data, begin = folded(sliced)
    assert [data[a:b].tobytes().decode() for a, b in zip(begin, begin[1:])] == ["b c", "d"]


def test_query_on_held_out_documents(spark, sf):
    rows = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = QUERIES["op5_language"](spark, sf).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    held = [r for r in out if r.held_out and len(rows[r.doc_id].text) >= 40]
    assert np.mean([r.lang_pred == rows[r.doc_id].lang for r in held]) >= 0.97


def test_query_against_brute_force(spark, sf):
    """Every verdict and score, by substring search in the samples."""
    table = spark.read.parquet(f"{sf}/documents.parquet")
    samples = sampled(table, "text", "lang", remainder(F.col("doc_id")) != HELD_OUT[1])
    texts = {r.doc_id: r.text for r in table.collect()}
    out = {r.doc_id: r for r in QUERIES["op5_language"](spark, sf).collect()}
    for key, text in list(texts.items())[:80]:
        plain = folded(pa.array([text]))[0].tobytes()
        bits = {k: plain_phrases(plain, v) * math.log2(len(v) + 2) / max(len(plain), 1) for k, v in samples.items()}
        best, second = sorted(bits.values())[:2]
        assert out[key].lang_pred == min(bits, key=lambda k: (bits[k], k)) and out[key].score == pytest.approx(1 - best / second)


def test_a_hundred_languages_stay_small(spark):
    rng = random.Random(1)
    samples = {f"l{i:03}": bytes(rng.choice(range(128, 250)) if rng.random() < 0.5 else rng.choice(b"abcdefghij ") for _ in range(32_000)) for i in range(4)}
    model = build(samples)
    assert model.nbytes / 4 * 100 < 400 << 20 < language.MOST_MODEL_BYTES
    with pytest.raises(ValueError, match="bytes"):
        with_language(spark.createDataFrame([("a",)], "text string"), "text", [], model, most_bytes=1000)


def test_odd_rows(spark, documents):
    rows = [(i, t) for i, t in enumerate(["the cat sat on the mat and the dog", None, "", "12 34 !?", "漢字", "the " * 60_000, "the cat", "the cat"])] + [(None, "the dog")]
    table = documents(rows)
    model = fit(table, "text", "lang", F.lit(True))
    found = [(r.doc_id, r.lang_pred, r.score) for r in with_language(table, "text", ["doc_id"], model).collect()]
    assert len(found) == len(rows) and {k: p for k, p, _ in found} == {k: "und" if k in (1, 2, 3) else "en" for k, _ in rows}
    assert all(s == 0 for k, p, s in found if p == "und")
    nothing = fit(table, "text", "lang", F.lit(False))
    assert {r.lang_pred for r in with_language(table, "text", ["doc_id"], nothing).collect()} == {"und"}
    assert with_language(table.where(F.lit(False)), "text", ["doc_id"], model).count() == 0


def test_the_sample_is_of_different_texts(spark, documents):
    rows = [(i, f"text {i} " + "abc def " * 500) for i in range(50)] + [(i, "copied " * 40) for i in range(50, 5000)] + [(9999, ""), (9998, None)]
    table = documents(rows)
    found = sampled(table, "text", "lang", F.lit(True), rows=30, chars=100)
    assert list(found) == ["en"] and len(found["en"]) <= 30 * 101 and len(found["en"].split(b"copied")) <= 16
    assert found == sampled(table.repartition(7), "text", "lang", F.lit(True), rows=30, chars=100)
    every = sampled(table, "text", "lang", F.lit(True), rows=1000, chars=10**6)
    assert len(every["en"]) == sum(len(folded(pa.array([t]))[0]) + 1 for t in {t for _, t in rows if t})
