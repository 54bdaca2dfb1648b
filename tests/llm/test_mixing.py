import re

import pytest
from pyspark.sql import functions as F

from tabulyse.llm.mixing import mixed, targets
from tabulyse.llm.queries import QUERIES


def plain_targets(sizes, weights=(5, 2, 1), epochs=3):
    """Clamp, share out the excess by weight, again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, left = {}, sum(sizes.values())
    while True:
        free = [s for s in names if s not in full]
        level = left / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if weight[s] * level >= epochs * sizes[s]]
        if not over:
            return full | {s: weight[s] * level for s in free}
        for s in over:
            full[s] = epochs * sizes[s]
            left -= full[s]


def check(rows, found):
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, (_, t, _) in enumerate(rows)}
    totals = {}
    for i, (_, _, s) in enumerate(rows):
        totals[s] = totals.get(s, 0) + size[i]
    aims = plain_targets(totals)
    taken = dict.fromkeys(totals, 0)
    assert len(found) == len(rows)
    for r in found:
        assert r.source_size == totals[r.source] and r.target == pytest.approx(aims[r.source])
        assert r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[r.source] += r.taken
    for s, t in taken.items():
        assert abs(t - aims[s]) <= max([size[i] for i, x in enumerate(rows) if x[2] == s])
    assert sum(aims.values()) == pytest.approx(sum(totals.values()))


def test_query_hits_its_targets(spark, sf):
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    out = QUERIES["op1_mixing"](spark, sf).collect()
    source = {d: s for d, _, s in rows}
    check(rows, [type("R", (), r.asDict() | {"source": source[r.doc_id]}) for r in out])
    assert sorted(out) == sorted(QUERIES["op1_mixing"](spark, sf).repartition(3).collect())


def test_odd_rows(spark, documents):
    rows = [(i, "w " * (i % 7), s) for i, s in enumerate(["b", "a", None, "ü", "", "b"] * 40)] + [(500, None, "void"), (501, "", "void"), (None, "x y", "a"), (7, "q " * 50_000, "long")]
    found = mixed(documents(rows), "doc_id", "source", "text", ["doc_id", "source", "size", "key"])
    found = found.toDF("doc_id", "source", "_size", "_key", "size", "source_size", "target", "repeats", "taken").collect()
    check(rows, found)
    assert max(r.repeats for r in found) <= 3


def test_rows_without_words_repeat_no_more_than_others(spark, documents):
    rows = [(i, "w " * (i % 3), s) for s, n in (("a", 40), ("b", 4000)) for i in range(n)]
    found = mixed(documents(rows), "doc_id", "source", "text", ["source"]).where("source = 'a'").collect()
    assert {r.target for r in found} == {3.0 * found[0].source_size} and {r.repeats for r in found} == {3}


def test_clamping_needs_rounds(spark):
    sizes = [("a", 1), ("b", 2), ("c", 900), ("d", 3), ("e", 50), ("f", 10_000), ("g", 0)]
    rows = spark.createDataFrame([("0" + s, n) for s, n in sizes], "source_key string, size long")
    found = {r.source_key[1:]: r.target for r in targets(rows).collect()}
    assert found == pytest.approx(plain_targets(dict(sizes)))


def test_empty_and_wordless(spark, documents):
    assert mixed(documents([(1, "a")]).where(F.lit(False)), "doc_id", "source", "text", ["doc_id"]).count() == 0
    row = mixed(documents([(1, None)]), "doc_id", "source", "text", ["doc_id"]).first()
    assert (row["size"], row.target, row.taken) == (0, 0.0, 0)
