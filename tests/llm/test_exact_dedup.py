"""Exact dedup against a plain grouping, with a digest that collides, runs that hold one row, and a hot group."""

import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tabulyse.llm.exact_dedup import merged_runs, with_copies
from tabulyse.llm.queries import QUERIES


def plain(rows):
    groups = defaultdict(list)
    for key, text in rows:
        groups[re.sub(r"[ \t-\r]+", " ", text or "")].append(key)
    out = []
    for text, keys in groups.items():
        known = [k for k in keys if k is not None]
        keep = min(known) if known else None
        out += [(k, keep, len(keys), hashlib.sha256(text.encode()).hexdigest()) for k in keys]
    return sorted(out, key=str)


ROWS = [
    (5, "one  two"), (3, "one two"), (9, "one\ttwo"), (4, " one two"), (8, "one two "), (7, None), (2, ""), (6, " "), (1, "\n\r"), (11, "ONE two"),
    (12, "a b"), (13, "a b"), (14, "z" * 300_000), (10, "z" * 300_000), (15, "z" * 299_999 + "y"), (16, "\x1f"), (17, "a\x0bb"),
]


def result(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.digest.hex()) for r in df.collect()), key=str)


@pytest.mark.parametrize("runs, fan, most", [(512, 8, 200_000), (4, 2, 0), (1, 2, 200_000), (9, 3, 0)])
def test_groups(spark, documents, runs, fan, most):
    df = documents(ROWS).repartition(5)
    assert result(with_copies(df, "doc_id", "text", runs=runs, fan=fan, most=most)) == plain(ROWS)


def test_colliding_digests_are_taken_apart(spark, documents):
    rows = ROWS + [(20 + i, f"text {i % 7}") for i in range(40)]
    got = with_copies(documents(rows).repartition(3), "doc_id", "text", digest=lambda t: F.unhex(F.lpad(F.hex(F.length(t) % 3), 2, "0")))
    want = {(k, keep, n) for k, keep, n, _ in plain(rows)}
    assert {(r.doc_id, r.keep_id, r.group_size) for r in got.collect()} == want
    assert got.where("kept").count() == len({keep for _, keep, _ in want})


def test_ties_null_keys_and_columns(spark, documents):
    rows = [(None, "x"), (None, "x"), (2, "x"), (2, "x"), (None, "y"), (None, "y")]
    got = with_copies(documents(rows), "doc_id", "text", ["source", "key", "doc_id"]).collect()
    assert got[0].__fields__ == ["doc_id", "source", "key", "keep_id", "group_size", "kept", "digest"]
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size) for r in got) == [("2", "2", 4)] * 2 + [("None", "2", 4)] * 2 + [("None", "None", 2)] * 2
    assert sorted(str(r.doc_id) for r in got if r.kept) == ["2", "None"]


def test_empty(spark, documents):
    assert with_copies(documents([]).where("false"), "doc_id", "text").collect() == []


def test_a_round_brings_together_one_entry_a_run(spark):
    entries = spark.range(0, 20_000, 1, 64).select(F.spark_partition_id().alias("run"), F.lit(1).alias("digest"), F.col("id").alias("least"), F.lit(1).cast("long").alias("n"))
    assert merged_runs(entries, ["digest"], 64, 8).collect() == [(1, 0, 20_000)]


def test_no_python_in_the_plan(spark, documents):
    plan = with_copies(documents(ROWS), "doc_id", "text")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = QUERIES["op12_exact_dedup"](spark, sf).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == plain(docs)
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)
