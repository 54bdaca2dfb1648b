from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tabulyse.llm import components, simhash
from tabulyse.llm.queries import QUERIES
from tabulyse.llm.simhash import _by_midpoints, _with_least, covering_masks, fingerprint, fingerprint_links, near_duplicates
from tests.llm.conftest import plan


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    pieces = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in pieces]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, radius=4):
    """{key: smallest key reachable} for {key: fingerprint}."""
    root = {k: k for k in prints}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = sorted(prints)
    values = np.array([prints[k] for k in keys], np.uint64)
    for i, k in enumerate(keys):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= radius):
            a, b = sorted((find(k), find(keys[i + 1 + j])))
            root[b] = a
    return {k: find(k) for k in keys}


def test_masks_cover_every_pair_within_the_radius():
    masks = covering_masks(4)
    assert len(masks) == 31 and all(30 <= m.bit_count() <= 34 for m in masks)
    rng = np.random.default_rng(3)
    for flips in [*combinations(range(0, 64, 3), 4), *(tuple(rng.choice(64, 4, replace=False)) for _ in range(3000))]:
        differ = sum(1 << int(i) for i in flips)
        assert any(m & differ == 0 for m in masks)


def test_fingerprint_against_plain_form():
    for text in ["", " \t\n", "One", "one two three", "A b c d e F g", "naïve É 漢字 \x85 x\x0by " * 9, "w " * 70_000]:
        assert fingerprint(text.encode()) == plain_fingerprint(text)
    assert fingerprint(None) == 0


def test_query_against_brute_force(spark, sf):
    rows = QUERIES["op8_simhash"](spark, sf).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    prints = {k: plain_fingerprint(t) for k, t in texts.items()}
    assert {r.doc_id: r.fingerprint for r in rows} == {k: f"{v:016x}" for k, v in prints.items()}
    assert {r.doc_id: r.component_id for r in rows} == plain_components(prints)
    assert len(rows) == len(texts)


@pytest.mark.parametrize("bucket", [1, 3, 1024])
def test_links_connect_the_same_whatever_the_bucket(spark, bucket):
    rng = np.random.default_rng(7)
    centres = rng.integers(0, 2**63, 4)
    prints = {int(c) ^ sum(1 << int(i) for i in rng.choice(63, int(rng.integers(0, 6)), replace=False)) for c in centres for _ in range(12)}
    nodes = spark.createDataFrame([(p,) for p in prints], "fingerprint long")
    links = [(r.u, r.v) for r in fingerprint_links(nodes, 4, bucket).collect()]
    root = {p: p for p in prints}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for u, v in links:
        a, b = sorted((find(u), find(v)))
        root[b] = a
    assert {p: find(p) for p in prints} == plain_components({p: p for p in prints})


def test_midpoints_never_link_beyond_the_radius(spark):
    prints = [0, 0b1, 0b111, 0b11111, 0b1111111111, -1]
    for radius in (1, 2, 3):
        found = _by_midpoints(spark.createDataFrame([(p,) for p in prints], "fingerprint long"), radius).collect()
        assert all(((r.u ^ r.v) & (2**64 - 1)).bit_count() <= radius for r in found)
        assert {0b1, 0} in [{r.u, r.v} for r in found]


@pytest.mark.parametrize("parts", [1, 7, 256])
def test_smallest_key_of_a_large_component_is_found_in_parts(spark, parts):
    rows = [(i, None if i % 3 == 0 else 10_000 - i, 0 if i < 2000 else i // 10) for i in range(3000)] + [(3000, None, 3000)]
    placed = spark.createDataFrame(rows, "fingerprint long, least long, root long").repartition(5)
    least = {root: min((k for _, k, r in rows if r == root and k is not None), default=None) for root in {r[2] for r in rows}}
    found = {(r.fingerprint, r.component_id, r.root) for r in _with_least(placed, parts).collect()}
    assert found == {(f, least[r], r) for f, _, r in rows} and least[0] == 8001 and least[3000] is None


def test_no_task_gets_a_whole_large_component(spark):
    placed = spark.range(100_000).selectExpr("id as fingerprint", "id as least", "if(id < 50000, 0, id) as root")
    plan = _with_least(placed.hint("shuffle_merge"))._jdf.queryExecution().executedPlan().toString()
    dealt = [x.split("hashpartitioning(")[1].split(")")[0] for x in plan.splitlines() if "hashpartitioning(" in x]
    assert len(dealt) >= 3 and sum("part#" not in x for x in dealt) == 1  # that of the window: a row a part


@pytest.mark.parametrize("bucket", [2, 1024])
def test_no_table_that_grows_with_the_corpus_is_broadcast(spark, documents, plans, bucket):
    words = [f"w{i}" for i in range(400)]
    table = documents([(i, " ".join(words[: 400 - i % 8])) for i in range(64)] + [(100 + i, f"a{i} b{i} c{i} d{i}") for i in range(20)])
    seen = plans(simhash, components)
    found = near_duplicates(table, "doc_id", "text", bucket=bucket)
    seen.append(("found", plan(found)))
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == "10485760b"
    assert [label for label, text in seen if "Broadcast" in text] == []
    joins = [label for label, text in seen if "SortMergeJoin" in text]
    assert {"crowded", "links", "classes", "found"} <= set(joins) and joins.count("links") >= 2
    assert found.where("doc_id < 64").select("component_id").distinct().count() == 1 and found.count() == 84


def test_hubs_and_long_paths_are_one_component_each(spark):
    hub, path = [(5000, k) for k in range(2000)] + [(k, 0) for k in range(6000, 7000)], [(10_000 + k, 10_001 + k) for k in range(40)]
    links = [*hub, *path, (10_020, 10_020), (20_001, 20_000), (20_000, 20_001)]
    found = {r.node: r.root for r in components.components(spark.createDataFrame(links, "u long, v long").repartition(5)).collect()}
    wanted = {k: 0 for k in [*range(1, 2000), 5000, *range(6000, 7000)]} | {10_001 + k: 10_000 for k in range(40)} | {20_001: 20_000}
    assert found == wanted


def test_no_task_gets_all_links_of_a_hub(spark):
    links = spark.range(1, 100_000).selectExpr("id + 1 as u", "id div 2 as v")
    for stars in (components._stars(links), components._drawn_in(links)):
        lines = plan(stars).splitlines()
        dealt = {x.split("hashpartitioning(")[1].split(")")[0]: below for x, below in zip(lines, lines[1:]) if "hashpartitioning(" in x}
        alone = [below for x, below in dealt.items() if "part#" not in x and "v#" not in x]
        assert len(dealt) >= 4 and alone and all("HashAggregate(keys=[u#" in x and "part#" in x for x in alone)  # those of the windows: a row a part


def test_odd_rows(spark, documents):
    long = "lorem ipsum dolor sit amet " * 30_000
    rows = [(None, "a b c d e"), (5, "a b c d e"), (5, "a b c d e"), (7, None), (9, ""), (2, long), (3, long + " x"), (None, "only here with no key"), (4, "A B c d E")]
    found = near_duplicates(documents(rows), "doc_id", "text").collect()
    by = sorted((r.doc_id if r.doc_id is not None else -1, r.fingerprint, r.component_id) for r in found)
    assert len(by) == len(rows)
    assert [x[2] for x in by if x[0] in (4, 5)] == [4, 4, 4]
    assert {x[2] for x in by if x[0] in (7, 9)} == {7} and {x[2] for x in by if x[0] in (2, 3)} == {2}
    assert sorted(str(x[2]) for x in by if x[0] == -1) == ["4", "None"]


def test_empty_table(spark, documents):
    found = near_duplicates(documents([(1, "x")]).where(F.lit(False)), "doc_id", "text")
    assert found.columns == ["doc_id", "fingerprint", "component_id", "component"] and found.count() == 0
