import re

import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from tabulyse.llm import components, simhash
from tabulyse.llm.quality import BANDS, CHUNK_BYTES, MOST_BAD_CHUNKS
from tests.llm.conftest import plan
from tests.llm.test_decontaminate import plain as plain_hits
from tests.llm.test_mixing import plain_targets
from tests.llm.test_pii import base
from tests.llm.test_quality import plain as plain_counts
from tests.llm.test_simhash import plain_components, plain_fingerprint

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def good(text):
    if plain_counts(text)[-1]:
        return False
    data, compressor = text.encode(), zstandard.ZstdCompressor(level=3)

    def inside(piece):
        low, high = [b[1:] for b in BANDS if len(piece) >= b[0]][-1] if len(piece) >= BANDS[0][0] else (0, 99)
        return low <= len(compressor.compress(piece)) / len(piece) <= high

    pieces = [p for p in (data[k : k + CHUNK_BYTES] for k in range(0, len(data), CHUNK_BYTES)) if len(p) >= BANDS[0][0]]
    return inside(data) and sum(len(p) for p in pieces if not inside(p)) <= MOST_BAD_CHUNKS * sum(map(len, pieces))


def test_stages_against_brute_force(spark, sf, tmp_path):
    docs, before = spark.read.parquet(f"{sf}/documents.parquet"), None
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        out = stage(spark, docs, sf)
        assert out.columns == COLUMNS + ["copy"] * (name == "mixing")
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        rows = docs.collect()
        texts = {d: r.text for d, r in before.items()}
        if name == "quality":
            want = {d for d, t in texts.items() if good(t)}
        elif name == "near_dedup":
            groups = plain_components({d: plain_fingerprint(t) for d, t in texts.items()})
            want = set(groups.values())
        elif name == "decontamination":
            want = {d for d, _, hit, _ in plain_hits(texts.items(), items) if not hit}
        else:
            want = set(texts)
        if name == "mixing":
            check_mix(before, rows)
            continue
        assert {r.doc_id for r in rows} == want and len(rows) == len(want), name
        for r in rows:
            old = before[r.doc_id]
            if name != "personal_data":
                assert r == old
                continue
            assert (r.lang, r.source, r.n_chars) == (old.lang, old.source, len(r.text)) and base(r.text) == []
            pieces = re.split(r"<[A-Z]+>", r.text)
            assert all(p in old.text for p in pieces) and (len(pieces) > 1 or not base(old.text))
    assert 0 < len(want)


def check_mix(before, rows):
    size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for d, r in before.items()}
    totals, taken = {}, {}
    for d, r in before.items():
        totals[r.source] = totals.get(r.source, 0) + size[d]
    for r in rows:
        assert r.text == before[r.doc_id].text and 1 <= r.copy <= 3
        taken[r.source] = taken.get(r.source, 0) + size[r.doc_id]
    assert len({(r.doc_id, r.copy) for r in rows}) == len(rows)
    for source, target in plain_targets(totals).items():
        assert abs(taken.get(source, 0) - target) <= max(size[d] for d, r in before.items() if r.source == source)


def test_run_gives_the_mix(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == [*COLUMNS, "copy"] and out.count() > 0


@pytest.mark.parametrize("name", ["near_dedup", "personal_data"])
def test_no_table_that_grows_with_the_corpus_is_broadcast(spark, sf, documents, plans, name):
    rows = [(i, " ".join(f"w{k}" for k in range(400 - i % 8)) + f" a{i}@b.cd") for i in range(40)] + [(100 + i, f"a{i} b{i} c{i} d{i}") for i in range(9)]
    seen = plans(corpus_pipeline, components, simhash)
    out = dict(corpus_pipeline.STAGES)[name](spark, documents(rows), sf)
    seen.append((name, plan(out)))
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == "10485760b"
    assert [label for label, text in seen if "Broadcast" in text] == [] and "SortMergeJoin" in seen[-1][1]
    assert out.count() == (10 if name == "near_dedup" else 49)


ODD = [(1, "word " * 60), (1, "word " * 60), (None, None), (None, "lonely"), (2, ""), (3, " ".join(f"w{i}" for i in range(400))), (3, " ".join(f"w{i}" for i in range(400))), (None, " ".join(f"v{i} a{i}@b.cd" for i in range(200))), (4, " ".join(f"v{i}" for i in range(40_000)))]


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_odd_rows(spark, sf, documents, name, stage):
    table = documents(ODD).selectExpr("*", "true AS kept", "'z' AS id", "0 AS n", "1L AS component", "array(1) AS spans", "2 AS repeats")
    out = stage(spark, table, sf)
    assert out.columns == table.columns + ["copy"] * (name == "mixing")
    rows = out.collect()
    if name == "near_dedup":
        assert sorted(str(r.doc_id) for r in rows) == ["1", "2", "3", "4", "None", "None"]
    elif name == "personal_data":
        assert len(rows) == len(ODD) and sum("<EMAIL>" in (r.text or "") for r in rows) == 1
    elif name == "quality":
        assert {r.doc_id for r in rows} <= {None, 3, 4}
    assert stage(spark, table.where(F.lit(False)), sf).count() == 0
