import hashlib
import re
import time

import pytest
from pyspark.sql import functions as F

from tabulyse.llm.pii import KINDS, PATTERNS, estimated, listed, masked, personal_spans, votes, with_spans
from tabulyse.llm.queries import QUERIES

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def passes(kind, hit):
    digits = re.sub("[^0-9]", "", hit)
    if kind == "ip":
        return all(int(p) <= 255 for p in hit.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def base(text):
    found = [(m.start(), KINDS.index(k), k, m.end()) for k in KINDS for m in re.finditer(PLAIN[k], text or "") if passes(k, m.group())]
    return [f"{k}:{s}:{e}" for s, _, k, e in sorted(found)]


def test_query_against_brute_force(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op10_pii"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = base(texts[r.doc_id])
        assert [r[f"n_{k}"] for k in KINDS] == [sum(x.startswith(k + ":") for x in want) for k in KINDS]
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        spans = r.spans.split(",") if r.spans else []
        assert set(want) <= set(spans)
        places = [(int(s.split(":")[1]), s.split(":")[0]) for s in spans]
        assert [p for p, _ in places] == sorted(p for p, _ in places)
        for kind, start, end in (x.split(":") for x in set(spans) - set(want)):
            assert re.search("[0-9]", texts[r.doc_id][int(start) : int(end)])
        if not re.search("[0-9]{2}|@", texts[r.doc_id]):
            assert spans == []


def test_patterns_find_what_the_plain_ones_find(spark):
    import random

    rng = random.Random(3)
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for letters in ("ab1.@-_% é\n", "12... é", "12- +()") for _ in range(4000)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    found = rows.select("text", *(F.regexp_extract_all("text", F.lit(PATTERNS[k]), F.lit(0)).alias(k) for k in ("email", "ip", "phone"))).collect()
    for r in found:
        for k in ("email", "ip", "phone"):
            assert r[k] == [m.group() for m in re.finditer(PLAIN[k], r.text)]


def test_long_runs_cost_in_proportion(spark):
    runs = ["a", "7", "-", ".", "1.", "7 ", "+1", "@", "a@"]
    rows = spark.createDataFrame([(c * 500_000 + " x@y.z 1.2.3.4",) for c in runs], "text string").repartition(len(runs))
    counts = [F.regexp_count("text", F.lit(p)).alias(k) for k, p in PATTERNS.items()]
    start = time.perf_counter()
    rows.select(*counts).collect()
    assert time.perf_counter() - start < 60  # at the square of the length, one run would take an hour


ODD = [
    None,
    "",
    "mail a.b+c@x-y.co.uk, A_%@b.c@d.e and @x.y a@b",
    "é漢😀 a@b.cd_x@e.fg 1.2.3.4.5 256.1.1.1 001.002.003.0255 1.2.3",
    "4111 1111 1111 1111, 4111-1111-1111-1112; 4111111111111111 0000 0000 0000 79927398713 " + "1" * 25,
    "+1 (555) 010-9999. +44 20 7946 0958 ext +123456 +1 23 45 +4 (0) 1234567890123456",
    "7 " * 40_000 + "4111 1111 1111 1111",
    "12 34 " * 3_000 + " +33 1 23 45 67 89 x@y.zz",
    "10.0.0.1" * 3 + " " + "a" * 200_000 + "@x.org",
]


def test_odd_rows(spark, documents):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, ODD[2]), (None, ODD[3]), (2, ODD[2]), (2, ODD[3])]
    found = with_spans(documents(rows), "doc_id", "text", ["doc_id", "text", "key", "size"])
    out = found.select("doc_id", "text", listed(F.filter("spans", lambda s: s["base"])).alias("base"), masked(F.col("text"), F.col("spans")).alias("masked"), "spans").collect()
    assert sorted(((r.doc_id, r.text, r.base) for r in out), key=str) == sorted(((k, t, ",".join(base(t))) for k, t in rows), key=str)
    for r in out:
        if r.text is None:
            assert r.masked is None
            continue
        want, upto = "", 0
        for s in r.spans:
            if s["start"] >= upto:
                want += r.text[upto : s["start"]] + f"<{s['kind'].upper()}>"
            upto = max(upto, s["end"])
        assert r.masked == want + r.text[upto:]


def test_classifier_adds_what_context_supports(spark, documents):
    clean = [(i, f"plain words number {i} and nothing else to see here") for i in range(30)]
    token = "ghp_" + "a1B2c3D4e5F6g7H8i9J0"
    rows = clean + [(100 + i, f'the api token = "{token}{i}" stays secret') for i in range(20)] + [(200 + i, f"order 4111 1111 1111 11{10 + i} of 2020") for i in range(20)] + [(300, "card 4111 1111 1111 1111")]
    found = {r.doc_id: [s["kind"] for s in r.spans] for r in with_spans(documents(rows), "doc_id", "text", ["doc_id"]).collect()}
    assert all(not found[k] for k, _ in clean)
    assert all(found[100 + i] == ["secret"] for i in range(20))
    assert found[300] == ["card"] and sum(bool(found[200 + i]) for i in range(20)) == sum(luhn(f"41111111111111{10 + i}") for i in range(20))


def test_a_million_emails_do_not_decide_on_other_kinds(spark, documents):
    few = [(i, f"my ssn is 123-45-{6000 + i}.") for i in range(20)] + [(100 + i, f"please call 555-010-{4000 + i} soon") for i in range(20)] + [(200 + i, f"build 000-12-{3000 + i}x") for i in range(20)]
    many = spark.range(1000, 1200).selectExpr("id AS doc_id", "repeat('kim@example.com, ', 5000) AS text")

    def verdicts(table):
        return {r.doc_id: [s["kind"] for s in r.spans] for r in with_spans(table, "doc_id", "text", ["doc_id"]).where("doc_id < 1000").collect()}

    table = documents(few).select("doc_id", "text")
    want = {i: ["ssn"] if i < 100 else ["phone"] if i < 200 else [] for i, _ in few}
    assert verdicts(table) == want
    assert verdicts(table.unionByName(many)) == want


def test_surroundings_tell_equal_votes_apart(spark, documents):
    """Numbers in the shape of a local phone, without any cue: those that stand where cued ones do score higher than those that
    stand where junk does."""
    rows = [(i, f"reach {['Ann', 'Bob', 'Kim'][i % 3]} at the desk, call 202-555-{1000 + i}") for i in range(150)]
    rows += [(1000 + i, f"the desk, {['Ann', 'Bob', 'Kim'][i % 3]} at 202-555-{3000 + i} ") for i in range(40)]
    rows += [(2000 + i, f"see version lot 300-400-{1000 + i}x{i}") for i in range(150)] + [(3000 + i, f"spare lot 300-400-{2000 + i} ") for i in range(40)]
    score = {r.doc: r.score for r in personal_spans(documents(rows), "doc_id", "text", threshold=0.0).collect()}
    assert min(score[i] for i in range(150)) > 0.5 > max(score[2000 + i] for i in range(150))
    assert min(score[1000 + i] for i in range(40)) > max(score[3000 + i] for i in range(40))


def test_gazetteers_by_rule(spark):
    rows = {("email", "a@b.pt"): 1, ("email", "a@b.zzzz"): 0, ("phone", "+351 21 123 4567"): 1, ("phone", "+999 21 123 4567"): 1, ("phone", "+210 21 123 4567"): 1, ("phone", "+0 21 123 4567"): 0, ("ip", "8.8.8.8"): 1, ("ip", "10.0.0.1"): -1, ("ip", "240.1.1.1"): 0}
    spans = spark.createDataFrame([(k, h, "", "") for k, h in rows], "kind string, hit string, left string, right string")
    assert {(r.kind, r.hit): r.gazetteer for r in votes(spans).collect()} == rows


def test_estimates_follow_the_votes(spark):
    rows = [(1, 1, 1, 1, 500), (1, 0, 1, 1, 300), (-1, 0, 0, -1, 700), (-1, -1, -1, 1, 200), (1, 0, 0, 1, 50)]
    rates = estimated(spark.createDataFrame(rows, "form int, gazetteer int, context int, edges int, n long"))
    assert 0.4 < rates.share < 0.6
    assert rates.table["form"][1][2] > 0.95 and rates.table["form"][0][0] > 0.95
    assert rates.table["context"][1][2] > 0.7 > 0.1 > rates.table["context"][0][2]


def test_empty_and_clean(spark, documents):
    assert with_spans(documents([(1, "a@b.cd")]).where(F.lit(False)), "doc_id", "text", ["doc_id"]).count() == 0
    assert [r.spans for r in with_spans(documents([(1, "nothing here"), (1, "nothing here")]), "doc_id", "text", ["doc_id"]).collect()] == [[], []]


@pytest.mark.parametrize("kind", sorted(PATTERNS))
def test_patterns_do_not_overflow(spark, kind):
    long = {"email": "a@" + "b." * 60_000 + "c", "card": "1 " * 60_000, "ip": "1." * 60_000, "phone": "+1" + " 2" * 60_000}.get(kind, "A1-" * 60_000)
    row = spark.createDataFrame([(long,)], "t string").select(F.size(F.regexp_extract_all("t", F.lit(PATTERNS[kind]), F.lit(0))).alias("n")).first()
    assert row.n >= 0
