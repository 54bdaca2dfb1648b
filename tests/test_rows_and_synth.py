"""Records from text, and synthetic tables."""

import json
import re

import pytest
from pyspark.sql import functions as F

from tabulyse.functions import vocabulary
from tabulyse.functions.mending import mend_json
from tabulyse.functions.semantic_types import ColumnSpec
from tabulyse.operators import json_rows, synth

MALFORMED = object()

REPAIRS = {
    "": [],
    "  ": [],
    "no data here": MALFORMED,
    '```json\n[{"a":1,},]\n```': [{"a": 1}],
    'Sure: [{"a":1}] hope it helps': [{"a": 1}],
    '[{"a":1}] and [it]': MALFORMED,
    '[{"a":1},{"a":2,"b":"te': [{"a": 1}],
    '[{"a":1,"b":"te': [{"a": 1, "b": "te"}],
    '[{"a":1,"b":"te\\': [{"a": 1, "b": "te"}],
    '{"a":1}': [{"a": 1}],
    '{"a":1},{"a":2}': [{"a": 1}, {"a": 2}],
    '{"a":1}\n{"a":2}': [{"a": 1}, {"a": 2}],
    '[{"u":"http://x.y/z"}] // c': [{"u": "http://x.y/z"}],
    '[{"u":"/* no */",/* c */"b":2}//x\n]': [{"u": "/* no */", "b": 2}],
    '[{"a":{"z":[1,2]': [{"a": {"z": [1, 2]}}],
    'x {"a":"b [c"': [{"a": "b [c"}],
    '[{"a" 1}]': MALFORMED,
    "[1 2]": MALFORMED,
    "42": MALFORMED,
    '"a [b] c"': MALFORMED,
    'He said "no". [{"a":1}]': [{"a": 1}],
}


@pytest.mark.parametrize("raw", list(REPAIRS))
def test_repair(raw):
    text = mend_json(raw)
    if REPAIRS[raw] is MALFORMED and raw != "42":
        with pytest.raises(json.JSONDecodeError):
            json.loads(text)
    elif raw != "42":
        assert json.loads(text) == REPAIRS[raw]


def test_repair_leaves_good_json_alone():
    good = [{"a": 'q"\\,}', "b": [1, {"c": None}], "d": "// x"}, {"a": ",]"}]
    assert json.loads(mend_json(json.dumps(good, indent=1))) == good


@pytest.fixture(scope="module")
def parsed(spark):
    return json_rows.parse_replies(spark.createDataFrame(list(enumerate([*REPAIRS, None])), "id int, raw string"), "raw")


def test_reply_status(parsed):
    found = {r.id: (r.status, r.n) for r in parsed.select("id", "status", F.size("records").alias("n")).collect()}
    for i, (raw, want) in enumerate(REPAIRS.items()):
        if raw == "42" or want == []:
            assert found[i][0] == "empty", raw
        elif want is MALFORMED:
            assert found[i][0] == "malformed", raw
        else:
            assert found[i] == ("records", len(want)), raw
    assert found[len(REPAIRS)][0] == "empty"


def test_trailing_text_is_not_dropped_silently(spark):
    tricky = ['{"a":1} {"b":2}', '1} x', '{"a":1}] , [', '1, "v": 2', '{"a":1}}', "[1]]"]
    df = json_rows.parse_replies(spark.createDataFrame(list(enumerate(tricky)), "id int, raw string"), "raw")
    found = {r.id: (r.status, r.n) for r in df.select("id", "status", F.size("records").alias("n")).collect()}
    assert found[0] == ("records", 2)
    assert all(found[i][0] != "records" or found[i][1] >= 1 for i in found)
    assert found[1][0] == found[3][0] == "malformed"


def test_rows_with_inferred_types(spark):
    raw = [
        '[{"user_id": 7, "price": "$1,200.50", "joined": "Jan 5, 2024", "ok": true, "x y": "a", "n": 1}, 5]',
        '{"user_id": 8, "ok": null, "x y": " b  c ", "n": 2.5, "more": {"k": [1]}}',
        "[{",
    ]
    df = spark.createDataFrame(list(enumerate(raw)), "id int, raw string")
    rows = json_rows.reply_rows(df, "raw", null_policy="null").orderBy("id", "position")
    assert dict(rows.dtypes) == {
        "id": "int", "position": "int", "joined": "date", "more": "string", "n": "double", "ok": "boolean", "price": "double", "user_id": "bigint", "x y": "string",
    }
    first, second, blank = rows.collect()
    assert set(blank[2:]) == {None}  # the record cut off before its first member
    assert (first.price, str(first.joined), first.ok, first.n, first["x y"]) == (1200.5, "2024-01-05", True, 1.0, "a")
    assert (second.user_id, second.ok, second["x y"], second.more) == (8, None, "b c", '{"k":[1]}')
    named = json_rows.reply_rows(df, "raw", [ColumnSpec("n", "integer"), ColumnSpec("absent", "price")])
    assert [(r.n, r.absent) for r in named.orderBy("id").collect()] == [(1, 0.0), (2, 0.0), (0, 0.0)]


def test_rows_asked_for(spark):
    df = spark.createDataFrame([(1, '[7, {"i": 1}, {"i": 2}, "x", {"i": 3}]'), (2, '{"i": 9}')], "id int, raw string")
    specs = [ColumnSpec("i", "integer")]
    assert sorted(map(tuple, json_rows.reply_rows(df, "raw", specs, rows=2).collect())) == [(1, 0, 1), (1, 1, 2), (2, 0, 9)]
    assert json_rows.reply_rows(df, "raw", specs).count() == 4
    assert sorted((r.position, r.member) for r in json_rows.skipped_members(json_rows.parse_replies(df, "raw")).collect()) == [(0, "7"), (3, '"x"')]


def test_as_many_columns_as_allowed(spark):
    df = spark.createDataFrame([(1, json.dumps([{f"c{i:02d}": i for i in range(30)}]))], "id int, raw string")
    assert json_rows.reply_rows(df, "raw", most_columns=30).columns[2:] == [f"c{i:02d}" for i in range(30)]
    with pytest.raises(ValueError, match="more than 29"):
        json_rows.reply_rows(df, "raw", most_columns=29)


ALL = [ColumnSpec(t.replace(" ", "_"), t) for t in synth.synth_types()]


def test_synth_is_the_same_for_any_partitioning(spark):
    one = synth.synth(spark, ALL, 60, seed=5, partitions=1).collect()
    assert sorted(map(str, synth.synth(spark, ALL, 60, seed=5, partitions=7).collect())) == sorted(map(str, one))
    assert synth.synth(spark, ALL, 60, seed=6).collect() != one
    assert len(one) == 60 and all(v is not None for r in one for v in r)


def test_synth_values_are_well_formed(spark):
    rows = synth.synth(spark, ALL, 300, seed=1, as_of="2024-12-31").collect()
    shapes = {
        "email": r"[a-z.0-9]+@example\.(com|net|org)",
        "phone_number": r"\(\d{3}\) 555-01\d\d",
        "ssn": r"9\d\d-\d\d-\d{4}",
        "postal_code": r"\d{5}",
        "employee_id": r"EMP-\d{4,}",
        "uuid": r"[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}",
        "mac_address": r"02(:[0-9a-f]{2}){5}",
        "ip_address": r"(192\.0\.2|198\.51\.100|203\.0\.113)\.\d{1,3}",
        "password": r"\S{12}",
        "slug": r"[a-z]+-[a-z]+-[a-z]+",
        "time": r"\d\d:\d\d:\d\d",
        "iban": r"DE\d{20}",
        "bitcoin_address": r"1[1-9A-HJ-NP-Za-km-z]{32}",
        "image_url": r"https://images\.example\.com/[2-8]\d\d/[2-8]\d\d",
        "paragraph": r"([A-Z][a-z ]+\.( |$)){3}",
    }
    for r in rows:
        for name, shape in shapes.items():
            assert re.fullmatch(shape, r[name]), (name, r[name])
        digits = [int(c) for c in r.credit_card]
        assert len(digits) == 16 and sum(sum(divmod(d * (2 - i % 2), 10)) for i, d in enumerate(digits)) % 10 == 0
        assert int("".join(str(int(c, 36)) for c in r.iban[4:] + r.iban[:4])) % 97 == 1
        assert 1 <= r.integer <= 1000 and 0 <= r.float <= 100 and 1 <= r.price <= 1000 and -90 <= r.latitude <= 90
        assert 1934 <= r.date_of_birth.year <= 2006 and len(r.description) <= 100
    assert len({r.uuid for r in rows}) == 300 and {r.boolean for r in rows} == {True, False}


def test_synth_follows_column_names(spark):
    names = ["first_name", "lname", "status", "category", "title", "notes"]
    specs = [ColumnSpec(n, " String ") for n in names] + [ColumnSpec(n, "NUMBER") for n in ("page", "age", "id", "sale_price", "year", "stock")]
    row = synth.synth(spark, specs, 20).orderBy("id").first()
    assert row.id == 1 and 18 <= row.age <= 99 and 1 <= row.page <= 1000 and 10 <= row.sale_price <= 10_000 and 1950 <= row.year <= 2025
    assert " " not in row.first_name + row.lname and row.title.count(" ") == 2
    assert synth.synth(spark, [ColumnSpec("x", "no such type")], 1).first().x.isalpha()


def test_presets(spark):
    specs = synth.default_specs("Pet Shop", ["Number", "String", "date"], 4)
    assert [(s.name, s.type) for s in specs] == [("due", "date"), ("year", "Number"), ("label", "String"), ("grade", "String")]
    assert [s.name for s in synth.default_specs("A b", ["uuid", "date"])] == ["a_b_uid", "due", "checked"]
    known = set(synth.synth_types())
    assert all(t.lower() in known for _, t in vocabulary.PRESET_COLUMNS) and len(vocabulary.PRESET_COLUMNS) == len({n for n, _ in vocabulary.PRESET_COLUMNS})
    assert len(synth.default_specs("a", ["Number", "String", "Date", "Email", "City"], 99)) == 10
    assert synth.synth_preview(spark, specs).count() == 5
