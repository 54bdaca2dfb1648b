"""Sources and sinks."""

import csv
import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulyse.functions.semantic_types import ColumnSpec
from tabulyse.operators.usage import quota_count
from tabulyse.session import scratch_dir
from tabulyse.sinks import insert_text, writers
from tabulyse.sinks.registry import register_write
from tabulyse.sources import insert_dump, readers


@pytest.fixture
def put(tmp_path):
    def write(name, text):
        path = tmp_path / name
        path.write_text(text, encoding="utf-8")
        return str(path)

    return write


def test_csv_types_and_null_tokens(spark, put):
    path = put("t.csv", 'i,d,b,s,mixed,"q,x",none\n1,1.5,True,a,1,"say ""hi"", ok",NA\nNA,,False,N/A,x,,null\n3,-2e3,true,null,5d,z,\n')
    df = readers.read_table(spark, path)
    assert dict(df.dtypes) == {"i": "bigint", "d": "double", "b": "boolean", "s": "string", "mixed": "string", "q,x": "string", "none": "double"}
    assert [tuple(r) for r in df.collect()] == [
        (1, 1.5, True, "a", "1", 'say "hi", ok', None),
        (None, None, False, None, "x", None, None),
        (3, -2000.0, True, None, "5d", "z", None),
    ]


def test_csv_with_schema(spark, put):
    schema = T.StructType([T.StructField("n", T.IntegerType()), T.StructField("day", T.DateType())])
    df = readers.read_csv(spark, put("t.csv", "n,day\n1,2024-01-05\nx,soon\n"), schema)
    assert [(r.n, str(r.day)) for r in df.collect()] == [(1, "2024-01-05"), (None, "None")]


def test_csv_line_breaks_inside_quotes(spark, put):
    df = readers.read_csv(spark, put("t.csv", 'a,b\n1,"x\ny"\n'), multi_line=True)
    assert df.first().b == "x\ny"


def test_json_lines_and_flattening(spark, put):
    df = readers.read_table(spark, put("t.json", '{"id": 1, "who": {"name": "a", "at": {"x": 2}}}\n{"id": 2}\n'))
    assert df.columns == ["id", "who.at.x", "who.name"]
    assert [tuple(r) for r in df.orderBy("id").collect()] == [(1, 2, "a"), (2, None, None)]


def test_json_document_of_records(spark, put):
    path = put("t.json", json.dumps([{"id": 1, "who": {"name": "a"}}, {"id": 2, "who": {"name": "b"}}], indent=1))
    df = readers.read_json(spark, path, lines=False)
    assert sorted(tuple(r) for r in df.select("id", "`who.name`").collect()) == [(1, "a"), (2, "b")]


def test_json_document_takes_its_first_array(spark, put):
    path = put("t.json", json.dumps({"meta": {"n": 2}, "rows": [{"v": 1}, {"v": 2}], "also": [{"w": 3}]}, indent=1))
    assert sorted(r.v for r in readers.read_json(spark, path, lines=False).collect()) == [1, 2]
    assert [r.w for r in readers.read_json(spark, path, lines=False, record_path="also").collect()] == [3]
    plain = readers.read_json(spark, put("p.json", '{"a": 1,\n "b": {"c": 2}}'), lines=False)
    assert plain.columns == ["a", "b.c"]


@pytest.mark.parametrize("document", [{"a": {"0": 1, "1": 2}, "b": {"0": "x", "1": None}}, {"a": [1, 2], "b": ["x", None]}])
def test_json_by_column(spark, put, document):
    df = readers.read_json(spark, put("c.json", json.dumps(document)), by_column=True)
    assert dict(df.dtypes) == {"a": "bigint", "b": "string"}
    assert sorted(map(tuple, df.collect())) == [(1, "x"), (2, None)]


def test_unknown_formats_are_refused(spark, tmp_path):
    with pytest.raises(ValueError):
        readers.read_table(spark, "x.xls")
    with pytest.raises(ValueError):
        writers.write_table(spark.range(1), str(tmp_path / "x"), "xls")


def test_registered_formats(spark, tmp_path):
    readers.register_reader("orc", lambda spark, path: spark.read.orc(path))
    writers.register_writer("orc", lambda df, path, specs, context: df.write.orc(path))
    path = str(tmp_path / "x.orc")
    assert writers.write_table(spark.range(5), path, "orc") == 5
    assert readers.read_table(spark, path).count() == 5


@pytest.fixture(scope="module")
def tricky(spark):
    return spark.createDataFrame(
        [
            (1, "it's", True, 1.5, "n"),
            (2, "back\\slash \\n and\nbreak\rreturn", False, None, "NULL"),
            (3, None, None, -2.0, "a, 'b'); INSERT"),
            (4, "", True, 3.0, 'say "hi"'),
            (5, "''", True, 0.0, "\\\\'"),
        ],
        "id bigint, s string, b boolean, d double, t string",
    )


def test_sql_dump_keeps_everything(spark, tricky, tmp_path):
    path = str(tmp_path / "dump.sql")
    assert writers.write_table(tricky, path, "sql", context="Our best customers") == 5
    schema = insert_dump.dump_tables(spark, path)
    assert list(schema) == ["customer_data"]
    back = readers.read_table(spark, path)
    assert back.dtypes == tricky.dtypes
    assert back.orderBy("id").collect() == tricky.orderBy("id").collect()
    assert insert_dump.dump_quarantine(spark, path).count() == 0


def test_sql_dump_quarantine_and_largest(spark, put):
    lines = [
        'CREATE TABLE "a" ("x" INT);',
        'CREATE TABLE "b" ("x" INT, "y ""z""" TEXT);',
        'INSERT INTO "a" ("x") VALUES (1);',
        'INSERT INTO "b" ("x", "y ""z""") VALUES (1, \'p\');',
        'INSERT INTO "b" ("y ""z""", "x") VALUES (NULL, 2);',
        'INSERT INTO "b" ("x") VALUES (1, 2);',
        "DROP TABLE a;",
    ]
    path = put("d.sql", "\n".join(lines))
    assert [tuple(r) for r in readers.read_table(spark, path).orderBy("x").collect()] == [(1, "p"), (2, None)]
    assert [r.x for r in insert_dump.read_insert_dump(spark, path, "a").collect()] == [1]
    assert {r.value for r in insert_dump.dump_quarantine(spark, path).collect()} == set(lines[-2:])
    with pytest.raises(ValueError):
        insert_dump.read_insert_dump(spark, path, "c")
    with pytest.raises(ValueError):
        insert_dump.read_insert_dump(spark, put("e.sql", "SELECT 1;"))


def test_long_text_survives_the_dump(spark, tmp_path):
    text = "it''s \\ " * 50_000
    path = str(tmp_path / "long.sql")
    writers.write_table(spark.createDataFrame([(text,)], "s string"), path, "sql")
    assert readers.read_table(spark, path).first().s == text


def test_largest_table_ties(spark):
    tables = {"a": spark.range(2), "b": spark.range(3), "c": spark.range(3)}
    assert insert_dump.largest_table(tables).first().name == "b"
    with pytest.raises(ValueError):
        insert_dump.largest_table({})


def test_table_names():
    assert insert_text.table_name("All EMPLOYEE records") == "employee_data"
    assert insert_text.table_name("Weather, in Oslo! And then some more words") == "weather__in_oslo__and_then_som"
    assert insert_text.table_name("") == insert_text.table_name("!!") == "generated_data"


def test_ddl():
    specs = [ColumnSpec("a", "Integer"), ColumnSpec("p", "price"), ColumnSpec("x", "whatever")]
    assert insert_text.create_table_statement(specs, "t") == 'CREATE TABLE "t" ("a" INT, "p" DECIMAL(15,2), "x" TEXT);'


@pytest.mark.parametrize("fmt", ["json", "parquet"])
def test_json_and_parquet_keep_rows(spark, tricky, tmp_path, fmt):
    path = str(tmp_path / f"t.{fmt}")
    writers.write_table(tricky, path, fmt)
    back = readers.read_table(spark, path).select(*tricky.columns)
    assert back.orderBy("id").collect() == tricky.orderBy("id").collect()


def test_json_writes_nulls_and_plain_decimals(spark, tmp_path):
    path = str(tmp_path / "t.json")
    writers.write_table(spark.sql("select cast(1.50 as decimal(5,2)) m, cast(null as string) s"), path, "json")
    assert json.loads(spark.read.text(path).first().value) == {"m": 1.5, "s": None}


def test_csv_projects_and_flattens(spark, tricky, tmp_path):
    path = str(tmp_path / "t.csv")
    writers.write_table(tricky.withColumn("list", F.array("id")), path, "csv", [ColumnSpec("list", "text"), ColumnSpec("s", "string")])
    back = readers.read_table(spark, path)
    assert back.columns == ["list", "s"]
    assert {r.list: r.s for r in back.collect()}["[2]"] == "back\\slash \\n and break return"


def test_registry(spark, tmp_path):
    folder, registry = str(tmp_path / "data"), str(tmp_path / "registry")
    ids = {register_write(spark.range(n), folder, registry, "ann", f"set {n}", "json") for n in (3, 4)}
    entries = spark.read.parquet(registry)
    assert {r.dataset_id for r in entries.collect()} == ids
    assert {(r["rows"], r.columns, r.bytes > 0) for r in entries.collect()} == {(3, 1, True), (4, 1, True)}
    assert quota_count(entries, "owner", 2).first().full


def test_source_size(spark, put, tmp_path):
    put("a.txt", "x" * 2000), put("b.txt", "y" * 48)
    assert tuple(readers.source_size(spark, str(tmp_path)).first()) == (2, 2048, "2.0 KB")


def test_scratch_folder_comes_from_the_session(spark):
    own = scratch_dir(spark, "x").rsplit("/", 1)[0]
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert own == (named or spark.conf.get("tabulyse.scratch.dir", None))


def test_sql_dump_of_another_writer(spark, put):
    path = put(
        "o.sql",
        "-- made elsewhere\nBEGIN;\nCREATE TABLE IF NOT EXISTS `t` (\n  id BIGINT PRIMARY KEY,\n  price DECIMAL(20, 4) NOT NULL,\n"
        "  s VARCHAR(20) DEFAULT 'a, b',\n  PRIMARY KEY (id)\n);\n"
        "INSERT INTO t VALUES (1, 1234567890123456.5678, 'it''s (1, 2)');\n"
        "insert into `t` (price, id) values (2.5, 2), (3.5,3),\n (NULL, 4);\nCOMMIT;\n",
    )
    df = readers.read_table(spark, path)
    assert df.dtypes == [("id", "bigint"), ("price", "decimal(20,4)"), ("s", "string")]
    assert [(r.id, str(r.price), r.s) for r in df.orderBy("id").collect()] == [
        (1, "1234567890123456.5678", "it's (1, 2)"), (2, "2.5000", None), (3, "3.5000", None), (4, "None", None),
    ]
    assert {r.value for r in insert_dump.read_dump(spark, path).quarantine.collect()} == {"BEGIN;", "COMMIT;"}


def test_sql_dump_never_loses_an_insert_silently(spark, put):
    path = put("b.sql", "CREATE TABLE t (x INT);\nINSERT INTO t VALUES (1);\nINSERT INTO t VALUES (now());\nINSERT INTO u VALUES (1);\n")
    with pytest.raises(Exception, match="cannot be read"):
        readers.read_table(spark, path, strict=True).collect()
    dump = insert_dump.read_dump(spark, path)
    assert [r.x for r in dump.tables["t"].collect()] == [1]
    assert dump.quarantine.count() == 2


def test_every_json_document_decides_for_itself(spark, tmp_path):
    documents = [{"rows": [{"v": 1}]}, {"items": [{"v": 2}, 7], "n": [{"v": 9}]}, [{"v": 3}, {"v": 4, "tags": ["a"], "f": 1.0}], {"v": 5, "f": 2.0}, [6]]
    for i, document in enumerate(documents):
        (tmp_path / f"{i}.json").write_text(json.dumps(document, indent=1))
    (tmp_path / "bad.json").write_text('{"v": ')
    df = readers.read_json(spark, str(tmp_path), lines=False)
    assert df.columns == ["f", "items", "tags", "v", "value"] and df.schema["f"].dataType == T.DoubleType()
    rows = df.collect()
    assert sorted(r.v for r in rows if r.v) == [1, 2, 3, 4, 5] and [r["items"] for r in rows if r["items"]] == [7]
    assert [r.value for r in rows if r.value] == [6] and [r.tags for r in rows if r.tags] == [["a"]]
    assert [r.value for r in readers.json_quarantine(spark, str(tmp_path), lines=False).collect()] == ['{"v": ']
    with pytest.raises(Exception, match="no JSON"):
        readers.read_json(spark, str(tmp_path), lines=False, strict=True).collect()


def test_json_rows_and_quarantine_are_the_lines(spark, put):
    lines = ['{"a": 1, "b": "x"}', '{"a": "12x", "b": "y"}', "no json", "7", '{"b": {"c": 1}}', '{"a": [1], "b": "z", "n": {"d": "soon", "e": 2}}', '{"a": 5, "b": ', "[1, 2]", "{}"]
    path = put("t.json", "\n".join(lines) + "\n\n")
    schema = T.StructType.fromDDL("a bigint, b string, n struct<d: date, e: int>")
    df = readers.read_json(spark, path, schema)
    aside = readers.json_quarantine(spark, path, schema=schema)
    assert sorted(r.value for r in aside.collect()) == sorted(["no json", "7", '{"a": 5, "b": ', "[1, 2]"])
    want = [(1, "x", None, None), (None, "y", None, None), (None, '{"c":1}', None, None), (None, "z", None, 2), (None, None, None, None)]
    assert sorted(map(tuple, df.collect()), key=str) == sorted(want, key=str)
    assert df.count() + aside.count() == len(lines)
    assert readers.read_json(spark, path).count() + readers.json_quarantine(spark, path).count() == len(lines)
    many = put("m.json", '[{"a": 1}, {"a": "x", "b": "y"}]\n[]\n')
    assert sorted(map(tuple, readers.read_json(spark, many, T.StructType.fromDDL("a bigint, b string")).collect()), key=str) == [(1, None), (None, "y")]


@pytest.fixture
def small_ranges(spark):
    """Files are read in ranges of a few hundred bytes."""
    settings = {"spark.sql.files.maxPartitionBytes": "700b", "spark.sql.files.openCostInBytes": "1b", "spark.sql.files.minPartitionNum": "40"}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k in settings:
        spark.conf.unset(k)


def odd_cells(rng):
    parts = ["plain", "", "a,b", 'say "hi"', "two\nlines", "\n", '"', '""', "x" * 300, "\n\n;\r\n", "é", " padded ", 'q"uote', "1,2\n3,4"]
    return [[str(i), *(rng.choice(parts) for _ in range(3))] for i in range(150)]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_csv_is_cut_by_ranges(spark, tmp_path, small_ranges, end):
    rng, want = random.Random(6), []
    for k in range(3):
        rows = odd_cells(rng)
        with open(tmp_path / f"{k}.csv", "w", newline="", encoding="utf-8") as f:
            w = csv.writer(f, lineterminator=end)
            w.writerow(["id", "two\nlines", "c", "d"])
            w.writerows(rows)
            if k == 1:
                f.write("7,only")  # fewer cells, no line end
                want.append(("7", "only", None, None))
        want += [tuple(c or None for c in r) for r in rows]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "two\nlines", "c", "d")])
    df = readers.read_csv(spark, str(tmp_path), schema)
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, want))
    lines = spark.read.text(str(tmp_path))
    assert lines.rdd.getNumPartitions() > 20 and readers.csv_quarantine(spark, str(tmp_path)).count() == 0
    assert dict(readers.read_csv(spark, str(tmp_path)).dtypes)["id"] == "bigint"


@pytest.mark.parametrize("cell", ["plain", "x\ny"])
def test_csv_keeps_the_columns_of_folders(spark, tmp_path, cell):
    for k in (1, 2):
        (tmp_path / f"part={k}").mkdir()
        (tmp_path / f"part={k}" / "a.csv").write_text(f'a,a\n{k},"{cell}"\n1,2,3\n')
    df = readers.read_csv(spark, str(tmp_path))
    assert df.columns == ["a", "a.1", "part"] and sorted(map(tuple, df.collect())) == [(1, cell, 1), (2, cell, 2)]
    assert readers.csv_quarantine(spark, str(tmp_path)).count() == 2


def test_csv_ranges_need_one_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b\n1,"x\ny"\n')
    (tmp_path / "b.csv").write_text('b,a\n1,"x\ny"\n')
    with pytest.raises(ValueError, match="different headers"):
        readers.read_csv(spark, str(tmp_path))


@pytest.mark.parametrize(
    "text, names, rows",
    [
        ("", [], []),
        ("a,b\n", ["a", "b"], []),
        ('\ufeffa,b\n1,"x\ny"\n', ["a", "b"], [(1, "x\ny")]),
        ("a,b\n1,2", ["a", "b"], [(1, 2)]),
        ('a,b\n5" pipe,6" x\n"q" z,1\n', ["a", "b"], [('5" pipe', '6" x'), ('"q" z', "1")]),
        ('a,b\n1,"never closed\n2,3\n', ["a", "b"], [(1, "never closed\n2,3")]),
        ("a,b\r1,2\r3,4\r", ["a", "b"], [(1, 2), (3, 4)]),
    ],
)
def test_odd_csv_files(spark, tmp_path, text, names, rows):
    (tmp_path / "x.csv").write_text(text, newline="")
    df = readers.read_csv(spark, str(tmp_path / "x.csv"))
    assert df.columns == names and [tuple(r) for r in df.collect()] == rows
    assert readers.csv_quarantine(spark, str(tmp_path / "x.csv")).count() == 0


@pytest.mark.parametrize("broken", ["", '9,"q\nq"\n'])
def test_csv_ragged_rows_and_repeated_names(spark, put, broken):
    path = put("r.csv", 'a,b,a,\n1,2,3,4\n5,6\n7,8,9,10,11\n"1,2",x,,,\n\n12,13,14,15,\n16,"1,2,3,4,5",,\n' + broken)
    df = readers.read_table(spark, path)
    assert df.columns == ["a", "b", "a.1", "_c3"]
    rows = [("1", "2", 3, 4), ("5", "6", None, None), ("16", "1,2,3,4,5", None, None)] + ([("9", "q\nq", None, None)] if broken else [])
    assert sorted(tuple(str(x) for x in r) for r in df.collect()) == sorted(tuple(str(x) for x in r) for r in rows)
    aside = [r.value for r in readers.csv_quarantine(spark, path).collect()]
    assert sorted(aside) == sorted(["7,8,9,10,11", '"1,2",x,,,', "12,13,14,15,"])
    with pytest.raises(Exception, match="more cells"):
        readers.read_csv(spark, path, strict=True).collect()


def test_large_json_arrays_are_cut_by_ranges(spark, tmp_path, small_ranges):
    rng = random.Random(8)
    texts = ["plain", 'quo"te', "br}ace", "{[", "back\\", '\\"}', "", "é\n", "x" * 200]
    def member(i):
        return {"id": i, rng.choice("ab"): rng.choice(texts), "n": {"deep": [{"k": rng.choice(texts)}, 1], "e": {}}}
    documents = {"a": [member(i) for i in range(120)], "b": [1, {"id": 1000}, [2, {"id": "no"}], "}", {"id": 1001}, None], "c": [], "d": {"rows": [member(2000)]}, "e": [7, 8]}
    for name, document in documents.items():
        (tmp_path / f"{name}.json").write_text(" \n" + json.dumps(document, indent=rng.choice([None, 1])) + "\n")
    (tmp_path / "bad.json").write_text('[{"id": 3000}, {"id": }, {"id": 3001}]')
    kinds = {"schema": T.StructType.fromDDL("id string, a string, b string, value string, n struct<deep: array<variant>>")}
    small = readers.read_json(spark, str(tmp_path), lines=False, **kinds)
    cut = readers.read_json(spark, str(tmp_path), lines=False, range_bytes=1, **kinds)
    def rows(df):
        return sorted(str(r) for r in df.select("id", "a", "b", "value", F.to_json("`n.deep`")).collect() if not (r.id or "").startswith("300"))
    assert rows(cut) == rows(small) and cut.where("id IN ('3000', '3001')").count() == 2
    assert [r.value for r in readers.json_quarantine(spark, str(tmp_path), lines=False, range_bytes=1).collect()] == ['[ {"id": }]']


CRLF = "CREATE TABLE t (\r\n  x INT, -- it's; odd\r\n  s TEXT\r\n);\r\nINSERT INTO t VALUES (1, 'a;\r\nb');\r\nINSERT INTO t VALUES (2, 'it''s');INSERT INTO t VALUES (3, ';');\r\n-- don't\r\nCOMMIT;\r\n"


def test_dumps_with_windows_line_ends(spark, put):
    path = put("w.sql", "")
    open(path, "w", newline="").write(CRLF)
    dump = insert_dump.read_dump(spark, path)
    assert sorted(map(tuple, dump.tables["t"].collect())) == [(1, "a;\r\nb"), (2, "it's"), (3, ";")]
    assert dump.rows == {"t": 3} and [r.value for r in dump.quarantine.collect()] == ["COMMIT;"]
    open(path, "w", newline="").write("CREATE TABLE t (x INT);\r\nINSERT INTO t VALUES (1);\r\nINSERT INTO t VALUES (2);\r\n")
    assert sorted(r.x for r in readers.read_table(spark, path).collect()) == [1, 2]
    open(path, "w", newline="").write("CREATE TABLE t (x INT); INSERT INTO t VALUES (1); INSERT INTO t VALUES (')")
    dump = insert_dump.read_dump(spark, path)
    assert [r.x for r in dump.tables["t"].collect()] == [1] and [r.value for r in dump.quarantine.collect()] == ["INSERT INTO t VALUES (');"]


def test_statements_are_cut_by_ranges(spark, tmp_path, small_ranges):
    rng = random.Random(9)
    words = ["a", "b;\n", "\n", "it''s", ";", '"', "`", "--", "\r\n", "x" * 90]
    values = ["".join(rng.choices(words, k=rng.randint(0, 6))) for _ in range(200)]
    for k in range(2):
        text = "CREATE TABLE t (i INT, s TEXT);\n" + "".join(f"INSERT INTO t VALUES\n ({i}, '{v}');\n" for i, v in enumerate(values) if i % 2 == k)
        (tmp_path / f"{k}.sql").write_text(text, newline="")
    dump = insert_dump.read_dump(spark, str(tmp_path))
    assert {r.i: r.s for r in dump.tables["t"].collect()} == {i: v.replace("''", "'") for i, v in enumerate(values)}
    assert dump.rows == {"t": 200} and dump.quarantine.count() == 0


def test_a_hundred_tables_in_one_pass(spark, tmp_path):
    lines = [f'CREATE TABLE "t{k}" (x INT);' for k in range(100)] + [f"INSERT INTO t{k} VALUES ({i});" for k in range(100) for i in range(k % 4)]
    (tmp_path / "many.sql").write_text("\n".join(lines))
    dump = insert_dump.read_dump(spark, str(tmp_path))
    (tmp_path / "many.sql").unlink()  # nothing reads the dump again
    assert dump.rows == {f"t{k}": k % 4 for k in range(100)}
    assert sorted(r.x for r in dump.tables["t7"].collect()) == [0, 1, 2] and dump.tables["t8"].count() == 0 and dump.quarantine.count() == 0


def test_bad_json_lines_add_no_column(spark, put):
    path = put("t.json", '{"a": 1}\nnot json\n{"a": 2}\n')
    df = readers.read_table(spark, path)
    assert df.columns == ["a"] and sorted(r.a for r in df.collect()) == [1, 2]
    assert [r.value for r in readers.json_quarantine(spark, path).collect()] == ["not json"]
    with pytest.raises(Exception):
        readers.read_json(spark, path, strict=True).collect()
