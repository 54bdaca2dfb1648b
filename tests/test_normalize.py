"""Truth tables of the cleaning functions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tabulyse.functions import normalize as n
from tabulyse.functions.semantic_types import ColumnSpec, register_semantic_type
from tabulyse.operators import normalize_table as nt

DAY = dt.datetime(2024, 1, 5)
NOON = dt.datetime(2024, 1, 5, 10, 11, 12)

CASES = [
    (n.is_null_token, {"N/A": True, " none ": True, "-": True, "—": True, "": True, " nil\n": True, "0": False, "no": False, "nullx": False}),
    (
        n.parse_long,
        {"1,234.9": 1234, "$500": 500, "45%": 45, "-7": -7, "1e3": 1000, "abc": None, "12-15": None, "5d": 5, "10 eggs": 10, "9e30": None, "-1.9": -1, "9007199254740993.0": 9007199254740993,
         "$9,007,199,254,740,993.00": 9007199254740993, "-9007199254740993.5": -9007199254740993, "9,007,199,254,740,993.75 %": 9007199254740993,
         ".5": 0, "-.5": 0, "5.": 5, ".": None, "+": None, "2.9999999": 2, "99999999999999999999.5": None, "1.5e3": 1500},
    ),
    (n.parse_double, {"€12.50": 12.5, "45.5%": 45.5, "1.2345678": 1.234568, "1.2.3": None, "-": None, ".5": 0.5, "1e400": None, "+3": 3.0}),
    (
        n.parse_boolean,
        {"Yes": True, "active": True, "1": True, "2": True, "closed": False, "off": False, "0": False, "maybe": False, "5d": False, "-Inf": True, "n/a": None},
    ),
    (
        n.parse_timestamp,
        {
            "2024-01-05T10:11:12Z": NOON,
            "2024-01-05T10:11:12+05:30": NOON,
            "2024-01-05 10:11:12": NOON,
            "2024-01-05T10:11:12.5": NOON.replace(microsecond=500000),
            "1/5/2024": DAY,
            "January 5, 2024": DAY,
            "January 5, 2024 10:11:12": NOON,
            "5 Jan 2024": DAY,
            "05.01.2024": DAY,
            "Friday, January 5, 2024": DAY,
            "Fri Jan 05 2024": DAY,
            "20240105": DAY,
            "20240105101112": NOON,
            "13/02/2024": dt.datetime(2024, 2, 13),
            "31-12-2024": dt.datetime(2024, 12, 31),
            "12-31-2024": dt.datetime(2024, 12, 31),
            "5-1-2024 10:11:12": NOON,
            "01/05/2024 10:11:12 AM": NOON,
            "2024/1/5": DAY,
            "1/5/24": DAY,
            "1/5/70": dt.datetime(1970, 1, 5),
            "24-01-05": DAY,
            "Jan 2024": dt.datetime(2024, 1, 1),
            "1704412800": DAY,
            "1704449472000": NOON,
            "due 2024-01-05 at last": DAY,
            "2024-02-30": None,
            "soon": None,
            "14:30": None,
            "99999999999999999": None,
        },
    ),
    (n.parse_time, {"14:30": "14:30:00", "2:30 PM": "14:30:00", "2024-01-05 10:11:12": "10:11:12", "x": None}),
    (n.clean_string, {'  "a   b" ': "a b", "null": None, "'x'": "x", '"': '"', "a  b\n c": "a b c", "'a\"": "'a\""}),
    (n.date_unparsed, {"soon": True, "2024-01-05": False, "": False}),
]


@pytest.mark.parametrize("fn, table", CASES, ids=[fn.__name__ for fn, _ in CASES])
def test_truth_table(spark, fn, table):
    df = spark.createDataFrame([(v,) for v in table], "v string")
    assert {r.v: r.out for r in df.select("v", fn(F.col("v")).alias("out")).collect()} == table


def test_null_input_stays_null(spark):
    df = spark.createDataFrame([(None,)], "v string")
    row = df.select(*[fn(F.col("v")).alias(fn.__name__) for fn, _ in CASES]).first().asDict()
    assert row.pop("is_null_token") is True and row.pop("date_unparsed") is False
    assert set(row.values()) == {None}


def test_cleaning_twice_changes_nothing(spark):
    texts = ["  'a  b' ", "x\ty", "plain", '"q"']
    once = spark.createDataFrame([(t,) for t in texts], "v string").select(n.clean_string(F.col("v")).alias("v"))
    assert once.select(n.clean_string(F.col("v")).alias("v")).collect() == once.collect()


SPECS = [
    ColumnSpec("i", "Quantity"),
    ColumnSpec("f", " price "),
    ColumnSpec("b", "bool"),
    ColumnSpec("d", "Date"),
    ColumnSpec("t", "time"),
    ColumnSpec("s", "anything"),
    ColumnSpec("gone", "int"),
]


def test_null_policies(spark):
    df = spark.createDataFrame([("n/a", "x", None, "soon", "", " null ", 1)], "i string, f string, b string, d string, t string, s string, extra int")
    default = nt.normalize(df, SPECS)
    assert default.columns == [s.name for s in SPECS]
    assert list(default.first()) == [0, 0.0, False, None, None, "", 0]
    assert list(nt.normalize(df, SPECS, "null").first()) == [None] * 7
    assert [(f.name, f.dataType) for f in default.schema] == [(f.name, f.dataType) for f in nt.target_schema(SPECS)]
    with pytest.raises(ValueError):
        nt.normalize(df, SPECS, "zero")


def test_typed_columns_skip_text(spark):
    df = spark.sql("select 2.9D i, true f, 0.5D b, timestamp_ntz'2024-01-05 10:11:12' d, timestamp_ntz'2024-01-05 10:11:12' t, array(1, 2) s, cast('NaN' as double) gone")
    assert list(nt.normalize(df, SPECS, "null").first()) == [2, 1.0, True, DAY.date(), "10:11:12", "[1,2]", None]


@pytest.mark.parametrize(
    "name, expected",
    [
        ("id", "Number"), ("user_id", "Number"), ("User ID", "Number"), ("created_at", "Date"), ("event time", "Date"), ("generated", None),
        ("lifetime", None), ("unit_price", "Float"), ("page", None), ("age", "Number"), ("update_count", "Number"), ("is_active", "Boolean"), ("width", None),
    ],
)
def test_names_decide_by_whole_words(name, expected):
    assert nt.type_from_name(name) == expected


def test_inference_by_values(spark):
    df = spark.sql(
        "select * from values (true, 1, 1.5D, '2024-01-05', 'a', cast(null as string)), (null, 2, 2.5D, '1/5/2024', 'b', null),"
        " (false, 3, 3.5D, 'x', '2024-01-05', 'n/a') t(flag, whole, real, mostly, rarely, blank)"
    )
    found = {r["column"]: r.type for r in nt.infer_types(df).collect()}
    assert found == {"flag": "Boolean", "whole": "Number", "real": "Float", "mostly": "Date", "rarely": "String", "blank": "String"}


def test_registered_type(spark):
    register_semantic_type("Litres", "float", "DECIMAL(10,3)")
    spec = ColumnSpec("v", "litres")
    assert spec.ddl == "DECIMAL(10,3)"
    df = spark.createDataFrame([("3.5 l",)], "v string")
    assert nt.normalize(df, [spec]).first().v == 3.5
