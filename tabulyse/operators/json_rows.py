"""Text replies that should hold JSON records, to rows.

Well-formed JSON, alone or inside a fence or between sentences, is parsed on the JVM. Only what fails is
sent to Python to be mended. What cannot be mended is set aside, never an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulyse.functions import missing as m
from tabulyse.functions import normalize as n
from tabulyse.functions.binding import let
from tabulyse.functions.mending import mended
from tabulyse.functions.semantic_types import ColumnSpec
from tabulyse.operators.normalize_table import looks_like_date, normalize, type_from_counts, type_from_name

MOST_COLUMNS = 2_000
_BRACKETED = r"(?s)[\[{].*[\]}]"


def parse_replies(df: DataFrame, text: str) -> DataFrame:
    """The table without the text, plus status ('records', 'empty', 'malformed') and the records.

    ``records`` is an array of variants, NULL unless the status is 'records'. Blank text and JSON that
    is neither an array nor an object count as empty.
    """
    raw = m.col(text)
    others = [m.col(c) for c in df.columns if c != text]
    blank = raw.isNull() | raw.rlike(r"^\s*\z")
    # From the first opening to the last closing bracket; text without both is taken as it is.
    inside = F.coalesce(F.nullif(F.regexp_extract(raw, _BRACKETED, 0), F.lit("")), raw)
    parsed = df.select(*others, raw.alias("_raw"), blank.alias("_blank"), let(inside, _parse_whole).alias("_parsed"))
    broken = F.when(F.col("_parsed").isNull() & ~F.col("_blank"), F.col("_raw"))
    repaired = parsed.withColumn("_fixed", mended(broken))
    whole = F.coalesce("_parsed", _parse_whole(F.col("_fixed")))
    outcome = let(whole, lambda json: let(_records_in(json), lambda found: _outcome(json, found)))
    kept = [m.col(c) for c in df.columns if c != text]
    return repaired.select(*kept, outcome.alias("_out")).select(*kept, "_out.status", "_out.records")


def _records_in(json: Column) -> Column:
    shape = F.schema_of_variant(json)
    return F.when(shape.startswith("ARRAY"), F.try_variant_get(json, "$", "array<variant>")).when(shape.startswith("OBJECT"), F.array(json))


def _outcome(json: Column, found: Column) -> Column:
    some = F.size(found) > 0
    status = F.when(some, "records").when(~F.col("_blank") & json.isNull(), "malformed").otherwise("empty")
    return F.struct(status.alias("status"), F.when(some, found).alias("records"))


def _parse_whole(text: Column) -> Column:
    """The text as variant if it is one JSON value and nothing else, else NULL.

    The JSON functions stop at the end of the first value. What follows it shows once the text is put
    into brackets: it breaks either the array or the object.
    """
    alone = F.json_array_length(F.concat(F.lit("["), text, F.lit("\n]"))) == 1
    member = F.size(F.json_object_keys(F.concat(F.lit('{"v":'), text, F.lit("\n}")))) == 1
    return F.when(alone & member, F.try_parse_json(text))


def extract_records(parsed: DataFrame, rows: int | None = None) -> DataFrame:
    """One row per record of each reply: the reply's columns, its position, the record as variant.

    Array members that are not objects are skipped and not counted; ``skipped_members`` lists them. With
    ``rows`` the first that many records of each reply are kept.
    """
    objects = F.filter("records", _is_object)
    wanted = F.slice(objects, 1, rows) if rows is not None else objects
    return _members(parsed, wanted).select(*_reply_columns(parsed), "position", F.col("member").alias("record"))


def skipped_members(parsed: DataFrame) -> DataFrame:
    """(reply columns, position in the array, member): the array members that are not objects."""
    rest = _members(parsed, F.col("records")).where(~_is_object(F.col("member")))
    return rest.select(*_reply_columns(parsed), "position", F.to_json("member").alias("member"))


def _reply_columns(parsed: DataFrame) -> list[Column]:
    return [m.col(c) for c in parsed.columns if c not in ("status", "records")]


def _members(parsed: DataFrame, array: Column) -> DataFrame:
    # The outer form keeps Spark from testing for empty arrays up front, which would parse every reply twice.
    members = parsed.select(*_reply_columns(parsed), F.posexplode_outer(array).alias("position", "member"))
    return members.where("position is not null")


def _is_object(member: Column) -> Column:
    return F.coalesce(F.schema_of_variant(member).startswith("OBJECT"), F.lit(False))


def record_field(name: str, record: str = "record") -> Column:
    """A member of the record as text; numbers and nested values as their JSON."""
    quoted = name.replace("\\", "\\\\").replace('"', '\\"')
    return F.try_variant_get(record, f'$["{quoted}"]', "string")


def record_columns(records: DataFrame, names: list[str], keep: list[str]) -> DataFrame:
    return records.select(*[m.col(k) for k in keep], *[record_field(c).alias(c) for c in names])


def infer_record_specs(records: DataFrame, most_columns: int = MOST_COLUMNS) -> list[ColumnSpec]:
    """One spec per member name found in any record, in name order, from one aggregate.

    More than ``most_columns`` names are an error: a table that wide is probably one of keys that belong into a column.
    """
    members = records.select(F.explode(F.try_variant_get("record", "$", "map<string,variant>")).alias("name", "v"))
    sort, text = F.schema_of_variant("v"), F.try_variant_get("v", "$", "string")
    seen = members.select("name", sort.alias("sort"), text.alias("text"))
    there = ~n.is_null_token(F.col("text"))
    whole, number = F.col("sort") == "BIGINT", F.col("sort").rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    counts = seen.groupBy("name").agg(
        F.count_if(there).alias("present"),
        F.count_if(there & (F.col("sort") == "BOOLEAN")).alias("booleans"),
        F.count_if(there & whole).alias("whole"),
        F.count_if(there & number).alias("numbers"),
        F.count_if(there & looks_like_date(F.col("text"))).alias("dates"),
    )
    rows = counts.orderBy("name").limit(most_columns + 1).collect()
    if len(rows) > most_columns:
        raise ValueError(f"the records have more than {most_columns} different members; name the columns wanted, or allow more")
    return [ColumnSpec(r["name"], type_from_name(r["name"]) or type_from_counts(*r[1:])) for r in rows]


def reply_rows(
    df: DataFrame,
    text: str,
    specs: list[ColumnSpec] | None = None,
    null_policy: str = "typed_default",
    rows: int | None = None,
    most_columns: int = MOST_COLUMNS,
) -> DataFrame:
    """Replies to clean typed rows: the reply's columns, the record's position, the columns of the spec.

    Without a spec the columns are inferred, up to ``most_columns`` of them, which parses the replies once more. ``rows`` is
    the number of rows asked of each reply; what a reply holds beyond it is left out.
    """
    records = extract_records(parse_replies(df, text), rows)
    specs = specs or infer_record_specs(records, most_columns)
    keep = [c for c in records.columns if c != "record"]
    return normalize(record_columns(records, [s.name for s in specs], keep), specs, null_policy, tuple(keep))

