"""One query per operator, each over whole tables.

The test tables hold no missing or messy values, so queries about those derive them from the tables
with expressions that the SQL side states as well.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulyse.functions import normalize as n
from tabulyse.functions.semantic_types import ColumnSpec
from tabulyse.operators import conversations as conv
from tabulyse.operators import distribution as dist
from tabulyse.operators import json_rows, normalize_table, page_index, preview, profile, quantiles, relations, synth, usage
from tabulyse.operators.identity import link_identities
from tabulyse.operators.value_counts import approx_distinct_and_missing, distinct_and_missing, frequent_values, row_sketches, sketched_duplicates
from tabulyse.plans.report import report_long
from tabulyse.session import scratch_dir
from tabulyse.sinks.insert_text import insert_statements, table_name
from tabulyse.sinks.registry import register_write
from tabulyse.sinks.writers import write_table
from tabulyse.sources.insert_dump import largest_table, read_dump
from tabulyse.sources.readers import csv_quarantine, read_table, source_size
from tabulyse.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
ORDER_SPECS = [
    ColumnSpec("o_orderkey", "id"),
    ColumnSpec("o_custkey", "integer"),
    ColumnSpec("o_orderstatus", "status"),
    ColumnSpec("o_totalprice", "price"),
    ColumnSpec("o_orderdate", "datetime"),
    ColumnSpec("o_orderpriority", "string"),
]


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def gappy_lineitem(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem with missing values where a discount or tax is zero (as NULL and as NaN)."""
    zero_tax = F.when(F.col("l_tax") == 0, F.lit(float("nan"))).otherwise(F.col("l_tax"))
    return table(spark, sf, "lineitem").withColumns({"l_discount": F.nullif("l_discount", F.lit(0.0)), "l_tax": zero_tax})


def variant(key: str, choices: list[Column]) -> Column:
    """One of several spellings per row, by a key."""
    chosen = F.col(key) % len(choices)
    return reduce(lambda rest, i: F.when(chosen == i, choices[i]).otherwise(rest), range(len(choices)), F.lit(None))


# Profile


@query
def dataset_summary(spark, sf):
    return profile.dataset_summary(gappy_lineitem(spark, sf))


@query
def duplicate_rows(spark, sf):
    return profile.duplicate_rows(table(spark, sf, "documents").select("text", "lang"))


def wide_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events as rows of 20 columns: each twice, and once more a microsecond later."""
    base = table(spark, sf, "events").select("ts", "user_id", "event_type", "value", *[(F.col("user_id") + i).alias(f"c{i}") for i in range(16)])
    later = base.withColumn("ts", F.col("ts") + F.expr("interval 1 microsecond"))
    return base.unionAll(later).unionAll(base)


@query
def duplicate_rows_wide(spark, sf):
    return profile.duplicate_rows(wide_events(spark, sf))


@query
def duplicate_rows_approx(spark, sf):
    """Duplicates from sketches kept per kind of event and merged, held against the exact count."""
    wide = wide_events(spark, sf)
    kept = row_sketches(wide, ["event_type"])
    both = sketched_duplicates(kept).join(profile.duplicate_rows(wide).select("rows", F.col("duplicates").alias("exact")), "rows")
    near = F.abs(F.col("duplicates") - F.col("exact")) <= F.col("margin")
    return both.select("rows", near.alias("near"), (F.col("margin") < F.col("rows") / 10).alias("narrow"))


@query
def distinct_nested(spark, sf):
    """Distinct structs that differ by a microsecond only, by the sign of a zero, or maps by the order of their entries."""
    user, odd = F.col("user_id"), F.col("event_id") % 2 == 0
    wide = wide_events(spark, sf).withColumn("event_id", F.unix_micros(F.col("ts").cast("timestamp")))
    zero = F.struct(F.when(odd, 0.0).otherwise(-0.0).alias("z"), user)
    both = F.when(odd, F.create_map(F.lit("a"), user, F.lit("b"), F.lit(1))).otherwise(F.create_map(F.lit("b"), F.lit(1), F.lit("a"), user))
    nested = wide.select(F.struct("ts", "user_id").alias("at"), F.struct(F.col("ts").cast("timestamp").alias("t")).alias("zoned"), zero.alias("zero"), both.alias("map"))
    return distinct_and_missing(nested, ["at", "zoned", "zero", "map"])


@query
def data_bytes(spark, sf):
    return profile.data_bytes(table(spark, sf, "orders"))


@query
def column_profile(spark, sf):
    return profile.column_profile(gappy_lineitem(spark, sf))


@query
def column_profile_text(spark, sf):
    return profile.column_profile(table(spark, sf, "documents"))


@query
def column_profile_approx(spark, sf):
    """Approximate distinct counts, and whether they are within a tenth of the exact ones."""
    lineitem, columns = gappy_lineitem(spark, sf), MEASURES + ["l_orderkey", "l_returnflag"]
    exact = distinct_and_missing(lineitem, columns).select("column", F.col("distinct").alias("exact"))
    near = F.abs(F.col("distinct") / F.col("exact") - 1) < 0.1
    return approx_distinct_and_missing(lineitem, columns).join(exact, "column").select("column", "n", "missing", near.alias("near"))


@query
def quantiles_approx(spark, sf):
    """Whether approximate quantiles have the rank they should, within a hundredth."""
    orders = table(spark, sf, "orders")
    found = quantiles.approx_quantiles(orders, ["o_totalprice"], [0.1, 0.5, 0.9], accuracy=1_000)
    upto = [F.struct(F.lit(r.p).alias("p"), F.count_if(F.col("o_totalprice") <= r.value).alias("upto")) for r in found.collect()]
    ranked = found.join(orders.agg(F.array(*upto).alias("e")).select(F.inline("e")), "p")
    near = F.abs(F.col("upto") / F.col("n") - F.col("p")) < 0.01
    return ranked.select("column", "p", "n", near.alias("near"))


@query
def numeric_stats(spark, sf):
    flat = F.lit(7.5).alias("flat")
    return profile.numeric_stats(gappy_lineitem(spark, sf).select("*", flat), MEASURES + ["l_orderkey", "flat"])


@query
def deciles(spark, sf):
    found = quantiles.quantiles(table(spark, sf, "orders"), ["o_totalprice", "o_custkey"], [i / 10 for i in range(11)])
    return found.select("column", F.round("p", 1).alias("p"), F.round("value", 3).alias("value"), "n")


@query
def datetime_stats(spark, sf):
    written = F.when(F.col("o_orderstatus") == "P", "soon").otherwise(F.date_format("o_orderdate", "M/d/yyyy"))
    orders = table(spark, sf, "orders").withColumn("written", written)
    return profile.datetime_stats(orders, ["o_orderdate", "written"])


@query
def top_values(spark, sf):
    return profile.top_values(table(spark, sf, "part"), ["p_name", "p_brand", "p_type", "p_size"])


@query
def top_values_frequent(spark, sf):
    """Frequent values by candidates and bounds: columns with frequent values, and two of which no value is."""
    return frequent_values(table(spark, sf, "lineitem"), ["l_suppkey", "l_quantity", "l_returnflag", "l_orderkey", "l_shipdate"], k=8)


@query
def top_values_text(spark, sf):
    return profile.top_values(table(spark, sf, "documents"), ["text", "lang"])


# Distribution


@query
def histogram(spark, sf):
    lineitem = gappy_lineitem(spark, sf).withColumn("flat", F.lit(7.5))
    return dist.histogram(lineitem, MEASURES + ["flat"])


@query
def category_distribution(spark, sf):
    return dist.category_distribution(table(spark, sf, "part"), "p_brand")


@query
def box_plot(spark, sf):
    spread = table(spark, sf, "events").withColumn("cubed", F.col("value") * F.col("value") * F.col("value"))
    return dist.box_plot(spread, ["value", "cubed"])


@query
def outliers_iqr(spark, sf):
    spread = table(spark, sf, "events").withColumn("cubed", F.col("value") * F.col("value") * F.col("value"))
    return dist.outliers_iqr(spread, ["value", "cubed"])


@query
def outlier_rows(spark, sf):
    spread = table(spark, sf, "events").withColumn("cubed", F.col("value") * F.col("value") * F.col("value"))
    return dist.outlier_rows(spread, ["value", "cubed"], ["event_id"])


@query
def daily_counts(spark, sf):
    shipped = table(spark, sf, "lineitem").withColumn("l_month", F.trunc("l_shipdate", "month"))
    return dist.daily_counts(shipped, ["l_shipdate", "l_month"])


# Relations


@query
def correlation_matrix(spark, sf):
    lineitem = gappy_lineitem(spark, sf).withColumn("flat", F.lit(7.5))
    return relations.correlation_matrix(lineitem, MEASURES + ["flat"])


@query
def correlation_widest(spark, sf):
    """More than 15 columns: powers of price and quantity, the 15 of largest variance stay."""
    lineitem = table(spark, sf, "lineitem")
    wide = lineitem.select(*[(F.col("l_quantity") * i + F.col("l_tax") * (i * i)).alias(f"m{i}") for i in range(1, 18)])
    return relations.correlation_matrix(wide)


@query
def top_correlations(spark, sf):
    return relations.top_correlations(gappy_lineitem(spark, sf), MEASURES + ["l_orderkey", "l_partkey", "l_linenumber"])


@query
def top_correlations_wide(spark, sf):
    """The strongest of the 19,900 pairs of 200 columns, some of them with gaps."""
    a, b, c, d = (F.col(x) for x in MEASURES)
    wide = gappy_lineitem(spark, sf).select(*[((a * (i % 7) + b * (i % 11) / 1000 + c * (i % 5) * 100 + d * (i % 3) * 100 + F.pmod(F.col("l_orderkey") * (i + 1), F.lit(97 + i))).alias(f"w{i}")) for i in range(200)])
    return relations.top_correlations(wide, n=40)


@query
def scatter_sample(spark, sf):
    return relations.scatter_sample(table(spark, sf, "orders"), "o_totalprice", "o_custkey", ["o_orderkey"])


@query
def what_if(spark, sf):
    return relations.what_if(gappy_lineitem(spark, sf), "l_extendedprice", "l_discount", [-90.0, -10.0, 0.0, 25.0, 200.0])


# Preview


@query
def preview_page(spark, sf):
    return preview.preview_page(table(spark, sf, "orders"), ["o_orderkey"], page=3)


@query
def preview_deep(spark, sf):
    """The page in the middle of the table, found by seeking."""
    columns = ["l_quantity", "l_extendedprice", "l_orderkey", "l_partkey"]
    lineitem = table(spark, sf, "lineitem").select(*columns)
    page = preview.preview_pages(lineitem).first().total_pages // 2 + 1
    return preview.preview_page(lineitem, columns, page=page, shallow_rows=1_000)


@query
def preview_deep_text(spark, sf):
    """The page in the middle in the order of a text column with long shared prefixes."""
    customers = table(spark, sf, "customer")
    page = preview.preview_pages(customers).first().total_pages // 2 + 1
    return preview.preview_page(customers, ["c_mktsegment", "c_name"], page=page, shallow_rows=20)


@query
def preview_deep_ties(spark, sf):
    """The page in the middle in the order of a column of three values."""
    lineitem = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    page = preview.preview_pages(lineitem).first().total_pages // 2 + 1
    return preview.preview_page(lineitem, ["l_returnflag"], page=page, shallow_rows=100)


@query
def preview_indexed(spark, sf):
    """The page in the middle of the table, from a written index of its order."""
    lineitem = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_extendedprice")
    index = page_index.write_pages(lineitem, ["l_returnflag", "l_extendedprice", "l_orderkey", "l_linenumber"], scratch_dir(spark, "pages"))
    total = preview.preview_pages(lineitem).first().total_pages
    return page_index.read_page(spark, index, total // 2 + 1)


@query
def preview_pages(spark, sf):
    return preview.preview_pages(table(spark, sf, "lineitem"))


# Normalization


@query
def null_tokens(spark, sf):
    orders = table(spark, sf, "orders")
    spellings = [F.lit(t) for t in (" N/A ", "None", "-", "—", "", "no", "0")] + [F.col("o_orderstatus"), F.lit(None)]
    return orders.select("o_orderkey", n.is_null_token(variant("o_orderkey", spellings)).alias("is_null"))


def messy_price() -> Column:
    price = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    grouped = F.format_number("o_totalprice", 2)
    spellings = [
        price,
        F.concat(F.lit("$"), grouped),
        F.concat(F.lit("  "), price, F.lit(" %")),
        F.concat(F.lit("USD "), grouped),
        F.concat(F.lit("-"), price),
        F.concat(price, F.lit(" eggs")),
        F.concat(F.regexp_replace(price, r"\.", ""), F.lit("e-2")),
        F.lit("n/a"),
        F.concat(price, F.lit("-"), price),
    ]
    return variant("o_orderkey", spellings)


@query
def parse_numbers(spark, sf):
    messy = table(spark, sf, "orders").select("o_orderkey", messy_price().alias("v"))
    return messy.select("o_orderkey", n.parse_double(F.col("v")).alias("as_double"), n.parse_long(F.col("v")).alias("as_long"))


@query
def parse_large_numbers(spark, sf):
    """Whole numbers beyond 2^53, in several spellings."""
    whole = F.col("o_orderkey") + F.lit(9007199254740993)
    plain = whole.cast("string")
    spellings = [plain, F.concat(F.lit("$"), F.format_number(whole, 0)), F.concat(F.lit(" -"), plain, F.lit(" pcs")), F.concat(plain, F.lit("0000")),
                 F.concat(plain, F.lit(".00")), F.concat(F.lit("€ "), F.format_number(whole, 0), F.lit(".75"))]
    return table(spark, sf, "orders").select("o_orderkey", n.parse_long(variant("o_orderkey", spellings)).alias("as_long"))


@query
def iso_texts(spark, sf):
    return table(spark, sf, "events").select("event_id", n.iso_date(F.col("ts")).alias("day"), n.iso_datetime(F.col("ts")).alias("moment"))


@query
def parse_booleans(spark, sf):
    words = ["Yes", "active", "1", " TRUE ", "2", "1e2", "No", "closed", "0", "0.0", "maybe", "5d", "n/a"]
    orders = table(spark, sf, "orders")
    return orders.select("o_orderkey", n.parse_boolean(variant("o_orderkey", [F.lit(w) for w in words])).alias("flag"))


def messy_date() -> Column:
    patterns = [
        "yyyy-MM-dd'T'HH:mm:ss'Z'",
        "yyyy-MM-dd HH:mm",
        "yyyy-MM-dd",
        "M/d/yyyy",
        "MM/dd/yyyy hh:mm a",
        "d.M.yyyy",
        "yyyy/MM/dd HH:mm:ss",
        "MMMM d, yyyy",
        "d MMM yyyy",
        "MMM dd yyyy",
        "yyyyMMdd",
        "yyyyMMddHHmmss",
        "M/d/yy",
    ]
    spellings = [F.date_format("o_orderdate", p) for p in patterns]
    spellings.append(F.unix_seconds(F.col("o_orderdate").cast("timestamp")).cast("string"))
    spellings.append(F.concat(F.date_format("o_orderdate", "E"), F.lit(", "), F.date_format("o_orderdate", "MMMM d, yyyy")))
    spellings.append(F.concat(F.lit("on "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" or so")))
    spellings.append(F.lit("soon"))
    return variant("o_orderkey", spellings)


@query
def parse_dates(spark, sf):
    messy = table(spark, sf, "orders").select("o_orderkey", messy_date().alias("v"))
    return messy.select("o_orderkey", n.parse_date(F.col("v")).alias("day"), n.date_unparsed(F.col("v")).alias("unparsed"))


@query
def parse_times(spark, sf):
    events = table(spark, sf, "events")
    spellings = [F.date_format("ts", p) for p in ("HH:mm:ss", "hh:mm:ss a", "yyyy-MM-dd HH:mm:ss", "MM/dd/yyyy hh:mm:ss a")]
    return events.select("event_id", n.parse_time(variant("event_id", spellings)).alias("clock"))


@query
def clean_strings(spark, sf):
    documents = table(spark, sf, "documents")
    spellings = [F.col("text"), F.concat(F.lit('\t "'), F.col("text"), F.lit('" ')), F.concat(F.lit("'"), F.col("text"), F.lit("'"))]
    return documents.select("doc_id", n.clean_string(variant("doc_id", spellings)).alias("text"))


def messy_orders(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        "o_orderkey",
        F.concat(F.col("o_custkey").cast("string"), F.lit(" pcs")).alias("o_custkey"),
        F.concat(F.lit(" '"), F.col("o_orderstatus"), F.lit("'")).alias("o_orderstatus"),
        messy_price().alias("o_totalprice"),
        messy_date().alias("o_orderdate"),
        F.when(F.col("o_orderpriority") == "5-LOW", "N/A").otherwise(F.col("o_orderpriority")).alias("o_orderpriority"),
    )


@query
def normalize_table_default(spark, sf):
    specs = ORDER_SPECS + [ColumnSpec("absent", "float")]
    return normalize_table.normalize(messy_orders(spark, sf), specs)


@query
def normalize_table_null(spark, sf):
    return normalize_table.normalize(messy_orders(spark, sf), ORDER_SPECS, null_policy="null")


#: Bytes of orders behind one arriving file. A file of one row group is read by one task, so a batch needs many of them.
ARRIVING_BYTES = 1 << 20
ARRIVING_BATCHES = 3


@query
def normalize_stream(spark, sf):
    """The same cleaning on a stream of files, one batch after another until all are read; the files of a batch grow in number
    with the table."""
    incoming, cleaned, marks = (scratch_dir(spark, label) for label in ("incoming", "cleaned", "marks"))
    messy = messy_orders(spark, sf)
    size = source_size(spark, f"{sf}/orders.parquet").first().bytes
    at_once = max(1, math.ceil(size / ARRIVING_BYTES / ARRIVING_BATCHES))
    messy.repartition(ARRIVING_BATCHES * at_once, "o_orderkey").write.parquet(incoming)
    arriving = spark.readStream.schema(messy.schema).option("maxFilesPerTrigger", at_once).parquet(incoming)
    clean = jobs.normalize_stream(arriving, ORDER_SPECS, null_policy="null")
    run = clean.writeStream.format("parquet").option("checkpointLocation", marks).trigger(availableNow=True).start(cleaned)
    run.awaitTermination()
    return spark.read.parquet(cleaned)


def untyped_orders(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("order_id"),
        F.col("o_totalprice").cast("string").alias("unit_price"),
        F.date_format("o_orderdate", "d MMM yyyy").alias("due_date"),
        F.when(F.col("o_orderstatus") == "P", "unknown").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("seen"),
        F.when(F.col("o_orderstatus") == "P", "yes").otherwise("no").alias("verified"),
        F.col("o_custkey").alias("holder"),
        F.col("o_totalprice").alias("paid"),
        F.col("o_orderpriority").alias("priority"),
    )


@query
def infer_types(spark, sf):
    return normalize_table.infer_types(untyped_orders(spark, sf))


@query
def normalize_inferred(spark, sf):
    return normalize_table.normalize_inferred(untyped_orders(spark, sf))


# Sources and sinks


def roundtrip(df: DataFrame, fmt: str, specs: list[ColumnSpec] | None = None, **options) -> DataFrame:
    path = scratch_dir(df.sparkSession, fmt)
    write_table(df, path, fmt, specs)
    return read_table(df.sparkSession, path, fmt, **options)


@query
def csv_roundtrip(spark, sf):
    specs = [ColumnSpec("page_id", "id"), ColumnSpec("html", "text"), ColumnSpec("score", "float")]
    score = F.nullif(F.col("page_id") * 0.5, F.lit(0.0))
    return roundtrip(table(spark, sf, "pages").withColumn("score", score), "csv", specs)


@query
def csv_quoted_breaks(spark, sf):
    """A file of another writer: 19 and 20 digit ids, line breaks inside quotes."""
    ids = (F.col("event_id") + F.lit(1234567890123456789)).cast("string")
    note = F.concat("event_type", F.lit('\nsaid "'), F.col("event_id").cast("string"), F.lit('"'))
    path = scratch_dir(spark, "quoted")
    rows = table(spark, sf, "events").select(ids.alias("id"), F.concat(ids, F.lit("5")).alias("longer"), note.alias("note"))
    rows.write.csv(path, header=True, escape='"')
    return read_table(spark, path, "csv").select("id", F.col("longer").cast("string").alias("longer"), "note")


@query
def csv_ragged(spark, sf):
    """Rows of too few and too many cells under a header that repeats a name: the table, and what was set aside."""
    cells = [F.col("o_orderkey").cast("string"), F.col("o_orderpriority"), F.col("o_orderstatus")]
    short, long = F.concat_ws(",", *cells[:2]), F.concat_ws(",", *cells, F.lit('"a,b"'), F.lit(""))
    line = F.when(F.col("o_orderkey") % 10 == 0, long).when(F.col("o_orderkey") % 7 == 0, short).otherwise(F.concat_ws(",", *cells))
    path = scratch_dir(spark, "ragged")
    # Lines as they are: one column, whose separator and quotes do not occur.
    table(spark, sf, "orders").select(line.alias("id,note,note")).write.csv(path, header=True, sep="\x01", quote="")
    rows, aside = read_table(spark, path, "csv"), csv_quarantine(spark, path)
    found = rows.select("id", "note", F.col("`note.1`").alias("more"), F.lit(None).cast("string").alias("aside"))
    return found.unionByName(aside.select(F.col("value").alias("aside")), allowMissingColumns=True)


@query
def sql_dump_crlf(spark, sf):
    """A dump from Windows with semicolons at line ends inside texts: its rows, and what is no INSERT that can be read."""
    path = scratch_dir(spark, "crlf")
    key, name = F.col("c_custkey").cast("string"), F.concat(F.lit("'"), F.col("c_name"), F.lit(";\r\n it''s'"))
    insert = F.concat(F.lit("INSERT INTO c VALUES\r\n  ("), key, F.lit(", "), name, F.lit(");"))
    odd = F.concat(F.lit("INSERT INTO c VALUES (now(), "), key, F.lit(");"))
    customers = table(spark, sf, "customer")
    statements = customers.select(F.when(F.col("c_custkey") % 9 == 0, odd).otherwise(insert).alias("value"))
    create = customers.limit(1).select(F.lit("CREATE TABLE c (\r\n  id INT, -- the key;\r\n  name TEXT\r\n);").alias("value"))
    create.unionByName(statements).write.option("lineSep", "\r\n").text(path)
    dump = read_dump(spark, path)
    found = dump.tables["c"].select("id", "name", F.lit(None).cast("string").alias("aside"))
    return found.unionByName(dump.quarantine.select(F.col("value").alias("aside")), allowMissingColumns=True)


def exact_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events with a microsecond to each instant, NaN and infinite values among them."""
    shifted = F.col("ts") + F.make_dt_interval(secs=(F.col("event_id") % 1000).cast("decimal(18,6)") / 1000000)
    value = F.when(F.col("event_id") % 7 == 0, float("nan")).when(F.col("event_id") % 11 == 0, float("inf")).otherwise(F.col("value"))
    return table(spark, sf, "events").select("event_id", shifted.alias("ts"), shifted.cast("timestamp").alias("zoned"), value.alias("value"))


def _events_back(back: DataFrame) -> DataFrame:
    moment = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    value = F.nullif(F.col("value").cast("string").cast("double"), F.lit(float("inf")))
    return back.select("event_id", *[F.date_format(F.col(c).cast("timestamp"), moment).alias(c) for c in ("ts", "zoned")], value.alias("value"))


@query
def json_roundtrip_exact(spark, sf):
    return _events_back(roundtrip(exact_events(spark, sf), "json"))


@query
def csv_roundtrip_exact(spark, sf):
    return _events_back(roundtrip(exact_events(spark, sf), "csv"))


@query
def sql_dump_roundtrip_exact(spark, sf):
    return _events_back(roundtrip(exact_events(spark, sf), "sql"))


@query
def json_roundtrip(spark, sf):
    back = roundtrip(table(spark, sf, "customer"), "json")
    return back.select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


@query
def json_flatten(spark, sf):
    events = table(spark, sf, "events")
    nested = events.select("event_id", F.struct("user_id", F.struct(F.col("event_type").alias("name")).alias("type")).alias("who"), "props")
    return roundtrip(nested.withColumn("props", F.from_json("props", "k bigint")), "json")


@query
def json_documents(spark, sf):
    """Documents that hold their records in an array member, one document per line."""
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.sort_array(F.collect_list(F.struct("l_partkey", "l_quantity"))).alias("rows")
    )
    return roundtrip(lines, "json", record_path="rows")


@query
def parquet_roundtrip(spark, sf):
    return roundtrip(table(spark, sf, "orders"), "parquet")


@query
def sql_dump_roundtrip(spark, sf):
    return roundtrip(table(spark, sf, "documents"), "sql")


@query
def insert_statements_orders(spark, sf):
    orders = table(spark, sf, "orders").select(
        "o_orderkey",
        F.concat(F.col("o_orderpriority"), F.lit("\n'\\"), F.col("o_orderstatus")).alias("note"),
        (F.col("o_orderstatus") == "F").alias("done"),
        F.nullif("o_custkey", F.lit(0)).alias("o_custkey"),
    )
    specs = [ColumnSpec("o_orderkey", "id"), ColumnSpec("note", "string"), ColumnSpec("done", "boolean"), ColumnSpec("o_custkey", "id")]
    return insert_statements(orders, specs, "order_data")


@query
def insert_statements_named(spark, sf):
    """The table is named after what the rows are said to be."""
    return insert_statements(table(spark, sf, "supplier").select("s_suppkey", "s_name"), table=table_name("Our PRODUCT suppliers"))


@query
def sql_dump_grouped(spark, sf):
    """A dump of another writer: several rows in a statement of several lines, no column list, long decimals."""
    path = scratch_dir(spark, "grouped")
    amount = F.concat(F.lit("123456789012"), F.format_string("%09d", "o_custkey"), F.lit(".25"))
    note = F.concat(F.lit("'"), F.col("o_orderpriority"), F.lit("''s'"))
    group = F.concat(F.lit("("), F.concat_ws(", ", F.col("o_orderkey").cast("string"), amount, note), F.lit(")"))
    orders = table(spark, sf, "orders").groupBy(F.floor(F.col("o_orderkey") / 64).alias("chunk")).agg(F.sort_array(F.collect_list(group)).alias("groups"))
    inserts = orders.select(F.concat(F.lit("INSERT INTO `o` VALUES\n"), F.array_join("groups", ",\n"), F.lit(";")).alias("value"))
    create = "CREATE TABLE `o` (\n  id BIGINT,\n  amount NUMERIC(30, 2) NOT NULL,\n  note TEXT\n);"
    inserts.unionByName(orders.limit(1).select(F.lit(create).alias("value"))).write.text(path)
    return read_table(spark, path, "sql", strict=True)


@query
def json_mixed_documents(spark, sf):
    """Documents that hold their records under different names or as a bare array, each of a range of keys."""
    records = F.array_join(F.sort_array(F.collect_list(F.to_json(F.struct("s_suppkey", "s_name")))), ",\n")
    shapes = [('{"n": 1, "rows": [', "]}"), ("[", "]"), ('{"items": [', '], "rows": 3}')]
    file = F.floor(F.col("s_suppkey") / 20)
    parts = table(spark, sf, "supplier").groupBy(file.alias("file")).agg(records.alias("records"))
    path = scratch_dir(spark, "mixed")
    spelled = variant("file", [F.concat(F.lit(head), F.col("records"), F.lit(tail)) for head, tail in shapes])
    parts.select(spelled.alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return read_table(spark, path, "json", lines=False, strict=True)


@query
def json_array_ranges(spark, sf):
    """Documents that are arrays, cut by byte range: braces, quotes and brackets inside their texts."""
    note = F.concat(F.col("o_orderpriority"), F.lit(' "}], {'), F.col("o_orderstatus"))
    record = F.to_json(F.struct("o_orderkey", note.alias("note"), F.struct("o_totalprice").alias("price")))
    chunk = F.floor(F.col("o_orderkey") / 16_000)  # a document has some 1.4 MB
    documents = table(spark, sf, "orders").groupBy(chunk.alias("chunk")).agg(F.array_join(F.collect_list(record), ",\n").alias("records"))
    path = scratch_dir(spark, "arrays")
    documents.select(F.concat(F.lit(" [\n"), "records", F.lit("\n]")).alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return read_table(spark, path, "json", lines=False, range_bytes=10_000)


@query
def largest_table_of_all(spark, sf):
    names = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
    return largest_table({t: table(spark, sf, t) for t in names.split()})


@query
def dataset_registry(spark, sf):
    folder, registry = scratch_dir(spark, "datasets"), scratch_dir(spark, "registry")
    register_write(table(spark, sf, "orders"), folder, registry, owner="owner-1", name="orders")
    register_write(table(spark, sf, "customer"), folder, registry, owner="owner-1", name="customers", fmt="csv", mode="realistic")
    return spark.read.parquet(registry).select("owner", "name", "mode", "model", "format", "rows", "columns", (F.col("bytes") > 0).alias("has_bytes"))


@query
def json_by_column(spark, sf):
    """Customers as documents that map each column to its values, one document per range of keys."""
    chunk = F.floor(F.col("c_custkey") / 300)
    customers = table(spark, sf, "customer").groupBy(chunk.alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("c_custkey", "c_name"))).alias("rows"))
    columns = customers.select(F.to_json(F.struct(F.col("rows.c_custkey").alias("key"), F.col("rows.c_name").alias("name"))).alias("value"))
    path = scratch_dir(spark, "by-column")
    columns.write.option("maxRecordsPerFile", 1).text(path)
    return read_table(spark, path, "json", by_column=True)


# Records from text


def replies(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as the text replies they might have come in, with all kinds of damage."""
    record = F.to_json(F.struct("o_orderkey", "o_orderstatus", "o_totalprice", F.col("o_orderpriority").alias("note")))
    priced = F.format_string('{"o_orderkey": %d, "o_orderstatus": "%s"}', F.col("o_orderkey"), F.col("o_orderstatus"))
    spellings = [
        F.concat(F.lit("["), record, F.lit("]")),
        record,
        F.concat(F.lit("```json\n["), record, F.lit(",]\n```")),
        F.concat(F.lit("Here you are: ["), record, F.lit("] // anything else?")),
        F.concat(F.lit("["), record, F.lit(", "), priced, F.lit(', {"o_orderkey": 1, "note": "cut o')),
        F.concat(F.lit('[{"u": "http://x.example.com/a", "o_orderkey": '), F.col("o_orderkey").cast("string"), F.lit(', "note": "cut [o')),
        F.concat(record, F.lit("\n"), priced),
        F.concat(F.lit("[1, "), record, F.lit("]")),
        F.lit("  "),
        F.lit("42"),
        F.lit('[{"a" 1}]'),
    ]
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("reply_id"), variant("o_orderkey", spellings).alias("raw"))


@query
def json_repair(spark, sf):
    """What became of every reply."""
    parsed = json_rows.parse_replies(replies(spark, sf), "raw")
    return parsed.select("reply_id", "status", F.greatest(F.coalesce(F.size("records"), F.lit(0)), F.lit(0)).cast("bigint").alias("members"))


@query
def extract_records(spark, sf):
    records = json_rows.extract_records(json_rows.parse_replies(replies(spark, sf), "raw"))
    return json_rows.record_columns(records, ["o_orderkey", "o_orderstatus", "note", "u"], ["reply_id", "position"])


@query
def skipped_members(spark, sf):
    return json_rows.skipped_members(json_rows.parse_replies(replies(spark, sf), "raw"))


@query
def reply_to_rows(spark, sf):
    return json_rows.reply_rows(replies(spark, sf), "raw", null_policy="null")


# Synthesis


@query
def synth_orders_like(spark, sf):
    specs = [
        ColumnSpec("order_id", "Number"),
        ColumnSpec("customer_age", "Number"),
        ColumnSpec("stock", "Number"),
        ColumnSpec("total_price", "Number"),
        ColumnSpec("points", "Integer"),
        ColumnSpec("weight", "Float"),
        ColumnSpec("is_gift", "Boolean"),
        ColumnSpec("ordered", "Date"),
        ColumnSpec("lat", "Latitude"),
        ColumnSpec("lon", "Longitude"),
        ColumnSpec("uid", "UUID"),
        ColumnSpec("zip", "Zip Code"),
        ColumnSpec("badge", "Employee ID"),
    ]
    return synth.synth_columns(synth.spread(table(spark, sf, "orders").select("o_orderkey")), "o_orderkey", specs, seed=42)


@query
def synth_people(spark, sf):
    """Every type of the generator, one row per customer."""
    specs = [ColumnSpec(t.replace(" ", "_"), t) for t in synth.synth_types()]
    return synth.synth_columns(synth.spread(table(spark, sf, "customer").select("c_custkey")), "c_custkey", specs, seed=7)


@query
def synth_preview(spark, sf):
    """Five rows like those of a table, whose column types are inferred."""
    suppliers = table(spark, sf, "supplier")
    specs = [ColumnSpec(r.column, r.type) for r in normalize_table.infer_types(suppliers).orderBy("position").collect()]
    return synth.synth_preview(spark, [s for s in specs if s.key != "string"], seed=7)


@query
def synth_preset(spark, sf):
    """The ready-made schema for a topic, of the types allowed."""
    specs = synth.default_specs("Sales", ["City", "Email"])
    return synth.synth_columns(synth.spread(table(spark, sf, "customer").select("c_custkey")), "c_custkey", specs, seed=7)


# Conversations


@query
def has_table(spark, sf):
    return table(spark, sf, "documents").select("doc_id", conv.has_table(F.col("text")).alias("has_table"))


@query
def recent_history(spark, sf):
    return conv.recent_history(table(spark, sf, "conversations"), k=4)


@query
def conversation_title(spark, sf):
    return conv.conversation_title(table(spark, sf, "conversations"))


@query
def conversation_archive(spark, sf):
    nested = conv.conversation_archive(table(spark, sf, "conversations"))
    ends = {"first": F.element_at("messages", 1), "last": F.element_at("messages", -1)}
    shown = [ends[e][f].alias(f"{e}_{f}") for e in ends for f in ("role", "text")]
    turns = F.array_join(F.transform("messages", lambda x: x["turn"].cast("string")), ",")
    return nested.select("conv_id", "part", "n", *shown, turns.alias("turns"))


@query
def archive_long_conversation(spark, sf):
    """All messages as seven conversations of sparse turns, each turn said by many."""
    messages = table(spark, sf, "conversations")
    merged = messages.select((F.col("conv_id") % 7).alias("conv_id"), (F.col("turn") * 1_000_000).alias("turn"), "role", "text")
    nested = conv.conversation_archive(merged, turns_per_row=100)
    said = F.transform("messages", lambda x: F.concat_ws(":", x["turn"].cast("string"), x["role"], x["text"]))
    return nested.select("conv_id", "part", "n", F.sha2(F.array_join(said, "\n"), 256).alias("digest"))


@query
def message_lists(spark, sf):
    lists = conv.message_lists(table(spark, sf, "conversations"), "Answer with tables.", "Now the rows.", k=4)
    return lists.select("conv_id", F.posexplode("prompt").alias("position", "said")).select("conv_id", "position", "said.role", "said.content")


@query
def full_message_rows(spark, sf):
    return conv.full_message_rows(table(spark, sf, "conversations"), "Answer with tables.", "Now the rows.")


@query
def mode_params(spark, sf):
    modes = [F.lit(x) for x in ("Synthetic", "real-time", "HYBRID", "live-data", "realistic", "odd")]
    chats = table(spark, sf, "conversations").select("conv_id", "turn", variant("conv_id", modes).alias("data_mode"))
    return conv.mode_params(chats, "data_mode")


# Usage


@query
def usage_minute(spark, sf):
    limits = {"click": 1, "view": 2}
    return usage.usage_minute(table(spark, sf, "events"), "event_type", limits, other=1)


@query
def usage_first_hit(spark, sf):
    """Windows of a day from a user's first event on."""
    events = table(spark, sf, "events")
    return usage.usage_first_hit(events, "user_id", other=2, seconds=86_400)


@query
def usage_first_hit_kinds(spark, sf):
    """A few keys with all events between them, in windows of six hours."""
    return usage.usage_first_hit(table(spark, sf, "events"), "event_type", {"click": 4}, other=9, seconds=21_600)


@query
def usage_daily(spark, sf):
    return usage.usage_daily(table(spark, sf, "events"), "user_id", "event_type", {"click": 1, "view": 2}, other=3)


@query
def usage_status(spark, sf):
    events = table(spark, sf, "events")
    return usage.usage_status(events, events, "user_id", "event_type", ["click", "view", "report"], "2024-01-02")


@query
def sessions(spark, sf):
    return usage.sessions(table(spark, sf, "events"), "user_id", as_of="2024-01-30 23:58:00")


@query
def newest_per_owner(spark, sf):
    return usage.newest_per_owner(table(spark, sf, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], 3)


@query
def newest_of_owner(spark, sf):
    """The history of the owner with the most orders."""
    orders = table(spark, sf, "orders")
    owner = usage.quota_count(orders, "o_custkey").orderBy(F.desc("n"), "o_custkey").first().o_custkey
    return usage.newest_of_owner(orders, "o_custkey", owner, ["o_orderdate", "o_orderkey"], 20)


@query
def quota_count(spark, sf):
    return usage.quota_count(table(spark, sf, "orders"), "o_custkey")


@query
def owned_runs(spark, sf):
    owner = F.when(F.col("c_acctbal") > 0, F.col("c_custkey")).alias("owner")
    return usage.owned_rows(table(spark, sf, "orders"), "o_custkey", table(spark, sf, "customer").select(owner), "owner")


def identity_inputs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Orders as sign-ins by three providers. Every customer is a user; building customers sign in with the address that is on
    file, some of them by a provider that is linked."""
    address = F.concat(F.lit("Customer"), F.col("o_custkey").cast("string"), F.lit("@Example.com "))
    signins = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("seq"),
        F.col("o_orderstatus").alias("provider"),
        F.col("o_custkey").cast("string").alias("provider_id"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.upper(address)).otherwise(address).alias("email"),
    )
    customers, builds = table(spark, sf, "customer"), F.col("c_mktsegment") == "BUILDING"
    key = F.col("c_custkey").cast("string")
    on_file = F.when(builds, "@example.com").otherwise("@example.org")
    users = customers.select(F.concat(F.lit("user-"), key).alias("user_id"), F.concat(F.lit("customer"), key, on_file).alias("email"))
    provider = F.when(builds & (F.col("c_acctbal") > 0), "F").otherwise("elsewhere")
    links = customers.select(F.concat(F.lit("user-"), key).alias("user_id"), provider.alias("provider"), key.alias("provider_id"))
    return signins, users, links


@query
def identity_link(spark, sf):
    return link_identities(*identity_inputs(spark, sf)).resolved


@query
def identity_new_links(spark, sf):
    return link_identities(*identity_inputs(spark, sf)).new_links


# Report


@query
def report(spark, sf):
    return report_long(table(spark, sf, "customer"), ["c_custkey"])
