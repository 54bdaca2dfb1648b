"""Edge cases of profiling, distribution and relations."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulyse.functions import missing as m
from tabulyse.operators import distribution as dist
from tabulyse.operators import profile, relations
from tabulyse.operators.value_counts import approx_distinct_and_missing, distinct_and_missing
from tabulyse.plans.report import ReportLimits, profile_report, report_long

NAN, INF = float("nan"), float("inf")


def rows(df, key="column"):
    return {r[key]: r for r in df.collect()}


@pytest.fixture(scope="module")
def mixed(spark):
    return spark.sql(
        """select * from values
        (1, cast('NaN' as double), true, 'x', array(1)), (1, null, true, 'x', array(1)), (2, 1.5D, null, null, null), (null, 1.5D, false, 'y', array(2))
        t(i, d, flag, s, a)"""
    )


def test_roles(mixed):
    roles = m.column_roles(mixed)
    assert roles == {"i": "numeric", "d": "numeric", "flag": "boolean", "s": "categorical", "a": "nested"}


def test_text_dates_are_sniffed(spark):
    df = spark.createDataFrame([("2024-01-05", "x", None), (None, "2024-01-05", None), ("1/6/2024", "y", None)], "d string, s string, e string")
    assert m.column_roles(df, sniff_text=True) == {"d": "datetime", "s": "categorical", "e": "categorical"}
    assert profile.column_profile(df, sniff_text=True).where("role = 'datetime'").first()["column"] == "d"


def test_null_and_nan_are_missing(mixed):
    found = rows(profile.column_profile(mixed))
    assert {c: (r.missing, r.distinct) for c, r in found.items()} == {"i": (1, 2), "d": (2, 1), "flag": (1, 2), "s": (1, 2), "a": (1, 2)}
    assert found["d"].missing_pct == 50.0
    summary = profile.dataset_summary(mixed).first()
    assert (summary.rows, summary.missing_values, summary.missing_pct) == (4, 6, 30.0)
    # NaN and NULL are one value, so the first two rows are copies.
    assert summary.duplicates == 1


def test_approximate_profile_is_close(mixed):
    assert rows(approx_distinct_and_missing(mixed, mixed.columns)).keys() == rows(distinct_and_missing(mixed, mixed.columns)).keys()


def test_duplicates_in_narrow_tables(spark):
    df = spark.sql("select * from values (1, null), (1, null), (1, 0.0D), (1, -0.0D), (2, 1.0D) t(a, b)")
    assert profile.duplicate_rows(df).first().duplicates == 2
    wide = df.select("*", *[F.lit(f"t{i}").alias(f"c{i}") for i in range(20)])
    assert profile.duplicate_rows(wide).first().duplicates == 2
    assert profile.duplicate_rows(df.withColumn("s", F.array(F.col("b")))).first().duplicates >= 1


def test_empty_table(spark):
    df = spark.createDataFrame([], "a double, s string, t timestamp")
    assert profile.dataset_summary(df).first().asDict() | {"size_label": None} == {
        "rows": 0, "columns": 3, "numeric_columns": 1, "categorical_columns": 1, "missing_values": 0, "missing_pct": 0.0,
        "duplicates": 0, "data_bytes": 0, "size_label": None,
    }
    assert {c: r.distinct for c, r in rows(profile.column_profile(df)).items()} == {"a": 0, "s": 0, "t": 0}
    stats = profile.numeric_stats(df).first()
    assert (stats.n, stats["mean"], stats.status) == (0, None, "empty")
    assert profile.numeric_stats(df, zero_fill=True).first()["median"] == 0.0
    assert profile.datetime_stats(df).count() == 0
    bins = dist.histogram(df, ["a"]).collect()
    assert [b.n for b in bins] == [0] * 20 and (bins[0].lo, bins[-1].hi) == (0.0, 1.0)
    box = dist.box_plot(df, ["a"]).first()
    assert (box.status, box.q1, box.outlier_count) == ("empty", None, 0)
    assert dist.daily_counts(df).count() == 0


def test_one_row_and_constant(spark):
    one = profile.numeric_stats(spark.sql("select 5.0D a")).first()
    assert (one.std, one.skew, one.status, one["median"]) == (None, None, "few_rows", 5.0)
    constant = profile.numeric_stats(spark.sql("select 0.1D a from range(7)")).first()
    assert constant.skew == 0.0
    flat = dist.histogram(spark.sql("select 3 a from range(4)"), ["a"], bins=2).collect()
    assert [(b.lo, b.hi, b.n) for b in sorted(flat, key=lambda b: b.bin)] == [(2.5, 3.0, 0), (3.0, 3.5, 4)]


def test_statistics_match_pandas(spark):
    x = np.random.default_rng(3).lognormal(1, 2, 500)
    got = profile.numeric_stats(spark.createDataFrame(pd.DataFrame({"x": x}))).first()
    s = pd.Series(x)
    want = {"mean": s.mean(), "median": s.median(), "std": s.std(), "q25": s.quantile(0.25), "q75": s.quantile(0.75), "skew": s.skew()}
    assert {k: got[k] for k in want} == pytest.approx(want, abs=1e-3)


def test_histogram_matches_numpy(spark):
    x = np.concatenate([np.arange(0, 101) / 10, np.random.default_rng(4).random(500) * 10])
    df = spark.createDataFrame(pd.DataFrame({"x": np.append(x, [NAN, INF, -INF])}))
    for bins in (7, 20, 100):
        got = sorted(dist.histogram(df, ["x"], bins, label=True).collect(), key=lambda b: b.bin)
        counts, edges = np.histogram(x, bins)
        assert [b.n for b in got] == counts.tolist()
        assert [b.lo for b in got] + [got[-1].hi] == edges.tolist()
    with pytest.raises(ValueError):
        dist.histogram(df, ["x"], 0)


def test_ties_go_by_value(spark):
    df = spark.createDataFrame([(v,) for v in "b a c c d d".split()], "s string")
    assert [(r["rank"], r.value, r.n) for r in dist.category_distribution(df, "s", 3).orderBy("rank").collect()] == [(1, "c", 2), (2, "d", 2), (3, "a", 1)]


def test_top_values_of_every_type(spark):
    long = "x" * 100
    df = spark.sql(f"select * from values (true, date'2024-01-05', 1.5D, '{long}', 7), (true, date'2024-01-05', 1.5D, '{long}', 7) t(f, d, r, s, i)")
    assert {c: (r.value, r.n) for c, r in rows(profile.top_values(df, df.columns)).items()} == {
        "f": ("true", 2), "d": ("2024-01-05", 2), "r": ("1.5", 2), "s": (long, 2), "i": ("7", 2),
    }


def test_distribution_by_role(spark):
    df = spark.sql("select id, cast(id % 2 as string) s from range(10)")
    assert dist.distribution(df, "id").count() == 20
    assert dist.distribution(df, "s").count() == 2
    with pytest.raises(ValueError):
        dist.distribution(df, "nope")


def test_whiskers_lie_inside_the_fences(spark):
    df = spark.createDataFrame([(float(v),) for v in [*range(1, 12), 100, -50]], "x double")
    box = dist.box_plot(df, ["x"]).first()
    assert (box.lower_whisker, box.upper_whisker, box.outlier_count) == (1.0, 11.0, 2)
    found = dist.outlier_rows(df.withColumn("k", F.col("x").cast("int")), ["x"], ["k"], limit=1).collect()
    assert [(r.k, r.x) for r in found] == [(100, 100.0)]
    with pytest.raises(ValueError):
        dist.box_plot(spark.sql("select 'a' s"), ["s"])


def test_daily_counts_need_two_dates(spark):
    df = spark.sql("select * from values (date'2024-01-01', null), (date'2024-01-01', date'2024-01-02') t(a, b)")
    assert [(r["column"], r.n) for r in dist.daily_counts(df).collect()] == [("a", 2)]


def test_elapsed_days_are_whole(spark):
    df = spark.sql("select * from values (timestamp'2024-01-01 23:00:00'), (timestamp'2024-01-03 01:00:00') t(a)")
    assert profile.datetime_stats(df).first().range_days == 1


def test_correlation_matches_pandas_with_gaps(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(1e6, 1, 300)
    pdf = pd.DataFrame({"x": x, "y": x * 2 + rng.normal(0, 1, 300), "z": rng.normal(0, 1, 300), "flat": 0.1, "z2": 3.0})
    pdf.loc[pdf.index % 3 == 0, "z"] = np.nan
    pdf.loc[pdf.index % 4 == 0, "y"] = np.nan
    pdf.loc[pdf.index % 3 == 0, "z2"] = rng.normal(0, 1, 100)  # constant where z is present
    got = relations.correlation_matrix(spark.createDataFrame(pdf)).collect()
    want = pdf.corr().round(3).fillna(0)
    for r in got:
        expected = 0.0 if {r.column_a, r.column_b} & {"flat"} or {r.column_a, r.column_b} == {"z", "z2"} else want.loc[r.column_a, r.column_b]
        assert r.r == pytest.approx(expected, abs=1.1e-3), (r.column_a, r.column_b)
        assert abs(r.r) <= 1
    assert len(got) == 25
    top = relations.top_correlations(spark.createDataFrame(pdf), n=1).first()
    assert (top.column_a, top.column_b) == ("x", "y")


def test_correlation_needs_two_columns(spark):
    assert relations.correlation_matrix(spark.sql("select 1 a, 'x' s")).count() == 0
    assert relations.top_correlations(spark.sql("select 's' s")).count() == 0


def test_widest_columns_come_first(spark):
    df = spark.range(50).select(*[(F.col("id") * (i + 1)).alias(f"c{i:02d}") for i in range(17)])
    matrix = relations.correlation_matrix(df).collect()
    order = [c for _, c in sorted({(r["row"], r.column_a) for r in matrix})]
    assert order == [f"c{i:02d}" for i in range(16, 1, -1)]


def test_what_if_status(spark):
    few = relations.what_if(spark.range(7).selectExpr("id x", "id y"), "y", "x", 10).first()
    assert (few.status, few.slope) == ("few_rows", None)
    flat = relations.what_if(spark.range(9).selectExpr("4 x", "id y"), "y", "x", 10).first()
    assert flat.status == "flat_driver"
    line = relations.what_if(spark.range(9).selectExpr("id x", "3 * id + 1 y"), "y", "x", [-50.0, 100.0]).orderBy("change_pct").collect()
    assert [(r.slope, r.intercept, r.baseline_target, r.simulated_target, r.direction) for r in line] == [
        (3.0, 1.0, 13.0, 7.0, "decrease"),
        (3.0, 1.0, 13.0, 25.0, "increase"),
    ]
    assert line[0].target_delta_pct == pytest.approx(-46.154)


def test_scatter_does_not_depend_on_partitions(spark):
    df = spark.range(2000).selectExpr("id", "id * 2 x", "if(id % 10 = 0, null, id) y")
    sample = relations.scatter_sample(df, "x", "y", ["id"], 50)
    again = relations.scatter_sample(df.repartition(7), "x", "y", ["id"], 50)
    assert sorted(sample.collect()) == sorted(again.collect()) and sample.count() == 50
    assert relations.scatter_sample(df.limit(5), "x", "y", ["id"]).where("y is null").count() == 0


def test_scatters_of_several_pairs_are_the_single_ones(spark):
    df = spark.range(2000).selectExpr("id", "id * 2 x", "if(id % 10 = 0, null, id) y", "double(id % 7) z")
    pairs = [("x", "y"), ("y", "z"), ("x", "z")]
    got = relations.scatter_samples(df, pairs, ["id"], 50)
    for a, b in pairs:
        one = got.where((F.col("column_a") == a) & (F.col("column_b") == b)).select("id", "x", "y")
        assert sorted(one.collect()) == sorted(relations.scatter_sample(df, a, b, ["id"], 50).collect())


def test_report_sections(spark, sf):
    full = profile_report(spark.read.parquet(f"{sf}/customer.parquet"), ["c_custkey"])
    assert set(full) == {
        "summary", "columns", "numeric_stats", "histograms", "bar_charts", "pie_chart", "correlation", "top_correlations", "scatters",
        "box_plots", "outliers", "categoricals",
    }
    assert full["histograms"].count() == 3 * 25
    assert {r["column"] for r in full["pie_chart"].collect()} == {"c_mktsegment"}
    words = report_long(spark.sql("select 'a' s from range(3)"), ["s"])
    assert {r.section for r in words.collect()} == {"summary", "columns", "bar_charts", "pie_chart", "categoricals"}


def test_report_shows_every_column_when_asked(spark, sf):
    lineitem = spark.read.parquet(f"{sf}/lineitem.parquet")
    numerics = [f.name for f in lineitem.schema.fields if isinstance(f.dataType, T.NumericType)]
    full = profile_report(lineitem, ["l_orderkey", "l_linenumber"], ReportLimits.whole())
    assert {r["column"] for r in full["histograms"].collect()} == set(numerics) == {r["column"] for r in full["box_plots"].collect()}
    assert full["top_correlations"].count() == len(numerics) * (len(numerics) - 1) // 2
    texts = [f.name for f in lineitem.schema.fields if isinstance(f.dataType, T.StringType)]
    assert {r["column"] for r in full["bar_charts"].collect()} == set(texts)


def test_unknown_columns_are_refused(spark):
    with pytest.raises(ValueError):
        profile.numeric_stats(spark.range(3), ["nope"])
    with pytest.raises(ValueError):
        relations.what_if(spark.range(9), "id", "nope", 1)
