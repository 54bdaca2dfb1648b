"""Correlation of many columns, frequent values by candidates, duplicates by sketches."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabulyse.operators import cross_products, relations
from tabulyse.operators.value_counts import candidate_counts, duplicate_rows, frequent_values, row_sketches, sketched_duplicates, top_values


@pytest.fixture(scope="module")
def wide(spark):
    rng = np.random.default_rng(7)
    base = rng.normal(1e6, 3.0, (3000, 1))
    pdf = pd.DataFrame(np.round(base * rng.normal(0, 1, 40) + rng.normal(0, 5, (3000, 40)), 6), columns=[f"c{i}" for i in range(40)])
    for c in ("c3", "c17", "c18"):
        pdf.loc[rng.random(3000) < 0.4, c] = np.nan
    pdf["c20"], pdf["c21"] = 7.5, np.nan
    pdf.loc[5, "c22"] = np.inf
    return pdf, spark.createDataFrame(pdf).repartition(5)


def test_moments_match_pandas(wide):
    pdf, df = wide
    found = {r.i: r for r in cross_products.moments(df, list(pdf)).collect()}
    for i, c in enumerate(pdf):
        x = pdf[c].dropna()
        assert (found[i].total, found[i].n) == (3000, len(x))
        if c == "c22":
            continue
        assert found[i]["mean"] == (pytest.approx(x.mean()) if len(x) else None)
        assert found[i].variance == (pytest.approx(x.var(), abs=1e-9) if len(x) > 1 else None)
        assert (found[i].low, found[i].high) == ((x.min(), x.max()) if len(x) else (np.inf, -np.inf))


@pytest.mark.parametrize("block", [256, 16, 7])
def test_wide_correlation_matches_pandas(wide, monkeypatch, block):
    pdf, df = wide
    monkeypatch.setattr(cross_products.pair_sums, "__defaults__", (block,))
    got = {(r.column_a, r.column_b): r.r for r in relations.correlation_matrix(df, keep=60).collect()}
    with np.errstate(invalid="ignore"):
        want = pdf.replace(np.inf, np.nan).corr().fillna(0.0)
    assert len(got) == 40 * 40
    for (a, b), r in got.items():
        if "c22" in (a, b):
            assert r == (1.0 if a == b else 0.0)
        elif a != b:
            assert abs(r - want.loc[a, b]) < 0.0015, (a, b)


def test_narrow_and_wide_agree(wide, monkeypatch):
    pdf, df = wide
    some = [c for c in pdf if c != "c22"][:20]
    narrow = sorted(map(tuple, relations.correlation_matrix(df, some, keep=20).collect()))
    monkeypatch.setattr(relations, "WIDE", 3)
    assert sorted(map(tuple, relations.correlation_matrix(df, some, keep=20).collect())) == narrow
    assert [tuple(r)[:2] for r in relations.top_correlations(df, some, n=3).collect()]
    assert relations.correlation_matrix(df.limit(0), some, keep=20).where("r != 0").count() == 0


@pytest.fixture(scope="module")
def skewed(spark):
    """Many values that occur once or twice, a few frequent ones, and a hot one."""
    n = F.col("id")
    value = F.when(n % 3 == 0, 5).when(n % 50 < 4, 100 + n % 50).when(n % 1000 == 7, 1 + n % 2).otherwise(1_000_000 + n % 70_001)
    long_text = F.concat(F.lit("x" * 80), value.cast("string"))
    return spark.range(0, 120_000, 1, 6).select(
        value.alias("v"), value.cast("double").alias("d"), value.cast("string").alias("s"), long_text.alias("t"), F.timestamp_seconds(value).alias("at"),
        (n % 2 == 0).alias("flag"), F.when(n < 0, n).alias("nothing"), n.alias("key"),
    )


@pytest.mark.parametrize("tracked, buckets", [(10_000, 1 << 14), (200, 64), (80, 1)])
def test_frequent_values_are_the_top_values(skewed, tracked, buckets):
    columns = ["v", "d", "s", "t", "at", "flag", "nothing", "key"]
    want = sorted(map(tuple, top_values(skewed, columns, 6).collect()))
    assert sorted(map(tuple, frequent_values(skewed, columns, 6, tracked, buckets).collect())) == want


def test_candidates_do_not_grow_with_the_values(skewed):
    long = skewed.select(F.lit("v").alias("column"), F.col("v").alias("key"))
    counted = candidate_counts(long, 1, 6, 500, 256)
    assert counted.count() <= 256 + 8 * 6 and counted.agg(F.sum("n")).first()[0] == 120_000
    least = sorted((r.n for r in counted.where("key is not null").collect()), reverse=True)[4]
    assert counted.where("key is null").agg(F.max("n")).first()[0] < least  # nothing is left to count


def test_duplicates_by_sketches(skewed):
    rows = skewed.drop("key", "flag")
    exact, near = duplicate_rows(rows).first(), duplicate_rows(rows, approx=True).first()
    assert near.rows == exact.rows and abs(near.duplicates - exact.duplicates) <= near.margin < 5000
    kept = row_sketches(skewed.drop("key"), ["flag"])
    assert kept.count() == 2
    merged, exact = sketched_duplicates(kept.unionByName(kept)).first(), duplicate_rows(skewed.drop("key")).first()
    assert merged.rows == 2 * exact.rows and abs(merged.duplicates - exact.rows - exact.duplicates) <= merged.margin
    nulls = rows.sparkSession.sql("select * from values (1, null), (null, 1), (null, null), (null, null), (1, 0), (10, null) t(a, b)")
    assert tuple(duplicate_rows(nulls, approx=True).first())[:2] == (6, 1)
    assert tuple(duplicate_rows(rows.limit(0), approx=True).first()) == (0, 0, 0)


def test_estimated_duplicates_shuffle_no_rows(skewed):
    text = duplicate_rows(skewed, approx=True)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in text and "partial_hll_sketch_agg" in text


def test_only_digests_are_sent_for_long_texts(skewed):
    text = top_values(skewed, ["t"], 5)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in text and text.count("SortMergeJoin") <= 1


def test_strongest_of_many_columns_take_one_pass(wide, monkeypatch):
    """Every task takes its own centres, far apart here, and their sums are put together."""
    pdf, df = wide
    pdf = pdf.drop(columns="c22").assign(c23=np.arange(3000) * 1e6 + pdf["c0"], c24=np.arange(3000) // 600 * 1e7, c25=0.1)
    df = df.sparkSession.createDataFrame(pdf).repartitionByRange(5, "c23")
    seen = []
    monkeypatch.setattr(relations.cross_products, "moments", lambda *a: seen.append(a))
    got = {(r.column_a, r.column_b): r.r for r in relations.top_correlations(df, n=1000).collect()}
    want = pdf.corr().fillna(0.0)
    assert not seen and len(got) == 39 * 38 // 2
    assert max(abs(r - want.loc[a, b]) for (a, b), r in got.items()) < 0.0015
    assert relations.top_correlations(df.limit(0), n=5).count() == 0
