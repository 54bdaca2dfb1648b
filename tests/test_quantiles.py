"""The exact quantile search against numpy."""

import numpy as np
import pandas as pd
import pytest

from tabulyse.operators import preview, quantiles

PROBS = [0, 0.01, 0.1, 0.25, 1 / 3, 0.5, 0.75, 0.9, 0.99, 1]


@pytest.fixture
def small_passes(monkeypatch):
    """Make a few thousand values need every pass."""
    monkeypatch.setattr(quantiles, "VALUES_PER_PASS", 8)
    monkeypatch.setattr(quantiles, "CELLS_PER_PASS", 32)
    monkeypatch.setattr(quantiles, "CELLS_PER_E", 2)


def check(spark, values):
    df = spark.createDataFrame(pd.DataFrame({"a.b": values, "other": np.arange(len(values)) * 1.0}))
    got = {(r["column"], r.p): r.value for r in quantiles.quantiles(df, ["a.b", "other"], PROBS).collect()}
    for p in PROBS:
        want = np.nanquantile(values, p)
        assert got["a.b", p] == pytest.approx(want, rel=1e-9, abs=1e-12)
        assert got["other", p] == pytest.approx(p * (len(values) - 1))


def test_spread_over_magnitudes(spark, small_passes):
    rng = np.random.default_rng(1)
    check(spark, np.concatenate([rng.normal(0, 1, 2000), rng.lognormal(0, 40, 1500), -rng.lognormal(0, 9, 500), np.zeros(50), [np.nan] * 7]))


def test_a_hot_value_and_close_neighbours(spark, small_passes):
    rng = np.random.default_rng(2)
    check(spark, np.concatenate([np.full(3000, 7.25), 1000 + rng.random(3000) * 1e-10, rng.integers(0, 50, 1000) / 100]))


def test_infinite_values(spark):
    df = spark.createDataFrame([(v,) for v in (float("-inf"), 1.0, 2.0, 3.0, float("inf"))], "x double")
    assert [r.value for r in quantiles.quantiles(df, ["x"], [0, 0.25, 0.5, 1]).collect()] == [float("-inf"), 1.0, 2.0, float("inf")]


def test_empty_and_single(spark):
    df = spark.createDataFrame([(None, 4), (float("nan"), None)], "x double, y int")
    rows = {r["column"]: (r.n, r.q1, r.median, r.q3) for r in quantiles.quartiles(df, ["x", "y"]).collect()}
    assert rows == {"x": (0, None, None, None), "y": (1, 4.0, 4.0, 4.0)}


def test_approximate_ranks_are_within_bounds(spark):
    df = spark.range(10_001)
    for r in quantiles.approx_quantiles(df, ["id"], [0.1, 0.5, 0.9], accuracy=100).collect():
        assert abs(r.value - r.p * 10_000) <= 10_001 / 100 + 1
    assert abs(quantiles.quartiles(df, ["id"], accuracy=1000).first().median - 5000) <= 11


def test_many_columns_skip_the_scan_filter(spark, monkeypatch, small_passes):
    monkeypatch.setattr(quantiles, "_CELLS_PUSHED", 1)
    check(spark, np.random.default_rng(6).normal(5, 1, 500))


def test_bad_probability(spark):
    with pytest.raises(ValueError):
        quantiles.quantiles(spark.range(3), ["id"], [1.5])


@pytest.mark.parametrize("page", [1, 2, 7, 13, 20, 21, 40])
def test_seek_pages_match_plain_pages(spark, page):
    """Many ties in the first column, missing values, and a date column in the order."""
    df = spark.sql(
        "select if(id % 9 = 0, null, id % 3) as hot, date_add(date'2024-01-01', cast(id % 5 as int)) as day, id * 7 % 1000 as k from range(1000)"
    )
    plain = preview.preview_page(df, ["hot", "day", "k"], page, 50, shallow_rows=10**9).collect()
    assert preview.preview_page(df, ["hot", "day", "k"], page, 50, shallow_rows=0).collect() == plain
    assert len(plain) == (50 if page <= 20 else 0)


@pytest.mark.parametrize("page", [1, 5, 9, 14, 16, 17])
def test_seek_by_text(spark, page):
    """Long shared prefixes, texts that extend each other, accents, and missing texts."""
    df = spark.sql(
        """select case when id % 10 = 0 then null when id % 4 = 0 then repeat('same prefix ', 3)
                  when id % 4 = 1 then concat('same prefix same é', id % 7) else substring('same prefix', 1, cast(id % 12 as int)) end as s,
                  id % 2 = 0 as b, id as k from range(800)"""
    )
    order = ["s", "b", "k"]
    plain = preview.preview_page(df, order, page, 50, shallow_rows=10**9).collect()
    assert preview.preview_page(df, order, page, 50, shallow_rows=0).collect() == plain
    assert len(plain) == (50 if page <= 16 else 0)


def test_seek_by_decimal_and_huge_numbers(spark):
    df = spark.sql("select cast(id % 40 as decimal(20, 4)) / 7 as d, 9007199254740992 + id % 50 as h, id from range(400)")
    for order in (["d", "id"], ["h", "id"]):
        for page in (2, 4, 8):
            plain = preview.preview_page(df, order, page, 50, shallow_rows=10**9).collect()
            assert preview.preview_page(df, order, page, 50, shallow_rows=0).collect() == plain
    with pytest.raises(ValueError):
        preview.preview_page(spark.sql("select array(id) a from range(9)"), ["a"], 2, 4, shallow_rows=0)


@pytest.mark.parametrize("order", [["two"], ["bytes"], ["d"], ["h"], ["x", "two"], []])
def test_seek_with_many_ties(spark, order):
    """Coarse keys, binary, long decimals, large whole numbers, NaN beside NULL, and rows with many copies."""
    df = spark.sql(
        """select id % 2 as two, cast(concat('k', id % 3) as binary) as bytes, 9007199254740992 + id % 5 as h,
                  cast(id % 5 - 2 as decimal(38, 20)) / 100000000000000000000 + cast(id % 2 as decimal(38, 20)) - 1 as d,
                  case when id % 3 = 0 then double('nan') when id % 3 = 1 then null else 1.5 end as x,
                  if(id < 300, 0, id % 100) as k from range(600)"""
    ).select("two", "bytes", "h", "d", "x", "k")
    df = df.unionByName(spark.sql("select 0L two, binary('k0') bytes, 9007199254740992 h, cast(0 as decimal(38, 20)) d, 1.5D x, 0L k from range(400)").select(*df.columns))
    for page in (9, 20, 21):
        plain = preview.preview_page(df, order, page, 50, shallow_rows=10**9).collect()
        assert preview.preview_page(df, order, page, 50, shallow_rows=10).collect() == plain
        assert len(plain) == (50 if page <= 20 else 0)


def test_page_bounds(spark):
    with pytest.raises(ValueError):
        preview.preview_page(spark.range(3), ["id"], page=0)
    with pytest.raises(ValueError):
        preview.preview_page(spark.range(3), ["id"], page_size=201)
    assert preview.preview_pages(spark.range(0)).first().total_pages == 1
