"""Places of rows counted in two levels, and pages read by them."""

import random
import re

import pytest

from tabulyse.operators import page_index, preview
from tabulyse.operators.positions import numbered


def test_places_are_a_plain_count(spark):
    rng = random.Random(2)
    rows = [(rng.choice([1, 1, 1, 2, None]), rng.choice([None, *range(9)]), rng.choice("ab")) for _ in range(3000)]
    df = spark.createDataFrame(rows, "g int, x int, s string").repartition(7)
    got = {(r.g, r.x, r.s): (r.n, r.before) for r in numbered(df, ["g"], ["x", "s"]).collect()}
    first = lambda v: (v is not None, v or 0)
    want = {r: (rows.count(r), sum(o[0] == r[0] and (first(o[1]), o[2]) < (first(r[1]), r[2]) for o in rows)) for r in set(rows)}
    assert got == want
    assert numbered(df.limit(0), ["g"], ["x"]).count() == 0


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, 1, 2, 3]), rng.choice([float("nan"), 0.5, 7.25, None]), "t" * rng.randint(0, 3)) for _ in range(1200)]
    return spark.createDataFrame(rows, "a int, d double, s string").repartition(5)


@pytest.mark.parametrize("page", [1, 3, 24, 25])
def test_indexed_pages_are_the_plain_pages(spark, table, tmp_path_factory, page):
    path = str(tmp_path_factory.mktemp("pages") / "t")
    page_index.write_pages(table, ["d", "a"], path, chunk_rows=100)
    got = list(map(tuple, page_index.read_page(spark, path, page).collect()))
    assert got == list(map(tuple, preview.preview_page(table, ["d", "a"], page).collect())) and len(got) == (50 if page < 25 else 0)


def test_a_page_reads_its_chunk_and_place_only(spark, table, tmp_path):
    path = page_index.write_pages(table, ["a", "s"], str(tmp_path / "t"), chunk_rows=100)
    plan = page_index.read_page(spark, path, 7)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*__chunk#\d+ (IN|=) ", plan) and "GreaterThanOrEqual(__place,300)" in plan and "LessThanOrEqual(__place,349)" in plan
    index = spark.read.parquet(f"{path}/index")
    assert sorted((r.place, r.n) for r in index.collect()) == [(100 * i, 100) for i in range(12)] and "first_a" in index.columns


@pytest.mark.parametrize("order", [["a"], ["d", "s"], ["s", "a", "d"]])
@pytest.mark.parametrize("page, size", [(1, 7), (2, 50), (6, 200), (7, 200)])
def test_shallow_pages_take_ties_and_gaps(table, order, page, size):
    """The filter up to the page's last key changes nothing."""
    rows = table.withColumn("__row", preview.row_key(table))
    ordered = rows.orderBy(*[preview.m.value(rows, c).asc_nulls_last() for c in [*order, "__row"]]).offset((page - 1) * size).limit(size)
    want = [tuple(r) for r in ordered.select(*[preview.shown(table, c) for c in table.columns]).collect()]
    assert [tuple(r) for r in preview.preview_page(table, order, page, size).collect()] == want


@pytest.mark.parametrize("order", [["a", "d", "s"], ["a"]])
def test_marks_and_digests_are_not_written_with_the_rows(spark, table, tmp_path, monkeypatch, order):
    """The ranges hold the columns and, where rows can tie, the digest; all rows of a chunk are in one file."""
    seen, numbered_ = [], page_index.numbered
    monkeypatch.setattr(page_index, "numbered", lambda *a: seen.append(numbered_(*a)) or seen[-1])
    path = page_index.write_pages(table, order, str(tmp_path / "t"), chunk_rows=100)
    assert set(seen[0].columns) == {"a", "d", "s", "n", "before"} | ({"__row"} if len(order) == 1 else set())
    got = [tuple(r) for page in (1, 2, 12, 24) for r in page_index.read_page(spark, path, page).collect()]
    assert got == [tuple(r) for page in (1, 2, 12, 24) for r in preview.preview_page(table, order, page).collect()] and len(got) == 200
