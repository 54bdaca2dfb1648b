"""What the plans must and must not contain."""

import pytest

from checks.queries import QUERIES, ORDER_SPECS, messy_orders, table
from tabulyse.operators import conversations as conv
from tabulyse.operators import normalize_table, preview, profile, quantiles, relations, usage
from tabulyse.operators.value_counts import distinct_and_missing, duplicate_rows, top_values


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


#: Broken replies are mended, and many columns multiplied, in Arrow batches.
NEEDS_PYTHON = {"json_repair", "extract_records", "skipped_members", "reply_to_rows", "top_correlations_wide"}


def test_report_reads_the_table_a_few_times(spark, sf):
    text = plan(QUERIES["report"](spark, sf))
    assert text.count("customer.parquet") <= 8


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_and_no_cross_join(spark, sf, name):
    text = plan(QUERIES[name](spark, sf))
    assert ("ArrowEvalPython" in text or "MapInArrow" in text) == (name in NEEDS_PYTHON)
    assert "BatchEvalPython" not in text and "CartesianProduct" not in text and "NestedLoopJoin" not in text and "Scan ExistingRDD" not in text


@pytest.mark.parametrize(
    "build",
    [
        lambda s, d: usage.newest_per_owner(table(s, d, "orders"), "o_custkey", ["o_orderdate"], 3),
        lambda s, d: conv.recent_history(table(s, d, "conversations")),
        lambda s, d: top_values(table(s, d, "part"), ["p_brand", "p_name"], 5),
    ],
)
def test_ranking_is_cut_before_the_shuffle(spark, sf, build):
    assert plan(build(spark, sf)).count("WindowGroupLimit") >= 2


def test_top_n_instead_of_sorting(spark, sf):
    orders = table(spark, sf, "orders")
    for df in (preview.preview_page(orders, ["o_orderkey"], 2), relations.scatter_sample(orders, "o_totalprice", "o_custkey", ["o_orderkey"])):
        assert "TakeOrderedAndProject" in plan(df)


def test_only_needed_columns_are_read(spark, sf):
    text = plan(relations.what_if(table(spark, sf, "lineitem"), "l_extendedprice", "l_quantity", 10))
    assert "ReadSchema: struct<l_quantity:double,l_extendedprice:double>" in text
    assert text.count("FileScan") == 1


def test_quantile_passes_push_their_range_down(spark, sf):
    page = preview.preview_page(table(spark, sf, "lineitem"), ["l_orderkey"], 3, shallow_rows=10)
    assert "GreaterThan(l_orderkey" in plan(page)
    cell = quantiles._within(table(spark, sf, "lineitem"), "l_extendedprice", 10.0, 20.0)
    inside = plan(table(spark, sf, "lineitem").select("l_extendedprice").where(cell))
    assert "GreaterThanOrEqual(l_extendedprice,10.0)" in inside


def test_long_text_is_shuffled_as_digest(spark, sf):
    for df in (distinct_and_missing(table(spark, sf, "documents"), ["text"]), duplicate_rows(table(spark, sf, "documents"))):
        text = plan(df)
        assert "sha2" in text and "partial_count" in text


def test_one_scan_for_all_moments(spark, sf):
    text = plan(profile.numeric_stats(table(spark, sf, "lineitem")))
    assert text.count("FileScan") == 1


def test_cleaning_is_one_projection(spark, sf):
    text = plan(normalize_table.normalize(messy_orders(spark, sf), ORDER_SPECS))
    assert "Exchange" not in text and text.count("FileScan") == 1
