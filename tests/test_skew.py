"""One key, text or user with a third of all rows: whole results, and little to shuffle."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabulyse.operators import conversations as conv
from tabulyse.operators import distribution as dist
from tabulyse.operators import json_rows, profile, quantiles, usage
from tabulyse.operators.identity import link_identities

ROWS = 30_000


@pytest.fixture(scope="module")
def hot(spark):
    """User 0 owns a third of the rows, all with one long text."""
    user = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 1000 + 1)
    text = F.when(F.col("id") % 3 == 0, F.lit("hot " * 50)).otherwise(F.concat(F.lit("cold " * 30), (F.col("id") % 5000).cast("string")))
    second = F.lit(1_700_000_000) + F.pmod(F.col("id") * 7919, F.lit(864_000))
    return spark.range(ROWS).select("id", user.alias("user_id"), text.alias("text"), F.timestamp_seconds(second).alias("ts")).repartition(8).cache()


@pytest.fixture(scope="module")
def local(hot):
    return hot.toPandas()


def test_frequent_values(hot, local):
    want = local["text"].value_counts()
    got = profile.top_values(hot, ["text"], 5).orderBy("rank").collect()
    assert got[0].value == "hot " * 50 and [r.n for r in got] == want.head(5).tolist()


def test_duplicates_and_distinct(hot, local):
    rows = hot.select("user_id", "text")
    assert profile.duplicate_rows(rows).first().duplicates == local[["user_id", "text"]].duplicated().sum()
    found = {r["column"]: r.distinct for r in profile.column_profile(rows).collect()}
    assert found == {"user_id": local.user_id.nunique(), "text": local["text"].nunique()}


def test_quantiles_with_a_hot_value(hot, local):
    got = [r.value for r in quantiles.quantiles(hot, ["user_id"], [0.1, 0.33, 0.34, 0.9]).collect()]
    assert got == pytest.approx([local.user_id.quantile(p) for p in (0.1, 0.33, 0.34, 0.9)])


def test_sessions_of_a_hot_user(hot, local):
    gaps = local.sort_values("ts").groupby("user_id").ts.diff() > pd.Timedelta(minutes=30)
    want = (gaps.groupby(local.user_id).sum() + 1).to_dict()
    found = usage.sessions(hot, "user_id")
    assert {r.user_id: r.n for r in found.groupBy("user_id").agg(F.count("*").alias("n")).collect()} == want
    assert found.agg(F.sum("n")).first()[0] == ROWS


def test_rankings_of_a_hot_owner(hot, local):
    got = usage.newest_per_owner(hot, "user_id", ["ts", "id"], 3).where("user_id = 0").orderBy("rank").collect()
    want = local[local.user_id == 0].sort_values(["ts", "id"], ascending=False).head(3)
    assert [r.id for r in got] == want.id.tolist()


def test_a_hot_conversation(hot):
    messages = hot.select(F.col("user_id").alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), "text")
    parts = conv.conversation_archive(messages, turns_per_row=500).where("conv_id = 0")
    assert parts.agg(F.sum("n"), F.max("n")).first() == (ROWS // 3, 500)
    assert conv.recent_history(messages, 4).where("conv_id = 0").count() == 4
    assert conv.full_message_rows(messages, "s", "i").where("conv_id = 0").count() == ROWS // 3 + 2


def test_a_hot_address(hot):
    signins = hot.select(F.col("id").alias("seq"), F.lit("mail").alias("provider"), F.col("user_id").cast("string").alias("provider_id"), F.lit("a@x.org").alias("email"))
    users = hot.sparkSession.createDataFrame([], "user_id string, email string")
    links = hot.sparkSession.createDataFrame([], "user_id string, provider string, provider_id string")
    out = link_identities(signins, users, links)
    assert out.new_users.count() == 1 and out.new_links.count() == 1
    assert out.resolved.count() == hot.select("user_id").distinct().count()


def test_daily_counts_and_histogram_keep_every_row(hot):
    assert dist.daily_counts(hot, ["ts"]).agg(F.sum("n")).first()[0] == ROWS
    assert dist.histogram(hot, ["user_id", "id"], 50).groupBy("column").agg(F.sum("n").alias("n")).where(f"n = {ROWS}").count() == 2


def test_one_reply_with_many_records(spark):
    raw = "[" + ",".join(f'{{"i": {i}}}' for i in range(20_000)) + ",]"
    df = spark.createDataFrame([(1, raw), (2, '[{"i": 1}]')], "id int, raw string")
    assert json_rows.extract_records(json_rows.parse_replies(df, "raw")).count() == 20_001
