"""Metering, sessions, identities, conversations, and the same on streams."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tabulyse.functions.semantic_types import ColumnSpec
from tabulyse.operators import conversations as conv
from tabulyse.operators import usage
from tabulyse.operators.identity import link_identities
from tabulyse.operators.normalize_table import normalize
from tabulyse.streaming import jobs


def at(seconds):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seconds)


def test_session_boundary(spark):
    """Gaps of 29:59 and 30:00 stay in a session, 30:01 starts one."""
    times = [0, 1799, 3599, 5400]
    events = spark.createDataFrame([(1, at(t)) for t in times] + [(2, at(10))], "user_id int, ts timestamp")
    found = usage.sessions(events, "user_id", as_of="2024-01-01 02:00:00").orderBy("user_id", "start").collect()
    assert [(r.user_id, r.session, r.start, r.end, r.n, r.state) for r in found] == [
        (1, 1, at(0), at(3599), 3, "expired"),
        (1, 2, at(5400), at(5400), 1, "active"),
        (2, 1, at(10), at(10), 1, "expired"),
    ]


def test_minute_limits(spark):
    events = spark.createDataFrame([("a", at(t)) for t in (0, 59, 59, 60)] + [("b", at(1))], "key string, ts timestamp")
    found = {(r.key, r.window_start): (r.used, r.limit, r.over, r.rejected) for r in usage.usage_minute(events, "key", {"a": 2}, other=5).collect()}
    assert found == {("a", at(0)): (3, 2, True, 1), ("a", at(60)): (1, 2, False, 0), ("b", at(0)): (1, 5, False, 0)}


def first_hits(times, length):
    opened = []
    for t in sorted(times):
        if not opened or t >= opened[-1][0] + length:
            opened.append([t, 0])
        opened[-1][1] += 1
    return [tuple(x) for x in opened]


def test_windows_opened_by_the_first_hit(spark):
    rng = random.Random(4)
    times = {k: [rng.randint(0, 5000) / 8 for _ in range(n)] for k, n in (("a", 400), ("b", 30), (None, 50), ("c", 1))}
    times["d"] = [60.0 * i for i in range(70)]
    events = spark.createDataFrame([(k, at(t)) for k, ts in times.items() for t in ts] + [("e", None)], "key string, ts timestamp").repartition(5)
    got = usage.usage_first_hit(events, "key", {"a": 2}, other=5).collect()
    assert sorted(((str(r.key), r.window_start, r.used) for r in got)) == sorted((str(k), at(t), n) for k, ts in times.items() for t, n in first_hits(ts, 60))
    assert {(r.key, r.over, r.rejected) for r in got if r.key == "a"} == {("a", n > 2, max(n - 2, 0)) for _, n in first_hits(times["a"], 60)}
    assert usage.usage_first_hit(events.limit(0), "key").count() == 0


def test_daily_limits_know_the_kinds(spark):
    events = spark.createDataFrame([(1, " Report ", at(0)), (1, "other", at(86_400))], "user_id int, kind string, ts timestamp")
    assert {r.day.day: r.limit for r in usage.usage_daily(events, "user_id", "kind").collect()} == {1: 20, 2: 120}


def test_newest_of_one_owner(spark):
    df = spark.range(20).selectExpr("id", "id % 2 as owner")
    assert [r.id for r in usage.newest_of_owner(df, "owner", 1, ["id"], 3).collect()] == [19, 17, 15]


def test_identities_meet_by_address(spark):
    signins = spark.createDataFrame(
        [
            (1, "google", "g1", " Ann@X.org "),
            (2, "github", "h1", "ann@x.org"),
            (3, "google", "g1", "ann@x.org"),
            (4, "google", "g2", "ANN@x.org"),
            (5, "github", "h9", "bob@x.org"),
            (6, "mail", "m1", "old@x.org"),
            (7, "mail", "m2", None),
        ],
        "seq long, provider string, provider_id string, email string",
    )
    users = spark.createDataFrame([("u1", "old@x.org"), ("u2", "moved@x.org")], "user_id string, email string")
    links = spark.createDataFrame([("u2", "github", "h9")], "user_id string, provider string, provider_id string")
    out = link_identities(signins, users, links)
    resolved = {(r.provider, r.provider_id): (r.user_id, r.is_new) for r in out.resolved.collect()}
    ann = resolved["google", "g1"][0]
    assert resolved == {
        ("google", "g1"): (ann, True), ("github", "h1"): (ann, True), ("google", "g2"): (ann, True),
        ("github", "h9"): ("u2", False), ("mail", "m1"): ("u1", False), ("mail", "m2"): (None, False),
    }
    assert [tuple(r) for r in out.new_users.collect()] == [(ann, "ann@x.org")]
    assert {tuple(r) for r in out.new_links.collect()} == {(ann, "google", "g1"), (ann, "github", "h1"), ("u1", "mail", "m1")}
    # A second run over what the first one left changes nothing.
    again = link_identities(signins, users.union(out.new_users), links.union(out.new_links))
    assert again.new_users.count() == 0 and again.new_links.count() == 0


@pytest.fixture(scope="module")
def messages(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"m{t}" if t else "  hello " + "x" * 60) for t in range(30)]
    rows += [(2, 0, "user", " \n\t "), (2, 1, "assistant", "|a|b|")]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_history_and_titles(messages):
    recent = conv.recent_history(messages).where("conv_id = 1")
    assert sorted(r.turn for r in recent.collect()) == list(range(18, 30))
    titles = {r.conv_id: r.title for r in conv.conversation_title(messages).collect()}
    assert titles == {1: "hello " + "x" * 42, 2: "New Chat"}


def test_archive_continues_long_conversations(messages):
    parts = conv.conversation_archive(messages, turns_per_row=8).where("conv_id = 1").orderBy("part").collect()
    assert [(p.part, p.n) for p in parts] == [(0, 8), (1, 8), (2, 8), (3, 6)]
    assert [x.turn for p in parts for x in p.messages] == list(range(30))
    whole = conv.conversation_archive(messages).where("conv_id = 2").first()
    assert [x.show_download for x in whole.messages] == [False, True]


def test_archive_goes_by_position(spark):
    same = [(1, 5, "user", "again")] * 1500 + [(2, t * 1_000_000, "user", f"m{t}") for t in range(5)] + [(None, 1, "user", "x")] * 3
    df = spark.createDataFrame(same, "conv_id long, turn long, role string, text string").repartition(6)
    parts = {(r.conv_id, r.part): r for r in conv.conversation_archive(df).collect()}
    assert {k: (r.n, len(r.messages)) for k, r in parts.items()} == {(1, 0): (1000, 1000), (1, 1): (500, 500), (2, 0): (5, 5), (None, 0): (3, 3)}
    parts = {(r.conv_id, r.part): [x.text for x in r.messages] for r in conv.conversation_archive(df, turns_per_row=2).collect()}
    assert len(parts) == 750 + 3 + 2 and parts[2, 1] == ["m2", "m3"] and parts[2, 2] == ["m4"] and parts[None, 1] == ["x"]


def test_messages_of_one_turn_come_by_role_and_text(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "assistant", "z"), (1, 1, "user", "q")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    assert conv.conversation_title(df).first().title == "z"
    assert sorted(r.text for r in conv.recent_history(df, 2).collect()) == ["b", "q"]


def test_message_lists(messages):
    said = conv.message_lists(messages, "sys", "now", k=2).where("conv_id = 1").first().prompt
    assert [(x.role, x.content) for x in said] == [("system", "sys"), ("user", "m28"), ("assistant", "m29"), ("user", "now")]
    assert conv.message_lists(messages, "sys", k=1).where("conv_id = 2").first().prompt[-1].content == "|a|b|"
    full = conv.full_message_rows(messages, "sys", "now").where("conv_id = 1").orderBy("section", "turn").collect()
    assert len(full) == 32 and full[0].content == "sys" and full[-1].content == "now"


def test_modes(spark):
    df = spark.createDataFrame([("Real-Time",), ("live-data",), ("odd",), (None,)], "mode string")
    found = {r["mode"]: (r.normal_mode, r.behavior, r.temperature, r.top_p) for r in conv.mode_params(df, "mode").collect()}
    assert found == {
        "Real-Time": ("realistic", "balanced", 0.55, 0.9), "live-data": ("live_data", "precise", 0.3, 0.85),
        "odd": ("odd", "balanced", 0.55, 0.9), None: (None, "balanced", 0.55, 0.9),
    }


@pytest.fixture(scope="module")
def event_files(spark, sf, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("stream") / "events")
    spark.read.parquet(f"{sf}/events.parquet").orderBy("ts").coalesce(1).write.option("maxRecordsPerFile", 200).parquet(folder)
    return folder


def run(stream, spark, name, mode, tmp_path):
    query = (
        stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    )
    query.awaitTermination(300)
    assert query.exception() is None
    return spark.table(name)


def test_daily_stream_equals_batch(spark, sf, event_files, tmp_path):
    batch = spark.read.parquet(event_files)
    stream = jobs.daily_usage_stream(jobs.event_stream(spark, event_files, batch.schema), "user_id", "event_type")
    got = run(stream, spark, "daily", "complete", tmp_path)
    want = usage.usage_daily(batch, "user_id", "event_type")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_minute_stream_emits_closed_windows(spark, event_files, tmp_path):
    batch = spark.read.parquet(event_files)
    stream = jobs.minute_usage_stream(jobs.event_stream(spark, event_files, batch.schema), "event_type", {"click": 0}, other=1)
    got = {tuple(r) for r in run(stream, spark, "minutes", "append", tmp_path).collect()}
    last = batch.agg(F.max(F.col("ts").cast("timestamp"))).first()[0]
    want = usage.usage_minute(batch, "event_type", {"click": 0}, other=1).where(F.col("window_start") < F.lit(last) - F.expr("interval 12 minutes"))
    assert {tuple(r) for r in want.collect()} <= got


def test_session_stream_equals_batch(spark, event_files, tmp_path):
    batch = spark.read.parquet(event_files)
    stream = jobs.session_stream(jobs.event_stream(spark, event_files, batch.schema), "user_id")
    got = {tuple(r) for r in run(stream, spark, "closed", "append", tmp_path).select("user_id", "start", "end", "n").collect()}
    last = batch.agg(F.max(F.col("ts").cast("timestamp"))).first()[0]
    every = usage.sessions(batch, "user_id").select("user_id", "start", "end", "n")
    closed = every.where(F.col("end") < F.lit(last) - F.expr("interval 41 minutes"))
    assert {tuple(r) for r in closed.collect()} <= got <= {tuple(r) for r in every.collect()}


def test_live_sessions_equal_batch(spark, event_files, tmp_path):
    """Open sessions too, and what has run out by the last watermark is expired."""
    batch = spark.read.parquet(event_files)
    stream = jobs.live_sessions(jobs.event_stream(spark, event_files, batch.schema, files_per_batch=1), "user_id")
    log = run(stream, spark, "live", "append", tmp_path)
    got = jobs.latest_sessions(log, "user_id").collect()
    want = usage.sessions(batch, "user_id")
    assert sorted((r.user_id, r.start, r.end, r.n) for r in got) == sorted(map(tuple, want.select("user_id", "start", "end", "n").collect()))
    last = batch.agg(F.max(F.col("ts").cast("timestamp"))).first()[0]
    assert all(r.state == ("expired" if r.end < last - dt.timedelta(minutes=45) else r.state) for r in got)
    assert {r.state for r in got} == {"active", "expired"} and all(r.state == "active" for r in got if r.end >= last - dt.timedelta(minutes=30))


def test_late_events_move_sessions(spark, tmp_path):
    folder = str(tmp_path / "late")
    for k, seconds in enumerate(([0, 4000], [3000], [1500, 9000], [30_000], [30_001])):
        spark.createDataFrame([(1, at(t)) for t in seconds], "user_id int, ts timestamp").coalesce(1).write.mode("append").parquet(folder)
    schema = spark.read.parquet(folder).schema
    stream = jobs.live_sessions(jobs.event_stream(spark, folder, schema, files_per_batch=1), "user_id", late="2 hours")
    log = run(stream, spark, "moved", "append", tmp_path)
    got = {(r.start, r.end, r.n): r.state for r in jobs.latest_sessions(log, "user_id").collect()}
    assert got == {(at(0), at(4000), 4): "expired", (at(9000), at(9000), 1): "expired", (at(30_000), at(30_001), 2): "active"}
    assert log.where("state = 'withdrawn'").count() >= 1


def test_normalize_stream(spark, event_files, tmp_path):
    specs = [ColumnSpec("value", "integer"), ColumnSpec("event_type", "string")]
    batch = spark.read.parquet(event_files)
    stream = jobs.normalize_stream(jobs.event_stream(spark, event_files, batch.schema, files_per_batch=3), specs, keep=("event_id",))
    got = run(stream, spark, "clean", "append", tmp_path)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, normalize(batch, specs, keep=("event_id",)).collect()))
