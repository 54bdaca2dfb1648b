"""The same operators on streams."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState

from tabulyse.functions.semantic_types import ColumnSpec
from tabulyse.operators.normalize_table import normalize
from tabulyse.operators.usage import IDLE_SECONDS, event_time, usage_daily, usage_minute

# Ship this module with the stateful function, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def event_stream(spark: SparkSession, folder: str, schema: T.StructType, fmt: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
    """Files arriving in a folder, with ``ts`` as timestamp."""
    reader = spark.readStream.schema(schema).format(fmt)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return event_time(reader.load(folder))


def minute_usage_stream(events: DataFrame, key: str, limits: dict[str, int] | None = None, late: str = "10 minutes", **options) -> DataFrame:
    return usage_minute(events, key, limits, watermark=late, **options)


def daily_usage_stream(events: DataFrame, user: str, kind: str, late: str = "1 hour", **options) -> DataFrame:
    return usage_daily(events, user, kind, watermark=late, **options)


def session_stream(events: DataFrame, user: str, idle_seconds: int = IDLE_SECONDS, late: str = "10 minutes") -> DataFrame:
    """(user, start, end, n) of sessions the watermark has closed; ``end`` is the last event.

    The window is a microsecond longer than the idle time, so a gap of exactly that length stays inside.
    """
    window = F.session_window("ts", f"{idle_seconds} seconds 1 microsecond")
    grouped = event_time(events).withWatermark("ts", late).groupBy(window.alias("w"), F.col(user))
    return grouped.agg(F.count("*").alias("n"), F.max("ts").alias("end")).select(user, F.col("w.start").alias("start"), "end", "n")


def live_sessions(events: DataFrame, user: str, idle_seconds: int = IDLE_SECONDS, late: str = "10 minutes") -> DataFrame:
    """(user, start, end, n, state, version): a log of what becomes of every session, open ones included.

    A session is 'active' whenever events opened or prolonged it, 'expired' once the watermark is more than the idle time past
    its end, and 'withdrawn' where a late event gave it an earlier start or joined it to the one before. Versions count per
    user; ``latest_sessions`` takes the last word on each session. The state of a user is the open sessions, and a timer
    wakes it when the first of them runs out.
    """
    timed = event_time(events).withWatermark("ts", late).select(F.col(user).alias("user"), "ts")
    kind = timed.schema["user"].dataType.simpleString()
    idle = idle_seconds * 1_000_000
    return (
        timed.groupBy("user")
        .applyInPandasWithState(lambda key, parts, state: _sessions_of(key, parts, state, idle), f"user {kind}, start timestamp, end timestamp, n long, state string, version long", "open array<long>, version long", "append", "EventTimeTimeout")
        .withColumnRenamed("user", user)
    )


def _sessions_of(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState, idle: int) -> Iterator[pd.DataFrame]:
    """The log rows of one user in one batch. Open sessions are kept as start, end and number of events in turn."""
    flat, version = state.get if state.exists else ([], 0)
    before = {flat[i]: (flat[i + 1], flat[i + 2]) for i in range(0, len(flat), 3)}
    pieces = [(s, e, n) for s, (e, n) in before.items()]
    if not state.hasTimedOut:
        pieces += [(int(t), int(t), 1) for part in parts for t in part["ts"].dropna().dt.as_unit("us").astype("int64")]
    merged: list[list[int]] = []
    for start, end, n in sorted(pieces):
        if merged and start - merged[-1][1] <= idle:
            merged[-1][1:] = [max(merged[-1][1], end), merged[-1][2] + n]
        else:
            merged.append([start, end, n])
    passed = state.getCurrentWatermarkMs() * 1000
    now = {s: (e, n) for s, e, n in merged}
    rows = [(s, e, n, "withdrawn") for s, (e, n) in before.items() if s not in now]
    rows += [(s, e, n, "active") for s, (e, n) in now.items() if before.get(s) != (e, n)]
    over = {s for s, (e, _) in now.items() if e + idle < passed}
    rows += [(s, *now[s], "expired") for s in sorted(over)]
    still = [x for s, e, n in merged if s not in over for x in (s, e, n)]
    if still:
        state.update((still, version + len(rows)))
        state.setTimeoutTimestamp(max((min(still[1::3]) + idle) // 1000, state.getCurrentWatermarkMs()) + 1)
    else:
        state.remove()
    if rows:
        found = pd.DataFrame(rows, columns=["start", "end", "n", "state"])
        for c in ("start", "end"):
            found[c] = pd.to_datetime(found[c], unit="us")
        found.insert(0, "user", [key[0]] * len(found))
        # Versions go on from batch to batch. They begin anew once no session is open: none of those before can change.
        found["version"] = range(version + 1, version + 1 + len(found))
        yield found


def latest_sessions(log: DataFrame, user: str) -> DataFrame:
    """(user, start, end, n, state): what the log of ``live_sessions`` says last about every session."""
    last = log.groupBy(user, "start").agg(F.max(F.struct("version", "end", "n", "state")).alias("last"))
    return last.select(user, "start", "last.end", "last.n", "last.state").where("state != 'withdrawn'")


def normalize_stream(rows: DataFrame, specs: list[ColumnSpec], null_policy: str = "typed_default", keep: tuple[str, ...] = ()) -> DataFrame:
    """Stateless cleaning of a stream."""
    return normalize(rows, specs, null_policy, keep)
