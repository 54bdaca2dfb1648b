"""Usage metering, sessions and ownership over event tables.

The counting functions work on batch tables and on streams alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulyse.functions import fixed_values as fixed
from tabulyse.session import written

MINUTE_LIMIT = 30
IDLE_SECONDS = 1_800
OWNER_LIMIT = 10


def event_time(df: DataFrame, ts: str = "ts") -> DataFrame:
    """The table with ``ts`` as timestamp; windows and watermarks do not take one without zone."""
    if isinstance(df.schema[ts].dataType, T.TimestampType):
        return df
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def limit_of(kind: Column, limits: dict[str, int], other: int) -> Column:
    """The limit of a kind, from a table small enough to stand in the query."""
    if not limits:
        return F.lit(other).cast("bigint")
    known = F.create_map(*[F.lit(x) for name, limit in limits.items() for x in (name, limit)])
    return F.coalesce(F.element_at(known, F.lower(F.trim(kind))), F.lit(other)).cast("bigint")


def _against_limit(counted: DataFrame, limit: Column) -> DataFrame:
    limited = counted.withColumn("limit", limit)
    over = F.greatest(F.col("used") - F.col("limit"), F.lit(0).cast("bigint"))
    return limited.withColumns({"over": F.col("used") > F.col("limit"), "rejected": over})


def usage_minute(
    events: DataFrame, key: str, limits: dict[str, int] | None = None, other: int = MINUTE_LIMIT, watermark: str | None = None
) -> DataFrame:
    """(key, window_start, used, limit, over, rejected) per clock minute; windows start on the minute."""
    timed = event_time(events)
    timed = timed.withWatermark("ts", watermark) if watermark else timed
    counted = timed.groupBy(F.window("ts", "1 minute").alias("w"), F.col(key)).agg(F.count("*").alias("used"))
    flat = counted.select(F.col(key), F.col("w.start").alias("window_start"), "used")
    return _against_limit(flat, limit_of(F.col(key).cast("string"), limits or {}, other))


def usage_first_hit(events: DataFrame, key: str, limits: dict[str, int] | None = None, other: int = MINUTE_LIMIT, seconds: int = 60) -> DataFrame:
    """(key, window_start, used, limit, over, rejected) per window that its first event opens and that lasts ``seconds``.

    Where a window opens depends on the one before, so its first event is found by pointer doubling: every event points to the
    first one ``seconds`` later or more, and each round doubles how many windows a pointer skips. A key's windows are found
    in as many rounds as their number has binary digits, by joins on key and instant, so a key with a third of all events is
    spread as any other. Rounds are written, and run when the function is called.
    """
    length = seconds * 1_000_000
    keyed = event_time(events).select(F.struct(F.col(key).alias("key")).alias("key"), F.unix_micros("ts").alias("at")).where("at is not null")
    ticks = written(keyed.groupBy("key", "at").agg(F.count("*").alias("n")), "ticks")
    hops = written(_hops(ticks, length), "hops")
    starts = written(ticks.groupBy("key").agg(F.min("at").alias("at")), "starts")
    known = starts.count()
    while True:
        further = starts.join(hops, ["key", "at"]).select("key", F.col("next").alias("at"))
        starts = written(starts.unionByName(further).distinct(), "starts")
        if (now := starts.count()) == known:
            break
        known = now
        onward = hops.select("key", F.col("at").alias("next"), F.col("next").alias("after"))
        hops = written(hops.join(onward, ["key", "next"]).select("key", "at", F.col("after").alias("next")), "hops")
    # Windows are a slot long or more apart, so a slot opens one at most: an event's is that of its slot or of the slot before.
    slot = F.floor(F.col("at") / length)
    opened = starts.select("key", slot.alias("slot"), F.col("at").alias("start"))
    here, before = opened, opened.select("key", (F.col("slot") + 1).alias("slot"), F.col("start").alias("earlier"))
    placed = ticks.withColumn("slot", slot).join(here, ["key", "slot"], "left").join(before, ["key", "slot"], "left")
    start = F.when(F.col("start") <= F.col("at"), F.col("start")).otherwise(F.col("earlier"))
    used = placed.groupBy("key", start.alias("start")).agg(F.sum("n").alias("used"))
    flat = used.select(F.col("key.key").alias(key), F.timestamp_micros("start").alias("window_start"), "used")
    return _against_limit(flat, limit_of(F.col(key).cast("string"), limits or {}, other))


def _hops(ticks: DataFrame, length: int) -> DataFrame:
    """(key, at, next): the first instant of the key ``length`` microseconds later or more, where there is one.

    It lies in the slot of that moment or opens the next slot that has events. Windows run within a slot and over a key's slots.
    """
    slot = F.floor(F.col("at") / length)
    events = ticks.select("key", slot.alias("slot"), "at", F.col("at").alias("tick"), F.lit(None).cast("bigint").alias("asks"))
    asked = ticks.select("key", (slot + 1).alias("slot"), (F.col("at") + length).alias("at"), F.lit(None).cast("bigint").alias("tick"), F.col("at").alias("asks"))
    both = events.unionByName(asked)
    from_here = Window.partitionBy("key", "slot").orderBy(F.desc("at"), F.col("tick").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    inside = both.withColumn("next", F.last("tick", ignorenulls=True).over(from_here)).where("asks is not null")
    slots = both.groupBy("key", "slot").agg(F.min("tick").alias("first"))
    later = Window.partitionBy("key").orderBy(F.desc("slot")).rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.select("key", "slot", F.last("first", ignorenulls=True).over(later).alias("beyond"))
    found = inside.join(slots, ["key", "slot"]).select("key", F.col("asks").alias("at"), F.coalesce("next", "beyond").alias("next"))
    return found.where("next is not null")


def usage_daily(
    events: DataFrame,
    user: str,
    kind: str,
    limits: dict[str, int] | None = None,
    other: int = fixed.OTHER_DAILY_LIMIT,
    watermark: str | None = None,
) -> DataFrame:
    """(user, kind, day, used, limit, over, rejected) per UTC day."""
    timed = event_time(events)
    timed = timed.withWatermark("ts", watermark) if watermark else timed
    counted = timed.groupBy(F.window("ts", "1 day").alias("w"), F.col(user), F.col(kind)).agg(F.count("*").alias("used"))
    flat = counted.select(F.col(user), F.col(kind), F.col("w.start").cast("date").alias("day"), "used")
    return _against_limit(flat, limit_of(F.col(kind), fixed.DAILY_LIMITS if limits is None else limits, other))


def usage_status(
    events: DataFrame, users: DataFrame, user: str, kind: str, kinds: list[str], day: str, limits: dict[str, int] | None = None
) -> DataFrame:
    """(user, kind, used, limit) on one UTC day for every user and kind of the list, 0 where unused."""
    timed = event_time(events)
    today = timed.where((F.col("ts") >= F.lit(day).cast("timestamp")) & (F.col("ts") < F.date_add(F.lit(day).cast("date"), 1).cast("timestamp")))
    used = today.groupBy(F.col(user), F.col(kind)).agg(F.count("*").alias("used"))
    grid = users.select(user).distinct().withColumn(kind, F.explode(F.array(*[F.lit(k) for k in kinds])))
    filled = grid.join(used, [user, kind], "left")
    limit = limit_of(F.col(kind), fixed.DAILY_LIMITS if limits is None else limits, fixed.OTHER_DAILY_LIMIT)
    return filled.select(user, kind, F.coalesce("used", F.lit(0).cast("bigint")).alias("used"), limit.alias("limit"))


def sessions(events: DataFrame, user: str, idle_seconds: int = IDLE_SECONDS, as_of: str | None = None) -> DataFrame:
    """(user, session, start, end, n, state): a session ends once the user is idle for longer.

    A gap of exactly ``idle_seconds`` does not end it. Events are first collapsed to one row per user
    and clock slot of that length: two events in one slot are always in one session. So the window over
    a user's rows grows with the time span, not with the number of events.

    ``state`` is 'active' if the last event is within the idle time before ``as_of``, else 'expired';
    without ``as_of`` it is NULL.
    """
    micros = F.unix_micros("ts")
    slot = F.floor(micros / (idle_seconds * 1_000_000))
    slots = event_time(events).groupBy(F.col(user), slot.alias("slot")).agg(
        F.min(micros).alias("first"), F.max(micros).alias("last"), F.count("*").alias("n")
    )
    order = Window.partitionBy(user).orderBy("slot")
    gap = F.col("first") - F.lag("last").over(order)
    opened = slots.withColumn("opens", F.when(gap.isNull() | (gap > idle_seconds * 1_000_000), 1).otherwise(0))
    numbered = opened.withColumn("session", F.sum("opens").over(order))
    grouped = numbered.groupBy(user, "session").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"))
    state = F.lit(None).cast("string")
    if as_of is not None:
        idle = F.unix_micros(F.lit(as_of).cast("timestamp")) - F.col("last")
        state = F.when(idle > idle_seconds * 1_000_000, "expired").otherwise("active")
    return grouped.select(
        user, "session", F.timestamp_micros("first").alias("start"), F.timestamp_micros("last").alias("end"), "n", state.alias("state")
    )


def newest_per_owner(df: DataFrame, owner: str, newest_first: list[str], k: int) -> DataFrame:
    """The k newest rows of every owner, with their rank; each task forwards k rows per owner."""
    order = Window.partitionBy(owner).orderBy(*[F.desc(c) for c in newest_first])
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def newest_of_owner(df: DataFrame, owner: str, value, newest_first: list[str], k: int) -> DataFrame:
    """The k newest rows of one owner."""
    return df.where(F.col(owner) == value).orderBy(*[F.desc(c) for c in newest_first]).limit(k)


def quota_count(df: DataFrame, owner: str, limit: int = OWNER_LIMIT) -> DataFrame:
    """(owner, n, limit, full): how many rows each owner has against a limit."""
    counted = df.groupBy(owner).agg(F.count("*").alias("n"))
    return counted.withColumns({"limit": F.lit(limit).cast("bigint"), "full": F.col("n") >= limit})


def owned_rows(df: DataFrame, owner: str, owners: DataFrame, owner_key: str) -> DataFrame:
    """The rows whose owner is listed."""
    listed = owners.select(F.col(owner_key).alias(owner)).distinct()
    return df.join(listed, owner, "left_semi")
