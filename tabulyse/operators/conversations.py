"""Conversation tables: one row per message, keyed by conversation and turn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulyse.functions import fixed_values as fixed
from tabulyse.functions.normalize import strip
from tabulyse.operators.positions import numbered
from tabulyse.session import written

HISTORY_MESSAGES = 12
TITLE_LETTERS = 50
ARCHIVE_TURNS = 1_000


def has_table(text: Column) -> Column:
    """True where some line holds at least three pipes."""
    return text.rlike(fixed.TABLE_LINE)


def recent_history(messages: DataFrame, k: int = HISTORY_MESSAGES) -> DataFrame:
    """The last k messages of every conversation; messages of one turn come by role and text.

    Each task keeps k rows per conversation before the shuffle, so a huge conversation costs no more
    than a small one.
    """
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"), F.desc("role"), F.desc("text"))
    return messages.withColumn("back", F.row_number().over(newest)).where(F.col("back") <= k).drop("back")


def conversation_title(messages: DataFrame, default: str = fixed.DEFAULT_TITLE) -> DataFrame:
    """(conv_id, title): the first letters of the first message, or a default if they are blank."""
    first = messages.groupBy("conv_id").agg(F.min(F.struct("turn", "role", F.substring("text", 1, TITLE_LETTERS).alias("head"))).alias("first"))
    return first.select("conv_id", F.coalesce(F.nullif(strip(F.col("first.head")), F.lit("")), F.lit(default)).alias("title"))


def conversation_archive(messages: DataFrame, turns_per_row: int = ARCHIVE_TURNS) -> DataFrame:
    """(conv_id, part, n, messages): conversations as nested rows, messages in the order of turn, role and text.

    A conversation of up to ``turns_per_row`` messages is one row, part 0. A longer one continues in further rows of as many
    messages, whatever their turns, so no row, task or group grows with the length of a conversation. Whether there are long
    ones is counted when the function is called; only their messages are numbered.
    """
    message = F.struct("turn", "role", "text", F.when(F.col("role") == "assistant", has_table(F.col("text"))).otherwise(False).alias("show_download"))
    long = written(messages.groupBy("conv_id").agg(F.count("*").alias("n")).where(F.col("n") > turns_per_row).select("conv_id"), "long-conversations")
    rows, same = messages.select("conv_id", "turn", "role", "text"), F.col("m.conv_id").eqNullSafe(F.col("l.conv_id"))
    some = not long.isEmpty()
    short = rows.alias("m").join(long.alias("l"), same, "left_anti") if some else rows
    whole = short.groupBy("conv_id").agg(F.lit(0).cast("bigint").alias("part"), F.count("*").alias("n"), F.sort_array(F.collect_list(message)).alias("messages"))
    if not some:
        return whole
    placed = numbered(rows.alias("m").join(long.alias("l"), same, "left_semi"), ["conv_id"], ["turn", "role", "text"])
    # Equal messages are one row of n places; each part takes the places that fall to it.
    first, last = F.col("before"), F.col("before") + F.col("n")
    parts = placed.withColumn("part", F.explode(F.sequence(F.floor(first / turns_per_row), F.floor((last - 1) / turns_per_row))))
    copies = F.least(last, (F.col("part") + 1) * turns_per_row) - F.greatest(first, F.col("part") * turns_per_row)
    each = parts.select("conv_id", F.col("part").cast("bigint").alias("part"), F.struct("before", copies.cast("int").alias("copies"), message.alias("message")).alias("x"))
    cut = each.groupBy("conv_id", "part").agg(F.sum("x.copies").cast("bigint").alias("n"), F.sort_array(F.collect_list("x")).alias("xs"))
    spread = F.flatten(F.transform("xs", lambda x: F.array_repeat(x["message"], x["copies"])))
    return whole.unionByName(cut.select("conv_id", "part", "n", spread.alias("messages")))


def message_lists(messages: DataFrame, system: str, instruction: str | None = None, k: int = HISTORY_MESSAGES) -> DataFrame:
    """(conv_id, prompt): system text, the last k messages in order, and a closing instruction."""
    turn = F.struct("turn", "role", F.col("text").alias("content"))
    history = recent_history(messages, k).groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("history"))
    spoken = F.transform("history", lambda h: F.struct(h["role"].alias("role"), h["content"].alias("content")))
    return history.select("conv_id", F.concat(F.array(_said("system", system)), spoken, *_closing(instruction)).alias("prompt"))


def _said(role: str, text: str) -> Column:
    return F.struct(F.lit(role).alias("role"), F.lit(text).alias("content"))


def _closing(instruction: str | None) -> list[Column]:
    return [F.array(_said("user", instruction))] if instruction is not None else []


def full_message_rows(messages: DataFrame, system: str, instruction: str) -> DataFrame:
    """(conv_id, section, turn, role, content): the whole history framed by system text and instruction.

    One row per message, read in the order of section and turn: a whole history has no bound, so it is
    not gathered into one value.
    """
    said = messages.select("conv_id", F.lit(1).alias("section"), "turn", "role", F.col("text").alias("content"))
    conversations = messages.select("conv_id").distinct()
    zero = F.lit(0).cast("bigint").alias("turn")
    frame = conversations.select(
        "conv_id",
        F.inline(
            F.array(
                F.struct(F.lit(0).alias("section"), zero, F.lit("system").alias("role"), F.lit(system).alias("content")),
                F.struct(F.lit(2).alias("section"), zero, F.lit("user").alias("role"), F.lit(instruction).alias("content")),
            )
        ),
    )
    return said.unionByName(frame)


def normal_mode(mode: Column) -> Column:
    """A data mode in its normal spelling."""
    plain = F.replace(F.lower(mode), F.lit("-"), F.lit("_"))
    for synonym, name in fixed.MODE_SYNONYMS.items():
        plain = F.when(plain == synonym, name).otherwise(plain)
    return plain


def mode_params(df: DataFrame, mode: str) -> DataFrame:
    """The table with normal_mode, behavior, temperature and top_p for the data mode in a column."""

    def lookup(table: dict, key: Column) -> Column:
        return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)

    normal = normal_mode(F.col(mode))
    behavior = F.coalesce(lookup(fixed.MODE_BEHAVIOR, normal), F.lit(fixed.OTHER_BEHAVIOR))
    temperature = {name: t for name, (t, _) in fixed.BEHAVIOR_PARAMS.items()}
    top_p = {name: p for name, (_, p) in fixed.BEHAVIOR_PARAMS.items()}
    named = df.withColumns({"normal_mode": normal, "behavior": behavior})
    return named.withColumns({"temperature": lookup(temperature, F.col("behavior")), "top_p": lookup(top_p, F.col("behavior"))})
