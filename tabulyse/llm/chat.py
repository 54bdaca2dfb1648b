"""Chat formatting by incremental black-box rendering.

A template is any function from messages to text. Its output for the first k turns is compared with its output for k + 1:
if the longer one starts with the shorter, the rest is the span of the new turn; if not, the template rewrites history,
which is reported for the turn. Where the turn's own text lies in its span is found the same way, by rendering it once
more with a probe in its place.

A template sees all turns up to the new one, so a conversation costs the square of its turns and its task holds it. Only a
template that is declared ``local`` sees less: the first turn and the last few before the new one, so that a turn costs the
same wherever it stands and nothing holds a conversation. Rows of a conversation stream through a task in order.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tabulyse.llm.staging import ships
from tabulyse.llm.words import named

ships(__name__)

#: What ``local`` templates see before the new turn, beside the first.
LOOKBACK = 4
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]")
#: Stands for a turn's text when its place is looked for; private-use characters that templates leave alone.
PROBE = "\ue000probe\ue001"

Message = tuple[str, str]


def escaped(text: str) -> str:
    """Backslashes doubled, and one put after the first character of every control string, so none is left in the text."""
    text = text.replace("\\", "\\\\")
    for control in CONTROLS:
        text = text.replace(control, control[0] + "\\" + control[1:])
    return text


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def local(render: Callable[[list[Message]], str], lookback: int = LOOKBACK) -> Callable[[list[Message]], str]:
    """Declares that what a turn adds to the output depends on the first turn and the ``lookback`` turns before it alone, and that
    it changes nothing before those. This is not checked: other templates must not be declared so."""
    render.lookback = lookback
    return render


@local
def instruct(messages: list[Message]) -> str:
    """The template of the query: each turn stands alone and names its role."""
    return "".join(f"<s>[INST] {escaped(role)} [/INST]{escaped(text)}</s>" for role, text in messages)


def read_turn(span: str) -> Message:
    """Role and text of one turn as ``instruct`` wrote it."""
    role, _, text = span.removeprefix("<s>[INST] ").removesuffix("</s>").partition(" [/INST]")
    return unescaped(role), unescaped(text)


def turn_spans(messages: Iterator[Message], render: Callable[[list[Message]], str]) -> Iterator[tuple[str, int, int, bool]]:
    """Per turn: what it adds to the output, where its text lies in that (start, end; -1, -1 if it isn't there as such), and
    whether the template rewrote what it had written before (the addition is then what follows the common beginning)."""
    lookback = getattr(render, "lookback", None)
    history: list[Message] = []
    before = ""
    for role, text in messages:
        after, probed = render([*history, (role, text)]), render([*history, (role, PROBE)])
        rewrites = not after.startswith(before)
        common = len(before)
        if rewrites:
            common = next((i for i, (a, b) in enumerate(zip(before, after)) if a != b), min(len(before), len(after)))
        head, found, tail = probed.rpartition(PROBE)
        start, end = -1, -1
        if found and not rewrites and len(head) >= common and after.startswith(head) and after.endswith(tail) and len(after) >= len(head) + len(tail):
            start, end = len(head) - common, len(after) - len(tail) - common
        yield after[common:], start, end, rewrites
        history.append((role, text))
        before = after
        if lookback is not None and len(history) > lookback + 1:
            del history[1]
            before = render(history)


def formatted(df: DataFrame, conversation: str, turn: str, role: str, text: str, render: Callable[[list[Message]], str] = instruct, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv, nth, role, piece, loss_start, loss_end, rewrites): the output of each conversation, one row per turn in order, with
    the code points of the piece that are trained on (null for other roles). Rows of a conversation stay together in order.

    Turns are ordered by turn (null first), then role, then text; null roles and texts are empty; null conversations are
    one conversation; repeated rows are turns of their own. A conversation streams through one task, which its order asks for;
    with a ``local`` template it may have any length, with others its cost grows with the square of its turns. An empty table gives an empty table. Names of other columns don't matter.
    """
    rows = df.select(named(conversation).alias("conv"), named(turn).alias("turn"), F.coalesce(named(role), F.lit("")).alias("role"), F.coalesce(named(text), F.lit("")).alias("text"))
    ordered = rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text").select("conv", "role", "text")
    schema = StructType([rows.schema["conv"], *StructType.fromDDL("nth long, role string, piece string, loss_start int, loss_end int, rewrites boolean")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def turns() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns))

        def out() -> Iterator[tuple]:
            for conv, group in groupby(turns(), key=lambda r: r[0]):
                roles: list[str] = []

                def messages(group=group, roles=roles):
                    for _, r, t in group:
                        roles[:] = [r]
                        yield r, t

                for nth, (piece, start, end, rewrites) in enumerate(turn_spans(messages(), render)):
                    loss = (start, end) if roles[0] in trained and start >= 0 else (None, None)
                    yield conv, nth, roles[0], piece, *loss, rewrites

        yield from _batches(out(), schema_arrow)

    schema_arrow = _arrow(schema)
    return ordered.mapInArrow(run, schema)


def _arrow(schema: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 2000, chars: int = 1 << 24) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, str))
        if len(held) >= most or size >= chars:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def read_back(pieces: DataFrame) -> DataFrame:
    """Per conversation of ``formatted`` (written by ``instruct``), from the output alone: n_turns, turns_sha256 (role, line feed,
    text, line feed per turn), loss_chars, loss_sha256 (text under the loss mask) and formatted_chars. One pass, in the same tasks."""
    schema = StructType([pieces.schema["conv"], *StructType.fromDDL("n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def turns() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(batch.column(c).to_pylist() for c in ("conv", "piece", "loss_start", "loss_end")))

        def out() -> Iterator[tuple]:
            for conv, group in groupby(turns(), key=lambda r: r[0]):
                all_turns, loss, count, loss_chars, chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
                for _, piece, start, end in group:
                    role, text = read_turn(piece)
                    all_turns.update(f"{role}\n{text}\n".encode())
                    if start is not None:
                        masked = unescaped(piece[start:end])
                        loss.update(masked.encode())
                        loss_chars += len(masked)
                    count += 1
                    chars += len(piece)
                yield conv, count, all_turns.hexdigest(), loss_chars, loss.hexdigest(), chars

        yield from _batches(out(), schema_arrow)

    schema_arrow = _arrow(schema)
    return pieces.mapInArrow(run, schema)


def rewriting(pieces: DataFrame) -> Column:
    """True for conversations whose template rewrote history: for use in ``pieces.groupBy("conv").agg(...)``."""
    return F.bool_or("rewrites")
