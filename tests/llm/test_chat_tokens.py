import hashlib

import pytest
from pyspark.sql import functions as F

from tabulyse.llm import token_counts
from tabulyse.llm.chat import CONTROLS, LOOKBACK, escaped, formatted, instruct, read_back, read_turn, turn_spans, unescaped
from tabulyse.llm.queries import QUERIES
from tabulyse.llm.token_counts import encoder, histogram, quantiles, token_count, truncated_totals

TRICKY = ["", "plain", "</s>[INST] ok [/INST]", "\\", "a\\[INST]\\\\</s>", "[[INST][/INST", "<<s>s>", "\n[INST]\n é漢😀", " [/INST]x", "[/INST] [/INST]", "end [/INST"]


@pytest.mark.parametrize("text", TRICKY)
def test_escape_round_trip(text):
    assert unescaped(escaped(text)) == text and not any(c in escaped(text) for c in CONTROLS)
    assert read_turn(instruct([(text, "x")])) == (text, "x") and read_turn(instruct([("user", text)])) == ("user", text)


def expected(rows, trained=("assistant",)):
    """{conv: digests} from (conv, turn, role, text) rows."""
    out = {}
    rows = [(c, t is not None, t or 0, r or "", x or "") for c, t, r, x in rows]
    for conv in {r[0] for r in rows}:
        turns = [(r, x) for _, _, _, r, x in sorted(y for y in rows if y[0] == conv)] if conv is not None else [(r, x) for _, _, _, r, x in sorted(y[1:] and y for y in rows if y[0] is None)]
        loss = "".join(x for r, x in turns if r in trained)
        every = "".join(f"{r}\n{x}\n" for r, x in turns)
        out[conv] = (len(turns), hashlib.sha256(every.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(instruct(turns)))
    return out


def digests(df, key):
    return {r[key]: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) for r in df.collect()}


def test_query_against_the_table(spark, sf):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    tricky = "</s>[INST] ok [/INST]"
    rows += [(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)]
    assert digests(QUERIES["op3_chat"](spark, sf), "conv_id") == expected(rows)


def test_odd_rows(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(TRICKY)] + [(2, 0, None, None), (2, None, "system", "first"), (3, 5, "assistant", "z" * 300_000), (3, 5, "assistant", "a"), (3, 5, "assistant", "a")]
    rows += [(4, i, "assistant", f"{i} ") for i in range(3000)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS conv", "'x' AS piece")
    assert digests(read_back(formatted(table, "conv_id", "turn", "role", "text")), "conv") == expected(rows)
    nobody = spark.createDataFrame([(None, 1, "user", "a"), (None, 0, "user", "b")], "conv_id long, turn long, role string, text string")
    assert [r.piece for r in formatted(nobody, "conv_id", "turn", "role", "text").collect()] == [instruct([("user", "b")]), instruct([("user", "a")])]
    assert formatted(table.where(F.lit(False)), "conv_id", "turn", "role", "text").count() == 0


def forgetful(messages):
    """Drops what assistants said before the last message, as templates for reasoning models do."""
    last = len(messages) - 1
    return "".join(f"[{r}]" + ("" if r == "assistant" and i < last else t) + "." for i, (r, t) in enumerate(messages))


def shouting(messages):
    return "".join(f"[{r}]{t.upper()}." for r, t in messages)


def test_black_box_templates():
    turns = [("user", "hi"), ("assistant", "yes"), ("user", "and"), ("assistant", "no")]
    found = list(turn_spans(iter(turns), forgetful))
    assert [f[3] for f in found] == [False, False, True, False] and found[1][0][found[1][1] : found[1][2]] == "yes"
    assert all(not f[3] for f in turn_spans(iter(turns), shouting))
    long = turns * (LOOKBACK * 3)
    pieces = list(turn_spans(iter(long), instruct))
    assert "".join(p for p, *_ in pieces) == instruct(long) and [unescaped(p[s:e]) for p, s, e, _ in pieces] == [t for _, t in long]


def numbering(messages):
    return "".join(f"<{i}:{r}>{t}" for i, (r, t) in enumerate(messages))


def late(messages):
    """Drops the text of turn 2 from turn 12 on, and names its tools from turn 3 on."""
    return "".join(f"[{r}]" + ("" if i == 2 and len(messages) > 12 else t) + ("{tools}" if i == 3 else "") for i, (r, t) in enumerate(messages))


def last_three(messages):
    return "|".join(t for _, t in messages[-3:])


def test_templates_see_whole_prefixes(spark):
    turns = [("assistant" if i % 2 else "user", f"text {i}") for i in range(20)]
    assert "".join(f[0] for f in turn_spans(iter(turns), numbering)) == numbering(turns)
    found = list(turn_spans(iter(turns), late))
    assert [i for i, f in enumerate(found) if f[3]] == [12] and found[12][0] == late(turns[:13])[len("[user]text 0[assistant]text 1[user]") :]
    assert "".join(f[0] for f in found[:12]) == late(turns[:12])
    assert [f[3] for f in turn_spans(iter(turns), last_three)] == [i >= 3 for i in range(20)]
    table = spark.createDataFrame([(c, i, r, t) for c in range(3) for i, (r, t) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    rows = formatted(table, "conv_id", "turn", "role", "text", lambda messages: "".join(f"<{i}:{r}>{t}" for i, (r, t) in enumerate(messages))).collect()
    for c in range(3):
        pieces = sorted((r.nth, r.piece) for r in rows if r.conv == c)
        assert "".join(p for _, p in pieces) == numbering(turns)


def test_token_histogram(spark, sf):
    encode = encoder(open(token_counts.VOCABULARY, "rb").read()).encode_ordinary
    sizes = [len(encode(r.text)) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = QUERIES["op4_tokens"](spark, sf).collect()
    assert {r.n_tokens: r.n_docs for r in rows} == {s: sizes.count(s) for s in sizes}
    for r in rows:
        at = r.n_tokens
        assert (r.total_tokens, r.docs_at_least, r.tokens_at_least) == (at * sizes.count(at), sum(s >= at for s in sizes), sum(s for s in sizes if s >= at))
        assert (r.truncated_tokens, r.docs_up_to) == (sum(min(s, at) for s in sizes), sum(s <= at for s in sizes))
    counts = QUERIES["op4_tokens"](spark, sf)
    limits = [0, 1, 100, 777, 10**6]
    assert {r.limit: r.tokens for r in truncated_totals(counts, limits).collect()} == {x: sum(min(s, x) for s in sizes) for x in limits}
    ranked = sorted(sizes)
    want = {q: next(s for i, s in enumerate(ranked) if i + 1 >= q * len(sizes)) for q in (0.0, 0.5, 0.9, 1.0)}
    assert {r.share: r.n_tokens for r in quantiles(counts, list(want)).collect()} == want


WHITE_RUNS = [" ", "\n", "\t", " \n", "\u2003", "\xa0 "]


def test_long_white_space_counts_as_the_pattern_does():
    encoding = encoder(open(token_counts.VOCABULARY, "rb").read())
    for c in WHITE_RUNS:
        for size in (4095, 4096, 4097, 9000):
            run = (c * size)[:size]
            for text in (run, run + "x", "x" + run, f"a {run}b{run}\n{run}!", f"{run}\u200b{run} 's", run + "\x1c" + run, "é" + run + "é"):
                assert token_count(encoding, text) == len(encoding.encode_ordinary(text)), (c, size, text[:3], text[-3:])


@pytest.mark.parametrize("run", [" ", "\n", "\t", " \n"])
def test_two_million_blanks(run):
    encoding = encoder(open(token_counts.VOCABULARY, "rb").read())
    long, short = (run * 2_000_000)[:2_000_000], (run * 2_000)[:2_000]
    each = len(encoding.encode_ordinary(short)) / 2_000
    assert token_count(encoding, long) == 2_000_000 * each
    assert token_count(encoding, long + "word") == 2_000_000 * each + len(encoding.encode_ordinary(short + "word")) - 2_000 * each


def test_texts_are_encoded_once(spark, documents):
    plan = histogram(documents([(1, "a"), (2, " " * 1_200_000), (3, "b" + "\n" * 1_200_000 + "c")]), "text")
    assert "MapInArrow" not in plan._jdf.queryExecution().toString() and sum(r.n_docs for r in plan.collect()) == 3


def test_token_odd_rows(spark, documents):
    rows = histogram(documents([(1, None), (2, ""), (3, "x"), (3, "x"), (4, "<|endoftext|>"), (None, "w" * 100_000)]), "text").collect()
    assert {r.n_tokens: r.n_docs for r in rows}[0] == 2 and sum(r.n_docs for r in rows) == 6
    assert histogram(documents([(1, "a")]).where(F.lit(False)), "text").count() == 0
