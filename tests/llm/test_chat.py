"""Formatting against a plain loop, and the exact way back."""

import hashlib
from collections import defaultdict

import pytest
from hypothesis import given
from hypothesis import strategies as st

from notelake.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, is_last string, example string"
control = st.lists(st.sampled_from(["\\", "###", "#", " ", "</turn>", "<", "/turn>", ":", "\n", "x", "é", "### user: ", " </turn>\n"])).map("".join)


@given(st.lists(st.tuples(control, control), max_size=6))
def test_formatting_is_reversible(turns):
    text = "".join(chat.format_turn(role, said)[0] for role, said in turns)
    assert chat.parse(text) == turns
    for role, said in turns:
        formatted, a, b = chat.format_turn(role, said)
        assert chat.unescape(formatted[a:b]) == said


def test_other_text_is_refused():
    with pytest.raises(ValueError):
        chat.parse("### user: hello </turn>\nmore")


def brute(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = set()
    for conv, turns in by.items():
        turns.sort()
        said = [(role, text) for _, _, role, text in turns]
        loss = "".join(text for role, text in said if role == "assistant")
        chars, size, n = 0, 0, 0
        for i, (role, text) in enumerate(said):
            size += len(chat.format_turn(role, text)[0])
            if role == "assistant" or i == len(said) - 1:
                chars, n = chars + size, n + 1
        sha = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in said).encode()).hexdigest()
        out.add((conv, len(said), sha, len(loss), hashlib.sha256(loss.encode()).hexdigest(), chars, n))
    return out


def check(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(3)
    assert {tuple(r) for r in chat.read_back(chat.examples(df)).collect()} == brute(rows)


def test_edges_and_long_conversations(spark):
    strange = "\\### Assistant: </turn> ok"
    rows = [(-7, 0, "user", strange), (-7, 1, "assistant", strange), (1, 0, "user", None), (1, None, None, "first"), (1, 1, "assistant", ""),
            (None, 0, "assistant", "no id"), (2, 0, "assistant", "a"), (2, 0, "assistant", "a"), (2, 0, "assistant", "b"), (2, 5, "us:er\n", "end"),
            (3, 0, "system", "x" * 200_000)]
    rows += [(9, t, "assistant" if t % 2 else "user", f"turn {t} " + "é" * (t % 7)) for t in range(300)]  # several slices of targets
    check(spark, rows)
    check(spark, [])


def test_each_reply_is_trained_once_with_its_context(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "q1"), (1, 2, "assistant", "a1"), (1, 3, "user", "q2"), (1, 4, "assistant", "a2"), (1, 5, "user", "q3")]
    got = chat.examples(spark.createDataFrame([(*r, "", "") for r in rows], SCHEMA)).orderBy("example").collect()
    assert [[t for _, t in chat.parse(r.text)] for r in got] == [["s", "q1", "a1"], ["s", "q1", "a1", "q2", "a2"], ["s", "q1", "a1", "q2", "a2", "q3"]]
    assert [r.loss_start is not None and r.text[r.loss_start:r.loss_end] for r in got] == ["a1", "a2", False]
    assert [r.is_last for r in got] == [False, False, True]
