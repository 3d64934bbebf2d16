"""Transcripts: text comes back as it was, one part may be very long, and blocks change nothing."""

from __future__ import annotations

import itertools

import numpy as np
import pytest

from hireflow.llm import chat_format as C

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return C.fit(C.as_transcripts(spark.read.parquet(f"{SF}/conversations.parquet")))


def test_code_and_paragraphs_come_back_unchanged(spark, model):
    turns = ["How do I loop?", "Like this:\n\n    for x in y:\n        print(x)\n\n  * one\n  * two", "Thanks.\n\n\nBye."]
    parts = [(1, k, f"{who}: {t}") for k, (who, t) in enumerate(zip(("User", "Assistant", "User"), turns, strict=True))]
    out = C.parse_transcripts(spark.createDataFrame(parts, "conv_id long, part long, text string"), model)
    assert [r.text for r in out.orderBy("turn_no").collect()] == turns


def test_one_part_of_two_hundred_thousand_lines(spark, model):
    n = 100_000
    lines = [x for k in range(n) for x in (f"  line {k} of a long answer", f"and {k} more.")]
    rows = [(1, 0, "User: Tell me."), (1, 1, "Assistant: Well\n" + "\n".join(lines)), (2, 0, "User: hi"), (2, 1, "Assistant: hello.")]
    out = C.parse_transcripts(spark.createDataFrame(rows, "conv_id long, part long, text string"), model)
    got = {(r.conv_id, r.turn_no): r for r in out.collect()}
    assert set(got) == {(1, 0), (1, 1), (2, 0), (2, 1)}
    assert got[1, 1].n_lines == 2 * n + 1 and got[1, 1].text == "Well\n" + "\n".join(lines)


def test_states_are_the_best_of_all_paths(spark, model, monkeypatch):
    """Every sequence of states of a short transcript is scored; the parsed roles are those of the best."""
    monkeypatch.setattr(C, "BLOCK", 2)
    text = "User: why\n\nso it goes\nAnswer: because.\nmore"
    df = spark.createDataFrame([(1, 0, text)], "conv_id long, part long, text string")
    lines = C._lines(df).orderBy("part", "line").toArrow()
    score, first, move = model.scores(lines), model.start, model.move
    best = max(itertools.product(range(C.STATES), repeat=lines.num_rows), key=lambda s: first[s[0]] + score[0][s[0]] + sum(
        move[a, b] + score[k + 1][b] for k, (a, b) in enumerate(zip(s, s[1:], strict=False))))
    turns = [C.ROLES[s // 2] for s in best if s % 2 == 0]
    got = [r.role for r in C.parse_transcripts(df, model).orderBy("turn_no").collect()]
    assert got == turns and np.isfinite(score).all()
