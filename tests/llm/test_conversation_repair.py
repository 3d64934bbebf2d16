"""Conversation repair against a plain shortest-path search and against whole conversations."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from hireflow.llm import conversation_repair as R
from hireflow.llm import queries as Q
from hireflow.plans.compare import compare, duck

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"


def plain(codes: str) -> tuple[int, str]:
    """Cheapest, ASCII-least edits; a table over (rows done, initials so far: none, s, u, a)."""
    best = {"": (0, "")}

    def put(table, state, way):
        if state not in table or way < table[state]:
            table[state] = way

    def step(state, letter):
        if letter == "s":
            return "s" if state == "" else None
        if letter == "u":
            return "u" if state != "u" else None
        return "a" if letter == "a" and state == "u" else None

    def insertions(table):
        for _ in range(4):
            for state, (cost, edits) in list(table.items()):
                for letter in "ua":
                    if (to := step(state, letter)):
                        put(table, to, (cost + 5, edits + "I"))
        return table

    for code in codes:
        after = {}
        for state, (cost, edits) in insertions(dict(best)).items():
            put(after, state, (cost + 2, edits + "D"))
            if code == "d":
                continue
            extra = 5 if code.isupper() else 0
            if (to := step(state, code.lower())):
                put(after, to, (cost + extra, edits + "K"))
            for letter in "ua":
                if (to := step(state, letter)):
                    put(after, to, (cost + extra + 1, edits + "R"))
        best = after
    return min(w for s, w in insertions(dict(best)).items() if s in ("", "a"))


def test_search_is_cheapest_and_ascii_least():
    rng = random.Random(5)
    for n in [*range(1, 14), 13, 24, 25, 60, 150]:
        for letters in ("ua", "uad", "suxUAd", "suaxdSUAX", "UASX", "d"):
            codes = "".join(rng.choice(letters) for _ in range(n))
            cost, rows, state = R.solve(codes)
            assert (cost, "".join(rows) + "I" * (0, 2, 1, 0)[state]) == plain(codes), codes


def whole(rows):
    """One conversation's report from its rows in order."""
    seen, codes, count, faults = set(), "", {"blank": 0, "duplicate": 0, "truncated": 0}, []
    for _, role, text in rows:
        initial = role[:1] if role[:1] in ("s", "u", "a") and role else "x"
        if not re.search(r"[^\x20\x09-\x0D]", text):
            fault = "blank"
        elif (role, text) in seen:
            fault = "duplicate"
        elif re.findall(r"[^\x20\x09-\x0D]", text)[-1] not in ".!?":
            fault = "truncated"
        else:
            fault = None
        seen.add((role, text))
        faults.append(fault)
        if fault:
            count[fault] += 1
        codes += "d" if fault in ("blank", "duplicate") else initial.upper() if fault else initial
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:], strict=False)]
    cost, audit = plain(codes) if codes else (0, "")
    out, state, at = [], "", 0
    for letter in audit:
        expected = "assistant" if state == "u" else "user"
        if letter == "I":
            out.append(f"{expected}:")
            state = expected[0]
            continue
        _, role, text = rows[at]
        at += 1
        if letter != "D":
            role = expected if letter == "R" else role
            out.append(f"{role}:{text}")
            state = role[:1]
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, *count.values(), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
            hashlib.sha256("\n".join(out).encode()).hexdigest())


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))


def reports(table, damaged):
    by = {}
    for conv, turn, role, text in table:
        by.setdefault(conv, [])
        for kept in ([(turn, role, text)] if not damaged else spoil(conv, turn, role, text)):
            by[conv].append(kept)
    return sorted(((c, *whole(in_order([(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows])))
                   for c, rows in by.items()), key=str)


def spoil(conv, turn, role, text):
    key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
    kind, role, text = zlib.crc32(key.encode()) % 20, role if role is not None else " ", text if text is not None else " "
    if kind == 0:
        return []
    text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
    return [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)


def hard_rows():
    rng = random.Random(11)
    words = ["Yes.", "No!", "why", "", None, " \t\n", "Ok?\n", "x" * 20_000 + "."]
    out = [(None, None, None, None), (None, 1, "user", "A."), (None, 2, "assistant", "B."), (1, None, "user", "A."),
           (1, None, "user", "A."), (1, None, "assistant", "B."), (2, 5, "", "Empty role."), (2, 9, "User", "Capital."),
           (3, 1, "tool", "T."), (4, 1, "system", "S."), (5, 1, "system", None)]
    for conv in range(10, 60):
        for turn in range(rng.randrange(1, 30)):
            for _ in range(rng.choice((0, 1, 1, 1, 2))):
                out.append((conv, turn, rng.choice(("user", "assistant", "system", "tool")), rng.choice(words[:7])
                            if rng.random() < 0.5 else f"{rng.random()}."))
    # one conversation that is longer than any group of rows, with a row that returns all the time
    out += [(100, k // 2, rng.choice(("user", "assistant")), rng.choice(("Again.", f"T{k}.", f"cut {k}", ""))) for k in range(700)]
    out.append((101, 1, "user", words[7]))
    return out


@pytest.mark.parametrize("block", [7, 64, R.BLOCK])
def test_conversations_that_cross_groups(spark, block):
    rows = hard_rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5).select(
        "*", *[F.lit("clash").alias(c) for c in ("place", "conv", "code", "fault", "digest", "block", "edits")])
    got = sorted((tuple(r)[1:] for r in R.digests(R.repair(df, block=block)).collect()), key=str)
    want = sorted((r[1:] for r in reports(rows, damaged=False)), key=str)
    assert got == want


def test_damaged_conversations_with_hard_rows(spark):
    rows = hard_rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sorted((tuple(r) for r in R.conversation_report(df, R.damage(df)).collect()), key=str)
    assert got == reports(rows, damaged=True)
    empty = spark.createDataFrame([], SCHEMA)
    assert R.conversation_report(empty, R.damage(empty)).collect() == []


def test_repair_keeps_every_row_and_its_text(spark):
    df = spark.createDataFrame(hard_rows(), SCHEMA)
    out = R.repair(df, block=16).collect()
    assert sorted(r.place for r in out) == list(range(df.count()))
    assert all((r.text is None) == r.edits.endswith("D") for r in out)
    assert all(r.edits.endswith("D") for r in out if r.fault in ("blank", "duplicate"))


def test_query_equals_sql(spark):
    assert compare(Q.QUERIES["op11_conversation_repair"](spark, SF), Q.ORACLE_SQL["op11_conversation_repair"], duck(SF))["ok"]
