"""Conversation structure repair: the cheapest edits that give a well-formed dialogue.

A conversation is well formed when it is empty or reads ``system? (user assistant)+``.
Every row is kept (free), given another role (1) or deleted (2); empty turns may be
inserted anywhere (5). Blank and repeated rows have to go; a truncated row that stays
costs 5 more. The edits are found by iterative-deepening A*: a depth-first search
tries the edits of each row in ASCII order (Delete, Insert, Keep, Rerole) under a cost
bound that grows to the least cost that went over it; states that failed are kept in a
table with the budget that was not enough. The first accepting path is the answer, so
among equally cheap repairs the ASCII-least wins.

Spark deals out the work so that no conversation has to fit anywhere: rows get a global
position (conversation, turn), groups of ``block`` consecutive positions are searched
together, and a conversation that crosses groups is a chain of runs. What a run costs
between any two states of the grammar is a 4 x 4 matrix, so the cost to go behind each
run and the state in which it starts are found from those matrices alone. Inside a run
the search goes leg by leg (``LEG`` rows) in the same way. Texts stay out of all this;
only the rows that are kept meet their text again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import positions
from .common import cut

BLOCK = 4096          # consecutive rows searched together in one task
LEG = 12              # rows searched at once; longer runs are chains of legs
DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
_WHITE = " \t\n\x0b\x0c\r"
_FAR = float("inf")

# States of the grammar: nothing yet, after system, after user, after assistant.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: The turn that an insertion or a new role makes in each state, and the state after it.
_TURN = ("user", "user", "assistant", "user")
_NEXT = (USER, USER, ASSISTANT, USER)
#: States that can follow each state.
_REACH = ((0, 1, 2, 3), (1, 2, 3), (2, 3), (2, 3))
#: What the end of a conversation costs in each state: a pair, or its second half, is inserted.
_END = (0.0, 2.0 * INSERT, 1.0 * INSERT, 0.0)


def _after(state: int, code: str) -> int:
    """The state after a kept row, or -1 where the row cannot follow."""
    role = code.lower()
    if state == USER:
        return ASSISTANT if role == "a" else -1
    if role == "u":
        return USER
    return SYSTEM if role == "s" and state == NOTHING else -1


@lru_cache(maxsize=1 << 14)
def _search(codes: str, start: int, to_go: tuple[float, ...]) -> tuple[float, tuple[str, ...], int]:
    """(cost, edits of each row, last state): the ASCII-least cheapest way through the rows.

    ``codes`` has one letter a row: d for a row that has to go, else the first letter of the
    role (x for other roles), as a capital where the row is truncated. ``to_go[q]`` is what
    remains to be paid when the last row is left in state q.
    """
    n = len(codes)
    least = [0.0] * (n + 1)          # what the rows from here on cost at least
    for i in range(n - 1, -1, -1):
        least[i] = least[i + 1] + (DELETE if codes[i] == "d" or codes[i].isupper() else 0)
    rest = min(to_go)
    bound = least[0] + rest
    edits: list[str] = []
    while True:
        failed: dict[tuple[int, int], float] = {}
        over = _FAR

        def walk(i: int, state: int, left: float) -> int:
            """The last state of the first path that ends within ``left``, or -1."""
            nonlocal over
            need = to_go[state] if i == n else least[i] + rest
            if need > left:
                over = min(over, need - left)
                return -1
            if i == n:
                return state
            if failed.get((i, state), -1.0) >= left:
                return -1
            code = codes[i]
            edits.append("D")
            end = walk(i + 1, state, left - DELETE)
            if end < 0:
                edits[-1] = "I"
                end = walk(i, _NEXT[state], left - INSERT)
            if end < 0 and code != "d":
                extra = TRUNCATED if code.isupper() else 0
                kept = _after(state, code)
                if kept >= 0:
                    edits[-1] = "K"
                    end = walk(i + 1, kept, left - extra)
                if end < 0:
                    edits[-1] = "R"
                    end = walk(i + 1, _NEXT[state], left - REROLE - extra)
            if end < 0:
                edits.pop()
                failed[i, state] = left
            return end

        end = walk(0, start, bound)
        if end >= 0:
            text, rows, begun = "".join(edits), [], 0
            for k, letter in enumerate(text):
                if letter != "I":
                    rows.append(text[begun:k + 1])
                    begun = k + 1
            return bound, tuple(rows), end
        bound += over


@lru_cache(maxsize=1 << 14)
def _leg_costs(codes: str) -> tuple[tuple[float, ...], ...]:
    """Cost of a leg from each state (row) to each state (column)."""
    out = [[_FAR] * 4 for _ in range(4)]
    for start in range(4):
        for end in _REACH[start]:
            if end == SYSTEM and start == NOTHING and "s" not in codes.lower():
                continue
            only = tuple(0.0 if q == end else _FAR for q in range(4))
            out[start][end] = _search(codes, start, only)[0]
    return tuple(tuple(r) for r in out)


def _then(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Cost matrix of one run followed by another."""
    return (first[:, :, None] + second[None, :, :]).min(axis=1)


def _legs(codes: str) -> list[str]:
    return [codes[k:k + LEG] for k in range(0, len(codes), LEG)]


def run_costs(codes: str) -> np.ndarray:
    """Cost of a run of any length between any two states."""
    out = np.where(np.eye(4, dtype=bool), 0.0, _FAR)
    for leg in _legs(codes):
        out = _then(out, np.array(_leg_costs(leg)))
    return out


def solve(codes: str, start: int = NOTHING, to_go: tuple[float, ...] = _END
          ) -> tuple[float, list[str], int]:
    """``_search`` for a run of any length: leg after leg, each with the exact cost behind it."""
    legs = _legs(codes)
    behind = [np.array(to_go)]
    for leg in reversed(legs[1:]):
        behind.append((np.array(_leg_costs(leg)) + behind[-1][None, :]).min(axis=1))
    edits: list[str] = []
    state, total = start, None
    for leg in legs:
        ahead = behind.pop()
        floor = float(ahead.min())
        # Only differences matter to the search, so alike legs share one cached answer.
        cost, found, state = _search(leg, state, tuple(float(c) - floor for c in ahead))
        total = cost + floor if total is None else total
        edits += found
    return total if total is not None else float(to_go[start]), edits, state


def _runs(group: pa.Table) -> tuple[list[str], str, list[tuple[int, int]]]:
    """The rows of a group are consecutive; its conversations are its runs: key, codes, ranges."""
    group = group.sort_by("place")
    keys = group.column("conv").to_pylist()
    first = [k for k in range(len(keys)) if k == 0 or keys[k] != keys[k - 1]]
    return keys, "".join(group.column("code").to_pylist()), list(zip(first, [*first[1:], len(keys)], strict=True))


def _border_costs(group: pa.Table) -> pa.Table:
    """The first and last run of a group, which may go on in its neighbours, with their matrices."""
    keys, codes, runs = _runs(group)
    block = group.column("block")[0].as_py()
    out = [(keys[a], block, run_costs(codes[a:b]).ravel().tolist()) for a, b in dict.fromkeys((runs[0], runs[-1]))]
    return pa.table({"conv": [r[0] for r in out], "block": pa.array([r[1] for r in out], pa.int64()),
                     "costs": pa.array([r[2] for r in out], pa.list_(pa.float64()))})


def _costs_to_go(runs: pd.DataFrame) -> pd.DataFrame:
    """What remains to be paid behind each run of one conversation; one row per ``BLOCK`` rows."""
    runs = runs.sort_values("block")
    ahead, out = np.array(_END), []
    for costs in reversed(runs["costs"].tolist()):
        out.append(ahead.tolist())
        ahead = (np.array(costs).reshape(4, 4) + ahead[None, :]).min(axis=1)
    return pd.DataFrame({"conv": runs["conv"], "block": runs["block"], "to_go": out[::-1],
                         "whole": len(runs) == 1})


def _edits(group: pa.Table) -> pa.Table:
    """Edits of every row, from each state in which its run may start, and the run's last states."""
    keys, codes, runs = _runs(group)
    group = group.sort_by("place")
    to_go, whole = group.column("to_go").to_pylist(), group.column("whole").to_pylist()
    edits: list[list[str]] = []
    ends: list[list[int] | None] = []
    for a, b in runs:
        alone = whole[a] is None or whole[a]
        ahead = _END if to_go[a] is None else tuple(to_go[a])
        ways = [solve(codes[a:b], start, ahead) for start in ((NOTHING,) if alone else range(4))]
        edits += [list(x) for x in zip(*(w[1] for w in ways), strict=True)]
        ends += [None if alone else [w[2] for w in ways]] + [None] * (b - a - 1)
    return pa.table({"conv": keys, "place": group.column("place"), "block": group.column("block"),
                     "edits": pa.array(edits, pa.list_(pa.string())), "ends": pa.array(ends, pa.list_(pa.int64()))})


def _starts(runs: pd.DataFrame) -> pd.DataFrame:
    """The state in which each run of one conversation starts; one row per ``BLOCK`` rows."""
    runs = runs.sort_values("block")
    state, out = NOTHING, []
    for ends in runs["ends"].tolist():
        out.append(state)
        state = int(ends[state])
    return pd.DataFrame({"conv": runs["conv"], "block": runs["block"], "start": out})


def damage(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
           role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Test damage by crc32 of ``conv:turn`` modulo 20: 0 drops a row, 1 empties its text, 2 removes its
    full stops, exclamation and question marks, 3 repeats it, 4 makes it the user's. Nulls read as a space."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (conv_col, turn_col)])
    kind = F.crc32(key.cast("binary")) % 20
    text = F.coalesce(F.col(text_col), F.lit(" "))
    return (conversations.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"),
                                 F.coalesce(F.col(role_col), F.lit(" ")).alias("role"), text.alias("text"),
                                 kind.alias("kind"))
            .filter("kind <> 0")
            .withColumn("text", F.expr("CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END"))
            .withColumn("role", F.expr("CASE kind WHEN 4 THEN 'user' ELSE role END"))
            .withColumn("copy", F.explode(F.expr("CASE kind WHEN 3 THEN array(0, 1) ELSE array(0) END")))
            .drop("kind", "copy"))


def _keyed(df: DataFrame) -> DataFrame:
    """``conv`` names a conversation without nulls."""
    return df.withColumn("conv", F.expr("CASE WHEN conv_id IS NULL THEN 'n' ELSE concat('s', conv_id) END"))


def repair(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
           role_col: str = "role", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per input row: conv_id, conv, place, turn, role, fault, edits, text.

    place: position over all conversations (by conversation, then turn, nulls first, then role
    and SHA-256 of the text). fault: blank, duplicate, truncated or null. edits: the letters
    of the row's edits, insertions before it first (those behind the last row of a conversation
    follow from its last state, see ``_replay``). text: of rows that stay, else null.
    ``digests`` gives one row per conversation.

    Null roles and texts read as one space, so a null text is blank. A null conversation id is
    one conversation. Repeated rows (equal in all four) are duplicates of the first. Only
    rows are seen here: a conversation without any row has no row. An empty table gives an empty
    result. Other columns are ignored, whatever their names.
    """
    rows = _keyed(conversations.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit(" ")).alias("role"), F.coalesce(F.col(text_col), F.lit(" ")).alias("text")))
    rows = rows.withColumn("digest", F.sha2("text", 256))
    bare = F.rtrim(F.col("text"), F.lit(_WHITE))
    narrow = rows.select(
        "conv_id", "conv", "turn", "role", "digest", (bare == "").alias("blank"),
        (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("truncated"))
    placed = positions(narrow, "conv", F.col("turn").asc_nulls_first(), "role", "digest", name="place")
    same = ["conv", "role", "digest"]
    # Only what repeats is sent back to the rows; counted before anything meets.
    first = (placed.filter("NOT blank").groupBy(*same).agg(F.min("place").alias("first"), F.count("*").alias("n"))
             .filter("n > 1").drop("n"))
    role = F.substring("role", 1, 1)
    letter = F.when(role.isin("s", "u", "a"), role).otherwise("x")
    marked = (placed.join(first, same, "left")
              .withColumn("fault", F.expr("CASE WHEN blank THEN 'blank' WHEN place > first THEN 'duplicate' "
                                          "WHEN truncated THEN 'truncated' END"))
              .withColumn("code", F.when(F.col("fault").isin("blank", "duplicate"), "d")
                          .when(F.col("fault") == "truncated", F.upper(letter)).otherwise(letter))
              .withColumn("block", F.expr(f"place div {int(block)}"))
              .select("conv_id", "conv", "turn", "role", "digest", "fault", "code", "place", "block"))
    marked = cut(marked)
    codes = marked.select("conv", "place", "block", "code")
    costs = codes.groupBy("block").applyInArrow(_border_costs, "conv string, block long, costs array<double>")
    to_go = costs.groupBy("conv").applyInPandas(
        _costs_to_go, "conv string, block long, to_go array<double>, whole boolean")
    found = cut(codes.join(to_go, ["conv", "block"], "left").groupBy("block").applyInArrow(
        _edits, "conv string, place long, block long, edits array<string>, ends array<long>"))
    starts = (found.filter("ends IS NOT NULL").select("conv", "block", "ends")
              .groupBy("conv").applyInPandas(_starts, "conv string, block long, start int"))
    edits = (found.join(starts, ["conv", "block"], "left")
             .select("place", F.expr("element_at(edits, coalesce(start, 0) + 1)").alias("edits")))
    edited = cut(marked.drop("block", "code").join(edits, "place"))
    # Rows that stay are the first of their kind, so their key is unique on both sides.
    name = ["conv", "turn", "role", "digest"]
    stays = edited.filter(~F.col("edits").endswith("D")).select("place", *name)
    texts = rows.select(*name, "text").groupBy(*name).agg(F.first("text").alias("text"))
    same_row = F.lit(True)
    t = texts.select(*[F.col(c).alias(f"t_{c}") for c in name], "text")
    for c in name:
        same_row = same_row & (stays[c].eqNullSafe(t[f"t_{c}"]) if c == "turn" else stays[c] == t[f"t_{c}"])
    kept = stays.join(t, same_row).select("place", "text")
    return edited.join(kept, "place", "left").select(
        "conv_id", "conv", "place", "turn", "role", "fault", "edits", "text")


def _replay(state: int, edits: str, role: str, text: str | None, last: bool) -> tuple[int, str, list[tuple[str, str]]]:
    """The turns that one row becomes; ``last`` adds what is inserted behind a conversation."""
    turns = []
    for letter in edits:
        if letter == "I":
            turns.append((_TURN[state], ""))
            state = _NEXT[state]
        elif letter == "K":
            turns.append((role, text))
            state = _after(state, role[:1])
        elif letter == "R":
            turns.append((_TURN[state], text))
            state = _NEXT[state]
    while last and state in (SYSTEM, USER):
        turns.append((_TURN[state], ""))
        state = _NEXT[state]
        edits += "I"
    return state, edits, turns


class _Conversation:
    """Running digest of one conversation; what it holds grows by a letter a row, never by texts."""

    def __init__(self, conv: str):
        self.conv, self.state, self.audit = conv, NOTHING, []
        self.faults = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        self.illegal = self.turns = self.cost = self.count = 0
        self.low = self.high = self.before = self.pending = None
        self.hash = hashlib.sha256()

    def add(self, turn, role, fault, edits, text) -> None:
        self._settle(False)
        if fault:
            self.faults[fault] += 1
        if self.before is not None and self.before + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = role[:1]
        if turn is not None and turn != self.high:       # rows come by turn
            self.low = turn if self.low is None else self.low
            self.high, self.turns = turn, self.turns + 1
        self.pending = (fault, edits, role, text)

    def _settle(self, last: bool) -> None:
        if self.pending is None:
            return
        fault, edits, role, text = self.pending
        self.state, edits, turns = _replay(self.state, edits, role, text, last)
        self.audit.append(edits)
        self.cost += (edits.count("D") * DELETE + edits.count("I") * INSERT + edits.count("R") * REROLE
                      + (TRUNCATED if fault == "truncated" and "D" not in edits else 0))
        for r, t in turns:
            self.hash.update(f"{chr(10) if self.count else ''}{r}:".encode())
            self.hash.update(t.encode())
            self.count += 1
        self.pending = None

    def row(self) -> tuple:
        self._settle(True)
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.conv, gaps, *self.faults.values(), self.illegal, self.cost, "".join(self.audit),
                self.hash.hexdigest())


_DIGEST = pa.schema([("conv", pa.string()), *[(c, pa.int64()) for c in (
    "gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string()),
    ("repaired_sha256", pa.string())])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation from rows sorted by place; texts pass by once."""
    now, out = None, []
    for batch in batches:
        for conv, *row in zip(*(batch.column(c).to_pylist() for c in (
                "conv", "turn", "role", "fault", "edits", "text")), strict=True):
            if now is None or now.conv != conv:
                if now is not None:
                    out.append(now.row())
                now = _Conversation(conv)
            now.add(*row)
        if len(out) >= 4096:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _DIGEST, strict=True)], schema=_DIGEST)
            out = []
    if now is not None:
        out.append(now.row())
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _DIGEST, strict=True)], schema=_DIGEST)


def digests(repaired: DataFrame) -> DataFrame:
    """One row per conversation of ``repair``: conv, gaps, blank, duplicate, truncated, illegal, cost,
    audit, repaired_sha256.

    A hash over a whole conversation has to be fed in order, so a conversation is one task's; its
    rows are sorted on disk and pass by one after the other, however many they are.
    """
    return (repaired.select("conv", "place", "turn", "role", "fault", "edits", "text")
            .repartition("conv").sortWithinPartitions("conv", "place")
            .mapInArrow(_digest, "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, "
                                 "cost long, audit string, repaired_sha256 string"))


def conversation_report(conversations: DataFrame, rows: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """``digests`` of ``rows`` for every conversation of ``conversations``, null id included; one without
    rows has zeros, an empty audit and the hash of the empty string."""
    every = _keyed(conversations.select(F.col(conv_col).alias("conv_id")).distinct())
    found = digests(repair(rows))
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in (
        "gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.join(found, "conv", "left").select(
        "conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
