"""Transcript parsing with a hidden Markov model, and canonical turn rendering.

A transcript is text in numbered parts. Each line is seen as a few features: which
role's marker it opens with (if any), whether a blank line, the start of a part or
that of the transcript stands before it, how long it is and how it ends. The hidden states are
role x (first line of a turn, later line). Viterbi finds the best states; runs of them
are the turns, which are rendered in one canonical form without their markers.

A transcript may be of any length, and so may each of its parts. Lines get a position over
all transcripts, and ``BLOCK`` consecutive positions are a block. For each
block of a transcript a task finds the best score between every state before it and every state at
its end (a product of matrices in the max-plus algebra); these small matrices are
chained per transcript, which fixes the states at block ends; then each block's own
path follows. The result is that of one Viterbi pass over the whole transcript.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranking import positions
from .common import cut

ROLES = ("system", "user", "assistant")
#: Spellings of speaker markers, by role.
SPELLINGS = {"system": ("system", "instructions"), "user": ("user", "human", "question", "q", "prompt"),
             "assistant": ("assistant", "ai", "bot", "answer", "a", "model")}
BLOCK = 4096          # lines
#: Sizes of the features: marker, what stands before, length, ending.
SHAPE = (len(ROLES) + 1, 4, 3, 3)
BLEND = 0.02
STATES = 2 * len(ROLES)          # 2 r: first line of role r's turn, 2 r + 1: a later line


def _marker(role: str) -> str:
    names = "|".join(SPELLINGS[role])
    return rf"(?i)^\s*(?:<\|(?:{names})\|>|\[(?:{names})\]|#{{1,4}} *(?:{names})\b:?|(?:{names}) *:)\s*"


def _lines(parts: DataFrame) -> DataFrame:
    """conv_id, part, line, text and the features of every line that is not blank.

    Lines are numbered from 1. What stands before a line is found before the lines part, so that none
    carries more than itself and the end of the one before.
    """
    every = parts.select("conv_id", "part", F.split("text", "\n").alias("every"))
    lines = F.transform(F.sequence(F.lit(1), F.size("every")), lambda i: F.struct(
        i.alias("line"), F.get("every", i - 1).alias("text"),
        F.when(i > 1, F.trim(F.get("every", i - 2)) == "").alias("after_blank")))
    split = every.select("conv_id", "part", F.explode(lines).alias("l")).select("conv_id", "part", "l.*")
    blank = lambda c: F.trim(c) == ""
    marker = F.lit(0)
    for k, role in enumerate(ROLES, 1):
        marker = F.when(F.col("text").rlike(_marker(role)), k).otherwise(marker)
    before = F.when(F.col("line") == 1, F.when(F.col("part") == F.col("first_part"), 2).otherwise(3)).when(
        F.col("after_blank"), 1).otherwise(0)
    firsts = parts.groupBy("conv_id").agg(F.min("part").alias("first_part"))
    n = F.length("text")
    return (split.filter(~blank(F.col("text"))).join(firsts, "conv_id")
            .select("conv_id", "part", "line", "text",
                    marker.alias("marker"), before.alias("before"),
                    F.when(n < 40, 0).when(n < 160, 1).otherwise(2).alias("length"),
                    F.when(F.col("text").rlike(r"\?\s*$"), 0).when(F.col("text").rlike(r"[.!:]\s*$"), 1)
                    .otherwise(2).alias("ending")))


class Model:
    """Log probabilities: start (STATES), move (STATES x STATES), emit (one table per feature)."""

    def __init__(self, start, move, emit):
        self.start, self.move, self.emit = start, move, emit

    def scores(self, table: pa.Table) -> np.ndarray:
        """Log probability of each line's features in each state."""
        return sum(self.emit[k][:, table.column(c).to_numpy()].T
                   for k, c in enumerate(("marker", "before", "length", "ending")))

    def steps(self) -> np.ndarray:
        """Moves from each state; the last row is the start of a transcript."""
        return np.vstack([self.move, self.start])


def fit(parts: DataFrame) -> Model:
    """A model from labelled parts (conv_id, part, text, role): each part is one turn.

    Only counts reach the driver: at most a few dozen rows, whatever the table's size.
    Neighbouring parts meet in an equi-join on (conv_id, part), not in a window.
    """
    role = F.array_position(F.array(*[F.lit(r) for r in ROLES]), F.col("role")) - 1
    known = parts.filter(F.col("role").isin(*ROLES)).withColumn("r", role.cast("int"))
    lines = _lines(parts).join(known.select("conv_id", "part", "r"), ["conv_id", "part"])
    lines = lines.join(lines.groupBy("conv_id", "part").agg(F.min("line").alias("head")), ["conv_id", "part"])
    state = 2 * F.col("r") + F.when(F.col("line") == F.col("head"), 0).otherwise(1)
    seen = lines.groupBy(state.alias("s"), "marker", "before", "length", "ending").agg(F.count("*").alias("n")).collect()
    emit = [np.zeros((STATES, k)) for k in SHAPE]
    for r in seen:
        for k, c in enumerate(("marker", "before", "length", "ending")):
            emit[k][r.s, r[c]] += r.n
    # Shares of a state, mixed with a little of those of all lines: what no line has tells nothing, also
    # about a state that was seldom seen.
    emit = [(1 - BLEND) * t / np.maximum(1, t.sum(axis=1, keepdims=True)) + BLEND * (t.sum(axis=0) + 1) / (t.sum() + t.shape[1])
            for t in emit]
    blank, plain = 1, 0
    if not any(r.before == blank for r in seen):         # without blank lines to learn from, they are plain ones
        emit[1][:, blank] = emit[1][:, plain] / 10
    start, move = np.ones(STATES), np.ones((STATES, STATES))
    per = lines.groupBy("conv_id", "part", "r").agg(F.count("*").alias("lines"))
    for r in per.groupBy("r").agg(F.count("*").alias("n"), F.sum("lines").alias("lines")).collect():
        inner = r.lines - r.n
        move[2 * r.r, 2 * r.r + 1] += min(r.n, inner)
        move[2 * r.r + 1, 2 * r.r + 1] += max(0, inner - r.n)
    after = per.select("conv_id", (F.col("part") + 1).alias("part"), F.col("r").alias("from"),
                       (F.col("lines") > 1).cast("int").alias("inside"))
    for r in per.join(after, ["conv_id", "part"], "left").groupBy("from", "inside", "r").agg(
            F.count("*").alias("n")).collect():
        if r["from"] is None:
            start[2 * r.r] += r.n
        else:
            move[2 * r["from"] + r.inside, 2 * r.r] += r.n
    for r in range(len(ROLES)):                      # a later line follows its own turn only
        start[2 * r + 1] = 1e-9
        for s in range(STATES):
            if s // 2 != r:
                move[s, 2 * r + 1] = 1e-9
    norm = lambda x: np.log(x / x.sum(axis=-1, keepdims=True))
    return Model(norm(start), norm(move), [norm(e) for e in emit])


def _ordered(table: pa.Table) -> pa.Table:
    return table.sort_by([("part", "ascending"), ("line", "ascending")])


def _matrix(start, move, emit):
    """A block's best scores from each state before it (or the start) to each state at its end."""
    def run(table: pa.Table) -> pa.Table:
        model = Model(start, move, emit)
        score = model.scores(_ordered(table))
        best = model.steps() + score[0]
        for line in score[1:]:
            best = (best[:, :, None] + model.move[None]).max(axis=1) + line
        return pa.table({"conv_id": table.column("conv_id").slice(0, 1), "block": table.column("block").slice(0, 1),
                         "matrix": pa.array([best.ravel().tolist()], pa.list_(pa.float64()))})
    return run


def _chain(table: pa.Table) -> pa.Table:
    """The state before and at the end of each block of one transcript (STATES: its start)."""
    table = table.sort_by("block")
    matrices = [np.array(m).reshape(STATES + 1, STATES) for m in table.column("matrix").to_pylist()]
    value, back = matrices[0][STATES], []
    for m in matrices[1:]:
        total = value[:, None] + m[:STATES]
        back.append(total.argmax(axis=0))
        value = total.max(axis=0)
    ends = [int(value.argmax())]
    for b in reversed(back):
        ends.append(int(b[ends[-1]]))
    ends.reverse()
    return pa.table({"conv_id": table.column("conv_id"), "block": table.column("block"),
                     "enter": pa.array([STATES, *ends[:-1]], pa.int32()), "leave": pa.array(ends, pa.int32())})


def _path(start, move, emit):
    """The best states of a block's lines between its two fixed ends."""
    def run(table: pa.Table) -> pa.Table:
        model = Model(start, move, emit)
        table = _ordered(table)
        score = model.scores(table)
        value, back = model.steps()[table.column("enter")[0].as_py()] + score[0], []
        for line in score[1:]:
            total = value[:, None] + model.move
            back.append(total.argmax(axis=0))
            value = total.max(axis=0) + line
        states = [table.column("leave")[0].as_py()]
        for b in reversed(back):
            states.append(int(b[states[-1]]))
        states = np.array(states[::-1])
        return pa.table({"conv_id": table.column("conv_id"), "block": table.column("block"),
                         "part": table.column("part"), "line": table.column("line"), "text": table.column("text"),
                         "role": pa.array([ROLES[s // 2] for s in states]),
                         "head": pa.array(states % 2 == 0),
                         "turn_in_block": pa.array(np.cumsum(states % 2 == 0), pa.int64())})
    return run


def _rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|im_start|>"), role, F.lit("\n"), text, F.lit("<|im_end|>"))


def parse_transcripts(parts: DataFrame, model: Model) -> DataFrame:
    """conv_id, turn_no, role, text, n_lines, rendered: one row per recovered turn.

    Input: conv_id, part (order in the transcript), text. A turn's text keeps its lines as they are,
    blank lines and indentation inside it included (a blank line comes back empty); its marker, and
    blank space at its end, go. Null and empty parts have no lines, and a transcript without lines gives no turn.
    Rows with a null conv_id or part belong to no transcript and are left out. Rows that
    repeat a (conv_id, part) are all read, in the order of their texts. Other columns
    are ignored, whatever their names.
    """
    given = parts.filter("conv_id is not null and part is not null").select(
        "conv_id", F.col("part").cast("long").alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    joined = given.groupBy("conv_id", "part").agg(F.array_join(F.array_sort(F.collect_list("text")), "\n").alias("text"))
    lines = (positions(_lines(joined), "conv_id", "part", "line", name="at")
             .withColumn("block", F.expr(f"at div {BLOCK}")).drop("at"))
    id_type = parts.schema["conv_id"].dataType.simpleString()
    args = (model.start, model.move, model.emit)
    ends = (lines.groupBy("conv_id", "block").applyInArrow(
        _matrix(*args), f"conv_id {id_type}, block long, matrix array<double>")
        .groupBy("conv_id").applyInArrow(_chain, f"conv_id {id_type}, block long, enter int, leave int"))
    found = cut(lines.join(ends, ["conv_id", "block"]).groupBy("conv_id", "block").applyInArrow(
        _path(*args), f"conv_id {id_type}, block long, part long, line int, text string, role string, "
        "head boolean, turn_in_block long"))
    # Turns are numbered through: a block's first ones continue the count of those before it.
    upto = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    later = found.groupBy("conv_id", "block").agg(F.sum(F.col("head").cast("long")).alias("n")).select(
        "conv_id", "block", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
    clean = F.col("text")
    for role in ROLES:
        clean = F.when(F.col("head"), F.regexp_replace(clean, _marker(role), "")).otherwise(clean)
    turns = (found.join(later, ["conv_id", "block"], "left")
             .withColumn("turn_no", F.coalesce("before", F.lit(0)) + F.col("turn_in_block") - 1)
             .withColumn("text", clean)
             .groupBy("conv_id", "turn_no").agg(
                 F.min("role").alias("role"), F.count("*").alias("n_lines"),
                 F.array_sort(F.collect_list(F.struct("part", "line", "text"))).alias("lines")))
    # Lines as they were, with the blank ones between them; a marker alone in its line leaves none.
    gap = lambda x, i: F.when(i == 0, "").when(
        F.get("lines", i - 1)["part"] == x["part"],
        F.repeat(F.lit("\n"), x["line"] - F.get("lines", i - 1)["line"])).otherwise("\n")
    whole = F.array_join(F.transform("lines", lambda x, i: F.concat(gap(x, i), x["text"])), "")
    text = F.regexp_replace(F.regexp_replace(whole, r"\A(?:[^\S\n]*\n)+", ""), r"\s+\z", "")
    return turns.select("conv_id", "turn_no", "role", text.alias("text"), "n_lines").withColumn(
        "rendered", _rendered(F.col("role"), F.col("text")))


def as_transcripts(conversations: DataFrame) -> DataFrame:
    """Raw transcripts from a table of turns (conv_id, turn, role, text).

    Every transcript writes its markers in one of four styles, and one turn in eight
    has lost its marker; which, follows from hashes of the identifiers. Adds nothing
    that tells the role but the marker; ``role`` is kept for fitting and measuring.
    """
    style = F.pmod(F.xxhash64("conv_id"), F.lit(4))
    name = F.element_at(F.create_map(*[F.lit(x) for r in ROLES for x in (r, SPELLINGS[r][1])]), F.col("role"))
    plain = F.coalesce("role", F.lit(""))
    marker = (F.when(style == 0, F.concat(F.initcap(plain), F.lit(": ")))
              .when(style == 1, F.concat(F.lit("<|"), plain, F.lit("|>\n")))
              .when(style == 2, F.concat(F.lit("### "), F.initcap(F.coalesce(name, plain)), F.lit("\n")))
              .otherwise(F.concat(F.lit("["), F.upper(plain), F.lit("] "))))
    lost = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(8)) == 7
    return conversations.select("conv_id", F.col("turn").alias("part"), "role", F.concat(
        F.when(lost, F.lit("")).otherwise(marker), F.coalesce("text", F.lit(""))).alias("text"))
