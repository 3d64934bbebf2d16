"""A bitmap index of skills over ranked owners.

Owners (students by falling CGPA, jobs by rising minimum) get a position; 65,536
consecutive positions are a block, and per block and skill a bitmap says which of
them have the skill. A question is a set of skills and a ``cut``: how many of the first
``cut`` owners have all the skills asked for (``count_holders``), or have no skill
beyond them (``count_within``). A block's bitmaps answer it with a few word operations
per 64 owners, the cut touches one block only, and counts add up over blocks.

Owners that are asked for in the same way may be one place with a weight (``count_within``):
the answer is then the sum of the weights.

Spark deals out tiles: a block's bitmaps with a chunk of the questions. Questions go to the
blocks before their cut, bitmaps to the chunks (their number follows from the number of
questions); no owner ever meets a question as a row, and no tile grows with the data.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.snapshot import checkpointed

BLOCK = 65_536           # owners of a block
QUESTIONS = 8_192        # sets of skills that a tile answers, about
FEW_SKILLS = 256         # up to so many bitmaps are joined by OR for a set


def bitmaps(owned: DataFrame) -> DataFrame:
    """(block, skill_id, words): rows (place, skill_id) as sparse 64-bit words, at most 1,024 a bitmap."""
    bit = F.expr("shiftleft(CAST(1 AS BIGINT), CAST(place % 64 AS INT))")
    return (owned.select(F.expr(f"place div {BLOCK}").alias("block"), "skill_id",
                         F.expr(f"CAST((place % {BLOCK}) div 64 AS INT)").alias("word"), bit.alias("bit"))
            .groupBy("block", "skill_id", "word").agg(F.bit_or("bit").alias("bits"))
            .groupBy("block", "skill_id").agg(F.collect_list(F.struct("word", "bits")).alias("words")))


def _weights(weighed: DataFrame) -> DataFrame:
    """Weights (place, weight) as rows of the index: no skill, a cell per place."""
    return (weighed.select(F.expr(f"place div {BLOCK}").alias("block"),
                           F.expr(f"CAST(place % {BLOCK} AS INT)").alias("word"), F.col("weight").cast("long").alias("bits"))
            .groupBy("block").agg(F.collect_list(F.struct("word", "bits")).alias("words"))
            .select("block", F.lit(None).cast("long").alias("skill_id"), "words"))


def _dense(index: pa.Table) -> tuple[dict[int, np.ndarray], np.ndarray]:
    """skill -> 1,024 words; the weight of each place (1 unless given)."""
    out, weight = {}, np.ones(BLOCK, np.int64)
    for skill, words in zip(index.column("skill_id").to_pylist(), index.column("words").combine_chunks(), strict=True):
        cells = words.values.flatten()
        if skill is None:
            weight[cells[0].to_numpy()] = cells[1].to_numpy()
            continue
        full = np.zeros(BLOCK // 64, np.uint64)
        full[cells[0].to_numpy()] = cells[1].to_numpy().view(np.uint64)
        out[skill] = full
    return out, weight


def _questions(asked: pa.Table):
    """(rows, skills, cuts inside the block) per distinct set; the rows are sorted by set."""
    block = asked.column("block")[0].as_py()
    asked = asked.sort_by("asked")
    names = asked.column("asked").to_pylist()
    cuts = np.minimum(asked.column("cut").to_numpy() - block * BLOCK, BLOCK)
    first = [k for k in range(len(names)) if k == 0 or names[k] != names[k - 1]]
    skills = asked.column("skills")
    return asked, [(slice(a, b), skills[a].as_py(), cuts[a:b]) for a, b in zip(first, [*first[1:], len(names)], strict=True)]


def _answers(asked: pa.Table, counts: np.ndarray) -> pa.Table:
    return pa.table({"asked": asked.column("asked"), "cut": asked.column("cut"), "n": pa.array(counts, pa.int64())})


def _holders(asked: pa.Table, index: pa.Table) -> pa.Table:
    (of_skill, _), none = _dense(index), np.zeros(BLOCK // 64, np.uint64)
    asked, sets = _questions(asked)
    counts = np.zeros(asked.num_rows, np.int64)
    for rows, skills, cuts in sets:
        found = of_skill.get(skills[0], none)
        for skill in skills[1:]:
            found = found & of_skill.get(skill, none)
        upto = np.concatenate([[0], np.cumsum(np.bitwise_count(found), dtype=np.int64)])
        word, rest = cuts // 64, (cuts % 64).astype(np.uint64)
        part = np.append(found, np.uint64(0))[word] & ((np.uint64(1) << rest) - np.uint64(1))
        counts[rows] = upto[word] + np.bitwise_count(part)
    return _answers(asked, counts)


def _bits(words: np.ndarray) -> np.ndarray:
    return np.unpackbits(words.view(np.uint8), bitorder="little")


def _within(asked: pa.Table, index: pa.Table) -> pa.Table:
    of_skill, weight = _dense(index)
    number = {skill: k for k, skill in enumerate(of_skill)}
    words = np.array(list(of_skill.values()), np.uint64).reshape(len(number), BLOCK // 64)
    at, needed = [], None
    if len(number) > FEW_SKILLS:
        at = [np.flatnonzero(_bits(row)) for row in words]
        needed = np.bincount(np.concatenate(at), minlength=BLOCK).astype(np.int32)
    asked, sets = _questions(asked)
    counts = np.zeros(asked.num_rows, np.int64)
    for rows, skills, cuts in sets:
        last, have = int(cuts.max()), [number[s] for s in set(skills) if s in number]
        if needed is None:                   # an owner fits if no other skill's bitmap has it
            other = np.ones(len(number), bool)
            other[have] = False
            fits = _bits(~np.bitwise_or.reduce(words[other], axis=0, initial=np.uint64(0)))[:last]
        else:                                # an owner fits if all of its skills are taken off
            missing = needed[:last].copy()
            for k in have:
                missing[at[k][:np.searchsorted(at[k], last)]] -= 1
            fits = missing == 0
        places = np.flatnonzero(fits)
        upto = np.concatenate([[0], np.cumsum(weight[places])])
        counts[rows] = upto[np.searchsorted(places, cuts)]
    return _answers(asked, counts)


def _count(questions: DataFrame, index: DataFrame, tile) -> DataFrame:
    asked = F.array_join("skills", ",").alias("asked")
    questions = checkpointed(questions)      # counted, dealt out and joined to the answers
    named = questions.where("cut > 0").select(asked, "skills", "cut").distinct()
    chunks = max(1, math.ceil(named.select("asked").distinct().count() / QUESTIONS))
    dealt = named.select("asked", "skills", "cut", F.pmod(F.xxhash64("asked"), F.lit(chunks)).alias("chunk"),
                         F.explode(F.expr(f"sequence(0L, (cut - 1) div {BLOCK})")).alias("block"))
    copies = index.withColumn("chunk", F.explode(F.expr(f"sequence(0L, {chunks - 1}L)")))
    # A tile is little data and much work: a fixed number of tasks, which adaptive execution would
    # otherwise put together into a few.
    spark = questions.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    dealt, copies = (x.repartition(tasks, "block", "chunk") for x in (dealt, copies))
    answers = (dealt.groupBy("block", "chunk").cogroup(copies.groupBy("block", "chunk"))
               .applyInArrow(tile, "asked string, cut long, n long")
               .groupBy("asked", "cut").agg(F.sum("n").alias("n")))
    return (questions.withColumn("asked", asked).join(answers, ["asked", "cut"], "left")
            .withColumn("n", F.coalesce("n", F.lit(0))).drop("asked"))


def count_holders(questions: DataFrame, owned: DataFrame) -> DataFrame:
    """``questions`` (skills: sorted array, cut) + n: of the first ``cut`` owners those with all the skills.

    ``owned``: (place, skill_id). No skills asked for: all ``cut`` of them. Skills that nobody has give 0.
    """
    some = _count(questions.where(F.size("skills") > 0), bitmaps(owned), _tile(_holders))
    return some.unionByName(questions.where(F.size("skills") == 0).withColumn("n", F.col("cut")))


def count_within(questions: DataFrame, owned: DataFrame, weighed: DataFrame | None = None) -> DataFrame:
    """``questions`` + n: of the first ``cut`` owners those whose skills are all among the given ones.

    ``weighed``: (place, weight), how many owners a place stands for; without it, one each.
    """
    index = bitmaps(owned)
    return _count(questions, index if weighed is None else index.unionByName(_weights(weighed)), _tile(_within))


def _tile(answer):
    def tile(asked: pa.Table, index: pa.Table) -> pa.Table:
        if not asked.num_rows:               # a block that no question reaches
            return pa.table({"asked": pa.array([], pa.string()), "cut": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        return answer(asked, index)
    return tile
