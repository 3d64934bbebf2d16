"""Filters of a set-similarity join over a table of prefix rows.

A prefix row is (key, node, size, place): one of a set's rarest tokens, the set's
name and size, and the token's place in the set's rarity order. Thresholds are
whole percentages, so all comparisons are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

WORDS = 4        # 64-bit words of a set's marks


def prefix_length(size: Column, percent: int) -> Column:
    """How many of a set's rarest tokens a partner must share at least one of."""
    return size - F.ceil(F.lit(percent) * size / 100).cast("long") + 1


def with_marks(listed: DataFrame) -> DataFrame:
    """Adds to each row how many keys its set has here, and a bit map of their hashes.

    Bits of one set that another lacks are tokens that they do not share, so a join on
    a key can drop most pairs before it makes them.
    """
    bit = F.expr("shiftleft(1L, cast(shiftright(key, 2) & 63 as int))")
    marks = listed.groupBy("node").agg(F.count("*").alias("keys"), *[
        F.bit_or(F.when(F.pmod("key", F.lit(WORDS)) == i, bit).otherwise(0)).alias(f"mark{i}")
        for i in range(WORDS)])
    return listed.join(marks, "node")


def may_share_enough(x: str, y: str, percent: int) -> Column:
    """share_enough, from what the bit maps of rows ``x`` and ``y`` leave possible."""
    def most(a: str, b: str) -> Column:
        lacking = sum((F.bit_count(F.col(f"{a}.mark{i}").bitwiseAND(F.bitwise_not(F.col(f"{b}.mark{i}"))))
                       for i in range(WORDS)), F.lit(0))
        return F.col(f"{a}.keys") - lacking
    size = lambda a: F.col(f"{a}.size")
    rest = lambda a: size(a) - F.least(size(a), prefix_length(size(a), percent))
    common = F.least(most(x, y), most(y, x)) + F.greatest(rest(x), rest(y))
    return (100 + percent) * common >= percent * (size(x) + size(y))


def fits(size1, place1, size2, place2, percent: int) -> Column:
    """Length and positional filter for a token that two sets have at these places."""
    size1, place1, size2, place2 = (F.col(c) for c in (size1, place1, size2, place2))
    common = 1 + F.least(place1, place2) + F.least(size1 - place1 - 1, size2 - place2 - 1)
    return ((F.greatest(size1, size2) * percent <= 100 * F.least(size1, size2))
            & ((100 + percent) * common >= percent * (size1 + size2)))


def share_enough(pairs: DataFrame, listed: DataFrame, percent: int) -> DataFrame:
    """Drops pairs (src, dst) that agree on too few of their rarest tokens.

    Of a set's tokens all but those in its prefix may be common to a partner, so the
    intersection is at most the common part of both prefixes plus the larger rest.
    A set without rows in ``listed`` is left to the comparison.
    """
    prefix = cut(listed.groupBy("node").agg(F.first("size").alias("size"), F.collect_list("key").alias("keys")))
    side = lambda n: prefix.select(F.col("node").alias(n), F.col("size").alias(f"{n}_size"),
                                   F.col("keys").alias(f"{n}_keys"))
    rest = lambda n: F.col(f"{n}_size") - F.least(
        F.col(f"{n}_size"), prefix_length(F.col(f"{n}_size"), percent))
    most = F.size(F.array_intersect("src_keys", "dst_keys")) + F.greatest(rest("src"), rest("dst"))
    enough = (100 + percent) * most >= percent * (F.col("src_size") + F.col("dst_size"))
    return (pairs.join(side("src"), "src", "left").join(side("dst"), "dst", "left")
            .filter(F.col("src_size").isNull() | F.col("dst_size").isNull() | enough).select("src", "dst"))
