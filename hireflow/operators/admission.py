"""Ordered admission under several unique keys.

Rows claim values of several unique keys (an email, an id). Taken in order, a row gets in
unless an earlier row *that got in* holds one of its values; a row that was refused holds
nothing and blocks nobody. Rows are the nodes and shared values the edges of a conflict
graph, and what gets in is its greedy independent set in the given order.

It is found in rounds over the rows still open. A row that is first on every one of its
values gets in; every open row that shares a value with it is refused. The first row of
all always gets in, so rounds end; as many are needed as decisions hang on one another in a
row (a handful in a random batch). Each round is a few grouped minima with partial
aggregation, so a value that a third of all rows claim costs one row a task, and its result is
checkpointed in the shared folder. Rows without a rival never enter a round.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.snapshot import checkpointed


def _claims(rows: DataFrame, order: str, owner: str, keys: list[list[str]]) -> DataFrame:
    """One row per claimed value: _o (order), _w (owner), _k (number of the key), _v (value)."""
    def claim(k: int, columns: list[str]) -> Column:
        whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
        return F.when(whole, F.struct(F.lit(k).alias("k"), F.to_json(F.struct(*columns)).alias("v")))
    every = F.array_compact(F.array(*[claim(k, c) for k, c in enumerate(keys)]))
    # A row without an owner is its own.
    own = F.coalesce(F.col(owner).cast("string"), F.concat(F.lit("#"), F.col(order).cast("string")))
    return (rows.select(F.col(order).alias("_o"), own.alias("_w"), F.explode(every).alias("_c"))
            .select("_o", "_w", F.col("_c.k").alias("_k"), F.col("_c.v").alias("_v")))


def _two_first(claims: DataFrame) -> DataFrame:
    """Per value: the first row (_o1, owner _w1) and the first of any other owner (_o2)."""
    mine = claims.groupBy("_k", "_v", "_w").agg(F.min("_o").alias("_o"))
    turn = F.row_number().over(Window.partitionBy("_k", "_v").orderBy("_o"))
    two = mine.withColumn("_turn", turn).filter("_turn <= 2")
    return two.groupBy("_k", "_v").agg(
        F.max(F.when(F.col("_turn") == 1, F.col("_o"))).alias("_o1"),
        F.max(F.when(F.col("_turn") == 1, F.col("_w"))).alias("_w1"),
        F.max(F.when(F.col("_turn") == 2, F.col("_o"))).alias("_o2"))


def _earlier_rival() -> Column:
    """A row of another owner comes before this one on the value."""
    return F.coalesce(F.when(F.col("_w") == F.col("_w1"), F.col("_o2")).otherwise(F.col("_o1")) < F.col("_o"), F.lit(False))


def admit_in_order(rows: DataFrame, keys: list[list[str]], order: str = "form_id",
                   owner: str | None = None) -> DataFrame:
    """``rows`` with ``refused_by``: the numbers of the keys (from 0, sorted) on which an earlier
    admitted row of another owner holds the value; empty for admitted rows.

    ``order`` is unique. Rows with the same ``owner`` (by default every row is its own) do not
    refuse each other; a null owner is nobody else's. A key with a null in it claims nothing. ``rows`` should be materialised:
    they are read again for the result. An empty table gives an empty result.
    """
    owner = owner or order
    claims = _claims(rows, order, owner, keys)
    # A value with one owner is contested by nobody; rows without a contested value are in.
    rivals = claims.groupBy("_k", "_v").agg(F.min("_w").alias("_a"), F.max("_w").alias("_b")).filter("_a <> _b")
    contested = claims.join(rivals.select("_k", "_v"), ["_k", "_v"], "left_semi")
    claims = open_ = checkpointed(contested)
    entered = []
    while not open_.isEmpty():
        late = open_.join(_two_first(open_), ["_k", "_v"]).withColumn("_late", _earlier_rival())
        into = late.groupBy("_o").agg(F.max("_late").alias("_late")).filter("NOT _late").select("_o")
        now = checkpointed(open_.join(into, "_o", "left_semi"))
        entered.append(now)
        rest = open_.join(now.select("_o").distinct(), "_o", "left_anti")
        lost = (rest.join(_two_first(now), ["_k", "_v"]).filter(_earlier_rival()).select("_o").distinct())
        open_ = checkpointed(rest.join(lost, "_o", "left_anti"))
    if not entered:
        return rows.withColumn("refused_by", F.array().cast("array<int>"))
    held = reduce(DataFrame.unionByName, entered)
    refused = (claims.join(held.select("_o").distinct(), "_o", "left_anti").join(_two_first(held), ["_k", "_v"])
               .filter(_earlier_rival()).groupBy("_o").agg(F.array_sort(F.collect_set("_k")).alias("refused_by")))
    return (rows.join(refused.withColumnRenamed("_o", order), order, "left")
            .withColumn("refused_by", F.coalesce("refused_by", F.array().cast("array<int>"))))
