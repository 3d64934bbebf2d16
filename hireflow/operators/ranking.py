"""Positions and ranks over whole tables, without a window over all rows.

Rows are range-partitioned by the order (sampled splitters), sorted inside their
partition and numbered there; the counts per partition, one row each, are summed up
from the front, and a row's position is the sum before its partition plus its number
inside. What is gathered anywhere is one number per partition, whatever the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.snapshot import checkpointed

# monotonically_increasing_id() keeps a row's partition above its number inside.
_ROW_BITS = 33


def _deal(df: DataFrame, order, parts: int | None) -> DataFrame:
    """``df`` in order over range partitions, materialised; ``_at`` is partition and number inside."""
    spark = df.sparkSession
    n = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return checkpointed(df.withColumn("_tie", F.monotonically_increasing_id())
                        .repartitionByRange(n, *order, "_tie").sortWithinPartitions(*order, "_tie").drop("_tie")
                        .withColumn("_at", F.monotonically_increasing_id())
                        ).withColumn("_part", F.shiftright("_at", _ROW_BITS))


def _before(sums: DataFrame) -> DataFrame:
    """Sum of ``_n`` over the partitions before each. One row per partition (their number is a
    setting), so one task sums them and every task may hold them."""
    return sums.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))


def positions(df: DataFrame, *order: Column | str, name: str = "position", parts: int | None = None) -> DataFrame:
    """``df`` with each row's place (long, from 0) in ``order``.

    The order need not be unique: rows that it leaves equal follow each other in an
    arbitrary order, and many equal rows are split over partitions. The dealt rows are
    materialised once in the shared folder, so a lost executor cannot renumber them;
    ``df`` itself should give the same rows again when it is read twice. An empty table
    gives an empty result. Columns named ``_tie``, ``_at`` and ``_before`` are reserved.
    """
    dealt = _deal(df, order, parts)
    before = _before(dealt.groupBy("_part").agg(F.count("*").alias("_n")))
    inside = F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return (dealt.join(F.broadcast(before), "_part")
            .withColumn(name, (F.col("_before") + inside).cast("long")).drop("_part", "_at", "_before"))


def running_totals(df: DataFrame, value: str, amount: str, name: str = "total", descending: bool = False) -> DataFrame:
    """(value, total): per distinct value the sum of ``amount`` over all rows at or before it.

    Values are summed up with partial aggregation first; the running sum inside a range
    partition starts from the sum of the partitions before it. Null values come last.
    """
    values = df.groupBy(value).agg(F.sum(amount).alias("_n"))
    order = F.col(value).desc_nulls_last() if descending else F.col(value).asc_nulls_last()
    dealt = _deal(values, [order], None)
    before = _before(dealt.groupBy("_part").agg(F.sum("_n").alias("_n")))
    inside = F.sum("_n").over(Window.partitionBy("_part").orderBy("_at")
                              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (dealt.withColumn("_inside", inside).join(F.broadcast(before), "_part")
            .select(value, (F.col("_before") + F.col("_inside")).alias(name)))


def distinct_ranks(df: DataFrame, *columns: str, name: str = "rank", descending: bool = False) -> DataFrame:
    """One row per distinct value of ``columns`` with its dense rank (from 1) and row count ``n``.

    Values are counted with partial aggregation first, so a value that a third of all
    rows hold is one row when the positions are dealt out.
    """
    values = df.groupBy(*columns).agg(F.count("*").alias("n"))
    order = [F.col(c).desc_nulls_last() if descending else F.col(c).asc_nulls_last() for c in columns]
    return positions(values, *order, name=name).withColumn(name, F.col(name) + 1)


def dense_rank(df: DataFrame, *columns: str, name: str = "rank", descending: bool = False) -> DataFrame:
    """``df`` with the dense rank of each row's ``columns``; nulls are one value, ranked last.

    Every other column is kept. The join back is on the ranked values; a hot value is
    split by adaptive execution (its other side is a single row).
    """
    ranks = distinct_ranks(df, *columns, name=name, descending=descending).drop("n")
    keys = ranks.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(columns)], name)
    same = [df[c].eqNullSafe(keys[f"_k{i}"]) for i, c in enumerate(columns)]
    condition = same[0]
    for s in same[1:]:
        condition = condition & s
    return df.join(keys, condition).drop(*[f"_k{i}" for i in range(len(columns))])


def fresh_ids(rows: DataFrame, base: DataFrame, key: str, *order: Column | str) -> DataFrame:
    """``rows`` with ``key``: numbers from the highest of ``base`` on, in ``order``.

    Rows are numbered by positions over materialised range partitions, so a lost task hands out the
    same numbers again and no two rows share one. ``base`` without rows counts as 0.
    """
    highest = base.agg(F.coalesce(F.max(key), F.lit(0)).alias("highest")).scalar()
    return (positions(rows, *order, name="_place").withColumn(key, (F.col("_place") + 1 + highest).cast("long"))
            .drop("_place"))
