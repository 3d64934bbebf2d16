"""Exact deduplication by a content sort.

Sampled splitters (Spark's range partitioner) deal the rows out by content, an
external sort inside each partition places equal texts next to each other, and
neighbours are compared in full: a run of equal ones is a group, and its best
identifier stays. The order of contents is that of their first ``PREFIX`` characters,
then of a hash of the whole, then of the whole text, so the sample that reaches the driver
stays small whatever the length of the texts, and many texts with one beginning still spread.

All rows of a text meet in one partition, unless the text is heavy: one that more rows share
than a fair quarter of a partition. There are fewer than four of those per partition. Their
rows are split by a salt from the identifier, and only their runs meet again, as one
narrow row each.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, width

PREFIX = 64
LIGHT = 64            # a text of so few rows is never split


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                keep: str = "smallest") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical byte for byte; null counts as empty.
    ``keep`` names the identifier that stays: "smallest" or "largest".

    Null identifiers lose against any other; a group of nulls only has a null
    keep_id and keeps one row. Of repeated rows (same id and text) one is kept.
    Empty texts are equal to each other. An empty table gives an empty result;
    other columns of the input are ignored, whatever their names.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep: {keep}")
    best, order = ((F.max, F.col("doc_id").desc_nulls_last()) if keep == "largest"
                   else (F.min, F.col("doc_id").asc_nulls_last()))
    n = width(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).withColumn(
        "head", F.substring("text", 1, PREFIX)).withColumn("hash", F.xxhash64("text"))
    # A hash stands for its rows here, where only their number matters.
    sizes = cut(rows.groupBy("hash").agg(F.count("*").alias("n")))
    every = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    heavy = sizes.filter(F.col("n") * 4 * n > max(every, 4 * n * LIGHT)).select("hash", F.lit(True).alias("heavy"))
    dealt = (rows.join(F.broadcast(heavy), "hash", "left")            # fewer than 4 n rows
             .withColumn("salt", F.when(F.col("heavy"), F.pmod(F.xxhash64("doc_id"), F.lit(n))).otherwise(0))
             .repartitionByRange(n, "head", "hash", "salt"))
    run = Window.partitionBy("head", "hash", "salt", "text")
    runs = cut(dealt.select(
        "doc_id", F.coalesce("heavy", F.lit(False)).alias("heavy"), F.sha2("text", 256).alias("text_sha256"),
        best("doc_id").over(run).alias("keep_id"), F.count("*").over(run).alias("group_size"),
        F.row_number().over(run.orderBy(order)).alias("place")))
    whole = runs.filter("not heavy").select(
        "doc_id", "keep_id", "group_size", (F.col("place") == 1).alias("kept"), "text_sha256")
    split = runs.filter("heavy")
    groups = split.filter("place = 1").groupBy("text_sha256").agg(
        best("keep_id").alias("best_id"), F.sum("group_size").alias("rows"))
    # Each salt's first row has its run's best identifier; equal identifiers share a salt.
    kept = (F.col("place") == 1) & F.col("doc_id").eqNullSafe(F.col("best_id"))
    return whole.unionByName(split.join(F.broadcast(groups), "text_sha256").select(
        "doc_id", F.col("best_id").alias("keep_id"), F.col("rows").alias("group_size"), kept.alias("kept"), "text_sha256"))
