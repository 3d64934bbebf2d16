"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang each node's larger (or smaller) neighbours under its least neighbour.

    The minimum is an aggregate with map-side combine, joined back to the edges, so
    a hub's neighbours need not meet in one task.
    """
    if large:
        both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    else:
        both = edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    least = both.groupBy("src").agg(F.min("dst").alias("low")).withColumn("low", F.least("low", "src"))
    hung = both.join(least, "src")
    if large:
        out = hung.filter("dst > src").select(F.col("dst").alias("src"), F.col("low").alias("dst"))
    else:
        out = hung.select(F.col("dst").alias("src"), F.col("low").alias("dst")).unionByName(
            least.select("src", F.col("low").alias("dst")))
    return out.filter("src <> dst").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of an edge table (src, dst); the component is
    its least node. Each round is checkpointed; it ends when a round changes nothing."""
    now = cut(edges.filter("src <> dst").distinct())
    mark = lambda d: d.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
    before = mark(now)
    while before[0]:
        now = cut(_star(_star(now, True), False))
        after = mark(now)
        if tuple(after) == tuple(before):
            break
        before = after
    return now.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionByName(
        now.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct())
