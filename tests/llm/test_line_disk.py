"""What line dedup and ``cut`` keep on disk."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from hireflow.llm import line_dedup as L
from hireflow.llm.common import cut


def _shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for k in range(files.size()) if (name := files.apply(k).getName()).startswith("shuffle_")}


def test_cut_leaves_no_shuffle_files_though_its_input_is_kept(spark):
    before = _shuffle_files(spark)
    counted = spark.range(5000).groupBy((F.col("id") % 97).alias("k")).count()
    out = cut(counted)
    for _ in range(50):
        if not _shuffle_files(spark) - before:
            break
        time.sleep(0.2)
    assert not _shuffle_files(spark) - before
    assert out.count() == 97 and sorted(map(tuple, counted.collect())) == sorted(map(tuple, out.collect()))


def test_asked_lines_are_few_where_many_are_wanted(spark):
    node = F.struct(F.col("id").alias("place"), F.lit(5).alias("tag"), (F.col("id") % 7).cast("int").alias("pos"))
    wanted, others = (spark.range(a, a + 300_000).select(node.alias("node")) for a in (0, 10**9))
    flags = cut(L._flags(wanted)).scalar()
    assert wanted.filter(L._up(flags)).count() == 300_000
    assert others.filter(L._up(flags)).count() < 300_000 // 8
