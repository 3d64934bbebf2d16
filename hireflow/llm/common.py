"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: Whether shuffle files are removed at the end of the execution that wrote them.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and forget its lineage.

    Its shuffle files go as soon as it is written, not when the driver's JVM next collects
    garbage. ``df`` itself keeps its own: what runs here is a plan that nobody else holds.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        return df.select("*").checkpoint()
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def width(spark: SparkSession) -> int:
    """Partition count of a shuffle, as the cluster is set up."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")),
               spark.sparkContext.defaultParallelism)


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """Names a row by its id and its text: equal rows share a key and a result.

    Ids may be null or repeated, so an id alone does not name a row.
    """
    return F.md5(F.concat_ws("\x00", F.coalesce(F.col(id_col).cast("string"), F.lit("null")),
                             F.coalesce(F.col(text_col), F.lit("\x01"))))


def flag_table(flags: DataFrame, n: int) -> np.ndarray:
    """n flags, up where the one column of ``flags`` names them. Spark sets them in words of 64,
    so n / 64 rows reach the driver at most, whatever the number of rows."""
    words = (flags.toDF("flag").groupBy(F.expr("shiftright(flag, 6)").alias("word"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(flag & 63 as int))")).alias("bits")).collect())
    table = np.zeros(-(-n // 64), np.int64)
    table[[r.word for r in words]] = [r.bits for r in words]
    return np.unpackbits(table.view(np.uint8), bitorder="little").astype(bool)[:n]
