"""Sinks and batch readers.

``publish`` writes the snapshots of one change batch under one directory and
marks it committed last: readers trust a batch only when its marker exists,
so frames that must change together (a profile and its login email) appear
together or not at all. Each table write is a Spark job with the standard
output committer: lost executors just re-run tasks. Nothing is written over
a path a plan still reads — every batch gets a new directory.

``read_batch`` is the typed intake of a batch file (S4): explicit schema, no
inference, PERMISSIVE mode, malformed lines kept aside with their text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir

COMMIT_MARKER = "_COMMITTED"
CORRUPT = "_corrupt_record"


def publish(frames: dict[str, DataFrame], out_dir: str, batch_id: str,
            partition_by: dict[str, list[str]] | None = None) -> str:
    """Write every frame under ``out_dir/batch=<id>/<name>``, then the marker."""
    if not frames:
        raise ValueError("nothing to publish")
    target = f"{out_dir.rstrip('/')}/batch={batch_id}"
    spark = next(iter(frames.values())).sparkSession
    for name, df in frames.items():
        writer = df.write.mode("errorifexists")
        cols = (partition_by or {}).get(name)
        if cols:
            writer = writer.partitionBy(*cols)
        writer.parquet(f"{target}/{name}")
    (spark.createDataFrame([(n,) for n in frames], "table_name string")
     .coalesce(1).write.mode("errorifexists").json(f"{target}/{COMMIT_MARKER}"))
    return target


def read_published(spark: SparkSession, target: str, name: str) -> DataFrame:
    """Read one table of a committed batch (fails if the batch is not committed)."""
    committed = {r.table_name for r in spark.read.json(f"{target}/{COMMIT_MARKER}").collect()}
    if name not in committed:
        raise FileNotFoundError(f"{name} is not part of committed batch {target}")
    return spark.read.parquet(f"{target}/{name}")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut a long lineage with a reliable checkpoint in the shared folder
    named by ``spark.checkpoint.dir`` (never a local checkpoint)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def read_batch(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "csv",
               header: bool = True) -> tuple[DataFrame, DataFrame]:
    """(well-formed rows, malformed rows with their raw text) of a batch file."""
    full = T.StructType(list(schema.fields) + [T.StructField(CORRUPT, T.StringType(), True)])
    reader = (spark.read.schema(full).format(fmt)
              .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT))
    if fmt == "csv":
        reader = reader.option("header", header)
    # Spark refuses queries that touch only the corrupt-record column of a raw
    # file; the parsed batch is materialised once (reliable checkpoint in the
    # shared folder) and both halves are read from it.
    df = checkpointed(reader.load(path))
    good = df.where(F.col(CORRUPT).isNull()).drop(CORRUPT)
    bad = df.where(F.col(CORRUPT).isNotNull())
    return good, bad


def read_batches(spark: SparkSession, paths: dict[str, str], schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(well-formed rows, malformed lines) of batch files in several formats (csv without
    header, json), one path or glob per format.

    Both carry where they come from: ``source_format`` and ``source_file``; a malformed line
    has its text as ``raw``. Each format is parsed once.
    """
    full = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType(), True)])
    parts = [spark.read.schema(full).format(fmt).option("mode", "PERMISSIVE")
             .option("columnNameOfCorruptRecord", CORRUPT).load(path)
             .select(*full.names, F.lit(fmt).alias("source_format"), F.col("_metadata.file_path").alias("source_file"))
             for fmt, path in sorted(paths.items())]
    both = parts[0]
    for more in parts[1:]:
        both = both.unionByName(more)
    both = checkpointed(both)
    return (both.where(F.col(CORRUPT).isNull()).drop(CORRUPT),
            both.where(F.col(CORRUPT).isNotNull()).select("source_format", "source_file", F.col(CORRUPT).alias("raw")))
