"""Stored domain: the bound tables written once as bucketed catalog tables.

At scale the domain tables are stored, not re-derived per query. Facts and
their children are bucketed (and sorted) on the key they are joined on most,
with one bucket count for all, so application / interview / offer join on
``application_id`` and student / student_skill / certification on
``student_id`` without any shuffle (sort-merge join over co-located buckets).
``StoredDomain`` has the same interface as ``binding.Domain``, so every
operator runs on it unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .schema import TABLE_NAMES

# table -> bucket (and sort) column
BUCKET_KEYS = {
    "application": "application_id",
    "interview": "application_id",
    "offer": "application_id",
    "student": "student_id",
    "student_skill": "student_id",
    "certification": "student_id",
    "job": "job_id",
    "job_skill": "job_id",
}
EXTRA_TABLES = ("application_request", "status_change")


def materialize(T, database: str, buckets: int = 64,
                names=(*TABLE_NAMES, *EXTRA_TABLES)) -> "StoredDomain":
    """Write every domain table of ``T`` into ``database`` (bucketed where listed)."""
    spark = T.spark
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name in names:
        writer = T.table(name).write.mode("overwrite").format("parquet")
        key = BUCKET_KEYS.get(name)
        if key:
            writer = writer.bucketBy(buckets, key).sortBy(key)
        writer.saveAsTable(f"{database}.{name}")
    return StoredDomain(spark, database)


class StoredDomain:
    """Domain tables read from the catalog (``materialize`` output)."""

    def __init__(self, spark: SparkSession, database: str):
        self.spark = spark
        self.database = database
        self._overrides: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name in self._overrides:
            return self._overrides[name]
        return self.spark.table(f"{self.database}.{name}")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name in ("spark", "database"):
            raise AttributeError(name)
        return self.table(name)

    def with_tables(self, **frames: DataFrame) -> "StoredDomain":
        d = StoredDomain(self.spark, self.database)
        d._overrides = {**self._overrides, **frames}
        return d
