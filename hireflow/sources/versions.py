"""A log of table versions: which folder holds each table, version by version.

A batch writes the tables it changes into a folder of its own and then publishes a manifest
that names, for every table, the folder that holds it from now on. The manifest is written
aside and renamed into place, which fails if the version is there already, so a version
appears whole or not at all, and two batches that started from the same version cannot both
win. A batch that dies before the rename leaves files that no manifest names; readers go on
seeing the version before. Old versions stay readable.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_BUCKET = "_bucket"


class VersionTaken(RuntimeError):
    """Another batch has published the version first; run again from the new one."""


class VersionLog:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _file(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/versions/{name}")

    def _files(self):
        root = self._file("x")
        return self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(
            root.toUri(), self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Published versions, oldest first. One small file each."""
        folder = self._file("x").getParent()
        files = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(folder):
            return []
        names = [f.getPath().getName() for f in files.listStatus(folder)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def latest(self) -> int:
        """The newest version, 0 before the first."""
        return max(self.versions(), default=0)

    def manifest(self, version: int | None = None) -> dict[str, str]:
        """table -> folder at ``version`` (by default the latest); version 0 holds nothing."""
        version = self.latest() if version is None else version
        if version == 0:
            return {}
        (line,) = self.spark.read.text(f"{self.path}/versions/v{version:012d}.json", wholetext=True).collect()
        return json.loads(line.value)

    def read(self, table: str, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(self.manifest(version)[table])

    def open(self, base, version: int | None = None):
        """``base`` (a Domain) with the tables as of ``version``; tables never written are base's."""
        tables = self.manifest(version)
        return base.with_tables(**{t: self.spark.read.parquet(p) for t, p in tables.items()}) if tables else base

    def new_folder(self) -> str:
        return f"{self.path}/data/{uuid.uuid4().hex}"

    def commit(self, frames: dict[str, DataFrame], since: int) -> int:
        """Write ``frames`` as the version after ``since``; the other tables stay where they are."""
        folder = self.new_folder()
        for table, df in frames.items():
            df.write.parquet(f"{folder}/{table}")
        return self.point({t: f"{folder}/{t}" for t in frames}, since)

    def point(self, folders: dict[str, str], since: int) -> int:
        """Publish the version after ``since`` in which ``folders`` hold the tables they name."""
        self._publish(since + 1, json.dumps(self.manifest(since) | folders, sort_keys=True))
        return since + 1

    def _publish(self, version: int, text: str) -> None:
        jvm, files = self.spark._jvm, self._files()
        aside, final = self._file(f".{uuid.uuid4().hex}"), self._file(f"v{version:012d}.json")
        store = aside.getFileSystem(self.spark._jsc.hadoopConfiguration())
        out = store.create(aside, False)
        try:
            out.write(text.encode())
        finally:
            out.close()
        never = self.spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        never[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            files.rename(aside, final, never)
        except Py4JJavaError as e:
            store.delete(aside, False)
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                raise VersionTaken(f"version {version} exists") from e
            raise

    def run(self, base, route: Callable[..., dict[str, DataFrame]]) -> int:
        """One batch: ``route`` on the latest version, its snapshots published as the next."""
        since = self.latest()
        return self.commit(route(self.open(base, since)), since)


class BucketedTable:
    """A table on a log in ``buckets`` parts by a hash of its key; a change rewrites the parts it touches.

    Each part is a folder that the manifest names, so a version shares the untouched parts with the
    one before, file by file.
    """

    def __init__(self, log: VersionLog, table: str, key: str, buckets: int = 64):
        self.log, self.table, self.key, self.buckets = log, table, key, buckets

    def _write(self, df: DataFrame) -> str:
        folder = f"{self.log.new_folder()}/{self.table}"
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets))
        dealt = df.withColumn(_BUCKET, bucket).repartition(_BUCKET)
        dealt.write.partitionBy(_BUCKET).parquet(folder)
        return folder

    def _paths(self, version: int | None) -> dict[int, str]:
        start = f"{self.table}/"
        return {int(t[len(start):]): p for t, p in self.log.manifest(version).items() if t.startswith(start)}

    def create(self, df: DataFrame, since: int = 0) -> int:
        """The whole table as the version after ``since``. Parts without rows have no folder."""
        folder = self._write(df)
        parts = self.log.spark.read.parquet(folder).select(_BUCKET).distinct().collect()     # at most ``buckets``
        return self.log.point({f"{self.table}/{b}": f"{folder}/{_BUCKET}={b}" for (b,) in parts}, since)

    def read(self, version: int | None = None) -> DataFrame:
        return self.log.spark.read.parquet(*self._paths(version).values())

    def update(self, changes: DataFrame, since: int, apply) -> int:
        """The version after ``since`` with ``apply(rows, changes)`` on the parts that hold a key of ``changes``.

        ``changes`` is read twice; ``apply`` keeps the keys. Changes to keys without a part are dropped.
        """
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets))
        touched = {b for (b,) in changes.select(bucket).distinct().collect()}                  # at most ``buckets``
        paths = {b: p for b, p in self._paths(since).items() if b in touched}
        if not paths:
            return self.log.point({}, since)
        folder = self._write(apply(self.log.spark.read.parquet(*paths.values()), changes))
        return self.log.point({f"{self.table}/{b}": f"{folder}/{_BUCKET}={b}" for b in paths}, since)
