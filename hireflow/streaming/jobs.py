"""Structured Streaming twins of two request-at-a-time routes.

``stream_admission``     apply requests -> admitted applications + rejects
                         (batch twin: eligibility.admit_applications, E5)
``stream_status_latest`` status changes -> latest valid status per application
                         (batch twin: changes.scoped_status_update, M3)

Both read a directory of parquet files as a stream, keep their progress and
state in a checkpoint under the shared ``spark.checkpoint.dir``, and write
each micro-batch idempotently (one output partition per epoch, overwritten on
replay), so a lost executor or a restarted driver repeats work, never
duplicates it. Run with ``available_now=True`` to drain what is there and
stop (used by the tests and the registry), or continuously.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.changes import apply_updates
from ..operators.eligibility import DEFAULT_AS_OF, REASON_APPLIED, REASON_DUPLICATE, eligibility_pairs
from ..operators.ranking import fresh_ids
from ..sources.schema import APPLICATION_STATUSES
from ..sources.versions import BucketedTable, VersionLog

REQUEST_SCHEMA = "request_id bigint, student_id bigint, job_id bigint, ts timestamp_ntz"
CHANGE_SCHEMA = ("change_id string, application_id bigint, company_id bigint, status string, "
                 "ts timestamp_ntz")


PASSING = 4096      # groups in which refused requests pass the keyed state
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def _rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """A query started inside keeps its state in RocksDB (on disk, changes uploaded to the checkpoint)."""
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(STATE_STORE)
        else:
            spark.conf.set(STATE_STORE, before)


def _start(df: DataFrame, fn, checkpoint: str, available_now: bool, mode: str = "append"
           ) -> StreamingQuery:
    w = df.writeStream.outputMode(mode).foreachBatch(fn).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def _source(spark: SparkSession, schema: str, source_dir: str, max_files: int | None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(source_dir)


class _OnePerPair(StatefulProcessor):
    """Per (student, job): whether a request that the rules let in has been admitted.

    Of the requests of a micro-batch the earliest is decided and the others repeat it; once one has been
    admitted, later ones have applied already. What is held is one flag a pair. Requests that the rules
    refuse need none and pass in large groups, since every call to the store takes its time.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.admitted = handle.getValueState("admitted", "yes boolean")

    def handleInputRows(self, key, rows, timerValues):
        if key[2] is not None:
            yield from (_decided(row, row.reasons, False) for row in rows)
            return
        first = None
        for row in rows:                     # one pass, whatever their number
            if first is None or _turn(row) < _turn(first):
                row, first = first, row
            if row is not None:
                yield _decided(row, [REASON_DUPLICATE], True)
        if self.admitted.exists():
            yield _decided(first, [REASON_APPLIED], True)
        else:
            self.admitted.update((True,))
            yield _decided(first, [], True)

    def close(self) -> None:
        pass


def _turn(row) -> tuple:
    return (row.ts is not None, row.ts, row.request_id) if row.ts is not None else (False, row.request_id)


def _decided(row, reasons: list[str], settled: bool) -> Row:
    return Row(request_id=row.request_id, student_id=row.student_id, job_id=row.job_id, ts=row.ts, reasons=reasons,
               settled=settled)


def _repeats_marked(batch: DataFrame) -> DataFrame:
    """Of a micro-batch's requests for a pair that the rules refuse, the earliest has the reasons; the others repeat it."""
    refused = batch.where("NOT settled")
    turn = F.row_number().over(Window.partitionBy("student_id", "job_id").orderBy(F.col("ts").asc_nulls_first(), "request_id"))
    marked = refused.withColumn("_turn", turn).withColumn(
        "reasons", F.when(F.col("_turn") > 1, F.array(F.lit(REASON_DUPLICATE))).otherwise(F.col("reasons")))
    return batch.where("settled").unionByName(marked.drop("_turn")).drop("settled")


def stream_admission(spark: SparkSession, source_dir: str, T, out_dir: str, checkpoint: str,
                     as_of=DEFAULT_AS_OF, available_now: bool = True,
                     max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Admit application requests as they arrive, however late.

    Every request ends in exactly one output. Two keyed states in the checkpointed store remember what
    earlier epochs decided: the request ids seen (a repeated delivery is dropped) and the pairs of
    student and job with an admission. Rules are looked up by stream-static joins. A micro-batch
    reads nothing that earlier ones wrote but the highest id they gave, so its time does not grow with
    their number. New ids follow the order of the requests within an epoch.
    """
    requests = _source(spark, REQUEST_SCHEMA, source_dir, max_files_per_trigger).dropDuplicates(["request_id"])
    ruled = eligibility_pairs(T, requests, as_of, keep_unknown=True).select(
        "request_id", "student_id", "job_id", "ts",
        F.when((F.size("reasons") == 0) & F.col("already_applied"), F.array(F.lit(REASON_APPLIED)))
         .otherwise(F.col("reasons")).alias("reasons"))
    let_in = F.size("reasons") == 0
    keyed = (ruled.withColumn("_student", F.when(let_in, F.col("student_id")))
             .withColumn("_job", F.when(let_in, F.col("job_id")))
             .withColumn("_passing", F.when(~let_in, F.pmod(F.xxhash64("request_id"), F.lit(PASSING)))))
    decided = keyed.groupBy("_student", "_job", "_passing").transformWithState(
        _OnePerPair(), f"{REQUEST_SCHEMA}, reasons array<string>, settled boolean", "Append", "None")

    def per_batch(batch: DataFrame, epoch_id: int) -> None:
        path = f"{out_dir}/decided/epoch={epoch_id}"
        batch.write.mode("overwrite").parquet(path)          # the state advances once; all else reads this
        now = _repeats_marked(spark.read.parquet(path))
        before = (T.application.select("application_id") if epoch_id == 0
                  else spark.read.parquet(f"{out_dir}/highest/epoch={epoch_id - 1}"))
        accepted = fresh_ids(now.where(F.size("reasons") == 0), before, "application_id",
                             F.col("ts").asc_nulls_first(), "request_id")
        (accepted.select("application_id", "student_id", "job_id", F.lit(str(as_of)).cast("date").alias("application_date"),
                         F.lit("Applied").alias("status"), "request_id")
         .write.mode("overwrite").parquet(f"{out_dir}/accepted/epoch={epoch_id}"))
        (now.where(F.size("reasons") > 0).select("request_id", "student_id", "job_id", "reasons")
         .write.mode("overwrite").parquet(f"{out_dir}/rejected/epoch={epoch_id}"))
        (before.unionByName(accepted.select("application_id")).agg(F.max("application_id").alias("application_id"))
         .write.mode("overwrite").parquet(f"{out_dir}/highest/epoch={epoch_id}"))

    with _rocksdb_state(spark):
        return _start(decided, per_batch, checkpoint, available_now)


def admitted(spark: SparkSession, out_dir: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) over all epochs of a ``stream_admission`` run."""
    return (spark.read.parquet(f"{out_dir}/accepted").drop("epoch"),
            spark.read.parquet(f"{out_dir}/rejected").drop("epoch"))


def stream_status_latest(spark: SparkSession, source_dir: str, T, out_dir: str, checkpoint: str,
                         available_now: bool = True,
                         max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Keep the latest valid status change per application.

    Valid = status in the domain and the caller owns the job (stream-static
    join). The running max of (ts, change_id, status) per application is
    Spark's own streaming aggregation state (checkpointed state store); each
    micro-batch emits only the applications whose winner changed ("update"
    mode). They are merged into a bucketed snapshot (M3): only the buckets that hold one of them are
    written again, and the epoch's version names the new and the old folders.
    """
    owner = (T.application.select("application_id", "job_id")
             .join(T.job.select("job_id", F.col("company_id").alias("owner_id")), "job_id")
             .select("application_id", "owner_id"))
    changes = _source(spark, CHANGE_SCHEMA, source_dir, max_files_per_trigger)
    winners = (changes.where(F.col("status").isin(*APPLICATION_STATUSES))
               .join(owner, "application_id")
               .where(F.col("owner_id") == F.col("company_id"))
               .groupBy("application_id")
               .agg(F.max(F.struct("ts", "change_id", "status")).alias("w"))
               .select("application_id", F.col("w.ts").alias("ts"),
                       F.col("w.change_id").alias("change_id"), F.col("w.status").alias("status")))

    table = _statuses(spark, out_dir)
    if table.log.latest() == 0:
        table.create(T.application)

    def per_batch(batch: DataFrame, epoch_id: int) -> None:
        if table.log.latest() >= epoch_id + 2:               # a replay of an epoch that was published
            return
        path = f"{out_dir}/winners/epoch={epoch_id}"
        batch.write.mode("overwrite").parquet(path)
        table.update(spark.read.parquet(path), epoch_id + 1, lambda rows, winners: apply_updates(
            rows, winners, ["application_id"], ["status"], order=["ts", "change_id"]))

    return _start(winners, per_batch, checkpoint, available_now, mode="update")


def _statuses(spark: SparkSession, out_dir: str) -> BucketedTable:
    return BucketedTable(VersionLog(spark, f"{out_dir}/snapshot"), "application", "application_id")


def latest_status_snapshot(spark: SparkSession, out_dir: str, epoch: int | None = None) -> DataFrame:
    """Applications with the streamed winners applied, after the last epoch or after ``epoch``."""
    table = _statuses(spark, out_dir)
    return table.read(None if epoch is None else epoch + 2).select(
        "application_id", "student_id", "job_id", "application_date", "status")


def stage(df: DataFrame, path: str, files: int | None = None) -> str:
    """Write a derived request/change stream as parquet, in as many files as it has
    partitions (``files`` fixes the number in tests)."""
    (df.repartition(files) if files else df).write.mode("overwrite").parquet(path)
    return path
