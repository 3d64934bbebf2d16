"""Batch file intake, snapshot publishing, and stream twins == batch twins."""

from __future__ import annotations

import os

from pyspark.sql import functions as F
from pyspark.sql import types as T

from hireflow.operators import changes as M
from hireflow.operators import eligibility as E
from hireflow.session import shared_path
from hireflow.sources import snapshot as SN
from hireflow.sources.versions import VersionLog
from hireflow.streaming import jobs as ST


def _fresh(spark, name):
    import uuid
    return shared_path(spark, "tests", f"{name}-{uuid.uuid4().hex}")


def test_read_batch_keeps_malformed_lines_aside(spark, tmp_path):
    p = tmp_path / "skills.csv"
    p.write_text("student_id,skill_id,proficiency\n1,2,Beginner\n1,x,Advanced\n3,4\n")
    schema = T.StructType([T.StructField("student_id", T.LongType()),
                           T.StructField("skill_id", T.LongType()),
                           T.StructField("proficiency", T.StringType())])
    good, bad = SN.read_batch(spark, str(p), schema)
    assert [tuple(r) for r in good.collect()] == [(1, 2, "Beginner")]
    assert bad.count() == 2


def test_publish_is_all_or_nothing_per_batch(seed):
    spark = seed.spark
    out = _fresh(spark, "publish")
    target = SN.publish({"job": seed.job, "job_skill": seed.job_skill}, out, "b1")
    assert SN.read_published(spark, target, "job").count() == seed.job.count()
    assert os.path.exists(os.path.join(target, SN.COMMIT_MARKER)) or target.startswith("file:")


def test_status_stream_equals_batch_twin_over_many_epochs(seed):
    spark = seed.spark
    base = _fresh(spark, "status")
    # One change per file, newest first: later epochs bring older changes.
    src = f"{base}/source"
    sent = seed.status_change.orderBy(F.desc("ts"), F.desc("change_id")).collect()
    for i, row in enumerate(sent):
        spark.createDataFrame([row], seed.status_change.schema).write.parquet(f"{src}/part{i:04d}")
    files = f"{src}/*"
    q = ST.stream_status_latest(spark, files, seed, f"{base}/out", f"{base}/ckpt",
                                max_files_per_trigger=1)
    q.awaitTermination()
    log = VersionLog(spark, f"{base}/out/snapshot")
    epochs = log.latest() - 1
    assert epochs >= len(sent)
    # Files of one moment may come in any order; an epoch's winners say which changes it brought.
    came = [spark.read.parquet(f"{base}/out/winners/epoch={e}").select("change_id").collect() for e in range(epochs)]
    for epoch in sorted({0, min(1, epochs - 1), epochs - 1}):
        streamed = {r.application_id: r.status
                    for r in ST.latest_status_snapshot(spark, f"{base}/out", epoch).collect()}
        names = {r.change_id for rows in came[:epoch + 1] for r in rows}
        so_far = [r for r in sent if r.change_id in names] if epoch < epochs - 1 else sent
        batch = {r.application_id: r.status for r in M.scoped_status_update(
            seed.application, seed.job, spark.createDataFrame(so_far, seed.status_change.schema)).collect()}
        assert streamed == batch
    for version in range(2, epochs + 2):       # one change an epoch: at most one bucket is written again
        old, new = log.manifest(version - 1), log.manifest(version)
        assert set(old) == set(new) and sum(old[t] != new[t] for t in old) <= 1


def test_admission_stream_equals_batch_twin(seed):
    spark = seed.spark
    base = _fresh(spark, "admission")
    src = ST.stage(seed.application_request, f"{base}/source", files=2)
    ST.stream_admission(spark, src, seed, f"{base}/out", f"{base}/ckpt",
                        as_of="2026-10-01").awaitTermination()
    acc_s, rej_s = ST.admitted(spark, f"{base}/out")
    acc_b, rej_b = E.admit_applications(seed, seed.application_request, "2026-10-01")
    assert sorted(map(tuple, acc_s.collect())) == sorted(map(tuple, acc_b.collect()))
    assert (sorted((r.request_id, tuple(r.reasons)) for r in rej_s.collect())
            == sorted((r.request_id, tuple(r.reasons)) for r in rej_b.collect()))


def test_admission_stream_decides_late_and_repeated_requests_once(seed):
    """Four files, one per epoch: the second repeats requests, the last is years late."""
    spark = seed.spark
    base = _fresh(spark, "admission-late")
    ask = "request_id bigint, student_id bigint, job_id bigint, ts timestamp_ntz"
    r = [tuple(x) for x in seed.application_request.select("request_id", "student_id", "job_id", "ts").collect()]
    late = [(900001, *r[0][1:3], r[0][3].replace(year=2000)), (900002, -1, r[0][2], r[0][3].replace(year=2001))]
    for k, rows in enumerate((r, r[:2], late)):
        spark.createDataFrame(rows, ask).coalesce(1).write.parquet(f"{base}/source/part={k}")
    src = f"{base}/source/*"
    ST.stream_admission(spark, src, seed, f"{base}/out", f"{base}/ckpt", as_of="2026-10-01",
                        max_files_per_trigger=1).awaitTermination()
    acc, rej = ST.admitted(spark, f"{base}/out")
    got = sorted([x.request_id for x in acc.collect()] + [x.request_id for x in rej.collect()])
    assert got == sorted({x[0] for x in r} | {900001, 900002})
    ids = [x.application_id for x in acc.collect()] + [x.application_id for x in seed.application.collect()]
    assert len(ids) == len(set(ids))


def test_read_batches_of_two_formats_names_the_file_of_each_line(spark, tmp_path):
    (tmp_path / "a.csv").write_text("1,x\noops,y\n")
    (tmp_path / "b.json").write_text('{"id": 2, "name": "z"}\n{"id": "no"}\nnot json\n')
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType())])
    good, bad = SN.read_batches(spark, {"csv": str(tmp_path / "*.csv"), "json": str(tmp_path / "b.json")}, schema)
    assert sorted((r.id, r.name, r.source_format) for r in good.collect()) == [(1, "x", "csv"), (2, "z", "json")]
    lines = sorted((r.source_file.rsplit("/", 1)[1], r.raw) for r in bad.collect())
    assert lines == [("a.csv", "oops,y"), ("b.json", "not json"), ("b.json", '{"id": "no"}')]


def test_sketches_unite_upwards(spark):
    from hireflow.operators import sketches as SK
    rows = spark.range(60_000).selectExpr("id % 3 AS company_id", "id % 5 AS status", "id % 20000 AS student_id")
    fine = rows.groupBy("company_id", "status").agg(F.hll_sketch_agg("student_id", F.lit(SK.LOG_SIZE)).alias("applicants"))
    exact = {r.company_id: r.n for r in rows.groupBy("company_id").agg(F.countDistinct("student_id").alias("n")).collect()}
    for r in SK.united(fine, "company_id").collect():
        assert abs(r.estimate - exact[r.company_id]) <= SK.BOUND * exact[r.company_id]
